"""Web pages: visible text, title, meta values, links, canonical keys. Built-in functions; pages stay in their partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|title)[^>]*>"
#: The named entities of plain prose.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def visible_text(html, entities=ENTITIES):
    """Text without scripts, styles, comments and tags; block tags end lines; basic entities read; white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, _BLOCK, "\n"), r"<[^>]*>", " ")
    for entity, to in entities:
        text = F.replace(text, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def title(html):
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def hrefs(html):
    """Distinct targets of anchors without their fragments, in order of first use; empty ones go."""
    raw = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return F.filter(F.array_distinct(F.transform(raw, lambda u: F.substring_index(u, "#", 1))), lambda u: u != "")


def page_profile(pages: DataFrame) -> DataFrame:
    """(page_id, title, charset, links, first_link, headings, chars)."""
    links = hrefs(F.col("html"))
    return pages.select(
        "page_id", title(F.col("html")).alias("title"), F.regexp_extract("html", r'(?i)<meta\s[^>]*charset="?([A-Za-z0-9_-]+)', 1).alias("charset"),
        F.size(links).alias("links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"),
        F.regexp_count("html", F.lit(r"(?i)<h[1-6][ >]")).alias("headings"), F.length(visible_text(F.col("html"))).alias("chars"))


def link_targets(pages: DataFrame) -> DataFrame:
    """(target, pages): in how many pages each link target occurs; counted on the map side first."""
    return pages.select(F.explode(hrefs(F.col("html"))).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("pages"))


def url_key(url):
    """Canonical key: lower-case host without `www.` and default port, path without a slash at the end, query kept, no fragment."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.concat(host, path, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))


def url_groups(pages: DataFrame) -> DataFrame:
    """(url_key, pages, first_id, kind) of keys: how many pages have it and whether it names a file."""
    k = pages.select("page_id", url_key(F.col("url")).alias("url_key"))
    return k.groupBy("url_key").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_id")).withColumn("kind", F.when(F.col("url_key").rlike(r"\.(html?|pdf)(\?|$)"), "file").otherwise("landing"))
