"""Main content of a page: elements as intervals of its segments, measured by running sums, the best one chosen.

A page is cut into tags and text. An element of a kind ends where that kind's level falls below its own: open and close tags of
one kind and level alternate, so a tag's partner is the next of its kind and level. Unclosed elements reach to the page's end, and
close tags without an open one change nothing. Text, and text in links, inside of an element is the difference of two running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .pages import ENTITIES

#: Least characters of a dense element, greatest share of link text in it, least characters of a usable content.
DENSE, LINKS, USABLE = 200, 0.5, 120
#: Elements that are measured, whose text is not content, and that end a line.
CONTAINERS = ["main", "article", "div", "section", "body"]
ASIDE = ["nav", "header", "footer", "aside", "form"]
LINES = ["p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "body", "blockquote", "pre"]
_DROPPED = r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|$)"
_SEGMENT = r"(?s)<[/!?A-Za-z][^>]*>|[^<]+|<"


def _read(text: Column) -> Column:
    for entity, to in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(to))
    return text


def segments(pages: DataFrame) -> DataFrame:
    """(page_id, i, tag, closes, text): a page's tags (lower-case name; null for text) and texts in order.

    Comments, head, scripts and the like are left out first, to the page's end where they are not closed. Tags that close
    themselves count as text without characters.
    """
    bare = F.regexp_replace("html", _DROPPED, "")
    s = pages.select("page_id", F.posexplode(F.regexp_extract_all(bare, F.lit(_SEGMENT), F.lit(0))).alias("i", "s"))
    name = F.nullif(F.lower(F.regexp_extract("s", r"^</?([A-Za-z][A-Za-z0-9]*)[^>]*>$", 1)), F.lit(""))
    own = F.col("s").rlike(r"^<[/!?A-Za-z][^>]*>$")
    return s.select("page_id", "i", name.alias("tag"), F.startswith("s", F.lit("</")).alias("closes"), F.when(own, "").otherwise(_read(F.col("s"))).alias("text"), F.endswith("s", F.lit("/>")).alias("alone"))


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, tag, start, finish, chars, links): each element of CONTAINERS, its first and last segment, its characters that are
    no white space and lie in no element of ASIDE, and those of them in links."""
    return _measured(pages)[1]


def _measured(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    order = W.partitionBy("page_id").orderBy("i")
    s = segments(pages)
    for column, names in (("in_link", ["a"]), ("in_aside", ASIDE)):
        step = F.when(F.col("tag").isin(names) & ~F.col("alone"), F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
        s = s.withColumn("__sum", F.sum(step).over(order))
        # Less what was closed without being open: the level is counted from the lowest point so far.
        s = s.withColumn(column, F.col("__sum") - F.least(F.min("__sum").over(order), F.lit(0)) > 0).drop("__sum")
    size = F.when(~F.col("in_aside"), F.length(F.regexp_replace("text", r"[\s ]", ""))).otherwise(0)
    s = s.withColumn("size", size).withColumns({"c": F.sum("size").over(order), "l": F.sum(F.when(F.col("in_link"), F.col("size")).otherwise(0)).over(order)})
    last = F.max("i").over(W.partitionBy("page_id"))
    ends = s.withColumns({"last": last, "c_all": F.max("c").over(W.partitionBy("page_id")), "l_all": F.max("l").over(W.partitionBy("page_id"))})
    tags = ends.where(F.col("tag").isin(CONTAINERS) & ~F.col("alone"))
    kind = W.partitionBy("page_id", "tag").orderBy("i")
    tags = tags.withColumn("sum", F.sum(F.when(F.col("closes"), -1).otherwise(1)).over(kind))
    tags = tags.withColumn("level", F.when(F.col("closes"), F.col("sum") + 1).otherwise(F.col("sum")))
    partner = W.partitionBy("page_id", "tag", "level").orderBy("i")
    tags = tags.withColumns({f"{x}_": F.lead(x).over(partner) for x in ("i", "c", "l")})
    found = tags.where(~F.col("closes")).select("page_id", "tag", F.col("i").alias("start"), F.coalesce("i_", "last").alias("finish"), (F.coalesce("c_", "c_all") - F.col("c")).alias("chars"), (F.coalesce("l_", "l_all") - F.col("l")).alias("links"))
    return s, found


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, container, tag, chars, link_share, outcome, text) for every page.

    container: `main_or_article` (the one with most characters, main before article), else `density` (the div or section with
    most characters, of at least DENSE, and at most LINKS of them in links; the outer and earlier of equal ones), else `body`,
    else `page`. outcome: `ready`, `short` (under USABLE characters) or `empty`. Text lies outside of ASIDE; elements of LINES end
    a line; white space is collapsed. A null page is empty.
    """
    s, found = _measured(pages)
    share = F.when(F.col("chars") > 0, F.col("links") / F.col("chars")).otherwise(0.0)
    dense = F.col("tag").isin("div", "section") & (F.col("chars") >= DENSE) & (share <= LINKS)
    kind = F.when(F.col("tag").isin("main", "article"), 3).when(dense, 2).when(F.col("tag") == "body", 1)
    ranked = found.withColumns({"kind": kind, "share": share}).where("kind is not null")
    best = ranked.groupBy("page_id").agg(F.max(F.struct("kind", "chars", (F.col("tag") == "main").alias("main"), (-F.col("share")).alias("less"), (-F.col("start")).alias("s"), "finish", "tag", "share")).alias("b"))
    chosen = s.join(best, "page_id", "left").where(F.col("b").isNull() | F.col("i").between(-F.col("b.s"), F.col("b.finish")))
    piece = F.when(F.col("tag").isin(LINES), "\n").when(F.col("in_aside"), "").otherwise(F.regexp_replace("text", r"[\s ]+", " "))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("t")))), lambda x: x["t"]), "")
    text = F.trim(F.regexp_replace(F.regexp_replace(joined, " +", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    body = chosen.groupBy("page_id").agg(text.alias("text"), F.first("b").alias("b"), F.sum("size").alias("size"))
    out = pages.select("page_id").join(body, "page_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    chars = F.coalesce("b.chars", "size", F.lit(0).cast("long"))
    container = F.when(F.col("b.kind") == 3, "main_or_article").when(F.col("b.kind") == 2, "density").when(F.col("b.kind") == 1, "body").otherwise("page")
    return out.select("page_id", container.alias("container"), F.col("b.tag").alias("tag"), chars.alias("chars"), F.round("b.share", 4).alias("link_share"), F.when(F.col("text") == "", "empty").when(chars < USABLE, "short").otherwise("ready").alias("outcome"), "text")
