"""URL filtering: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter passes rows that may be listed; only those meet the exact join, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_test, bloom_words

#: Fixed values: (host, path prefix, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Query parameters that never tell pages apart, as a pattern over one parameter.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Columns (host, path). Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#`
    or the end. Null or no `://`: both empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url):
    """Canonical form of a URL column: no scheme, lower-case host without `www.`, no fragment, no `.html`, no trailing slash,
    no tracking parameters, the others in order. Null or no `://`: null."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(F.locate("://", url) > 0, F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", ""), tail))


def matching_rule(host, path, rules=RULES):
    """Struct (rule, verdict) of the longest rule that fits, by host and then path length; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(found)
    return found


def filter_urls(df: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of df.

    Verdict: the longest fitting rule's; else `block` if the canonical URL is that of a row of `listed`, else `allow`.
    Null URLs and those without `://` have empty host and path and are allowed. Repeated rows stay. Namesakes of the added
    columns are replaced. Only rows without a rule that pass the Bloom filter are shuffled, to the exact join.
    """
    host, path = host_and_path(F.col(url))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    judged = df.select(*kept, host.alias("host"), path.alias("path"))
    judged = judged.withColumn("__m", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("__c", canonical(F.col(url)))
    keys = listed.select(canonical(F.col(listed_url)).alias("__c")).where("__c is not null").distinct()
    n_words = bloom_words(keys.count())
    bits = bloom_filter(keys.select(F.xxhash64("__c").alias("k")), "k", n_words)
    judged = judged.withColumn("__p", F.col("__m").isNull() & F.col("__c").isNotNull() & bloom_test(bits, F.xxhash64("__c"), n_words))
    final = [*kept, "host", "path", F.col("__m.rule").alias("rule")]
    sure = judged.where("not __p").select(*final, F.coalesce("__m.verdict", F.lit("allow")).alias("verdict"))
    # The exact join; a hot URL's rows are only on the streamed side, which may be split.
    hits = judged.where("__p").join(keys.withColumn("__hit", F.lit(True)), "__c", "left")
    return sure.unionByName(hits.select(*final, F.when(F.col("__hit"), "block").otherwise("allow").alias("verdict")))
