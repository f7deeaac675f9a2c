"""Citation links, coverage and matching of bibliographic records, on relations of claims and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import topic_tokens


def constructed(orders: DataFrame, lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, references): one manuscript an order. Each of its lines makes a claim, and each line number a reference.

    A claim cites its own line's reference; where the part's number is divisible by five, one that does not exist.

    claims (doc_id, claim_id, sentence); references (doc_id, ref_number, entry, title, surname, year).
    """
    named = lineitem.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cited = F.col("l_linenumber") + F.when(F.col("l_partkey") % 5 == 0, 7).otherwise(0)
    claims = named.select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"),
        F.concat(F.lit("Claim on "), "p_name", F.lit(" ["), cited, F.lit("].")).alias("sentence"))
    one = named.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "p_name")).alias("x"))
    refs = one.join(supplier.select("s_suppkey", "s_name"), F.col("x.l_suppkey") == F.col("s_suppkey")).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    entry = F.concat(F.lit("["), "l_linenumber", F.lit("] "), "s_name", F.lit(". "), "x.p_name", F.lit(". "), F.year("o_orderdate"), F.lit("."))
    return claims, refs.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ref_number"), entry.alias("entry"), F.col("x.p_name").alias("title"), F.col("s_name").alias("surname"), F.year("o_orderdate").alias("year"))


def markers(claims: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, claim_id, ref_number): each number in square brackets of a claim's sentence; `kept` columns of the claim stay."""
    found = F.regexp_extract_all("sentence", F.lit(r"\[(\d+)\]"), F.lit(1))
    return claims.select("doc_id", "claim_id", *kept, F.explode(found.cast("array<int>")).alias("ref_number"))


def numeric_links(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, claims, linked, orphans): markers of each document with and without a reference of that number."""
    m = markers(claims).join(refs.select("doc_id", "ref_number", F.lit(1).alias("hit")), ["doc_id", "ref_number"], "left")
    return m.groupBy("doc_id").agg(F.countDistinct("claim_id").alias("claims"), F.count("hit").alias("linked"), F.count_if(F.col("hit").isNull()).alias("orphans"))


def uncited(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, ref_number) of references that no claim cites."""
    return refs.join(markers(claims), ["doc_id", "ref_number"], "left_anti").select("doc_id", "ref_number")


def coverage(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, total, cited, pct, verdict) for documents with references; verdict by the share cited."""
    cited = markers(claims).select("doc_id", "ref_number", F.lit(1).alias("hit")).distinct()
    x = refs.join(cited, ["doc_id", "ref_number"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("cited"))
    pct = F.round(100.0 * F.col("cited") / F.col("total"), 2)
    return x.select("doc_id", "total", "cited", pct.alias("pct"), F.when(pct >= 75, "healthy").when(pct >= 34, "partial").otherwise("poor").alias("verdict"))


def title_overlap(pairs: DataFrame, title: str, entry: str) -> DataFrame:
    """pairs with `overlap`, the share of the title's distinct topic tokens that the entry has (3 places), and `flag`."""
    t, share = F.col("__t"), F.col("overlap")
    pairs = pairs.withColumn("__t", F.array_distinct(topic_tokens(F.col(title))))
    pairs = pairs.withColumn("overlap", F.when(F.size(t) > 0, F.round(F.size(F.array_intersect(t, topic_tokens(F.col(entry)))) / F.size(t), 3))).drop("__t")
    return pairs.withColumn("flag", F.when(share < 0.2, "mismatch").when(share < 0.5, "warn"))


def edit_one_pairs(names: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b): pairs of keys, a < b, whose names are within one edit.

    Two such names share a variant with one character left out (or are equal): an equality join on variants, then
    `levenshtein` verifies. Variants grow with a name's length, pairs with the true matches, not with the table's square.
    """
    n = names.select(F.col(key).alias("k"), F.lower(F.col(name)).alias("n"))
    cuts = F.transform(F.sequence(F.lit(0), F.length("n")), lambda i: F.concat(F.substring(F.col("n"), F.lit(1), i), F.substring(F.col("n"), i + 2, F.length("n"))))
    v = n.select("k", "n", F.explode(F.array_distinct(cuts)).alias("v"))
    both = v.join(v.select(F.col("k").alias("k2"), F.col("n").alias("n2"), "v"), "v").where("k < k2").select("k", "n", "k2", "n2").distinct()
    return both.where(F.levenshtein("n", "n2") <= 1).select(F.col("k").alias("a"), F.col("k2").alias("b"))


def author_year_status(mentions: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, surname, year, matches, status): unique, ambiguous or orphan mentions by surname and year within a document."""
    key = ["doc_id", "surname", "year"]
    # Counted together, so nothing is sorted or held for a join; an entry or mention without one of these matches nothing.
    known = F.col("doc_id").isNotNull() & F.col("surname").isNotNull() & F.col("year").isNotNull()
    both = mentions.select(*key, F.lit(1).alias("m"), F.lit(0).alias("n")).unionByName(refs.where(known).select(*key, F.lit(0).alias("m"), F.lit(1).alias("n")))
    x = both.groupBy(*key).agg(F.sum("m").alias("m"), F.sum("n").alias("n")).where("m > 0")
    # A mention that repeats has a row each time.
    x = x.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return x.select("doc_id", "surname", "year", F.col("n").alias("matches"), F.when(F.col("n") == 0, "orphan").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"))
