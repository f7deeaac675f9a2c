"""Line deduplication by an exact set-similarity join. Built-in functions only.

A line's tokens are its distinct runs of five words (one token for the whole of a shorter line). A line goes if an earlier
line, by document and place, has the same text or a token set of Jaccard similarity 0.8 or more. Tokens are ordered by
rarity; two such sets must share a token among their first few (prefix filter), at places that leave room for the overlap
(positional filter), and have like sizes (length filter); parities of the sets rule out most pairs that only share a
common passage. Every pair that passes is verified.

Within a group of lines that share a prefix token, all are first compared with the earliest. Only lines that this does not
remove meet the other earlier lines, so large groups of near copies cost a number of pairs in proportion to their size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bloom_filter, bloom_test, bloom_words, parted, possible, settle

WORDS = 5
#: Rarity is counted in so many hash buckets, whatever the size of the corpus; the order decides cost only, not results.
BUCKETS = 1 << 13
#: So many common tokens of a line before each are looked at, lest a pair be made again (cost only, not results).
BEFORE = 3
#: Words of 64 parities of a set by which pairs are ruled out before their sets are brought together (cost only); a power of two.
PARITIES = 8


def _words(line):
    plain = F.split(line, " ")
    return F.when(F.contains(F.concat(F.lit(" "), line, F.lit(" ")), F.lit("  ")), F.array_remove(plain, "")).otherwise(plain)


def _grade(rarity, word):
    return F.get(rarity, F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")).cast("long")


def _tokens(rarity, words):
    """Sorted long tokens of a line: rarity class in the top bits, then 56 bits of hash, so that the natural order is by rarity.

    Runs of five words; one token for a shorter line. A run counts as rare as its first word.
    """

    low = F.lit((1 << 56) - 1)

    def token(top, code):
        return top.bitwiseAND(F.lit(-1 << 56)).bitwiseOR(code.bitwiseAND(low))

    # Each word is hashed and graded once; a run is hashed from its five codes.
    codes = F.transform(words, lambda w: F.shiftleft(_grade(rarity, w), 56).bitwiseOR(F.xxhash64(w).bitwiseAND(low)))
    runs = F.transform(
        F.array(codes),
        lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - WORDS), lambda i: token(F.get(c, i), F.xxhash64(*[F.get(c, i + k) for k in range(WORDS)]))),
    )
    whole = F.array(F.shiftleft(_grade(rarity, F.get(words, F.lit(0))), 56).bitwiseOR(F.xxhash64(F.array_join(words, " ")).bitwiseAND(low)))
    return F.when(F.size(words) >= WORDS, F.sort_array(F.array_distinct(F.get(runs, F.lit(0))))).otherwise(whole)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, p, line) of all lines of rows with id and text."""
    known = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return known.select(F.col(doc_id).alias("d"), F.posexplode(F.split(text, "\n")).alias("p", "line")).where(F.trim("line") != "")


def _rarity(lines: DataFrame):
    """Count class of each hash bucket of words, over all lines, as an array literal of BUCKETS small numbers."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).count()
    grades = np.zeros(BUCKETS, np.int8)
    for b, g in counts.select("b", F.least(F.lit(127), F.floor(F.log2(F.col("count") + 1) * 4))).collect():
        grades[b] = g
    return F.lit(grades)


def _parity(tokens):
    """64 parities of the tokens by hash: two sets differ in at least as many tokens as their parities in bits."""
    # A shift takes the low six bits of its distance.
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(t))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))


def _parities(tokens: str) -> list:
    """PARITIES columns of 64 parities, by other bits of the hash: each token is in one of them."""
    word = lambda t: F.shiftright(F.hash(t), 6).bitwiseAND(F.lit(PARITIES - 1))
    of = lambda i: F.filter(tokens, lambda t: word(t) == i)
    return [_parity(of(i)).alias(f"m{i}") for i in range(PARITIES)]


def _prefix_size(n):
    return n - F.floor((4 * n + 4) / 5).cast("int") + 1


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.select("d", "p", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, near): (at) of the lines that repeat an earlier line's text, and (at) of the first occurrences that an earlier
    line of other text makes superfluous."""
    lines = _lines(docs, doc_id, text)
    rarity = _rarity(lines)
    # Lines that occur again, by hash: (h1, h2, first place). Lines of their own are not shuffled with what belongs to them.
    again = settle(_hashed(lines).drop("line").groupBy("h1", "h2").agg(F.min(F.struct("d", "p")).alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    n_words = bloom_words(again.count())
    repeated = bloom_test(bloom_filter(again.select(F.xxhash64("h1").alias("k")), "k", n_words), F.xxhash64("h1"), n_words)
    tokens = _hashed(lines).select("d", "p", "h1", "h2", _words(F.col("line")).alias("w")).select("d", "p", "h1", "h2", _tokens(rarity, F.col("w")).alias("t"))
    # Hashes of lines of their own are of no use from here on.
    tokens = tokens.withColumn("r", repeated)
    hashes = [F.when(F.col("r"), F.col(h)).alias(h) for h in ("h1", "h2")]
    heads = settle(tokens.select(F.struct("d", "p").alias("at"), *hashes, "r", F.size("t").alias("n"), _parity("t").alias("m"), F.slice("t", 1, _prefix_size(F.size("t"))).alias("head")))
    kept = ["at", "n", "m", "head"]
    first = settle(heads.where("r").join(again.withColumnRenamed("at", "at1"), ["h1", "h2"], "left").where("at1 is null or at = at1").select(kept)).union(heads.where("not r").select(kept))
    entries = first.select("at", "n", "m", F.posexplode("head").alias("i", "t"))
    # Tokens of one line only stay where they are: a Bloom filter of the others lets few of them through.
    common = settle(entries.groupBy("t").count().where("count > 1").select("t"))
    entries = possible(entries, "t", common, common.count())
    group = W.partitionBy("t").orderBy("at")
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shared = entries.withColumn("c", F.count(F.lit(1)).over(whole)).withColumn("head", F.first(F.struct("at", "n", "i", "m")).over(group)).where("c > 1")
    shared = settle(shared.select("t", "c", "at", "n", "i", "m", F.col("head.at").alias("at0"), F.col("head.n").alias("n0"), F.col("head.i").alias("i0"), F.col("head.m").alias("m0")))
    fits = "at0 < at and 5 * least(n, n0) >= 4 * greatest(n, n0) and 9 * least(n - i, n0 - i0) >= 4 * (n + n0) and 9 * bit_count(m ^ m0) <= n + n0"
    pairs = settle(shared.where(fits).select("at0", "at").distinct())
    removed = settle(_verified(docs, doc_id, text, pairs, rarity))
    # What is left meets every other earlier line of its groups; in a group of two it has. Two lines that have a common token
    # among the few just before have met there, with no less room for the overlap, so most pairs are made once and not for
    # each common token.
    before = F.collect_list("t").over(W.partitionBy("at").orderBy("i").rowsBetween(-BEFORE, -1))
    marked = settle(shared.where("c > 2").join(removed.withColumn("gone", F.lit(True)), "at", "left").withColumn("b", before))
    late = marked.where("gone is null and at0 < at").select("t", "at", "n", "i", "m", "b", F.col("at0").alias("leader"))
    others = marked.select("t", F.col("at").alias("at0"), F.col("n").alias("n0"), F.col("i").alias("i0"), F.col("m").alias("m0"), F.col("b").alias("b0"))
    met = late.join(others, "t").where("at0 <> leader").where(fits).where("not arrays_overlap(b, b0)")
    more = settle(met.select("at0", "at").distinct().join(pairs, ["at0", "at"], "left_anti"))
    near = settle(removed.union(_verified(docs, doc_id, text, more, rarity)).distinct())
    # Later copies go in any case; a line of its own goes by its place, as `near` has it.
    copies = heads.where("r").select(F.col("at").alias("here"), "h1", "h2").join(again, ["h1", "h2"]).where("here <> at").select(F.col("here").alias("at"))
    return copies, near


def _verified(docs: DataFrame, doc_id: str, text: str, pairs: DataFrame, rarity) -> DataFrame:
    """(at) of the later lines of pairs whose token sets are similar; token sets are made again for the lines concerned only."""
    concerned = settle(pairs.select(F.col("at").alias("l")).union(pairs.select("at0")).distinct())
    keys = concerned.select(F.col("l.d").alias(doc_id)).distinct()
    near = possible(docs.select(doc_id, text), doc_id, keys, concerned.count())
    lines = _lines(near, doc_id, text).select(F.struct("d", "p").alias("l"), "line").join(concerned, "l", "left_semi")
    sets = settle(lines.select("l", _words(F.col("line")).alias("w")).select("l", _tokens(rarity, F.col("w")).alias("s")).dropDuplicates(["l"]).select("l", "s", F.size("s").alias("n"), *_parities("s")))
    # Pairs are many and sets long: most pairs go by their parities, so that few carry sets from one shuffle to the next.
    bits = [f"m{i}" for i in range(PARITIES)]
    short = lambda end: sets.select(F.col("l").alias(f"at{end}"), F.col("n").alias(f"n{end}"), *[F.col(m).alias(f"{m}_{end}") for m in bits])
    differ = " + ".join(f"bit_count({m}_ ^ {m}_0)" for m in bits)
    pairs = settle(pairs.join(short(""), "at").join(short("0"), "at0").where(f"9 * ({differ}) <= n + n0").select("at0", "at"))
    both = pairs.join(sets.select(F.col("l").alias("at"), F.col("s").alias("x")), "at").join(sets.select(F.col("l").alias("at0"), F.col("s").alias("y")), "at0")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("at").distinct()


def superfluous_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, lines): the places, from 0 and in order, of the lines to remove from each document that has any.

    Blank lines and rows with null id or text have none. Rows that repeat an id count as one document if their text is
    the same; if not, the lines of each count at their places.
    """
    copies, near = similar_lines(docs, doc_id, text)
    gone = near.union(copies).select(F.col("at.d").alias(doc_id), F.col("at.p").alias("p"))
    # Dealt out as two numbers a row before they are gathered: partial sets would be many times as large.
    return gone.repartition(doc_id).groupBy(doc_id).agg(F.array_sort(F.collect_set("p")).alias("lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the superfluous lines cut from `text`; all columns and rows stay.

    A document that loses every line keeps an empty text. Null ids and texts pass unchanged.
    """
    gone = settle(superfluous_lines(docs, doc_id, text).withColumnRenamed("lines", "__gone"))
    # Only documents that may lose a line are dealt out.
    concerned, rest = parted(docs, doc_id, gone, gone.count())
    joined = concerned.join(gone, doc_id, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)).select(docs.columns).union(rest.select(docs.columns))
