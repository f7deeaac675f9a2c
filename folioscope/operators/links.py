"""Links without an exact match: stable pair keys, inline identifiers, and ranked candidates for orphans and uncited entries."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from ..functions.forms import collapsed, marker_context

#: Weights of name and year, year terms (same, one apart, other), least scores, and how many are shown.
NAME, YEAR = 0.7, 0.3
SAME_YEAR, NEAR_YEAR, OTHER_YEAR = 1.0, 0.6, 0.2
LEAST_ORPHAN, LEAST_UNCITED, TOP_ORPHAN, TOP_UNCITED = 0.5, 0.72, 5, 3


#: Strings of more characters than this are compared one pair at a time.
SHORT = 48


def _characters(strings: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters by place and string, lengths) of strings of `width` characters at most."""
    n = np.fromiter(map(len, strings), np.int32, len(strings))
    c = np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width).T.copy()
    c[np.arange(width)[:, None] >= n] = pad
    return c, n


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher(None, x, y).ratio() of each pair of short strings: the longest common block, then what lies left and right of it.

    All pairs take a step at once; of blocks of one length the first in x counts, then the first in y, as there.
    """
    width = max(1, max(map(len, a), default=0), max(map(len, b), default=0))
    (x, nx), (y, ny) = _characters(a, width, 0x110000), _characters(b, width, 0x110001)
    matched, who = np.zeros(len(a), np.int32), np.arange(len(a))
    xlo, xhi, ylo, yhi = np.zeros_like(nx), nx, np.zeros_like(ny), ny
    while True:
        open_ = np.flatnonzero((xlo < xhi) & (ylo < yhi))
        if not len(open_):
            break
        who, xlo, xhi, ylo, yhi = who[open_], xlo[open_], xhi[open_], ylo[open_], yhi[open_]
        # The segments, moved to the start; what lies beyond them equals nothing.
        i, j = np.arange((xhi - xlo).max())[:, None], np.arange((yhi - ylo).max())[:, None]
        s = np.where(i < xhi - xlo, x[np.minimum(xlo + i, width - 1), who], 0x110000)
        t = np.where(j < yhi - ylo, y[np.minimum(ylo + j, width - 1), who], 0x110001)
        best, run = np.zeros(len(who), np.int32), np.zeros((len(j) + 1, len(who)), np.int16)
        first = np.zeros((2, len(who)), np.int32)
        places = (width - j).astype(np.int16)
        for end in range(len(i)):
            run[1:] = (run[:-1] + 1) * (s[end] == t)
            # The longest run, and of equal ones the first: its length and place as one number.
            top = ((run[1:] * (width + 1) + places) * (run[1:] > 0)).max(axis=0)
            size = top // (width + 1)
            more = size > best
            best[more] = size[more]
            first[0, more], first[1, more] = end - size[more] + 1, (width - top % (width + 1) - size + 1)[more]
        np.add.at(matched, who, best)
        some = best > 0
        who, best, first, xlo, xhi, ylo, yhi = who[some], best[some], first[:, some], xlo[some], xhi[some], ylo[some], yhi[some]
        who, xlo, xhi, ylo, yhi = np.tile(who, 2), np.concatenate((xlo, xlo + first[0] + best)), np.concatenate((xlo + first[0], xhi)), np.concatenate((ylo, ylo + first[1] + best)), np.concatenate((ylo + first[1], yhi))
    total = nx + ny
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters (2 M / T), without regard to case; the short pairs of a batch are compared together."""
    x, y = a.fillna("").str.lower().tolist(), b.fillna("").str.lower().tolist()
    short = [max(len(s), len(t)) <= SHORT for s, t in zip(x, y, strict=True)]
    out = np.zeros(len(x))
    out[short] = ratios([s for s, k in zip(x, short, strict=True) if k], [t for t, k in zip(y, short, strict=True) if k])
    seen: dict[tuple[str, str], float] = {}
    for i in np.flatnonzero(~np.array(short, bool)):
        pair = x[i], y[i]
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, *pair).ratio()
        out[i] = seen[pair]
    return pd.Series(out)


#: Said to be nondeterministic: else a filter on the score is pushed below it and all pairs are compared a second time.
similarity = similarity.asNondeterministic()


def orphan_candidates(orphans: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, surname, year, ref_number, score, rank): references of the same document most like an orphan, best first.

    Orphans (doc_id, surname, year) meet references (doc_id, ref_number, surname, year) by document only; of equal scores the
    lower number comes first. Orphans without a candidate have no row.
    """
    r = references.select("doc_id", "ref_number", F.col("surname").alias("name"), F.col("year").alias("printed"))
    term = F.when(F.col("printed").eqNullSafe(F.col("year")), SAME_YEAR).when(F.abs(F.col("printed") - F.col("year")) <= 1, NEAR_YEAR).otherwise(OTHER_YEAR)
    scored = orphans.join(r, "doc_id").withColumn("score", F.round(NAME * similarity("surname", "name") + YEAR * term, 3)).where(F.col("score") >= LEAST_ORPHAN)
    w = W.partitionBy("doc_id", "surname", "year").orderBy(F.desc("score"), "ref_number")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_ORPHAN).select("doc_id", "surname", "year", "ref_number", "score", "rank")


def uncited_candidates(uncited: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, ref_number, claim_id, score, rank): claims of the document with a word like an uncited entry's surname.

    Each claim counts by its nearest word; distinct words are compared once for each entry.
    """
    words = claims.select("doc_id", "claim_id", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"[\p{L}#0-9]{3,}"), F.lit(0)))).alias("word"))
    named = uncited.where(F.length("surname") >= 3).select("doc_id", "ref_number", "surname")
    scored = words.join(named, "doc_id").withColumn("s", similarity("surname", "word")).groupBy("doc_id", "ref_number", "claim_id").agg(F.round(F.max("s"), 3).alias("score")).where(F.col("score") >= LEAST_UNCITED)
    w = W.partitionBy("doc_id", "ref_number").orderBy(F.desc("score"), "claim_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_UNCITED)


def inline_identifiers(sentence: Column) -> Column:
    """Lower-case DOIs and arXiv ids inside parentheses, without marks at the end."""
    groups = F.regexp_extract_all(sentence, F.lit(r"\(([^()]*)\)"), F.lit(1))
    found = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(?i)10\.[0-9]{4,9}/[^\s;,)]+|arxiv:\s*[0-9]{4}\.[0-9]{4,5}"), F.lit(0))))
    return F.transform(found, lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"\s", "")), r"[.,;)\]}]+$", ""))


def inline_links(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, edges) of identifiers that sentences print: each document's distinct ones, numbered by first use (by claim id
    and place), and (doc_id, claim_id, ref_number) for every use."""
    # Dealt out by document once, before sentences are read: all that follows stays where it is. Claims that repeat change nothing.
    uses = claims.select("doc_id", "claim_id", "sentence").repartition("doc_id").select("doc_id", "claim_id", F.posexplode(inline_identifiers(F.col("sentence"))).alias("at", "identifier"))
    by_use = W.partitionBy("doc_id", "identifier").orderBy("claim_id", "at")
    uses = uses.withColumn("use", F.row_number().over(by_use))
    references = uses.where("use = 1").withColumn("ref_number", F.row_number().over(W.partitionBy("doc_id").orderBy("claim_id", "at", "identifier"))).select("doc_id", "identifier", "ref_number")
    # The first use goes with each, in the same order; of a claim's uses of one identifier the first stays.
    again = W.partitionBy("doc_id", "identifier", "claim_id").orderBy("at")
    edges = uses.where("doc_id is not null").withColumn("first", F.first(F.struct("claim_id", "at")).over(by_use)).withColumn("k", F.row_number().over(again)).where("k = 1")
    edges = edges.withColumn("ref_number", F.dense_rank().over(W.partitionBy("doc_id").orderBy("first", "identifier")))
    return references, edges.select("doc_id", "claim_id", "ref_number")


def reference_identity(entry: Column, surname: Column, year: Column, title: Column, doi: Column) -> Column:
    """The first stable identity: the entry as printed, else surname, year and title, else the DOI; null without any."""
    low = lambda c: F.lower(collapsed(F.coalesce(c.cast("string"), F.lit(""))))
    parts = F.concat_ws("|", low(surname), low(year), F.lit(""), low(title))
    return F.when(low(entry) != "", F.concat(F.lit("entry:"), low(entry))).when(parts != "|||", F.concat(F.lit("identity:"), parts)).when(low(doi) != "", F.concat(F.lit("doi:"), low(doi)))


def pair_keys(rows: DataFrame, manuscript: Column) -> DataFrame:
    """rows with `key`: S and the first 24 digits of a SHA-256 over manuscript, reference identity, marker, sentence and marker
    context; rows that share a key are told apart by `@n`, in order of `ordinal`. rows: (identity, marker, sentence, ordinal)."""
    digest = F.sha2(F.concat_ws("\x1f", manuscript, F.col("identity"), collapsed(F.col("marker")), F.col("__s"), marker_context(F.col("__s"), F.col("marker"))), 256)
    keyed = rows.withColumn("__s", collapsed(F.col("sentence"))).withColumn("base", F.concat(F.lit("S"), F.substring(digest, 1, 24))).drop("__s")
    same = W.partitionBy("base")
    numbered = keyed.withColumn("n", F.row_number().over(same.orderBy("ordinal"))).withColumn("all", F.count(F.lit(1)).over(same))
    return numbered.withColumn("key", F.when(F.col("all") > 1, F.concat_ws("@", "base", F.col("n").cast("string"))).otherwise(F.col("base"))).drop("base", "n", "all")
