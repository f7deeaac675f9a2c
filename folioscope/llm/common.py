"""Helpers that several corpus operators share: tables, settled results, Bloom pre-filters, components, word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settle, shared_dir  # noqa: F401

#: Largest number of 64-bit words in a Bloom filter sent to the executors (16 MB); a fuller filter only passes more rows on.
BLOOM_MAX_WORDS = 1 << 21
#: Bits of a key, all in one word, so that a test names the filter once and a task carries it once.
BLOOM_HASHES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bloom_place(key, n_words: int):
    """Index of the key's word and its bits. key: a long column of well mixed bits."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    bits = bit(0)
    for i in range(1, BLOOM_HASHES):
        bits = bits.bitwiseOR(bit(i))
    return F.pmod(F.shiftrightunsigned(key, 6 * BLOOM_HASHES), F.lit(n_words)).cast("int"), bits


def bloom_words(n_keys: int) -> int:
    """Words of a filter of about 16 bits a key, a power of two, within BLOOM_MAX_WORDS."""
    want = max(1024, n_keys * 16 // 64)
    return min(BLOOM_MAX_WORDS, 1 << (want - 1).bit_length())


def bloom_filter(keys: DataFrame, column: str, n_words: int):
    """Bloom filter, blocked by words, of a long column as one array column (a scalar subquery), at most n_words longs.

    Bits are merged on the map side, so a key that fills a third of the rows costs a row for each task.
    """
    word, bits = _bloom_place(F.col(column), n_words)
    filled = keys.where(F.col(column).isNotNull()).groupBy(word.alias("w")).agg(F.bit_or(bits).alias("m"))
    dense = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("w")).join(filled, "w", "left")
    packed = dense.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m")))).alias("a"))
    return packed.select(F.col("a.m").alias("bits")).scalar()


def bloom_test(bits, key, n_words: int):
    """True where all bits of key are set."""
    word, mask = _bloom_place(key, n_words)
    return F.get(bits, word).bitwiseAND(mask) == mask


def possible(df: DataFrame, column: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of df whose long column may occur in keys (same column name), for an exact join to follow; moves no row of df."""
    n_words = bloom_words(n_keys)
    mixed = keys.select(F.xxhash64(column).alias("bloom_key"))
    return df.where(F.col(column).isNotNull() & bloom_test(bloom_filter(mixed, "bloom_key", n_words), F.xxhash64(column), n_words))


def parted(df: DataFrame, column: str, keys: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose long column may occur in keys, all others): the others need not move for a join with keys."""
    n_words = bloom_words(n_keys)
    mixed = keys.select(F.xxhash64(column).alias("bloom_key"))
    may = F.col(column).isNotNull() & bloom_test(bloom_filter(mixed, "bloom_key", n_words), F.xxhash64(column), n_words)
    return df.where(may), df.where(~may)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b: long): rows (node, root), root being the least node of its component.

    Alternates large-star and small-star rounds; each groups with map-side minimums and joins them back, settled in the
    shared folder. A star's centre is one row on one side of that join; the other side may be split. Ends when a round changes nothing; raises if that takes more than `rounds`, rather than return part.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = digest(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: neighbours above a node move to the node's least neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lower neighbours move to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = settle(small.where("a <> b").distinct())
        if (new := digest(after)) == was:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, was = after, new
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def digest(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table: two numbers, whatever its size."""
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1]


# ---------------------------------------------------------------- word hashes in numpy, inside tasks

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORDS_AT_ONCE = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, BASE_INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[i] = np.cumprod(run, dtype=np.uint64)
    return _powers


def shingle_hashes(words: list[str], k: int) -> np.ndarray:
    """uint64 hash of each run of k words; of all words where there are fewer; empty for no word.

    A polynomial hash over the UTF-8 bytes of the words joined by spaces, by prefix sums, so its cost is that of the bytes.
    Long lists go block by block; blocks overlap by k - 1 words.
    """
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    parts = []
    for at in range(0, len(words) - k + 1, WORDS_AT_ONCE):
        data = np.frombuffer(" ".join(words[at : at + WORDS_AT_ONCE + k - 1]).encode("utf-8", "replace"), np.uint8)
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        n = len(starts) - k + 1
        parts.append(mix((sums[ends[k - 1 :]] - sums[starts[:n]]) * inverse[starts[:n]]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
