"""Hard-negative mining: for an anchor's best positives, the best rows of other labels that score nearly as high.

All rows are scored against blocks of anchors, a block of bounded bytes at a time. A first scan finds each anchor's
positives: a task keeps its best few for each anchor, a window keeps those of all. A second scan, which knows the positives,
keeps in each task for each positive the best few rows of its window of scores; no other row of that task can be among
those returned. What is kept, positives too, is packed into keys (anchor, falling score, positives first, id) that compare
byte by byte, and dealt out by anchor, sorted inside of partitions by the shuffle. An iterator over the sorted keys opens a window at
each positive and gives out the negatives that follow, holding at most the open windows of one anchor.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shared_dir
from .vectors import matrix, sound

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores from LOW / 100 of its positive's score up to that score.
LOW = 80
#: Bytes of the anchors that are sent out at once, and scores that a task holds at once.
BLOCK_BYTES, SCORES = 16 << 20, 1 << 21
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53
_KEY = struct.Struct(">QQBQ")
_TOP = 1 << 63
_MASK = (1 << 64) - 1


def pack(anchor: int, score: int, negative: int, row: int) -> bytes:
    """A key whose byte order is: anchor, falling score, positives before negatives, id."""
    return _KEY.pack(anchor + _TOP, _TOP - 1 - score, negative, row + _TOP)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, negative, row = _KEY.unpack(key)
    return anchor - _TOP, _TOP - 1 - score, negative, row - _TOP


def packed(anchor: np.ndarray, score: np.ndarray, negative: int, row: np.ndarray) -> list[bytes]:
    out = np.empty(len(anchor), [("a", ">u8"), ("s", ">u8"), ("k", "u1"), ("r", ">u8")])
    out["a"], out["r"] = anchor.view(np.uint64) ^ np.uint64(_TOP), row.view(np.uint64) ^ np.uint64(_TOP)
    out["s"], out["k"] = ~(score.view(np.uint64) ^ np.uint64(_TOP)), negative
    data, size = out.tobytes(), out.dtype.itemsize
    return [data[i : i + size] for i in range(0, len(data), size)]


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE v) as doubles that hold whole numbers."""
    return np.floor(v * SCALE)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (anchors x rows) as int64; raises if one might not fit a long."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, anchors.shape[1])
    if bound < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    if bound < 2.0**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    raise ArithmeticError("inner products of these vectors exceed a long")


def firsts(slot: np.ndarray, score: np.ndarray, row: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the first `keep` of each slot, by falling score, then id."""
    order = np.lexsort((row, -score, slot))
    s = slot[order]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), np.arange(len(s)), 0)) if len(s) else s
    return order[np.arange(len(s)) - start < keep]


class Best:
    """The first few (score, id) of each slot so far."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.row = (np.empty(0, np.int64) for _ in range(3))
        #: What a score must reach to be kept, where a slot is full.
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        slot, score, row = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.row, row))
        at = firsts(slot, score, row, self.keep)
        self.slot, self.score, self.row = slot[at], score[at], row[at]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.floor)) == self.keep)
        least = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(least, self.slot, self.score)
        self.floor[full] = least[full]


def prepared(df: DataFrame, label: Column | str = "label", column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Rows that take part: vec_id, label, v. Of rows with one id the least by label and vector; rows without an id, label or sound vector go."""
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("v"), sound(column).alias("ok"))
    rows = rows.where("ok and vec_id is not null and label is not null")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def mine(rows: DataFrame, anchors: Column, block_bytes: int | None = None) -> DataFrame:
    """rows (of `prepared`), anchors (a condition over vec_id) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are compared with those of their own length only. Equal scores go by id. Anchors without a positive, and
    positives without a row in their window, give no rows; so does an empty table.
    """
    spark, rows = rows.sparkSession, settle(rows)
    base = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for (width,) in sorted(rows.select(F.size("v")).distinct().collect()):
        same = rows.where(F.size("v") == width)
        chosen = same.where(anchors)
        n = chosen.count()
        blocks = max(1, -(-n * (width + 2) * 8 // (block_bytes or BLOCK_BYTES)))
        for b in range(blocks if n else 0):
            found = _block(same, chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), width, schema)
            if found is not None:
                paths.append(f"{base}/{width}-{b}")
                found.write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _block(rows: DataFrame, anchors: DataFrame, width: int, schema: str) -> DataFrame | None:
    spark = rows.sparkSession
    table = anchors.orderBy("vec_id").toArrow()
    if not table.num_rows:
        return None
    ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
    sent = spark.sparkContext.broadcast((ids, labels, whole(matrix(table["v"].combine_chunks(), width))))
    at_once = max(1, SCORES // len(ids))

    def scored(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                yield part.column(0).to_numpy(), part.column(1).to_numpy(), scores(sent.value[2], whole(matrix(part.column(2), width)))

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, _ = sent.value
        best = Best(len(ids), POSITIVES)
        for row, label, score in scored(batches):
            a, r = np.nonzero((labels[:, None] == label) & (ids[:, None] != row) & (score >= best.floor[:, None]))
            best.add(a, score[a, r], row[r])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.row)], ["a", "score", "row"])

    order = Window.partitionBy("a").orderBy(F.desc("score"), "row")
    near = rows.select("vec_id", "label", "v").mapInArrow(positives, "a long, score long, row long")
    top = near.withColumn("i", F.row_number().over(order)).where(F.col("i") <= POSITIVES).toArrow()
    a, i, score, row = (top[c].to_numpy() for c in ("a", "i", "score", "row"))
    limits = np.full((len(ids), POSITIVES), np.iinfo(np.int64).min)
    limits[a, i - 1] = score
    limits_sent = spark.sparkContext.broadcast(limits)

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, _ = sent.value
        limits = limits_sent.value
        # Windows in whole numbers: least score with 100 s >= LOW p. A window of negative scores is empty.
        least = np.where(limits >= 0, -(-LOW * limits // 100), np.iinfo(np.int64).max)
        best = Best(limits.size, NEGATIVES)
        for row, label, score in scored(batches):
            other = labels[:, None] != label
            for j in range(POSITIVES):
                floor = np.maximum(least[:, j], best.floor[j :: POSITIVES])
                x, r = np.nonzero(other & (score <= limits[:, j : j + 1]) & (score >= floor[:, None]))
                if len(x):
                    best.add(x * POSITIVES + j, score[x, r], row[r])
        found = np.unique(np.stack([best.slot // POSITIVES, best.score, best.row]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(packed(ids[found[0]], found[1], 1, found[2]), pa.binary())], ["key"])

    keys = rows.select("vec_id", "label", "v").mapInArrow(negatives, "key binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    opened = spark.sparkContext.parallelize(packed(ids[a], score, 0, row), min(parts, 1 + len(a) // 10_000))
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None)).union(opened.map(lambda k: (k, None)))
    dealt = pairs.repartitionAndSortWithinPartitions(parts, lambda k: struct.unpack_from(">Q", k)[0] * 0x9E3779B97F4A7C15 >> 20 & 0x7FFFFFFF)
    return spark.createDataFrame(dealt.mapPartitions(windows), schema, verifySchema=False)


def windows(keys) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys; a window closes when full or passed."""
    now, open_ = None, []
    for key, _ in keys:
        anchor, score, negative, row = unpack(key)
        if anchor != now:
            now, open_ = anchor, []
        if not negative:
            open_.append([row, score, 0])
            continue
        open_ = [w for w in open_ if w[2] < NEGATIVES and LOW * w[1] <= 100 * score]
        for w in open_:
            w[2] += 1
            yield anchor, w[0], w[2], row, w[1], score
