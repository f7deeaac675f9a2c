"""Suffix-array dedup: remove every byte covered by a stretch of LENGTH bytes that also starts earlier.

Equal stretches must meet in one place without an index of the whole corpus. Each window of LENGTH bytes is dealt out by its
least k-mer hash, which equal windows have in common, so that neighbouring windows of one least k-mer travel as one string. In turn:

1. Least k-mers that occur once in the corpus have no equal window anywhere. The others go into a Bloom filter of bounded size,
   which only lets more strings through when it is full.
2. Strings of the k-mers that pass are merged where they are equal (the first place of each stays), on the map side too, so a
   passage that fills a third of the corpus is one row for each task.
3. The different strings of a k-mer are indexed together in bounded chunks (bwt.py): interval expansion to LENGTH gives the
   classes of equal windows, and the first of each stays. A k-mer whose strings are more than HOT bytes is not kept together:
   its strings are cut anew at longer k-mers, at the last by whole windows, where equal strings have merged.
4. What is not the first of its class is removed: a document is given the places that stay and drops its other windows that passed.

Places are ordered by id, then start. A null id comes before all others, a null text is an empty one. Rows that share an id are
ordered by a hash of their texts; equal rows are the same document and get the same result. Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import first_windows
from .common import mix, settle, _power_tables

LENGTH = 100
#: Lengths of the k-mers by which windows meet; the next is for what is too much in one place.
KMERS = (32, 64, 84, 100)
#: Bytes of different strings of one k-mer that are indexed together at most, and bytes of a chunk with several k-mers.
HOT, CHUNK = 1 << 17, 1 << 19
#: Windows of one text, and bytes in all, that are hashed at once; places in them fit 16 bits.
PIECE, MOST = 1 << 15, (1 << 16) - 1
#: Words of 64 bits in the Bloom filter (16 MB).
BLOOM_WORDS = 1 << 21
_FIRST = -(1 << 63)


def stretches(data: np.ndarray, bounds: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, hash) of each run of windows with one least k-mer, windows lying within bounds[i]..bounds[i + 1]. At most MOST bytes."""
    n = len(data)
    ends = np.repeat(bounds[1:].astype(np.int32), np.diff(bounds))[: max(0, n - length + 1)]
    inside = np.arange(length, length + len(ends), dtype=np.int32) <= ends
    if not inside.any():
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= inverse[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    # 16 bits of the hash over 16 of the place, so that of equal ones the first counts.
    least = (h >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFF0000) | np.arange(len(h), dtype=np.uint32)
    span, width = 1, length - k + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    at = least & np.uint32(0xFFFF)
    cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]), [True])))
    starts, count = cuts[:-1], np.diff(cuts)
    kept = inside[starts]
    starts, count = starts[kept], count[kept]
    return starts, count, mix(h[at[starts]] ^ np.uint64(k))


def pieces(texts: list[bytes | None], length: int = LENGTH) -> Iterator[tuple[bytes, np.ndarray, list[int], np.ndarray]]:
    """(bytes, bounds, index of the text, offset in the text) of at most 64 KB at a time; texts of over PIECE windows are cut and overlap by length - 1."""
    held, of, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text or b"") - length + 1, PIECE):
            part = text[a : a + PIECE + length - 1]
            if held and size + len(part) > MOST:
                yield b"".join(held), np.concatenate(([0], np.cumsum([len(x) for x in held]))), of, np.array(offset)
                held, of, offset, size = [], [], [], 0
            held.append(part)
            of.append(i)
            offset.append(a)
            size += len(part)
    if held:
        yield b"".join(held), np.concatenate(([0], np.cumsum([len(x) for x in held]))), of, np.array(offset)


def _bit_mask(h: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (one << (h & np.uint64(63))) | (one << (h >> np.uint64(6) & np.uint64(63))) | (one << (h >> np.uint64(12) & np.uint64(63)))


def _passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the filter has h: a word by the upper bits, three bits in it by the lower ones."""
    mask = _bit_mask(h)
    return bloom[(h >> np.uint64(64 - (len(bloom).bit_length() - 1))).astype(np.int64)] & mask == mask


def repeated_kmers(texts: DataFrame) -> DataFrame:
    """h of the least k-mers that several windows' strings have. texts: one binary column."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(np.frombuffer(data, np.uint8), bounds, KMERS[0])[2] for data, bounds, _, _ in pieces(batch.column(0).to_pylist())]
            if found:
                h, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2))], ["h", "n"])

    return texts.mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def bloom_of(keys: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of the column h; bounded by BLOOM_WORDS whatever the number of keys."""
    words = min(BLOOM_WORDS, max(1024, 1 << (keys.count() - 1).bit_length() if keys.head(1) else 1))
    one = F.lit(1).cast("long")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftright("h", by).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 64 - (words.bit_length() - 1)).cast("int")
    filled = keys.groupBy(word.alias("w")).agg(F.bit_or(bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))).alias("m")).toArrow()
    out = np.zeros(words, np.uint64)
    out[filled["w"].to_numpy()] = filled["m"].to_numpy().view(np.uint64)
    return out


def _first_places(strings: DataFrame) -> DataFrame:
    """h, s, and the first place (d, tie, pos) of each different string."""
    return strings.groupBy("h", "s").agg(F.min(F.struct("d", "tie", "pos")).alias("p")).select("h", "s", "p.*")


_STRINGS = "h long, d long, tie long, pos long, s binary"


def _rows(data: bytes, start: np.ndarray, count: np.ndarray, h: np.ndarray, d: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    cut = [data[a:b] for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d), pa.array(tie), pa.array(pos), pa.array(cut, pa.binary())], ["h", "d", "tie", "pos", "s"])


def cut_strings(rows: DataFrame, k: int, bloom=None) -> DataFrame:
    """rows (d, tie, pos, s: binary) -> strings of the windows that have one least k-mer; with a broadcast filter, those of k-mers in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, tie, pos = (batch.column(i).to_numpy() for i in range(3))
            for data, bounds, of, offset in pieces(batch.column(3).to_pylist()):
                start, count, h = stretches(np.frombuffer(data, np.uint8), bounds, k)
                if bloom is not None:
                    kept = _passes(bloom.value, h)
                    start, count, h = start[kept], count[kept], h[kept]
                part = np.searchsorted(bounds, start, side="right") - 1
                i = np.array(of)[part]
                if len(i):
                    yield _rows(data, start, count, h, d[i], tie[i], pos[i] + offset[part] + start - bounds[part])

    return rows.select("d", "tie", "pos", "s").mapInArrow(cut, _STRINGS)


def runs(flags: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of true flags; a run also ends where `new` begins something else."""
    change = np.flatnonzero(np.concatenate(([True], (flags[1:] != flags[:-1]) | new[1:])))
    size = np.diff(np.append(change, len(flags)))
    return change[flags[change]], size[flags[change]]


def _kept_of(strings: list[bytes], d: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """The windows of some strings that are the first of their class, as runs."""
    order = np.lexsort((tie, d))
    other = np.concatenate(([False], (d[order][1:] != d[order][:-1]) | (tie[order][1:] != tie[order][:-1])))
    document = np.empty(len(d), np.int64)
    document[order] = np.cumsum(other)
    flags, ends = first_windows(strings, (document << 33) + pos, LENGTH)
    begins = np.concatenate(([0], ends[:-1]))
    new = np.zeros(len(flags), bool)
    new[begins] = True
    start, size = runs(flags, new)
    i = np.searchsorted(ends, start, side="right")
    return pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(tie[i]), pa.array(pos[i] + start - begins[i]), pa.array(size)], ["d", "tie", "start", "size"])


def kept_windows(strings: DataFrame) -> DataFrame:
    """strings (h, s, d, tie, pos; different ones, those of one h together of bounded size) -> d, tie, start, size of the runs of windows that stay.

    A string that is alone with its k-mer has nothing to be equal to and stays whole.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rest = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.concat_batches([rest, batch]) if rest is not None else batch
            h = batch.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            # The last k-mer may go on in the next batch.
            whole, rest = batch.slice(0, heads[-1]), batch.slice(heads[-1])
            for part in _groups(whole, heads[:-1]):
                if isinstance(part, pa.RecordBatch):
                    yield part
                else:
                    held.append(part)
                    size += part[4]
                    if size >= CHUNK:
                        yield _together(held)
                        held, size = [], 0
        if rest is not None:
            for part in _groups(rest, np.array([0])):
                if isinstance(part, pa.RecordBatch):
                    yield part
                else:
                    held.append(part)
        if held:
            yield _together(held)

    def _groups(batch: pa.RecordBatch, heads: np.ndarray):
        if not batch.num_rows:
            return
        d, tie, pos = (batch.column(i).to_numpy() for i in (2, 3, 4))
        sizes = np.diff(np.append(heads, batch.num_rows))
        lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1]).astype(np.int64)
        lone = heads[sizes == 1]
        if len(lone):
            yield pa.RecordBatch.from_arrays([pa.array(d[lone]), pa.array(tie[lone]), pa.array(pos[lone]), pa.array(lengths[lone] - LENGTH + 1)], ["d", "tie", "start", "size"])
        for a, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            yield batch.column(1).slice(a, n).to_pylist(), d[a : a + n], tie[a : a + n], pos[a : a + n], int(lengths[a : a + n].sum())

    def _together(held: list) -> pa.RecordBatch:
        return _kept_of([s for x in held for s in x[0]], *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3)))

    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.select("h", "s", "d", "tie", "pos").repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(expand, "d long, tie long, start long, size long")


def dedup(docs: DataFrame, spans: str = "spans", kept: str = "kept") -> DataFrame:
    """docs (doc_id, text, further columns) -> their columns, with spans (removed byte ranges: array of start, end) and kept (the other bytes).

    Columns of docs named like the two outputs are replaced. A text of fewer than LENGTH bytes, or null, loses nothing.
    """
    spark = docs.sparkSession
    named = docs.drop(spans, kept)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("__d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t")]
    texts = docs.select(key[0].alias("d"), key[1].alias("tie"), F.lit(0).cast("long").alias("pos"), F.col("text").cast("binary").alias("s"))
    bloom = spark.sparkContext.broadcast(bloom_of(settle(repeated_kmers(texts.select("s")))))
    pending, stay = cut_strings(texts, KMERS[0], bloom), None
    for longer in [*KMERS[1:], None]:
        different = settle(_first_places(pending))
        hot = different.groupBy("h").agg(F.sum(F.octet_length("s")).alias("n")).where(F.col("n") > HOT).select("h")
        hot = settle(hot) if longer else None
        crowded = longer is not None and bool(hot.head(1))
        found = settle(kept_windows(different.join(hot, "h", "left_anti") if crowded else different))
        stay = found if stay is None else stay.union(found)
        if not crowded:
            break
        pending = cut_strings(different.join(hot, "h", "left_semi"), longer)
    places = stay.groupBy(F.col("d").alias("__d"), F.col("tie").alias("__t")).agg(F.collect_list(F.struct("start", "size")).alias("__stay"))
    rest = [c for c in named.columns]
    joined = named.withColumns({"__d": key[0], "__t": key[1]}).join(places, ["__d", "__t"], "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema), f"`{spans}` array<struct<start: long, end: long>>", f"`{kept}` binary"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1)
            found = removed(texts, places, bloom.value)
            cut = [b"".join([t[a:b] for a, b in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(t)], strict=True)]) if r else t for t, r in zip((t or b"" for t in texts), found, strict=True)]
            lists = pa.array([[{"start": a, "end": b} for a, b in r] for r in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists, pa.array(cut, pa.binary())], [*rest, spans, kept])

    return joined.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("binary").alias("__s"), "__stay").mapInArrow(cut_out, schema)


def removed(texts: list[bytes | None], places: pa.Array, bloom: np.ndarray) -> list[list[tuple[int, int]]]:
    """Removed byte ranges of each text: covered by the windows that pass the filter and are not among the places that stay."""
    flagged: dict[int, list[np.ndarray]] = {}
    for data, bounds, of, offset in pieces(texts):
        start, count, h = stretches(np.frombuffer(data, np.uint8), bounds, KMERS[0])
        passed = _passes(bloom, h)
        start, count = start[passed], count[passed]
        if not len(start):
            continue
        part = np.searchsorted(bounds, start, side="right") - 1
        begins = start + offset[part] - bounds[part]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            flagged.setdefault(of[part[a]], []).append(np.stack([begins[a:b], count[a:b]]))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, found in flagged.items():
        gone = np.zeros(len(texts[i]), bool)
        gone[_spread(*np.concatenate(found, axis=1))] = True
        if places[i].is_valid:
            flat = places[i].values
            gone[_spread(flat.field("start").to_numpy(), flat.field("size").to_numpy())] = False
        start, size = runs(gone, np.zeros(len(gone), bool))
        if len(start):
            end = start + size + LENGTH - 1
            apart = start[1:] > end[:-1]
            out[i] = list(zip(start[np.concatenate(([True], apart))].tolist(), end[np.concatenate((apart, [True]))].tolist(), strict=True))
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start .. start + size - 1, for each pair."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
