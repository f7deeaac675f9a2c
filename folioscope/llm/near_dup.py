"""Near-duplicate documents: order min-hash signatures, verified by banded alignment, grouped by connected components.

A signature entry takes the LEAST occurrence-labelled word shingles with the least hashes and keeps them in text order, so
that documents collide in proportion to their edit similarity, not only to their common content. Short texts also collide
by blocks of words: of one block more than edits are allowed, one is unchanged.

Equal texts are one node from the start. Every text is first aligned with the first of its largest bucket of equal entries, then
one text of each class in a bucket with the bucket's first. Texts of different classes that still share a bucket all
meet, if they share one of their rarest words, as all similar texts do; so no link between candidates is left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_test, bloom_words, components, mix, parted, possible, settle, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Entries of a signature and shingles in each. At similarity 0.8 with spread edits an entry is shared with a chance of
#: about 0.04, and one of all with 0.99 (300 words).
ENTRIES, LEAST = 113, 2
#: Texts of so many words at most are also compared by blocks, which misses no pair.
SHORT = 60


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many earlier elements equal each element."""
    order = np.argsort(h, kind="stable")
    runs = h[order]
    new = np.concatenate(([True], runs[1:] != runs[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - first
    return out


_SEEDS = mix(np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def signature(words: list[str]) -> np.ndarray:
    """ENTRIES hashes (int64); empty for a text without words."""
    h = shingle_hashes(words, SHINGLE)
    if not len(h):
        return np.empty(0, np.int64)
    labelled = mix(h + occurrences(h).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at_once = max(1, min(ENTRIES, (1 << 20) // len(h)))
    return np.concatenate([_entries(labelled, _SEEDS[i : i + at_once]) for i in range(0, ENTRIES, at_once)]).view(np.int64)


def _entries(labelled: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    least = min(LEAST, len(labelled))
    m = mix(labelled[None] ^ seeds[:, None])
    chosen = np.empty((len(seeds), least), np.int64)
    for i in range(least):
        chosen[:, i] = m.argmin(axis=1)
        m[np.arange(len(seeds)), chosen[:, i]] = np.iinfo(np.uint64).max
    chosen.sort(axis=1)
    code = seeds
    for i in range(least):
        code = mix(code * np.uint64(31) + labelled[chosen[:, i]])
    return code


def budget(n: int) -> int:
    """Edits allowed where the longer text has n words."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def cuts(n: int) -> list[int]:
    """Bounds of budget(n) + 1 blocks of n words, as equal as can be."""
    k = min(n, budget(n) + 1)
    return [n * i // k for i in range(k + 1)]


@cache
def lengths(n: int) -> list[int]:
    """Lengths of the blocks of all texts to which one of n words can be the shorter."""
    found = set()
    longer = n
    while longer - budget(longer) <= n:
        c = cuts(longer)
        found |= {hi - lo for lo, hi in zip(c, c[1:], strict=False)}
        longer += 1
    return sorted(x for x in found if x <= n)


def blocks(words: list[str]) -> np.ndarray:
    """Hashes (int64) such that similar texts of SHORT words at most share one; empty for longer texts.

    All runs of words as long as the blocks of longer texts that may be similar; the text's own blocks are among them.
    """
    if not 0 < len(words) <= SHORT:
        return np.empty(0, np.int64)
    made = [mix(shingle_hashes(words, k) ^ np.uint64(k << 56)) for k in lengths(len(words))]
    return np.unique(np.concatenate(made)).view(np.int64)


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two arrays of word numbers if it is at most `most`, else None.

    Common ends are cut; what is left is aligned in a band of at most `most` diagonals on each side.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return None
    if not len(a) or not len(b):
        return max(len(a), len(b))
    return _narrow(a, b, most) if most <= NARROW else _narrow(a, b, NARROW) or _columns(a.tolist(), b.tolist(), most)


#: Edits up to which the band is followed diagonal by diagonal; wider bands go column by column as bits.
NARROW = 48


def _narrow(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The band widens by a diagonal on each side for each edit; on each, the furthest place in `a` reached so far is kept.

    What a diagonal holds unchanged is skipped by a search among its mismatches, listed when it is first entered.
    """
    n, m, goal = len(a), len(b), len(b) - len(a)
    stops: dict[int, list[int]] = {}

    def slide(i: int, k: int) -> int:
        if k not in stops:
            lo, hi = max(0, -k), min(n, m - k)
            stops[k] = [*(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo).tolist(), max(lo, hi)]
        at = stops[k]
        return at[bisect_left(at, i)] if i < at[-1] else i

    reached = {0: slide(0, 0)}
    for d in range(most + 1):
        if reached.get(goal, -1) >= n:
            return d
        new = {}
        # Diagonals from which the goal is out of reach are left out.
        for k in range(max(-n, -d - 1, goal - (most - d - 1)), min(m, d + 1, goal + (most - d - 1)) + 1):
            i = max(reached.get(k, -2) + 1, reached.get(k + 1, -2) + 1, reached.get(k - 1, -1))
            if i >= max(0, -k):
                new[k] = slide(min(i, n, m - k), k)
        reached = new
    return None


def _columns(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance by bit-parallel columns, each a few operations on one integer; stops once `most` is out of reach."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    n, full, top = len(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, n
    for j, y in enumerate(b, 1):
        eq = masks.get(y, 0)
        carry = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(carry | up)), up & carry
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score - (len(b) - j) > most:
            return None
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~(eq | down | plus)), plus & (eq | down)
    return score if score <= most else None


def similar(x: list[str], y: list[str]) -> bool:
    """Whether 1 - edits / longer length, over words, is SIMILARITY or more."""
    numbers: dict[str, int] = {}
    return similar_numbers(*(numbered(t, numbers) for t in (x, y)))


def numbered(words: list[str], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words, sorted numbers with occurrence); `numbers` learns new words."""
    n = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return n, np.sort(n << 32 | occurrences(n)) if len(n) else n


def similar_numbers(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    most = budget(longer := max(len(x[0]), len(y[0])))
    # Words that one text has more of than the other each need an edit: a quick bound before any alignment.
    if min(len(x[0]), len(y[0])) < longer - most or len(np.intersect1d(x[1], y[1], assume_unique=True)) < longer - most:
        return False
    return distance_within(x[0], y[0], most) is not None


def _signatures(docs: DataFrame) -> DataFrame:
    """(d, h1, h2, sig) of (d, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.concatenate((signature(w := t.as_py().split()), blocks(w))) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(made, pa.list_(pa.int64()))], names=["d", "h1", "h2", "sig"])

    return docs.select("d", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text").mapInArrow(run, "d long, h1 long, h2 long, sig array<long>")


#: About so many pairs are verified at a time in a task; and the least number of parts into which each side is dealt.
PAIRS_AT_ONCE, SIDES = 2000, 8


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar.

    Pairs are dealt into blocks by both ids; a text goes once to each block where it has a pair, so a text with many
    partners is not copied for each. Blocks grow in number with the pairs, not in size.
    """
    side = max(SIDES, isqrt(pairs.count() // PAIRS_AT_ONCE))
    part = lambda c: F.pmod(F.xxhash64(F.lit("part"), c), F.lit(side))
    blocks_ = settle(pairs.select((part("a") * side + part("b")).alias("k"), "a", "b"))
    places = settle(blocks_.select("k", F.explode(F.array("a", "b")).alias("d")).distinct())
    texts = possible(docs, "d", places.select("d"), places.count()).join(places, "d").select("k", "d", "text")

    def run(these: pa.Table, texts: pa.Table) -> pa.Table:
        numbers: dict[str, int] = {}
        least: dict[int, str] = {}
        for d, t in zip(texts["d"].to_pylist(), texts["text"].to_pylist(), strict=True):
            if d not in least or t < least[d]:
                least[d] = t
        held = {d: numbered(t.split(), numbers) for d, t in least.items()}
        keep = [similar_numbers(held[a], held[b]) for a, b in zip(these["a"].to_pylist(), these["b"].to_pylist(), strict=True)]
        return these.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return blocks_.groupBy("k").cogroup(texts.groupBy("k")).applyInArrow(run, "a long, b long")


#: Word counts that order words by rarity are kept in so many hash buckets; the order decides cost only, not results.
RARITY_BUCKETS = 1 << 16
#: Bits of parity by which pairs are ruled out before any text is read (cost only).
PARITY_WORDS = 16
#: So many shared rare words of a text before each are looked at, lest a pair be made again (cost only).
BEFORE = 6
#: Texts of a bucket that all meet, if they are of different classes; larger buckets are cut by rare words (cost only).
SMALL = 64


def _labelled_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hash of each word with the number of its earlier occurrences)."""
    h = shingle_hashes(words, 1)
    return h, mix(h + occurrences(h).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _word_counts(texts: DataFrame) -> np.ndarray:
    """Count of words by hash bucket over all rows of (d, text): RARITY_BUCKETS numbers, whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if words := t.as_py().split():
                    total += np.bincount((shingle_hashes(words, 1) % np.uint64(RARITY_BUCKETS)).astype(np.int64), minlength=RARITY_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    counts = np.zeros(RARITY_BUCKETS, np.int64)
    for b, n in texts.select("text").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n")).toLocalIterator():
        counts[b] = n
    return counts


def rare_words(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the text's rarest labelled words, parities of all): two similar texts share one of the hashes.

    The longer text, of n words, keeps all but budget(n) of its words in the shorter, so the budget(n) + 1 rarest of each
    have a word in common; the shorter's number is no smaller than it needs. The parities differ in no more bits than
    the texts in words.
    """
    h, marked = _labelled_words(words)
    order = np.lexsort((marked, counts[(h % np.uint64(RARITY_BUCKETS)).astype(np.int64)]))
    bits = np.bincount((marked % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return marked[order[: budget(len(words)) + 1]].view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketched(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(d, root, vs, n, m, w) of (d, root, vs, text): number of words, parities, and the rare words if `vs` is not empty."""
    held = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(rare_words(w := t.as_py().split(), held.value), len(w)) for t in batch.column(3)]
            rare = [x[0][0] if len(v) else [] for x, v in zip(made, batch.column(2), strict=True)]
            cols = [*batch.columns[:3], pa.array([x[1] for x in made], pa.int32()), pa.array([x[0][1] for x in made], pa.list_(pa.int64())), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "root", "vs", "n", "m", "w"])

    return texts.select("d", "root", "vs", "text").mapInArrow(run, "d long, root long, vs array<long>, n int, m array<long>, w array<long>")


def _meeting(rows: DataFrame, key: str, also=None) -> DataFrame:
    """Pairs (a, b) of rows (key, d, root, n, m0, ...) with the same key and other roots, whose lengths and parities allow similarity."""
    other = rows.withColumnsRenamed({c: f"{c}_" for c in rows.columns if c != key})
    longer = F.greatest("n", "n_")
    allowed = F.floor(longer * (1 - SIMILARITY) + 1e-9)
    differ = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"m{i}_"))) for i in range(PARITY_WORDS)), F.lit(0))
    fits = (F.col("d_") < F.col("d")) & (F.col("root_") != F.col("root")) & (longer - F.least("n", "n_") <= allowed) & (differ <= F.least("n", "n_") - longer + 2 * allowed)
    met = rows.alias("x").join(other.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (fits if also is None else fits & also))
    return met.select(F.col("d_").alias("a"), F.col("d").alias("b")).distinct()


def _rooted(shared: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Rows (v, d, lead, n, root) of buckets that hold more than one class, with each text's class as `root`."""
    if classes is None:
        rooted = shared.withColumn("root", F.col("d"))
    else:
        rooted = shared.join(classes.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    rooted = settle(rooted)
    mixed = rooted.groupBy("v").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("v")
    return rooted.join(mixed, "v", "left_semi")


def _remaining(known: DataFrame, rooted: DataFrame) -> DataFrame:
    """All pairs (a, b) of texts in `rooted`, of different classes, that share a bucket and may be similar.

    In a bucket of at most SMALL texts all of these meet. Larger ones are mostly of texts that share only a common passage;
    comparing all of these would grow with the square of their number. Similar texts also share one of their rarest words,
    so texts of large buckets meet where they share such a word, and a bucket.
    """
    large = F.when(F.col("n") > SMALL, F.col("v"))
    concerned = settle(rooted.groupBy("d", "root").agg(F.collect_set(large).alias("vs")))
    texts = possible(known, "d", concerned, concerned.count()).join(concerned, "d").dropDuplicates(["d"])
    texts = settle(texts.select("d", "root", "vs", "text"))
    sketched = settle(_sketched(texts, _word_counts(texts)))
    whole = [F.get("m", F.lit(i)).alias(f"m{i}") for i in range(PARITY_WORDS)]
    small = rooted.where(F.col("n") <= SMALL).select("v", "d").join(sketched.select("d", "root", "n", *whole), "d")
    pairs = _meeting(settle(small), "v")
    # Rare words that texts of one class only have stay where they are: a Bloom filter lets few of them through.
    # Dealt out before they are exploded: texts of a large bucket may lie side by side.
    wide = sketched.where(F.size("w") > 0).repartition("d")
    mixed = settle(wide.select(F.explode("w").alias("w"), "root").groupBy("w").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("w"))
    n_words = bloom_words(mixed.count())
    bits = bloom_filter(mixed.select(F.xxhash64("w").alias("k")), "k", n_words)
    kept = wide.withColumn("bits", bits).withColumn("w", F.filter("w", lambda w: bloom_test(F.col("bits"), F.xxhash64(w), n_words)))
    # A pair that shares one of the words just before meets there already.
    before = F.slice("w", F.greatest(F.col("i") + 1 - BEFORE, F.lit(1)), F.least("i", F.lit(BEFORE))).alias("before")
    rows = kept.select("d", "root", "n", "m", "vs", "w", F.posexplode("w").alias("i", "word")).select("word", "d", "root", "n", *whole, "vs", before)
    again = ~F.arrays_overlap("before", "before_") & F.arrays_overlap("vs", "vs_")
    return pairs.union(_meeting(settle(rows), "word", again)).distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, class_id) for the documents that have a copy or near copy: class_id is the least id of the class.

    Classes are the connected components of: equal text; or, among texts that share a signature entry or block, word edit
    similarity of 0.8 or more. Of pairs of SHORT words at most, none is left out. Rows with null id or text, or without any
    word, are alone. Ids should be unique; rows that repeat an id are one node, verified by the least of their texts.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text")).where("d is not null and text is not null")
    signed = settle(_signatures(known).where(F.size("sig") > 0))
    # One node for each text; its copies are linked to it and to nothing else.
    heads = settle(signed.groupBy("h1", "h2").agg(F.min("d").alias("a"), F.count(F.lit(1)).alias("n")))
    copies = signed.join(heads.where("n > 1"), ["h1", "h2"]).where("d <> a").select("a", F.col("d").alias("b"))
    nodes = signed.join(heads.select(F.col("a").alias("d"), "h1", "h2"), ["d", "h1", "h2"], "left_semi")
    # Entries of different seeds differ, so the value alone names the bucket. Only buckets of two texts or more are kept.
    entries = nodes.select("d", F.explode("sig").alias("v"))
    buckets = settle(entries.groupBy("v").agg(F.min("d").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = settle(possible(entries, "v", buckets, buckets.count()).join(buckets, "v"))
    # Every text meets the first of its largest bucket; most copies of one text are then one class.
    first = settle(shared.where("d > lead").groupBy("d").agg(F.max(F.struct("n", "lead")).alias("x")).select(F.col("x.lead").alias("a"), F.col("d").alias("b")))
    links = settle(_verified(known, first))
    classes = settle(components(links))
    # Then one text of each class in a bucket meets the bucket's first.
    rooted = settle(_rooted(shared, classes))
    members = rooted.groupBy("v", "root").agg(F.min("d").alias("b"), F.first("lead").alias("a")).where("a <> b")
    second = settle(members.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    links = links.union(settle(_verified(known, second)))
    classes = settle(components(links))
    # What is still apart meets in full.
    tried = first.union(second)
    third = settle(_remaining(known, settle(_rooted(shared, classes))).join(tried, ["a", "b"], "left_anti"))
    links = links.union(settle(_verified(known, third)))
    classes = settle(components(links))
    # A class of texts takes the least id over the copies too: that is the least of its nodes, each the least of its text.
    roots = classes.select(F.col("node").alias("a"), "root")
    linked = copies.join(roots, "a", "left").select(F.col("b").alias("node"), F.coalesce("root", "a").alias("root"))
    heads_linked = copies.select("a").distinct().join(roots, "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return linked.union(heads_linked).union(classes.select("node", "root")).groupBy("node").agg(F.min("root").alias("class_id")).withColumnRenamed("node", doc_id)


def with_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", class_id: str = "class_id") -> DataFrame:
    """docs with `class_id`: that of its near-duplicate class, its own id where it is alone. All rows and columns stay."""
    found = near_classes(docs, doc_id, text).withColumnRenamed("class_id", "__class")
    kept = [c for c in docs.columns if c != class_id]
    return docs.select(kept).join(settle(found), doc_id, "left").select(*kept, F.coalesce("__class", doc_id).alias(class_id))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the first (least id) of each near-duplicate class; null ids and texts stay."""
    found = near_classes(docs, doc_id, text)
    dropped = settle(found.where(F.col(doc_id) != F.col("class_id")).select(doc_id))
    concerned, rest = parted(docs, doc_id, dropped, dropped.count())
    return concerned.join(dropped, doc_id, "left_anti").union(rest)
