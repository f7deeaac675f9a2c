"""Benchmark decontamination by pigeonhole edit matching.

A text within e edits of an item holds, unchanged, at least one of any e + 1 pieces into which the item is cut. Pieces are
found exactly by one automaton pass over each document; what surrounds a hit is verified by Myers' bit-parallel distance.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits allowed for each hundred characters of an item (rounded down).
EDITS_PER_100 = 6
#: Items shorter than this (normalised) are looked for without edits, and as whole words.
MIN_CHARS = 24
#: Characters of items in one automaton; more items go in several blocks.
BLOCK_CHARS = 8_000_000
#: Automata that a worker process holds at once; with more blocks they are built again as they are needed.
MATCHERS = 2
#: Characters of a document searched at a time; blocks overlap, so results do not depend on it.
SEARCH_CHARS = 1 << 22


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends; other differences count as edits."""
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of near equal length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, window: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of the item to any substring of the window, last end of such a substring).

    Myers' recurrences over one big integer for the whole column; a free start lets the match begin anywhere.
    """
    m = len(item)
    if masks is None:
        masks = char_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        carry = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(carry | up)), up & carry
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(eq | down | plus)), plus & (eq | down)
        if score <= best:
            best, end = score, j
    return best, end


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def budget(item: str) -> int:
    """Edits allowed for a normalised item."""
    return len(item) * EDITS_PER_100 // 100 if len(item) >= MIN_CHARS else 0


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, budget(t)) for i, t in items]
        self.longest = max((len(t) + 2 * e for _, t, e in self.items), default=0)
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, edits) in enumerate(self.items):
            for at, piece in pieces(t, edits):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.empty = not found
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, place of the end in the normalised text) of the best match of each item in a normalised text."""
        if self.empty:
            return []
        best: dict[int, tuple[int, int]] = {}
        windows: dict[int, list[list[int]]] = {}
        for base in range(0, max(1, len(text)), SEARCH_CHARS):
            for end, (size, uses) in self.automaton.iter(text[base : base + SEARCH_CHARS + self.longest]):
                for n, at in uses:
                    _, item, edits = self.items[n]
                    begin = base + end + 1 - size - at
                    if len(item) < MIN_CHARS:
                        after = begin + len(item)
                        if (begin == 0 or text[begin - 1] == " ") and (after == len(text) or text[after] == " "):
                            best[n] = (0, after)
                        continue
                    # Every match of this piece here lies in this window; windows that meet are searched as one.
                    lo, hi = max(0, begin - edits), min(len(text), begin + len(item) + edits)
                    held = windows.setdefault(n, [])
                    if held and lo <= held[-1][1] and held[-1][0] <= hi:
                        held[-1] = [min(lo, held[-1][0]), max(hi, held[-1][1])]
                    else:
                        held.append([lo, hi])
        for n, held in windows.items():
            _, item, edits = self.items[n]
            if n not in self.masks:
                self.masks[n] = char_masks(item)
            held.sort()
            while held:
                lo, hi = held.pop(0)
                while held and held[0][0] <= hi:
                    hi = max(hi, held.pop(0)[1])
                d, e = best_match(item, text[lo:hi], self.masks[n])
                if d <= edits and d < best.get(n, (edits + 1,))[0]:
                    best[n] = (d, lo + e)
        return sorted((self.items[n][0], d, e) for n, (d, e) in best.items())


_matchers: OrderedDict[tuple[str, int], Matcher] = OrderedDict()


def _matcher(job: str, block: int, items) -> Matcher:
    """This worker's matcher of a block, built once for all tasks as long as MATCHERS allow."""
    key = (job, block)
    if key not in _matchers:
        while len(_matchers) >= MATCHERS:
            _matchers.popitem(last=False)
        _matchers[key] = Matcher(items.value)
    _matchers.move_to_end(key)
    return _matchers[key]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most BLOCK_CHARS characters; the driver holds one block at a time."""
    block, size = [], 0
    for r in items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct().toLocalIterator():
        if t := normalise(r[1]):
            block.append((r[0], t))
            size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]))


def find_items(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", matches: str = "matches") -> DataFrame:
    """Adds `matches`: an array of (item_id, distance, end in the normalised document) of the items that the document holds.

    An item is held if some part of the whole normalised text is within EDITS_PER_100 % edits of it; `distance` is the least
    one and `end` its last place among the parts verified. An item under MIN_CHARS characters is held if the text has it
    unchanged, as whole words. Null or empty texts hold none; null and blank items are not looked for. Repeated items
    count once each id and text. Other columns stay, a namesake is replaced. No shuffle of documents; items are
    broadcast in blocks of BLOCK_CHARS characters, and one pass over the documents searches for all blocks.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c != matches]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(matches, MATCHES)])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
    job, blocks = uuid.uuid4().hex, [spark.sparkContext.broadcast(b) for b in item_blocks(items, item_id, item_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalise(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            made: list[list[dict]] = [[] for _ in texts]
            for i, held in enumerate(blocks):
                matcher = _matcher(job, i, held)
                for t, m in zip(texts, made, strict=True):
                    m.extend({"item_id": k, "distance": d, "end": e} for k, d, e in matcher.find(t))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(made, arrow)], names=[*kept, matches])

    return df.mapInArrow(run, schema)


def brute_distance(item: str, text: str) -> int:
    """Least edit distance of item to any substring of text, by the plain table; for tests."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return int(row.min())
