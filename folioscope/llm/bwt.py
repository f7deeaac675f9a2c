"""Equal stretches of fixed length in a collection of byte strings, from a Burrows-Wheeler transform.

Suffixes are ordered by their first `depth` symbols (prefix doubling, cut off at depth). The transform is then searched
breadth first: each interval of suffixes with prefix w is extended backward to those with prefix cw, for all c at once, and
the right end of an interval found at length l is a place where neighbours share l - 1 symbols, unless a shorter one was known.
So common prefixes come by increasing value, and the search stops at depth: places not met by then share depth symbols.
"""

from __future__ import annotations

import numpy as np


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, starts, alphabet): each string followed by the separator 0, bytes as 1, 2, ... in their order."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    ends = starts + sizes
    used = np.zeros(256, bool)
    inside = np.ones(len(data), bool)
    inside[ends] = False
    used[data[inside]] = True
    symbols = np.cumsum(used).astype(np.uint16)[data]
    symbols[ends] = 0
    return symbols, starts, int(used.sum()) + 1


def suffix_order(symbols: np.ndarray, alphabet: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes by their first `depth` symbols, those past the end counting as 0. Equal ones come in any order."""
    n = len(symbols)
    packed, known = symbols.astype(np.int64), 1
    padded = np.concatenate((packed, np.zeros(64, np.int64)))
    while known < depth and (alphabet ** (known + 1)) < 1 << 62:
        packed = packed * alphabet + padded[known : known + n]
        known += 1
    order = np.argsort(packed)
    # A suffix's class is the place of its class's first member, so that a class keeps its number when others are refined.
    s = packed[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    place = np.arange(n)
    head = np.empty(n + 1, np.int64)
    head[order] = np.maximum.accumulate(np.where(new, place, 0))
    head[n] = -1
    while known < depth:
        step = min(known, depth - known)
        last = np.concatenate((new[1:], [True]))
        open_ = np.flatnonzero(~(new & last))
        if not len(open_):
            break
        at = order[open_]
        key = head[at] * (n + 1) + head[np.minimum(at + step, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        differs = np.concatenate(([True], key[1:] != key[:-1]))
        new[open_] |= differs
        head[at] = np.maximum.accumulate(np.where(differs, open_, 0))
        known += step
    rank = np.empty(n, np.int64)
    rank[order] = place
    return order, rank


def equal_prefixes(symbols: np.ndarray, alphabet: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, first of each class in that order): suffixes of a class agree in their first `depth` symbols.

    Holds for suffixes with `depth` symbols before the next separator; shorter ones are in classes without any of these.
    """
    n = len(symbols)
    order, rank = suffix_order(symbols, alphabet, depth)
    before = order - 1
    transform = symbols[before].astype(np.uint8 if alphabet <= 256 else np.uint16)
    back = rank[before].astype(np.int32)
    found = np.zeros(n + 1, bool)
    found[n] = True
    counts = np.bincount(symbols, minlength=alphabet)
    ends = np.cumsum(counts)
    low, high = ((x[counts > 0]).astype(np.int32) for x in (ends - counts, ends))
    found[high] = True
    for _ in range(1, depth):
        sizes = high - low
        shift = np.cumsum(sizes, dtype=np.int32) - sizes
        at = np.repeat(low - shift, sizes)
        at += np.arange(len(at), dtype=np.int32)
        c = transform[at]
        by = np.argsort(c, kind="stable")
        by = by[np.count_nonzero(c == 0) :]
        if not len(by):
            break
        c, interval, to = c[by], np.repeat(np.arange(len(low), dtype=np.int32), sizes)[by], back[at[by]]
        starts = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (interval[1:] != interval[:-1]))))
        low = np.minimum.reduceat(to, starts)
        high = low + np.diff(np.append(starts, len(to))).astype(np.int32)
        fresh = ~found[high]
        low, high = low[fresh], high[fresh]
        found[high] = True
        if not len(low):
            break
    return order, np.concatenate(([0], np.flatnonzero(found[1:n]) + 1))


def first_windows(strings: list[bytes], keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of `length` bytes come first: (flags, end of each string's flags in them), a flag for each window of each string.

    keys: an order key of each string's first window; a later window of the string has a key greater by its distance. Of equal
    windows the one of the least key comes first; equal windows of one key all do.
    """
    symbols, starts, alphabet = joined(strings)
    order, heads = equal_prefixes(symbols, alphabet, length)
    sizes = np.diff(np.append(starts, len(symbols))) - 1
    counts = np.maximum(sizes - length + 1, 0)
    ends = np.cumsum(counts)
    offset = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
    places = np.repeat(starts, counts) + offset
    key = np.full(len(symbols), np.iinfo(np.int64).max)
    key[places] = np.repeat(keys, counts) + offset
    sorted_key = key[order]
    least = np.minimum.reduceat(sorted_key, heads)
    first = np.empty(len(symbols), bool)
    first[order] = sorted_key == np.repeat(least, np.diff(np.append(heads, len(order))))
    return first[places], ends
