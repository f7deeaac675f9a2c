"""Suffix dedup, whitening and hard negatives against brute force; nulls, empties, ties, repeats and clashing columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bwt, hard_negatives, suffix_dedup, whitening

# ---------------------------------------------------------------- 11 suffix dedup


def brute_spans(rows, length=100):
    """(id, text) in order of place -> removed ranges of each."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = set()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone.update(range(p, p + length))
            seen.add(w)
        spans = []
        for p in sorted(gone):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append([tuple(s) for s in spans])
    return out


def mixed_texts(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdé \n") for _ in range(r.choice([90, 99, 100, 101, 130, 400]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(150))) for _ in range(r.randrange(1, 6))]
        rows.append((i, "".join(parts)))
    rows += [(n, "a" * 350), (n + 1, "ab" * 120), (n + 2, "a" * 101), (n + 3, ""), (n + 4, None), (n + 5, "x" * 99), (n + 6, rows[0][1]), (n + 7, "\0" * 220 + "ü" * 90)]
    return rows


def check_dedup(spark, rows):
    got = suffix_dedup.dedup(spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "doc_id long, text string, spans string, h int, d int").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (i, text), want in zip(sorted(rows, key=lambda r: r[0]), brute_spans(rows), strict=True):
        assert [(s.start, s.end) for s in by[i].spans] == want, i
        b = (text or "").encode()
        assert bytes(by[i].kept) == b"".join(b[p : p + 1] for p in range(len(b)) if not any(a <= p < e for a, e in want))
        assert (by[i].h, by[i].d) == (1, 2)


def test_suffix_dedup_against_all_windows(spark):
    check_dedup(spark, mixed_texts(1, 30))


def test_suffix_dedup_cuts_hot_kmers_and_long_texts(spark, monkeypatch):
    """Every level is taken, texts are cut into pieces, and a full filter lets everything through: the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", 300)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "bloom_of", lambda keys: np.full(1024, np.uint64(2**64 - 1)))
    levels = []
    cut = suffix_dedup.cut_strings
    monkeypatch.setattr(suffix_dedup, "cut_strings", lambda rows, k, bloom=None: levels.append(k) or cut(rows, k, bloom))
    r = random.Random(3)
    common = "".join(r.choice("abcdefg ") for _ in range(95))
    rows = mixed_texts(2, 20) + [(100 + i, "".join(r.choice("hijk") for _ in range(60)) + common + "".join(r.choice("lmno") for _ in range(60))) for i in range(25)]
    check_dedup(spark, rows)
    assert levels == list(suffix_dedup.KMERS)


def test_suffix_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.dedup(spark.createDataFrame([], schema)).collect() == []
    r = random.Random(5)
    t = "".join(r.choice("abcdef") for _ in range(250))
    # A null id comes first; equal rows are one document and share its result.
    got = suffix_dedup.dedup(spark.createDataFrame([(7, t), (None, t), (9, t + "z"), (9, t + "z")], schema)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, len(r.kept)) for r in got) == [(False, 0, 250), (True, 7, 0), (True, 9, 1), (True, 9, 1)]
    # Nothing that repeats in a whole batch, and one that does.
    lone = ["".join(r.choice("abcdef") for _ in range(200)) for _ in range(3)]
    assert [len(x.spans) for x in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(lone)), schema).coalesce(1)).collect()] == [0, 0, 0]
    # In a text of one letter all windows are equal: the first stays, the rest is covered by later ones.
    (got,) = suffix_dedup.dedup(spark.createDataFrame([(1, "e" * 250)], schema)).collect()
    assert [tuple(s) for s in got.spans] == [(1, 250)] and bytes(got.kept) == b"e"


def test_interval_expansion_against_sorted_prefixes():
    r = random.Random(6)
    for depth in (1, 2, 5, 17, 100):
        strings = [bytes(r.choice(b"ab\0c") for _ in range(r.randrange(1, 180))) for _ in range(40)]
        strings += [strings[0], strings[1] + b"a", bytes(range(256)) * (depth // 200 + 1)]
        symbols, starts, alphabet = bwt.joined(strings)
        order, heads = bwt.equal_prefixes(symbols, alphabet, depth)
        cls = np.empty(len(symbols), int)
        cls[order] = np.searchsorted(heads, np.arange(len(order)), side="right")
        windows = {}
        for s, at in zip(strings, starts.tolist(), strict=True):
            for p in range(len(s) - depth + 1):
                windows.setdefault(s[p : p + depth], set()).add(cls[at + p])
        assert all(len(c) == 1 for c in windows.values())
        assert len({next(iter(c)) for c in windows.values()}) == len(windows)


def test_equal_windows_have_one_least_kmer():
    r = np.random.default_rng(7)
    data = r.integers(0, 3, 3000).astype(np.uint8)
    twice = np.concatenate((data, r.integers(0, 3, 77).astype(np.uint8), data))
    for k in suffix_dedup.KMERS:
        start, count, h = suffix_dedup.stretches(twice, np.array([0, len(twice)]), k)
        of = np.repeat(h, count)
        assert start[0] == 0 and len(of) == len(twice) - 99
        assert (of[: 3000 - 99] == of[3077 : 3077 + 3000 - 99]).all()


# ---------------------------------------------------------------- 12 whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    y = (n * u - sums) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, e[::-1], v[:, ::-1]


@pytest.mark.parametrize(("width", "rows"), [(3, 40), (24, 300), (48, 400)])
def test_whitening_against_the_dense_problem(spark, width, rows):
    r = np.random.default_rng(width)
    vectors = (r.normal(size=(rows, width)) * np.linspace(1, 3, width)).round(2).tolist()
    vectors += vectors[:30]
    df = spark.createDataFrame([(i, v, "y", 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, component int")
    q = whitening.quantised(df)
    model = whitening.fit(q)
    got = whitening.whiten(q, model).toPandas().sort_values(["component", "vec_id"])
    x, n, sums, e, v = plain_whitening(np.array(vectors, np.float32))
    k = min(16, width)
    assert n == rows and len(got) == len(vectors) * k and model.identity_error < 1e-9
    z = (n * x - sums) / n @ v[:, :k] / np.sqrt(e[:k])
    for c in range(1, k + 1):
        part = got[got.component == c]
        sign = np.sign(part.whitened.to_numpy() @ z[:, c - 1])
        assert np.abs(part.whitened.to_numpy() * sign - z[:, c - 1]).max() < 1e-8
        assert np.allclose(part.explained, e[c - 1] / e.sum(), rtol=1e-10)
        assert part.deviation.tolist() == ((n * x - sums) ** 2).sum(axis=1).tolist()


def test_filtered_iteration_finds_close_eigenvalues():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(90, 90)))[0]
    values = np.sort(np.concatenate((1 + 0.001 * np.arange(40), r.uniform(0.9, 0.98, 50))))[::-1]
    m = (q * values) @ q.T
    e, v = whitening.leading_pairs(lambda b: m @ b, 90, 16)
    assert np.allclose(e, values[:16], rtol=1e-12) and np.abs(m @ v - v * e).max() < 1e-11
    assert whitening.lower_bound(lambda b: m @ b, 90, np.random.default_rng(2)) <= values[-1] + 1e-3


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    nan, inf = math.nan, math.inf
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0, 1.0]), (None, [0.0, 5.0])]
    q = whitening.quantised(spark.createDataFrame(rows, schema))
    got = whitening.whiten(q, whitening.fit(q)).collect()
    # Odd lengths, nulls and non-finite entries go; null and repeated ids stay, with equal values for equal vectors.
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert {r.n for r in got} == {3} and len({(r.vec_id, r.component, r.whitened) for r in got}) == 6
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        q = whitening.quantised(spark.createDataFrame(rows, schema))
        assert whitening.whiten(q, whitening.fit(q)).count() == 0
    # On a line only one component can be whitened.
    q = whitening.quantised(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema))
    assert {r.component for r in whitening.whiten(q, whitening.fit(q)).collect()} == {1}


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitener(10**9, 2, np.array([10**15, 10**15]), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[10**6, 10**6 + 2], [10**6, 10**6 + 100]])
    assert whitening.deviations(x, model) == [4 * 10**18, None]


# ---------------------------------------------------------------- 13 hard negatives


def brute_negatives(rows, is_anchor):
    clean = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        clean[i] = min(clean.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, v) in clean.items():
        if not is_anchor(a):
            continue
        scored = []
        for i, (other, w) in clean.items():
            if i != a and len(w) == len(v):
                scored.append((-sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, w, strict=True)), i, other))
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out |= {(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(window)}
    return out


def mined(spark, rows, block_bytes=None):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, v string").repartition(3)
    got = hard_negatives.mine(hard_negatives.prepared(df), F.col("vec_id") % 4 == 0, block_bytes).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("block_bytes", [None, 200])
def test_hard_negatives_against_all_pairs(spark, block_bytes):
    r = random.Random(8)
    # Few different values, so that many scores are equal, negative and zero ones among them; a third of the rows has one label.
    rows = [(i - 60, r.choice([0, 0, 1, 2, 3, -4]), [r.randrange(-3, 8) / 8 for _ in range(3)]) for i in range(180)]
    rows += [(500, 1, None), (504, None, [0.5, 0.5, 0.5]), (508, 1, [math.nan, 0.5, 0.5]), (512, 2, [None, 0.5, 0.5]), (None, 1, [0.5, 0.5, 0.5])]
    rows += [(600, 1, [0.5, 0.5]), (601, 1, [0.4, 0.5]), (602, 2, [0.45, 0.5]), (604, 0, []), (605, 1, []), (606, 0, [])]
    rows += [rows[3], rows[3], (rows[4][0], 9, [0.1, 0.1, 0.1])]
    got = mined(spark, rows, block_bytes)
    assert got == brute_negatives([(i, lab, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, lab, v in rows], lambda i: i % 4 == 0)
    assert len(got) > 100


def test_hard_negatives_edges(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(4, 1, [1.0]), (8, 1, [1.0])]) == set()
    # Wide vectors whose products exceed what doubles hold exactly.
    big = [(4, 1, [3e6 + 1, 1.0]), (5, 1, [3e6 + 3, 7.0]), (6, 2, [3e6 + 2, 5.0]), (7, 3, [2.5e6, 5.0])]
    assert mined(spark, big) == brute_negatives([(i, lab, [float(np.float32(c)) for c in v]) for i, lab, v in big], lambda i: i % 4 == 0) != set()
    with pytest.raises(ArithmeticError):
        hard_negatives.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_packed_keys_sort_as_tuples():
    r = random.Random(9)
    keys = [(r.choice([-(2**63), -5, 0, 7, 2**63 - 1]), r.choice([-(2**63), -1, 0, 1, 2**62, 2**63 - 1]), r.choice([0, 1]), r.choice([-3, 0, 9, 2**63 - 1])) for _ in range(300)]
    assert [hard_negatives.unpack(k) for k in sorted(hard_negatives.pack(*k) for k in keys)] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))
    assert hard_negatives.packed(*(np.array([k[i] for k in keys[:20]]) for i in (0, 1)), 1, np.array([k[3] for k in keys[:20]])) == [hard_negatives.pack(k[0], k[1], 1, k[3]) for k in keys[:20]]
