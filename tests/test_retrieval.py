"""Budgeted contexts and span look-up against plain replays."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import retrieval, texts
from folioscope.plans import catalogue


def replay(spans, query, budget, top_k, neighbours):
    """Places chosen of a document's spans (texts in order)."""
    tokens = [re.findall(r"[^\W_]+", t.lower()) for t in spans]
    terms, n = set(re.findall(r"[^\W_]+", query.lower())), len(spans)
    mean = sum(map(len, tokens)) / n
    scored = []
    for i, t in enumerate(tokens):
        s = 0.0
        for w in terms:
            if tf := t.count(w):
                df = sum(w in x for x in tokens)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        if s > 0:
            scored.append((-round(s, 9), i))
    size = lambda c: sum(len(spans[p]) for p in c) + 2 * max(0, sum(p - 1 not in c for p in c) - 1)
    chosen = set()
    for _, i in sorted(scored)[:top_k]:
        for more in (set(range(max(0, i - neighbours), min(n, i + neighbours + 1))), {i}):
            if size(chosen | more) <= budget:
                chosen |= more
                break
    return chosen


def test_contexts_against_a_replay(spark):
    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(40)]
    rows = [(d, " ".join(r.choice(vocabulary) + r.choice(["", "", ".", "!\n\n"]) for _ in range(r.randrange(5, 260)))) for d in range(30)]
    rows += [(90, None), (91, ""), (92, "nothing of it. " * 60), (93, "x" * 700 + " word1 " + "y" * 700), (94, "word1. " * 100)]
    queries = [(d, " ".join(r.sample(vocabulary, 4))) for d in range(30)] + [(90, "word1"), (91, "word1"), (92, "word1"), (93, "word1"), (94, "?!"), (95, "word1")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "doc_id long, query string")
    catalogue = texts.spans(docs)
    parts = {}
    for x in catalogue.orderBy("doc_id", "pos").collect():
        parts.setdefault(x.doc_id, []).append((x.text, x.start, x.finish))
    for budget, top_k, neighbours in ((300, 6, 1), (120, 3, 2), (500, 2, 0)):
        found = retrieval.contexts(docs, catalogue, asked, budget, top_k, neighbours)
        got = {x.doc_id: x for x in found.collect()}
        assert set(got) == {d for d, t in rows if t}
        for d, t in rows[:30]:
            if len(t) <= budget:
                assert (got[d].mode, got[d].context, got[d].status) == ("full_text", t, "ready")
                continue
            chosen = replay([x[0] for x in parts[d]], dict(queries)[d], budget, top_k, neighbours)
            runs = []
            for p in sorted(chosen):
                if runs and runs[-1][1] == parts[d][p][1]:
                    runs[-1][1] = parts[d][p][2]
                else:
                    runs.append([parts[d][p][1], parts[d][p][2]])
            if runs:
                assert [[x.start, x.finish] for x in got[d].ranges] == runs
                assert got[d].context == "\n\n".join(t[a:b] for a, b in runs) and got[d].chars <= budget
                assert got[d].context_hash == hashlib.sha256(got[d].context.encode()).hexdigest()
        assert {x.fault for x in retrieval.context_faults(found, docs, budget).collect()} == {None}
    assert (got[92].status, got[93].status, got[94].status) == ("no_match", "over_budget", "empty_query")
    bad = lambda c, e: {x.fault for x in retrieval.context_faults(found.withColumn(c, e), docs, 500).where("fault is not null").collect()}
    assert bad("source_hash", F.lit("x")) == {"source"} and bad("context", F.concat("context", F.lit("."))) == {"content"} and bad("ranges", F.transform("ranges", lambda x: F.struct(x["finish"].alias("start"), x["start"].alias("finish")))) == {"ranges"}


def test_visible_spans_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(d, "".join(r.choice(["ab", ". ", "\n\n", "c" * 900, "! "]) for _ in range(40))) for d in range(6)]
    catalogue = texts.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    chunks = [(d, i, a := r.randrange(len(t)), min(len(t), a + r.choice([0, 1, 50, 3000, 9000]))) for d, t in rows for i in range(12)]
    got = {(x.doc_id, x.chunk, x.pos): (x.start, x.finish, x.text) for x in retrieval.visible_spans(catalogue, spark.createDataFrame(chunks, "doc_id long, chunk int, start int, finish int")).collect()}
    want = {}
    for x in catalogue.collect():
        for d, i, a, b in chunks:
            if d == x.doc_id and max(a, x.start) < min(b, x.finish):
                want[d, i, x.pos] = (lo := max(a, x.start), hi := min(b, x.finish), dict(rows)[d][lo:hi])
    assert got == want


def test_passages_and_contiguous(spark):
    catalogue = spark.createDataFrame([("a", "One. "), ("b", "Two."), ("b", "Two.")], "span_id string, text string")
    wanted = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "x"), (2, 1, "a")], "list_id int, i int, span_id string")
    assert sorted(map(tuple, retrieval.passages(catalogue, wanted).collect())) == [(1, "Two.One. Two.", 0), (2, "One. ", 1)]
    chosen = [(1, 7, 5, 9), (1, 7, 0, 5), (2, 7, 0, 5), (2, 7, 6, 9), (3, 7, 0, 5), (3, 7, 4, 9), (4, 7, 0, 5), (4, 8, 5, 9)]
    got = retrieval.contiguous(spark.createDataFrame(chosen, "list_id int, doc_id int, start int, finish int")).orderBy("list_id").collect()
    assert [tuple(x) for x in got] == [(1, 0, 9, None), (2, None, None, "gap"), (3, None, None, "overlap"), (4, None, None, "documents")]


@pytest.mark.parametrize(("name", "most"), [("bm25_topk", 0), ("ranked_chunks", 2), ("budgeted_contexts", 2), ("context_faults", 3)])
def test_how_often_texts_are_read(spark, name, most):
    """Texts are cut into tokens, chunks and spans once, whatever the number of steps that use these."""
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "n_chars#" in line for line in plan.split("\n")) <= most
