"""Links, keys and identifiers: results on hand-made rows, and plans without the steps that made them slow."""

from pyspark.sql import functions as F

from folioscope.functions import forms
from folioscope.functions import text as T
from folioscope.operators import citations, links
from folioscope.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inline_links_are_numbered_where_they_lie(spark):
    rows = [(1, "b", "x (10.1234/B; 10.1234/a; 10.1234/B)"), (1, "a", "x (10.1234/c)"), (1, "b", "x (10.1234/B; 10.1234/a; 10.1234/B)"), (2, "a", "none"), (None, "a", "x (10.1234/n)")]
    refs, edges = links.inline_links(spark.createDataFrame(rows, "doc_id long, claim_id string, sentence string"))
    assert sorted((r.identifier, r.ref_number) for r in refs.where("doc_id = 1").collect()) == [("10.1234/a", 3), ("10.1234/b", 2), ("10.1234/c", 1)]
    assert sorted(tuple(r) for r in edges.collect()) == [(1, "a", 1), (1, "b", 2), (1, "b", 3)]
    assert "Join" not in plan(edges)


def test_author_year_status_is_counted_without_a_join(spark):
    refs = spark.createDataFrame([(1, "A", 1990), (1, "A", 1990), (1, "B", 1991), (1, None, 1992)], "doc_id long, surname string, year int")
    mentions = spark.createDataFrame([(1, "A", 1990), (1, "B", 1991), (1, "B", 1991), (1, "C", 1990), (1, None, 1992)], "doc_id long, surname string, year int")
    got = citations.author_year_status(mentions, refs)
    want = [("A", 2, "ambiguous"), ("B", 1, "unique"), ("B", 1, "unique"), ("C", 0, "orphan"), ("None", 0, "orphan")]
    assert sorted((str(r.surname), r.matches, r.status) for r in got.collect()) == want and "Join" not in plan(got)


def test_overlaps_take_a_claim_with_its_marker(spark):
    found = plan(catalogue.QUERIES["title_overlap_scores"](spark, "/root/testdata/sf0.001"))
    assert sum("Relation [" in x and "l_orderkey#" in x for x in found.split("\n")) == 2


def test_contexts_and_check_digits_are_generated_code(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(f"{words}  [1] {words}", "[1]"), ("[1]", "[1]"), ("a b", "[1]"), ("a [1]\nb", "[1]"), (None, "[1]"), ("a", None)], "t string, m string")
    got = rows.select(forms.marker_context(F.col("t"), F.col("m")).alias("c"))
    ends = " ".join([*(f"w{i}" for i in range(40, 50)), "[1]", *(f"w{i}" for i in range(30))])
    assert [r.c for r in got.collect()] == [ends, "[1]", "a b", "a [1] b", None, "a"] and "lambda" not in plan(got)
    codes = spark.createDataFrame([("0378-5955",), ("03785954",), ("2434-561x",), ("12",), (None,)], "v string").select(T.issn(F.col("v")).alias("c"))
    assert [r.c for r in codes.collect()] == ["03785955", None, "2434561X", None, None] and "lambda" not in plan(codes)
