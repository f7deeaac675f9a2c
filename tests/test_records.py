"""Matching and merging of records against all pairs, and on hand-made cases."""

import math
import random
import re
from itertools import combinations

import pytest

from folioscope.operators import records
from folioscope.plans import records as RP

REF = "ref_id long, title string, author string, year int, container string, volume string, pages string, doi string"
REC = "rec_id long, title string, author string, year int, container string, volume string, pages string, doi string, kind string"
TITLE = "The slow growth of northern harbour towns"


def decide(spark, ref, *recs):
    return records.decisions(spark.createDataFrame([ref], REF), spark.createDataFrame(list(recs), REC)).first()


def ref(**more):
    return tuple({"ref_id": 1, "title": TITLE, "author": "Abel", "year": 1990, "container": "Annals of Supply", "volume": "3", "pages": "4-9", "doi": None, **more}.values())


def rec(i, **more):
    return tuple({"rec_id": i, "title": TITLE, "author": "Abel", "year": 1990, "container": "Annals of Supply", "volume": "3", "pages": "4-9", "doi": None, "kind": "article", **more}.values())


def test_decisions(spark):
    got = decide(spark, ref(), rec(5), rec(7), rec(6, title="Erratum: " + TITLE))
    assert (got.status, got.rec_id, got.score, got.verdict, got.reasons) == ("matched", 5, 1.0, "confirmed", ["about_another_work"])
    got = decide(spark, ref(doi="10.1/X"), rec(5), rec(8, doi="10.1/x", author="Zuse"))
    assert (got.status, got.rec_id, got.score) == ("identified", 8, 0.75)
    got = decide(spark, ref(doi="10.1/x"), rec(8, doi="10.1/x", title="Something else about other rather distant things"))
    assert (got.status, got.refutations, got.verdict) == ("identifier_mismatch", ["identifier_targets_other_work"], "refuted")
    assert decide(spark, ref(doi="10.1/x"), rec(5, doi="10.1/y", volume="4", pages="1-2"))[1:] == ("not_found", None, None, None, 1, 1, ["volume_and_pages"], ["identifier_not_found"], "refuted")
    got = decide(spark, ref(), rec(5, title=TITLE + " today", container=None), rec(6, title=TITLE + " again", container=None))
    assert (got.status, got.rec_id, got.lead) == ("ambiguous", None, 0.0)
    assert decide(spark, ref(title="Supply"), rec(5, title="Supply", author="Zuse", year=1995)).reasons == ["short_title_other_year"]
    assert decide(spark, ref(title="Second " + TITLE), rec(5, title="Third " + TITLE)).status == "weak"
    assert decide(spark, ref(author="Zárate"), rec(5, author="Ortiz de ZARATE")).score == 1.0
    # Nulls are no evidence and no conflict.
    assert decide(spark, (1, None, None, None, None, None, None, None), rec(5)).status == "not_found"
    assert decide(spark, ref(), (5, None, None, None, None, None, None, None, None), rec(9, author=None, year=None, container=None, volume=None, pages=None)).score == 0.45


def test_no_candidate_is_missed(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(14)] + ["common"] * 6
    title = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 9)))
    refs = [(i, title(), None, None, None, None, None, r.choice([None, f"10.1/{i % 7}"])) for i in range(60)]
    recs = [(i, title(), None, None, None, None, None, r.choice([None, f"10.1/{i % 9}"]), None) for i in range(90)]
    got = {(x.ref_id, x.rec_id) for x in records.profiles(spark.createDataFrame(refs, REF), spark.createDataFrame(recs, REC)).collect()}
    want = set()
    for a in refs:
        for b in recs:
            s, t = set((a[1] or "").split()), set((b[1] or "").split())
            if a[7] and a[7] == b[7] or t and len(s & t) >= math.ceil(0.75 * len(t)):
                want.add((a[0], b[0]))
    assert got == want and len(want) > 50


def test_merged_works_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["One title", "one  TITLE", "Other thing", "", None]), r.choice([None, None, "10.1/a", "10.1/A", "10.1/b"]), r.choice([None, 1990, 1991, 1992, 1995, 1996]), r.choice([None, "v"])) for i in range(70)]
    rows += [(100 + i, f"Lone {i % 20}", r.choice([None, None, f"10.2/{i}"]), 1990 + r.choice([0, 1, 3]), r.choice([None, f"x{i}"])) for i in range(80)]
    fold = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    near = lambda a, b: a is None or b is None or abs(a - b) <= 1
    work = {}
    for i, t, doi, y, _ in rows:
        if not fold(t):
            continue
        found = {o[2].lower() for o in rows if o[2] and fold(o[1]) == fold(t) and near(o[3], y)} if doi is None else {doi.lower()}
        work[i] = (fold(t), found.pop() if len(found) == 1 else None, y, len(found) > 1)
    parent = {i: i for i in work}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(work, 2):
        (k, d, y, _), (l, e, z, _) = work[a], work[b]
        if k == l and d == e and (d is not None or (y is None) == (z is None) and near(y, z)):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {}
    for i in work:
        want.setdefault(find(i), []).append(i)
    values = {x[0]: x[4] for x in rows}
    got = records.works(spark.createDataFrame(rows, "rec_id long, title string, doi string, year int, note string"), ["note"]).collect()
    years = lambda m: [work[i][2] for i in m if work[i][2] is not None]
    assert {(x.rec_id, x.members, x.doi, x.year, x.contested, x.note) for x in got} == {
        (min(m), len(m), work[m[0]][1], min(years(m), default=None), any(work[i][3] for i in m), next((values[i] for i in sorted(m) if values[i] is not None), None)) for m in want.values()
    }
    assert records.works(spark.createDataFrame([], "rec_id long, title string, doi string, year int, note string"), ["note"]).count() == 0


def test_venues(spark):
    from pyspark.sql import functions as F

    from folioscope.operators import venues

    cases = [
        ("Journal of Trade Studies", "J. Trade Stud.", "inconclusive"), ("Annals of Supply & Demand", "ANNALS SUPPLY AND DEMAND", "equal"), ("Zeitschrift für Physik", "Z. Phys.", "inconclusive"),
        ("Journal of Trade Studies", "J. Stud.", "inconclusive"), ("Journal of Trade Studies", "JTS", "inconclusive"), ("Journal of Trade Studies", "Stud. J.", "different"), ("Journal of Trade Studies", "Trade Journal Studies", "different"),
        ("Nature", "Nature Physics", "inconclusive"), ("Nature", "Science", "different"), ("X x x y", "x y y", "different"), ("The of", "Nature", None), (None, "Nature", None), ("Phys. Rev. B", "Physical Review Letters", "different"),
    ]
    got = spark.createDataFrame(cases, "a string, b string, want string").select("a", "b", "want", venues.venue_relation(F.col("a"), F.col("b")).alias("got"), venues.venue_relation(F.col("b"), F.col("a")).alias("back")).collect()
    assert [(r.a, r.b, r.got, r.back) for r in got] == [(r.a, r.b, r.want, r.want) for r in got]


@pytest.mark.parametrize("name", ["record_evidence", "record_decisions", "record_verdicts"])
def test_records_are_made_once(spark, name):
    """The steps that find and judge pairs read what was made of references and records, not the tables again."""
    plan = RP.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_orderkey#" in line for line in plan.split("\n")) == 0


def test_works_read_their_records_once(spark):
    plan = RP.QUERIES["merged_works"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey#" not in plan and "o_orderkey#" not in plan


@pytest.mark.parametrize("step", [records.profiles, records.decisions])
def test_no_table_passes_the_driver_whole(spark, step):
    """Tables that are small on disk are many times as large when the driver builds them for sending out."""
    out = step(spark.createDataFrame([ref(doi="10.1/x")], REF), spark.createDataFrame([rec(5), rec(6, doi="10.1/x")], REC))
    out.collect()
    assert "SortMergeJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastExchange" not in plan
