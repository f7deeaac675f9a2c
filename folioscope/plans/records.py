"""Queries that match cited works with records and merge records of one work. References are the orders, as in `bibliography`;
records are the lineitems, each its order's work as one provider or another has it: whole, cut, late, about it, or another one's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import venues as V
from ..sources.tables import table
from . import bibliography as B

FIELDS = ["author", "container", "volume", "pages"]
_TITLE = f"CASE WHEN k % 29 = 0 THEN 'Trade ' || {B._spell('k - k % 116')} ELSE 'Study of ' || {B._spell('k')} || ' ' || {B._spell('k * 3 + 1')} || ' ' || {B._spell('k * 7 + 5')} || ' and ' || {B._spell('k % 997')} END"
#: Of an order, as a reference. Four orders share a short title, whatever the size of the tables.
REFS = {
    "ref_id": "k", "title": _TITLE, "author": "fam1", "year": "y", "container": "CASE WHEN style = 3 THEN NULL ELSE container END", "volume": "CASE WHEN style = 3 THEN NULL ELSE vol END", "pages": "CASE WHEN style = 3 THEN NULL ELSE p || '-' || q END",
    "doi": "CASE WHEN style > 1 THEN NULL WHEN k % 37 = 0 THEN '10.9999/None.' || CAST(k AS STRING) WHEN k % 41 = 0 THEN '10.' || CAST(1000 + (k + 1) % 9000 AS STRING) || '/ORD.' || CAST(k + 1 AS STRING) || '-' || CAST((k + 1) % 7 AS STRING) ELSE doi END",
}
#: Of a lineitem and its order, as a record.
RECORDS = {
    "rec_id": "k * 1000 + line", "title": f"CASE v WHEN 2 THEN regexp_replace(t, ' and [a-z]+$', '') WHEN 3 THEN 'Erratum to: ' || t WHEN 8 THEN upper(t) WHEN 9 THEN t || ' second' ELSE t END", "author": "CASE v WHEN 6 THEN fam2 WHEN 8 THEN replace(fam1, 'a', 'á') ELSE fam1 END",
    "year": "CASE v WHEN 2 THEN y + 1 WHEN 7 THEN y + 2 WHEN 8 THEN NULL ELSE y END", "container": "CASE WHEN v = 7 THEN 'Bulletin of Harbours' ELSE container END", "volume": "CASE WHEN v = 5 THEN '99' || vol ELSE vol END", "pages": "CASE WHEN v IN (5, 7) THEN '9' || p || '-9' || q ELSE p || '-' || q END",
    "doi": "CASE WHEN v IN (0, 3, 4) THEN doi WHEN v = 6 THEN doi || '.v2' END", "kind": "CASE WHEN v = 4 THEN 'dataset' ELSE 'article' END",
}
_LINE = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT)"


def refs(s: SparkSession, d: str) -> DataFrame:
    return B.made(s, d).selectExpr(*[f"{B.for_spark(e)} AS {n}" for n, e in REFS.items()])


def records(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").selectExpr("l_orderkey", "l_partkey % 10 AS v", f"{_LINE} AS line")
    made = B.made(s, d).selectExpr("k", "style", "fam1", "fam2", "y", "container", "vol", "p", "q", "doi", f"{B.for_spark(_TITLE)} AS t")
    # Merged, as orders that are small on disk would pass the driver whole.
    return lines.join(made.hint("merge"), lines.l_orderkey == made.k).selectExpr(*[f"{e} AS {n}" for n, e in RECORDS.items()])


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return R.profiles(refs(s, d), records(s, d)).drop("work")


def _decided(s: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return R.decisions(refs(s, d), records(s, d)).select("ref_id", "status", "rec_id", "score", "lead", "candidates", "vetoed", joined("reasons"), joined("refutations"), "verdict")


def _health(s: SparkSession, d: str) -> DataFrame:
    return R.decisions(refs(s, d), records(s, d)).groupBy("verdict", "status").agg(F.count(F.lit(1)).alias("refs"), F.round(F.avg("score"), 3).alias("mean_score"))


def _venues(s: SparkSession, d: str) -> DataFrame:
    """Each order's container against a form of it: the same, cut short, without a word, as initials, turned round, or another one's."""
    v, c = F.col("k") % 6, F.col("container")
    words = F.split(c, " ")
    short = F.array_join(F.transform(F.filter(words, lambda w: w != "of"), lambda w: F.concat(F.left(w, F.lit(3)), F.lit("."))), " ")
    turned = F.array_join(F.reverse(words), " ")
    initials = F.array_join(F.transform(F.filter(words, lambda w: w != "of"), lambda w: F.left(w, F.lit(1))), "")
    form = F.when(v == 0, F.upper(c)).when(v == 1, short).when(v == 2, F.substring_index(c, " ", 1)).when(v == 3, F.lit("Bulletin of Harbours")).when(v == 4, initials).otherwise(turned)
    return B.made(s, d).select("k", V.venue_relation(c, form).alias("relation"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "record_evidence": _evidence,
    "record_decisions": _decided,
    "record_verdicts": _health,
    "venue_relations": _venues,
    "merged_works": lambda s, d: R.works(records(s, d), FIELDS),
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


_KEY = "array_to_string(regexp_extract_all(lower(%s), '[a-z0-9]+'), ' ')"
_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce(%s, '')), '[a-z0-9]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in R.EMPTY_WORDS) + "], w))"
_FOLD = r"regexp_replace(strip_accents(lower(%s)), '[^a-z]', '', 'g')"
_BASE = f"""{B._MADE}, refs AS (SELECT {_select(REFS)} FROM made), base AS (SELECT made.*, l.v, l.line, {_TITLE} AS t FROM made JOIN (SELECT l_orderkey, l_partkey % 10 AS v, {_LINE} AS line FROM lineitem) l ON l_orderkey = k),
records AS (SELECT {_select(RECORDS)} FROM (SELECT * EXCLUDE (title) FROM base))"""
_EVIDENCE = rf"""{_BASE}, a AS (SELECT *, lower(doi) AS d, {_TOKENS % 'title'} AS t FROM refs), b AS (SELECT *, lower(doi) AS d, {_TOKENS % 'title'} AS t FROM records),
ta AS (SELECT ref_id, t, unnest(t) AS w FROM a), tb AS (SELECT rec_id, t, unnest(t) AS w FROM b),
c AS (SELECT DISTINCT ref_id, rec_id FROM ta JOIN tb USING (w) WHERE w <> 'study' AND len(list_intersect(ta.t, tb.t)) >= ceil(0.75 * len(tb.t)) UNION SELECT ref_id, rec_id FROM a JOIN b USING (d)),
p AS (SELECT ref_id, rec_id, a.year AS ay, b.year AS byear, a.volume AS av, b.volume AS bv, a.pages AS ap, b.pages AS bp, a.container AS ac, b.container AS bc, b.kind, b.title AS bt, coalesce({_KEY % 'a.title'} = {_KEY % 'b.title'}, false) AS same, least(len(a.t), len(b.t)) < 4 AS short,
  coalesce(contains({_FOLD % 'b.author'}, {_FOLD % 'a.author'}), false) AS author, coalesce(a.year = b.year, false) AS year, coalesce(round(len(list_intersect({_TOKENS % 'a.container'}, {_TOKENS % 'b.container'})) / nullif(len({_TOKENS % 'b.container'}), 0), 3), 0.0) AS venue, coalesce(a.d = b.d, false) AS same_doi,
  CASE WHEN list_contains(a.t, 'second') <> list_contains(b.t, 'second') THEN 0.0 WHEN {_KEY % 'a.title'} = {_KEY % 'b.title'} THEN 1.0 WHEN least(len(a.t), len(b.t)) < 4 THEN 0.0 ELSE round(len(list_intersect(a.t, b.t)) / len(b.t), 3) END AS title
  FROM c JOIN a USING (ref_id) JOIN b USING (rec_id)),
e AS (SELECT ref_id, rec_id, bt, title::DOUBLE AS title, author, year, venue, round(0.45::DOUBLE * title::DOUBLE + 0.25::DOUBLE * author::INT + 0.15::DOUBLE * year::INT + 0.15::DOUBLE * (venue >= 0.5)::INT, 3) AS score, same_doi,
  CASE WHEN starts_with(lower(bt), 'erratum') THEN 'about_another_work' WHEN kind = 'dataset' AND ac IS NOT NULL THEN 'dataset' WHEN av <> bv AND ap <> bp THEN 'volume_and_pages' WHEN venue < 0.5 AND ac <> bc AND ap <> bp THEN 'container_and_pages' WHEN venue < 0.5 AND ac <> bc AND av <> bv THEN 'container_and_volume'
    WHEN same AND short AND ay <> byear AND NOT author THEN 'short_title_other_year' END AS veto, {_KEY % 'bt'} AS work FROM p)"""
_DECIDED = rf"""{_EVIDENCE}, o AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY veto IS NOT NULL, score DESC, same_doi DESC, rec_id) AS i FROM e), f AS (SELECT ref_id, rec_id, score, work FROM o WHERE i = 1 AND veto IS NULL),
g AS (SELECT e.ref_id, max(CASE WHEN veto IS NULL AND e.work <> f.work THEN e.score END) AS nxt, bool_or(same_doi) AS known, max(CASE WHEN same_doi THEN title END) AS own_title, count(*) AS candidates, count(veto) AS vetoed, list_sort(list_distinct(list(veto) FILTER (veto IS NOT NULL))) AS reasons FROM e LEFT JOIN f USING (ref_id) GROUP BY e.ref_id),
own AS (SELECT ref_id, rec_id AS own_rec, score AS own_score FROM e WHERE veto IS NULL AND same_doi AND title >= 0.5 QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, rec_id) = 1),
h AS (SELECT r.ref_id, r.doi, f.rec_id, f.score, round(f.score - coalesce(nxt, 0.0), 3) AS lead, own_rec, own_score, coalesce(known, false) AS known, coalesce(known AND own_title < 0.2, false) AS mismatch, coalesce(candidates, 0) AS candidates, coalesce(vetoed, 0) AS vetoed, coalesce(reasons, []) AS reasons FROM refs r LEFT JOIN g USING (ref_id) LEFT JOIN f USING (ref_id) LEFT JOIN own USING (ref_id)),
s AS (SELECT *, CASE WHEN own_rec IS NOT NULL THEN 'identified' WHEN score >= 0.7 AND lead >= 0.05 THEN 'matched' WHEN mismatch THEN 'identifier_mismatch' WHEN score >= 0.7 THEN 'ambiguous' WHEN score >= 0.5 THEN 'weak' ELSE 'not_found' END AS status FROM h),
v AS (SELECT ref_id, status, CASE status WHEN 'identified' THEN own_rec WHEN 'matched' THEN rec_id END AS rec_id, CASE WHEN status = 'identified' THEN own_score ELSE score END AS score, lead, candidates, vetoed, array_to_string(reasons, ',') AS reasons,
  concat_ws(',', CASE WHEN doi IS NOT NULL AND NOT known THEN 'identifier_not_found' END, CASE WHEN mismatch THEN 'identifier_targets_other_work' END) AS refutations, CASE WHEN status IN ('identified', 'matched') THEN 'confirmed' WHEN doi IS NOT NULL AND NOT known OR mismatch THEN 'refuted' ELSE 'unproven' END AS verdict FROM s)"""
_FIRST = ", ".join(f"arg_min({f}, rec_id) FILTER ({f} IS NOT NULL) AS {f}" for f in FIELDS)
_WORKS = rf"""{_BASE}, r AS (SELECT rec_id, {_KEY % 'title'} AS key, year, lower(doi) AS doi, author, container, volume, pages FROM records),
near AS (SELECT l.rec_id, min(o.doi) AS d0, max(o.doi) AS d1 FROM r l JOIN r o ON l.key = o.key AND o.doi IS NOT NULL AND (l.year IS NULL OR o.year IS NULL OR abs(l.year - o.year) <= 1) WHERE l.doi IS NULL GROUP BY l.rec_id),
m AS (SELECT r.*, coalesce(r.doi, CASE WHEN d0 = d1 THEN d0 END) AS own, coalesce(d0 <> d1, false) AS contested FROM r LEFT JOIN near USING (rec_id)),
g AS (SELECT *, CASE WHEN own IS NULL AND year IS NOT NULL AND (lag(year) OVER w IS NULL OR year - lag(year) OVER w > 1) THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY key, own IS NULL AND year IS NOT NULL ORDER BY year)),
n AS (SELECT *, CASE WHEN own IS NULL AND year IS NOT NULL THEN sum(new) OVER (PARTITION BY key, own IS NULL AND year IS NOT NULL ORDER BY year) ELSE 0 END AS run FROM g)
SELECT key, own AS doi, min(rec_id) AS rec_id, count(*) AS members, min(year) AS year, max(year) - min(year) AS years_apart, bool_or(contested) AS contested, {_FIRST} FROM n GROUP BY key, own, run"""

ORACLE_SQL: dict[str, str] = {
    "record_evidence": f"WITH {_EVIDENCE} SELECT ref_id, rec_id, title, author, year, venue, score, same_doi, veto FROM e",
    "record_decisions": f"WITH {_DECIDED} SELECT * FROM v",
    "record_verdicts": f"WITH {_DECIDED} SELECT verdict, status, count(*) AS refs, round(avg(score), 3) AS mean_score FROM v GROUP BY verdict, status",
    "venue_relations": "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'equal' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'inconclusive' WHEN 4 THEN 'inconclusive' ELSE 'different' END AS relation FROM orders",
    "merged_works": f"WITH {_WORKS}",
}
