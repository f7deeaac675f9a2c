"""Queries of links without an exact match, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import links as K
from ..sources.tables import table

MANUSCRIPT = "ab" * 32


def _made(s, d):
    return C.constructed(*(table(s, d, t) for t in ("orders", "lineitem", "part", "supplier")))


def _orphans(s, d):
    """Mentions of all entries, with a letter of the name lost; for entries of even number the year is one late."""
    late = (F.col("ref_number") % 2 == 0).cast("int")
    return _made(s, d)[1].select("doc_id", F.expr("overlay(surname placing '' from 3 for 1)").alias("surname"), (F.col("year") + late).alias("year")).distinct()


def orphans(s, d):
    return K.orphan_candidates(_orphans(s, d), _made(s, d)[1])


def uncited(s, d):
    claims, refs = _made(s, d)
    gone = C.uncited(claims, refs).join(refs, ["doc_id", "ref_number"]).select("doc_id", "ref_number", F.regexp_extract("title", r"^(\S+)", 1).alias("surname"))
    return K.uncited_candidates(gone, claims)


def _inline(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    doi = F.concat(F.lit("10.1234/Ab."), F.col("l_partkey") % 50)
    text = F.concat(F.lit("As was shown (see "), doi, F.when(F.col("l_suppkey") % 2 == 0, "; arXiv: 2101.00001)").otherwise("), not 10.9999/outside"), F.lit("."))
    return K.inline_links(li.select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), text.alias("sentence")))


def _keys(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    marker = F.concat(F.lit("["), F.col("l_linenumber"), F.lit("]"))
    identity = K.reference_identity(F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Entry  No "), F.col("l_partkey"))), F.when(F.col("l_partkey") % 3 == 1, F.lit("Name")), F.lit(None), F.lit(None), F.concat(F.lit("10.1/"), F.col("l_partkey")))
    rows = li.select(identity.alias("identity"), marker.alias("marker"), F.concat(F.lit("The  claim of supplier "), F.col("l_suppkey"), F.lit(" is shown "), marker, F.lit(" here and there.")).alias("sentence"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"))
    return K.pair_keys(rows, F.lit(MANUSCRIPT)).select("ordinal.*", "identity", "key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "orphan_candidates": orphans,
    "uncited_candidates": uncited,
    "inline_references": lambda s, d: _inline(s, d)[0],
    "inline_edges": lambda s, d: _inline(s, d)[1],
    "marker_counts": lambda s, d: C.markers(_made(s, d)[0]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("markers"), F.countDistinct("ref_number").alias("numbers")),
    "pair_keys": _keys,
}

_LI = "li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"
_INLINE = f"""{_LI}, uses AS (SELECT l_orderkey AS doc_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS claim_id, 0 AS at0, '10.1234/ab.' || l_partkey % 50 AS identifier FROM li
  UNION ALL SELECT l_orderkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey), 1, 'arxiv:2101.00001' FROM li WHERE l_suppkey % 2 = 0),
refs AS (SELECT doc_id, identifier, row_number() OVER (PARTITION BY doc_id ORDER BY f, identifier) AS ref_number FROM (SELECT doc_id, identifier, min(struct_pack(c := claim_id, a := at0)) AS f FROM uses GROUP BY ALL))"""
ORACLE_SQL: dict[str, str] = {
    "inline_references": f"WITH {_INLINE} SELECT * FROM refs",
    "inline_edges": f"WITH {_INLINE} SELECT DISTINCT doc_id, claim_id, ref_number FROM uses JOIN refs USING (doc_id, identifier)",
    "marker_counts": "SELECT l_orderkey AS doc_id, count(*) AS markers, count(DISTINCT l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 7 ELSE 0 END) AS numbers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "pair_keys": f"""WITH {_LI}, i AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'entry:entry no ' || l_partkey WHEN 1 THEN 'identity:name|||' ELSE 'doi:10.1/' || l_partkey END AS identity, '[' || l_linenumber || ']' AS marker,
  'The claim of supplier ' || l_suppkey || ' is shown [' || l_linenumber || '] here and there.' AS sentence FROM li), k AS (SELECT *, 'S' || substr(sha256(concat_ws(chr(31), '{MANUSCRIPT}', identity, marker, sentence, sentence)), 1, 24) AS base FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, identity, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '@' || row_number() OVER (PARTITION BY base ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) ELSE base END AS key FROM k""",
}
