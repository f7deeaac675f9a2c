"""Queries over bibliographies: an entry for each order, a document for each customer. The tables hold no bibliographies, so their
lines are built from the orders' columns, then wrapped, hyphenated and mixed with page numbers; the SQL has the entries and fields
as they were before that."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authoryear as A
from ..operators import bibliography as B
from ..operators import styles as Y
from ..sources.tables import settle, table

_SYLLABLES = ("ba", "ke", "li", "mo", "nu", "pe", "ra", "si", "to", "vu")
_TAIL = " ".join(["and further words of the section after it"] * 40)


#: What Spark evaluates in place of the SQL that spells a number, by that SQL.
_BY_DIGITS: dict[str, str] = {}


def _spell(n: str) -> str:
    sql = reduce(lambda e, i: f"replace({e}, '{i}', '{_SYLLABLES[i]}')", range(10), f"CAST({n} AS STRING)")
    _BY_DIGITS[sql] = f"array_join(transform(split(CAST({n} AS STRING), ''), c -> coalesce(get(array{_SYLLABLES}, try_cast(c AS INT)), c)), '')"
    return sql


def for_spark(e: str) -> str:
    """The expression with numbers spelled digit by digit: so many nested replacements make code too long to be compiled to machine code."""
    return reduce(lambda e, sql: e.replace(sql, _BY_DIGITS[sql]), _BY_DIGITS, e)


def _name(n: str) -> str:
    return f"(upper(substr({_spell(n)}, 1, 1)) || substr({_spell(n)}, 2))"


def _initial(n: str) -> str:
    return f"chr(CAST(65 + ({n}) % 26 AS INT))"


def _pick(n: str, *values: str) -> str:
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Columns of an entry, stage by stage, in SQL that Spark and others share.
STAGES: list[dict[str, str]] = [
    {"doc_id": "o_custkey", "k": "o_orderkey", "y": "CAST(year(o_orderdate) AS INT)", "layout": "o_custkey % 4", "i": "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT)", "size": "CAST(count(*) OVER (PARTITION BY o_custkey) AS INT)"},
    {
        "style": "CASE WHEN k % 5 = 4 AND layout IN (1, 3) THEN 0 ELSE k % 5 END", "na": "CAST(k % 3 + 1 AS INT)", "fam1": f"CASE WHEN k % 11 = 0 THEN {_name('1 + k % 9')} || '-' || {_name('10 + k % 5')} ELSE {_name('10 + k * 7 % 37')} END", "fam2": _name("100 + k * 11 % 389"), "fam3": _name("500 + k * 13 % 283"),
        "x1": _initial("k"), "x2": _initial("k * 3"), "x3": _initial("k * 5 + 1"), "title": f"'Models of ' || {_spell('k')} || ' supply and ' || {_spell('k * 3 + 1')} || ' demand for priority ' || lower(substr(o_orderpriority, 3))",
        "container": _pick("k", "Journal of Trade Studies", "Annals of Supply", "Review of Market Orders", "Transport Letters"), "vol": "CAST(k % 90 + 1 AS STRING)", "iss": "CAST(k % 12 + 1 AS STRING)", "p": "CAST(k % 800 + 1 AS STRING)", "q": "CAST(k % 800 + k % 40 + 4 AS STRING)",
        "doi": "'10.' || CAST(1000 + k % 9000 AS STRING) || '/ord.' || CAST(k AS STRING) || '-' || CAST(k % 7 AS STRING)", "place": _pick("k", "Lisbon", "Oslo", "Vienna"), "publisher": _pick("k", "Harbour Press", "North Press"),
        "suffix": "CASE WHEN k % 6 = 0 AND k % 5 IN (0, 3) THEN 'a' ELSE '' END", "pages": "CASE WHEN k % 23 = 0 THEN CAST(k % 800 + k % 40 + 4 AS STRING) || '-' || CAST(k % 800 + 1 AS STRING) ELSE CAST(k % 800 + 1 AS STRING) || '-' || CAST(k % 800 + k % 40 + 4 AS STRING) END",
    },
    {
        "long": "fam1 || ', ' || x1 || '.' || CASE na WHEN 1 THEN '' WHEN 2 THEN ', & ' || fam2 || ', ' || x2 || '.' ELSE ', ' || fam2 || ', ' || x2 || '., & ' || fam3 || ', ' || x3 || '.' END", "short": "fam1 || ' ' || x1 || CASE WHEN na > 1 THEN ', ' || fam2 || ' ' || x2 ELSE '' END || CASE WHEN na > 2 THEN ', ' || fam3 || ' ' || x3 ELSE '' END",
        "parted": "fam1 || ', ' || x1 || '.' || CASE WHEN na > 1 THEN '; ' || fam2 || ', ' || x2 || '.' ELSE '' END || CASE WHEN na > 2 THEN '; ' || fam3 || ', ' || x3 || '.' ELSE '' END",
        "pair": "fam1 || ' v. ' || fam2", "names": "fam1 || CASE WHEN na = 1 THEN '' WHEN na = 2 THEN ' and ' || fam2 ELSE ' et al.' END", "cited": "CASE WHEN k % 17 = 0 THEN y + 1 ELSE y END", "noted": "CASE WHEN k % 12 = 0 THEN suffix ELSE '' END",
        "tail": "CASE WHEN layout IN (0, 2) AND k % 9 = 4 THEN ' See 293 (2203-2209) too.' ELSE '' END", "bled": "layout = 1 AND size >= 3 AND i = size",
    },
    {
        "clean": "CASE style WHEN 0 THEN long || ' (' || CAST(y AS STRING) || suffix || '). ' || title || '. ' || container || ', ' || vol || '(' || iss || '), ' || pages || '. https://doi.org/' || doi"
        " WHEN 1 THEN short || '. ' || title || '. ' || container || '. ' || CAST(y AS STRING) || ';' || vol || '(' || iss || '):' || pages || '. doi:' || doi || '.' WHEN 2 THEN parted || ' ' || title || '. ' || container || ' ' || CAST(y AS STRING) || ', ' || vol || ', ' || pages || '.'"
        " WHEN 3 THEN long || ' (' || CAST(y AS STRING) || suffix || '). ' || title || '. ' || place || ': ' || publisher || '.' ELSE pair || ', ' || vol || ' F.3d ' || p || ' (' || CAST(y AS STRING) || ').' END || tail",
        "sentence": "CASE WHEN k % 2 = 0 THEN 'This was shown by ' || CASE WHEN k % 22 = 0 THEN replace(names, '-', '') ELSE names END || ' (' || CAST(cited AS STRING) || noted || ') for some goods.' ELSE 'This holds for some goods (' || names || ', ' || CAST(cited AS STRING) || noted || '; see the annex).' END",
    },
]


def made(s: SparkSession, d: str) -> DataFrame:
    """All orders with the columns of STAGES."""
    out = table(s, d, "orders")
    for stage in STAGES:
        out = out.withColumns({f"__{n}" if n in out.columns else n: F.expr(for_spark(e)) for n, e in stage.items()})
    return out


def bibliographies(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): each customer's entries as wrapped lines: some numbered, some with words, pages and identifiers cut at the line's end."""
    k = F.col("k")
    full = F.concat(F.col("clean"), F.when(F.col("bled"), F.lit(" " + _TAIL)).otherwise(""))
    t = F.regexp_replace(full, r"(.{1,58})(?: +|$)", "$1\n")
    for when, what, by in ((k % 3 == 0, "/ord.", "/ord.\n"), (k % 6 == 1, "https://doi.org/10.", "https://doi.org/\n10."), (k % 4 == 1, " supply ", " sup-\nply "), (k % 2 == 0, "2203-2209)", "2203-\n2209)")):
        t = F.when(when, F.replace(t, F.lit(what), F.lit(by))).otherwise(t)
    t = F.concat(F.when(F.col("layout") == 0, F.concat(F.lit("["), "i", F.lit("] "))).when(F.col("layout") == 2, F.concat("i", F.lit(". "))).otherwise(""), t, F.when(k % 10 == 3, "- 14 -\n\n").otherwise(""))
    return made(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", t.alias("t")))), lambda x: x["t"]), "").alias("text"))


def _read(s: SparkSession, d: str) -> DataFrame:
    return B.read_entries(B.entries(bibliographies(s, d)))


def _fields(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d).select("doc_id", "n", "status", "reader", F.array_join("reasons", ",").alias("reasons"), F.array_join("authors", "; ").alias("authors"), *B.FIELDS[1:], B.kind_of(F.col("raw"), F.col("doi")).alias("kind"))


def _cites(s: SparkSession, d: str) -> DataFrame:
    return A.citations(made(s, d).select("doc_id", F.col("k").alias("claim_id"), "sentence"))


def _matched(s: SparkSession, d: str) -> DataFrame:
    return A.match(_cites(s, d), A.index(_read(s, d)))


def _shown(m: DataFrame) -> DataFrame:
    return m.select("doc_id", "claim_id", "surname", "year", "status", "n", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    """A reader chose, for each citation, the entry of its own order."""
    chosen = made(s, d).select("doc_id", F.col("k").alias("claim_id"), F.lit(0).alias("place"), F.col("i").alias("choice"))
    return A.resolved(_matched(s, d), chosen).groupBy("status").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("doc_id").alias("documents"))


def _coverage(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, entries, cited, orphans): what a document's citations reach of its entries."""
    # Made once: entries are matched and counted.
    read = settle(_read(s, d).select("doc_id", "n", "raw", "authors", "year"))
    m = A.match(_cites(s, d), A.index(read)).groupBy("doc_id").agg(F.countDistinct(F.when(F.col("status") == "unique", F.col("n"))).alias("cited"), F.count_if(F.col("status") == "orphan").alias("orphans"))
    return read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries")).join(m, "doc_id", "left").select("doc_id", "entries", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("orphans", F.lit(0)).alias("orphans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "reference_entries": lambda s, d: B.entries(bibliographies(s, d)),
    "reference_fields": _fields,
    "style_scores": lambda s, d: Y.style_scores(B.entries(bibliographies(s, d))),
    "detected_styles": lambda s, d: Y.detected_styles(B.entries(bibliographies(s, d))),
    "authoryear_citations": lambda s, d: _cites(s, d).select("doc_id", "claim_id", "surname", F.array_join("others", ",").alias("others"), "et_al", "year", "suffix"),
    "authoryear_matches": lambda s, d: _shown(_matched(s, d)),
    "authoryear_resolved": _resolved,
    "authoryear_coverage": _coverage,
}


def _made_sql() -> str:
    return reduce(lambda q, stage: f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM ({q})", STAGES, "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")


_MADE = f"made AS ({_made_sql()})"
_ENTRIES = rf"""{_MADE}, ent AS (
  SELECT *, bled AND style IN (0, 1, 3) AS cut, CASE WHEN bled THEN CASE WHEN style = 2 THEN clean || ' {_TAIL}' ELSE rtrim(substr(clean || ' {_TAIL}', 1, CAST(length(clean) + CASE WHEN style = 3 THEN 19 ELSE 20 END AS INT))) END ELSE clean END AS raw FROM made)"""
_FIELDS = rf"""{_ENTRIES}, f AS (
  SELECT *, CASE WHEN tail <> '' OR bled THEN 'generic' WHEN style < 3 AND k % 23 = 0 AND length(p) = length(q) THEN 'refused' ELSE 'parsed' END AS status, list_distinct(regexp_extract_all(raw, '\b((?:1[5-9]|20)[0-9]{{2}})\b', 1)) AS years, nullif(regexp_extract(raw, '10\.[0-9]{{4,9}}/\S*[^\s.,;]'), '') AS found FROM ent)"""
_MATCHED = rf"""{_MADE}, c AS (
  SELECT doc_id, k AS claim_id, CASE WHEN k % 22 = 0 THEN replace(fam1, '-', '') ELSE fam1 END AS surname, CASE WHEN na = 2 THEN fam2 END AS other, na = 3 AS et_al, cited AS year, noted AS suffix FROM made),
e AS (SELECT doc_id, i AS n, style, fam1, CASE WHEN style = 4 THEN NULL ELSE lower(fam1) END AS f1, lower(fam2) AS f2, CASE WHEN tail <> '' OR bled OR style < 3 AND k % 23 = 0 AND length(p) = length(q) THEN 1 ELSE na END AS na, CASE WHEN style IN (0, 3) THEN suffix ELSE '' END AS own,
  CASE WHEN (tail <> '' OR bled) AND style IN (1, 2) AND len(list_distinct(regexp_extract_all(clean, '\b((?:1[5-9]|20)[0-9]{{2}})\b', 1))) <> 1 OR style IN (1, 2) AND tail = '' AND NOT bled AND k % 23 = 0 AND length(p) = length(q) THEN NULL ELSE y END AS y FROM made),
j AS (SELECT c.*, e.n, e.na, e.own, other IS NOT NULL AND e.na > 1 AND e.f2 = lower(other) AS with_all, lower(c.surname) = e.f1 OR lower(c.surname) = replace(e.f1, '-', '') AS direct FROM c JOIN e ON c.doc_id = e.doc_id AND c.year = e.y AND replace(lower(c.surname), '-', '') = replace(e.f1, '-', '')),
t AS (SELECT * FROM (SELECT *, bool_or(direct) OVER (PARTITION BY claim_id) AS any_direct FROM j) WHERE direct = any_direct AND (suffix = '' OR suffix = own)),
g AS (SELECT *, count(*) OVER w AS size, count(*) FILTER (with_all) OVER w AS named FROM t WINDOW w AS (PARTITION BY claim_id)),
r AS (SELECT *, named = 0 OR with_all AS inn, CASE WHEN et_al THEN na >= 3 ELSE na = CASE WHEN other IS NULL THEN 1 ELSE 2 END END AS strict, (na > 1) = (et_al OR other IS NOT NULL) AS coarse FROM g),
s AS (SELECT *, count(*) FILTER (inn AND strict) OVER w AS n_strict, count(*) FILTER (inn AND coarse) OVER w AS n_coarse FROM r WINDOW w AS (PARTITION BY claim_id)),
b AS (SELECT claim_id, max(CASE WHEN size = 1 THEN n WHEN suffix <> '' THEN NULL WHEN named = 1 THEN CASE WHEN with_all THEN n END WHEN n_strict = 1 THEN CASE WHEN inn AND strict THEN n END WHEN n_coarse = 1 AND inn AND coarse THEN n END) AS n, list_sort(list(n) FILTER (inn OR suffix <> '')) AS all_n FROM s GROUP BY claim_id),
m AS (SELECT c.doc_id, c.claim_id, c.surname, c.year, CASE WHEN b.n IS NOT NULL THEN 'unique' WHEN len(all_n) > 0 THEN 'ambiguous' ELSE 'orphan' END AS status, b.n, CASE WHEN b.n IS NOT NULL THEN [b.n] ELSE coalesce(all_n, []) END AS candidates FROM c LEFT JOIN b USING (claim_id))"""

def _score_sql(style: str) -> str:
    quoted = {f: p.replace("'", "''") for f, p in Y.FEATURES.items()}
    sums = " + ".join("CASE WHEN " + " AND ".join([*(f"regexp_matches(raw, '{quoted[f]}')" for f in needs), *(f"NOT regexp_matches(raw, '{quoted[f]}')" for f in bars)]) + f" THEN {w} ELSE 0.0 END" for s, w, needs, bars in Y.WEIGHTS if s == style)
    changed = "mean"
    for mode, changes in (("numbered", Y.BY_NUMBER), ("dated", Y.BY_NAME)):
        if style in changes:
            factor, more, least = changes[style]
            changed = f"CASE WHEN mode = '{mode}' THEN round(mean * {factor} + CASE WHEN mean >= {least} THEN {more} ELSE 0.0 END, 3) ELSE {changed} END"
    return f"SELECT doc_id, '{style}' AS style, {changed} AS score FROM (SELECT doc_id, mode, round(avg(({sums})::DOUBLE), 3) AS mean FROM g GROUP BY ALL)"


_STYLES = f"""{_ENTRIES}, g AS (SELECT doc_id, CASE WHEN layout IN (0, 2) THEN 'numbered' ELSE 'dated' END AS mode, raw FROM ent), u AS ({" UNION ALL ".join(map(_score_sql, Y.STYLES))}),
ranked AS (SELECT doc_id, style, score, row_number() OVER w AS rank, round(score - lead(score) OVER w, 3) AS ahead FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, style))"""

ORACLE_SQL: dict[str, str] = {
    "style_scores": f"WITH {_STYLES} SELECT doc_id, style, score, rank FROM ranked",
    "detected_styles": f"WITH {_STYLES} SELECT doc_id, style, score, ahead AS lead, CASE WHEN score >= 1.5 AND ahead >= 0.6 THEN 'high' WHEN score >= 0.8 AND ahead >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE rank = 1",
    "reference_entries": f"WITH {_ENTRIES} SELECT doc_id, i AS n, CASE WHEN layout IN (0, 2) THEN 'numbered' ELSE 'dated' END AS mode, raw, cut FROM ent",
    "reference_fields": f"""WITH {_FIELDS} SELECT doc_id, i AS n, status, CASE status WHEN 'generic' THEN 'generic' WHEN 'parsed' THEN ['dated_journal', 'short_names', 'semicolons', 'dated_book', 'case'][style + 1] END AS reader, CASE WHEN status = 'refused' THEN 'pages' ELSE '' END AS reasons,
  CASE WHEN status = 'parsed' THEN CASE style WHEN 4 THEN '' WHEN 1 THEN replace(short, ', ', '; ') ELSE parted END END AS authors, CASE status WHEN 'parsed' THEN y WHEN 'generic' THEN CASE WHEN len(years) = 1 THEN years[1]::INT END END AS year, CASE WHEN status = 'parsed' THEN CASE style WHEN 4 THEN pair ELSE title END END AS title,
  CASE WHEN status = 'parsed' THEN CASE style WHEN 4 THEN 'F.3d' WHEN 3 THEN NULL ELSE container END END AS container, CASE WHEN status = 'parsed' AND style <> 3 THEN vol END AS volume, CASE WHEN status = 'parsed' AND style < 2 THEN iss END AS issue, CASE WHEN status = 'parsed' THEN CASE style WHEN 3 THEN NULL WHEN 4 THEN p ELSE pages END END AS pages,
  CASE WHEN status = 'parsed' AND style = 3 THEN place END AS place, CASE WHEN status = 'parsed' AND style = 3 THEN publisher END AS publisher, CASE WHEN status = 'parsed' AND style < 2 THEN doi WHEN status = 'generic' THEN found END AS doi,
  CASE WHEN style < 2 THEN 'article' WHEN style = 2 THEN CASE WHEN status = 'generic' THEN 'unknown' ELSE 'article' END WHEN style = 3 THEN 'book' ELSE 'case' END AS kind FROM f""",
    "authoryear_citations": f"WITH {_MADE} SELECT doc_id, k AS claim_id, CASE WHEN k % 22 = 0 THEN replace(fam1, '-', '') ELSE fam1 END AS surname, CASE WHEN na = 2 THEN fam2 ELSE '' END AS others, na = 3 AS et_al, cited AS year, noted AS suffix FROM made",
    "authoryear_matches": f"WITH {_MATCHED} SELECT doc_id, claim_id, surname, year, status, n, array_to_string(candidates, ',') AS candidates FROM m",
    "authoryear_resolved": f"WITH {_MATCHED}, z AS (SELECT m.doc_id, CASE WHEN status = 'ambiguous' AND list_contains(candidates, i) THEN 'chosen' ELSE status END AS status FROM m JOIN made ON claim_id = k) SELECT status, count(*) AS citations, count(DISTINCT doc_id) AS documents FROM z GROUP BY status",
    "authoryear_coverage": f"WITH {_MATCHED}, n AS (SELECT doc_id, count(*) AS entries FROM made GROUP BY doc_id), x AS (SELECT doc_id, count(DISTINCT CASE WHEN status = 'unique' THEN n END) AS cited, count(*) FILTER (status = 'orphan') AS orphans FROM m GROUP BY doc_id) SELECT doc_id, entries, coalesce(cited, 0) AS cited, coalesce(orphans, 0) AS orphans FROM n LEFT JOIN x USING (doc_id)",
}
