"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..operators import documents as D
from ..operators import ledger as L
from ..operators import pages as P
from ..operators import relational as R
from ..sources.tables import settle, table
from . import bibliography, links, records, relational, runs, texts

KINDS = ["click", "error", "purchase", "signup", "view"]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _events(spark, d):
    return table(spark, d, "events")


def _made(spark, d):
    return C.constructed(*(table(spark, d, t) for t in ("orders", "lineitem", "part", "supplier")))


def _statuses(spark, d):
    refs = settle(_made(spark, d)[1].select("doc_id", "ref_number", "surname", "year"))
    return C.author_year_status(_mentions(refs), refs)


def _mentions(refs):
    year = F.when(F.col("ref_number") % 2 == 0, F.col("year")).otherwise(F.col("year") + 1)
    return refs.select("doc_id", "surname", year.alias("year")).distinct()


def _rated(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", "quality", (F.col("n_chars") >= 1000).cast("int").alias("long_enough"))


def _overlaps(spark, d):
    claims, refs = _made(spark, d)
    m = C.markers(claims, "sentence").join(refs, ["doc_id", "ref_number"])
    return C.title_overlap(m, "title", "sentence").select("doc_id", "claim_id", "ref_number", "overlap", "flag").distinct()


def _codes(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    digits = F.lpad(F.col("l_partkey").cast("string"), 7, "0")
    span = F.concat_ws("-", F.col("l_partkey") + 100, F.col("l_suppkey") % 100)
    spec = F.concat(F.lit("1,3,"), F.col("l_linenumber"), F.lit("-"), F.col("l_linenumber") + 2)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.page_range_end(span).alias("last_page"), F.array_join(T.expand_numbers(spec).cast("array<string>"), " ").alias("numbers"), T.issn(F.concat(digits, (F.col("l_suppkey") % 10).cast("string"))).alias("issn"))


def _shipped(spark, d):
    """Orders as the line items tell them: those with an item, `X` where nothing was returned."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_returnflag") == "N", "X").otherwise(F.max("l_linestatus")).alias("o_orderstatus"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "claim_support_rollup": lambda s, d: D.support_rollup(_docs(s, d), table(s, d, "benchmark")),
    "exact_grounding": lambda s, d: D.ground_exact(_docs(s, d), table(s, d, "benchmark")),
    "sentence_windows": lambda s, d: D.sentence_windows(_docs(s, d)),
    "chunk_windows": lambda s, d: D.chunk_windows(_docs(s, d)),
    "doc_quality_flags": lambda s, d: D.quality_flags(_docs(s, d)),
    "repeated_lines": lambda s, d: D.repeated_lines(_docs(s, d)),
    "strip_repeated_lines": lambda s, d: D.strip_repeated_lines(_docs(s, d)),
    "text_hash_duplicates": lambda s, d: D.hash_duplicates(_docs(s, d)),
    "token_document_frequency": lambda s, d: D.document_frequency(_docs(s, d)),
    "bm25_topk": lambda s, d: D.bm25_top(_docs(s, d), table(s, d, "benchmark")),
    "page_profile": lambda s, d: P.page_profile(table(s, d, "pages")),
    "link_targets": lambda s, d: P.link_targets(table(s, d, "pages")),
    "url_canonical_groups": lambda s, d: P.url_groups(table(s, d, "pages")),
    "numeric_links": lambda s, d: C.numeric_links(*_made(s, d)),
    "uncited_refs": lambda s, d: C.uncited(*_made(s, d)),
    "coverage_ratio": lambda s, d: C.coverage(*_made(s, d)),
    "author_year_status": _statuses,
    "title_overlap_scores": _overlaps,
    "edit_one_alias_pairs": lambda s, d: C.edit_one_pairs(table(s, d, "supplier"), "s_suppkey", "s_name"),
    "identifier_forms": _codes,
    "rater_kappa": lambda s, d: L.kappa(_rated(s, d), "quality", "long_enough"),
    "discordant_pairs": lambda s, d: L.discordant(_rated(s, d), "quality", "long_enough"),
    "latest_event_per_user": lambda s, d: L.latest_state(_events(s, d)),
    "open_signups_anti": lambda s, d: L.open_signups(_events(s, d)),
    "failure_cohorts": lambda s, d: L.failure_cohorts(_events(s, d)),
    "attempt_metrics_rollup": lambda s, d: L.attempt_metrics(_events(s, d)),
    "outcome_pivot": lambda s, d: L.outcome_pivot(_events(s, d), KINDS),
    "strict_majority": lambda s, d: L.strict_majority(_events(s, d)),
    "decision_tree_outcome": lambda s, d: L.decision_tree(_events(s, d)),
    "pacing_gaps": lambda s, d: L.pacing_gaps(_events(s, d)),
    "decay_weights": lambda s, d: L.decay_weights(_events(s, d)),
    "turn_windows": lambda s, d: L.turn_windows(table(s, d, "conversations")),
    "null_safe_semi": lambda s, d: R.null_safe_semi(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"),
    "full_outer_diff": lambda s, d: R.table_difference(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), _shipped(s, d), "o_orderkey", "o_orderstatus"),
    "union_violations": lambda s, d: R.line_violations(table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "part")),
    "paged_groups": lambda s, d: R.top_per_group(table(s, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3),
}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOPIC = f"list_filter(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 1)"
_SENT = r"list_filter(string_split(regexp_replace(trim(regexp_replace(%s, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_MADE = """
named AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
claims AS (SELECT l_orderkey AS doc_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, 'Claim on ' || p_name || ' [' || (l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 7 ELSE 0 END) || '].' AS sentence FROM named),
one AS (SELECT l_orderkey, l_linenumber, min(struct_pack(l_partkey := l_partkey, l_suppkey := l_suppkey, p_name := p_name)) AS x FROM named GROUP BY ALL),
refs AS (SELECT l_orderkey AS doc_id, l_linenumber AS ref_number, x.p_name AS title, s_name AS surname, year(o_orderdate) AS year FROM one JOIN supplier ON x.l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
markers AS (SELECT doc_id, claim_id, sentence, unnest(regexp_extract_all(sentence, '\\[(\\d+)\\]', 1))::INT AS ref_number FROM claims)
"""
_RATED = "WITH r AS (SELECT quality AS a, (n_chars >= 1000)::INT AS b FROM labels JOIN documents USING (doc_id))"
_GROUND = r"""SELECT item_id, doc_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS finish,
  CASE WHEN instr(substr(d.text, instr(d.text, b.text) + 1), b.text) > 0 THEN 'ambiguous' ELSE 'unique' END AS status FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""

ORACLE_SQL: dict[str, str] = {
    "exact_grounding": _GROUND,
    "claim_support_rollup": f"""WITH g AS ({_GROUND}), c AS (SELECT doc_id, len({_SENT % 'text'}) AS sentences FROM documents),
n AS (SELECT doc_id, count(*) AS grounded, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM g GROUP BY doc_id)
SELECT doc_id, sentences, coalesce(grounded, 0) AS grounded, coalesce(ambiguous, 0) AS ambiguous,
  CASE WHEN coalesce(grounded, 0) = 0 THEN 'unsupported' WHEN ambiguous > 0 THEN 'ambiguous' ELSE 'supported' END AS badge FROM c LEFT JOIN n USING (doc_id) WHERE sentences > 0""",
    "sentence_windows": f"""WITH s AS (SELECT doc_id, {_SENT % 'text'} AS s FROM documents), e AS (SELECT doc_id, s, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM s)
SELECT doc_id, pos, sentence, array_to_string(s[greatest(pos, 1):pos + 2], ' ') AS context FROM e""",
    "chunk_windows": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line, {_SENT % 't'} AS s FROM l WHERE trim(t) <> ''), p AS (SELECT *, unnest(range(0, ((len(s) - 1) // 4) + 1)) AS part FROM s WHERE len(s) > 0)
SELECT doc_id, line, part, array_to_string(s[part * 4 + 1:part * 4 + 4], ' ') AS chunk FROM p""",
    "doc_quality_flags": r"""WITH m AS (SELECT doc_id, length(text) AS chars, CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text), 4) ELSE 0 END AS alpha,
  len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tokens, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, chars, alpha, tokens, len(l) AS lines, len(list_distinct(l)) AS distinct_lines, alpha < 0.55 AS low_alpha, chars > 10 * tokens AS long_words, len(l) - len(list_distinct(l)) >= 4 AS repeats, chars >= 200 AND alpha >= 0.35 AND tokens >= 50 AS usable FROM m""",
    "repeated_lines": "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 8 GROUP BY ALL HAVING count(*) >= 2",
    "strip_repeated_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(x) ORDER BY i) AS k FROM l)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (k = 1 OR length(trim(x)) < 8), '') AS text FROM r GROUP BY doc_id""",
    "text_hash_duplicates": "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "token_document_frequency": f"WITH t AS (SELECT unnest(list_distinct({_TOPIC % 'text'})) AS token FROM documents) SELECT token, count(*) AS df FROM t GROUP BY token",
    "bm25_topk": f"""WITH q AS (SELECT item_id, unnest(list_distinct({_TOPIC % 'text'})) AS token FROM benchmark), t AS (SELECT doc_id, {_TOPIC % 'text'} AS t FROM documents),
z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), p AS (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM t),
tf AS (SELECT token, doc_id, len, count(*) AS tf FROM p WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (token) JOIN q USING (token), z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, rank, doc_id, round(score, 3) AS score FROM r WHERE rank <= 5""",
    "page_profile": r"""WITH a AS (SELECT *, regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'gis') AS b FROM pages),
v AS (SELECT *, regexp_replace(regexp_replace(b, '</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|title)[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS c,
  list_filter(list_distinct(list_transform(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1, 'i'), lambda u: string_split(u, '#')[1])), lambda u: u <> '') AS d,
  list_filter(list_transform(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1, 'i'), lambda u: string_split(u, '#')[1]), lambda u: u <> '') AS f FROM a)
SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')) AS title, regexp_extract(html, '<meta\s[^>]*charset="?([A-Za-z0-9_-]+)', 1, 'i') AS charset,
  len(d) AS links, coalesce(f[1], '') AS first_link, len(regexp_extract_all(html, '<h[1-6][ >]', 0, 'i')) AS headings,
  length(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))) AS chars FROM v""",
    "link_targets": r"""WITH t AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1, 'i'), lambda u: string_split(u, '#')[1]))) AS target FROM pages)
SELECT target, count(*) AS pages FROM t WHERE target <> '' GROUP BY target""",
    "url_canonical_groups": r"""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS url_key FROM pages)
SELECT url_key, count(*) AS pages, min(page_id) AS first_id, CASE WHEN regexp_matches(url_key, '\.(html?|pdf)(\?|$)') THEN 'file' ELSE 'landing' END AS kind FROM k GROUP BY url_key""",
    "numeric_links": f"WITH {_MADE} SELECT m.doc_id, count(DISTINCT claim_id) AS claims, count(r.ref_number) AS linked, count(*) FILTER (r.ref_number IS NULL) AS orphans FROM markers m LEFT JOIN refs r ON m.doc_id = r.doc_id AND m.ref_number = r.ref_number GROUP BY m.doc_id",
    "uncited_refs": f"WITH {_MADE} SELECT doc_id, ref_number FROM refs r WHERE NOT EXISTS (SELECT 1 FROM markers m WHERE m.doc_id = r.doc_id AND m.ref_number = r.ref_number)",
    "coverage_ratio": f"""WITH {_MADE}, x AS (SELECT doc_id, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM markers m WHERE m.doc_id = r.doc_id AND m.ref_number = r.ref_number)) AS cited FROM refs r GROUP BY doc_id)
SELECT doc_id, total, cited, round(100.0 * cited / total, 2) AS pct, CASE WHEN round(100.0 * cited / total, 2) >= 75 THEN 'healthy' WHEN round(100.0 * cited / total, 2) >= 34 THEN 'partial' ELSE 'poor' END AS verdict FROM x""",
    "author_year_status": f"""WITH {_MADE}, m AS (SELECT DISTINCT doc_id, surname, CASE WHEN ref_number % 2 = 0 THEN year ELSE year + 1 END AS year FROM refs), h AS (SELECT doc_id, surname, year, count(*) AS n FROM refs GROUP BY ALL)
SELECT doc_id, surname, year, coalesce(n, 0) AS matches, CASE WHEN n IS NULL THEN 'orphan' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM m LEFT JOIN h USING (doc_id, surname, year)""",
    "title_overlap_scores": f"""WITH {_MADE}, p AS (SELECT doc_id, claim_id, ref_number, list_distinct({_TOPIC % 'title'}) AS t, {_TOPIC % 'sentence'} AS s FROM markers JOIN refs USING (doc_id, ref_number)),
o AS (SELECT *, CASE WHEN len(t) > 0 THEN round(len(list_intersect(t, s)) / len(t), 3) END AS overlap FROM p)
SELECT DISTINCT doc_id, claim_id, ref_number, overlap, CASE WHEN overlap < 0.2 THEN 'mismatch' WHEN overlap < 0.5 THEN 'warn' END AS flag FROM o""",
    "edit_one_alias_pairs": "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey AND levenshtein(lower(x.s_name), lower(y.s_name)) <= 1",
    "identifier_forms": r"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + 100 AS f, l_suppkey % 100 AS s, lpad(l_partkey::VARCHAR, 7, '0') AS g FROM lineitem),
c AS (SELECT *, length(s::VARCHAR) AS k, (10 ** length(s::VARCHAR))::BIGINT AS u, ((-list_sum(list_transform(range(1, 8), lambda i: try_cast(substr(g, i, 1) AS INT) * (9 - i))) % 11) + 11) % 11 AS r FROM l),
e AS (SELECT *, f - f % u + s AS z FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k >= length(f::VARCHAR) THEN s WHEN z < f THEN z + u ELSE z END AS last_page,
  concat_ws(' ', 1, 3, l_linenumber, l_linenumber + 1, l_linenumber + 2) AS numbers,
  CASE WHEN length(g) = 7 AND (CASE WHEN r = 10 THEN 'X' ELSE r::INT::VARCHAR END) = (l_suppkey % 10)::VARCHAR THEN g || (l_suppkey % 10) END AS issn FROM e""",
    "rater_kappa": f"""{_RATED}, t AS (SELECT count(*) AS items, count(*) FILTER (a = b) AS same FROM r), l AS (SELECT a AS v FROM r UNION SELECT b FROM r),
p AS (SELECT sum((SELECT count(*) FROM r WHERE a = v) * (SELECT count(*) FROM r WHERE b = v)) AS p FROM l), x AS (SELECT items, same / items AS o, p / (items * items) AS e FROM t, p)
SELECT items, round(o, 6) AS agreement, CASE WHEN e >= 1 THEN 1.0 ELSE round((o - e) / (1 - e), 6) END AS kappa FROM x""",
    "discordant_pairs": f"{_RATED} SELECT a AS first, b AS second, count(*) AS n FROM r WHERE a <> b GROUP BY ALL",
    "latest_event_per_user": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "open_signups_anti": "SELECT event_id, user_id FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 48 HOUR)",
    "failure_cohorts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (event_type = 'error') AS users, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS share FROM events GROUP BY 1",
    "attempt_metrics_rollup": "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS attempts, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS greatest FROM events GROUP BY ROLLUP (event_type)",
    "outcome_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KINDS) + " FROM events GROUP BY user_id",
    "strict_majority": "WITH v AS (SELECT user_id, event_type, count(*) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, max(struct_pack(v := v, t := event_type)) AS m, sum(v)::BIGINT AS c FROM v GROUP BY user_id) SELECT user_id, CASE WHEN 2 * m.v > c THEN m.t END AS winner, m.v AS votes, c AS \"cast\" FROM b",
    "decision_tree_outcome": "SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'retry' ELSE 'drop' END WHEN event_type = 'purchase' THEN 'credit' WHEN value >= 90 THEN 'review' WHEN value IS NULL THEN 'unknown' ELSE 'pass' END AS outcome FROM events",
    "pacing_gaps": "WITH g AS (SELECT user_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, count(*) AS gaps, max(g) AS longest, count(*) FILTER (g < 60) AS breaches FROM g WHERE g IS NOT NULL GROUP BY user_id",
    "decay_weights": "SELECT user_id, round(sum(0.5 ** (((SELECT max(floor(epoch(ts))) FROM events) - floor(epoch(ts))) / 86400.0 / 7.0)), 4) AS weight FROM events GROUP BY user_id",
    "turn_windows": "SELECT conv_id, turn, role, lag(role) OVER w AS reply_to, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "null_safe_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 5000 AND c_custkey IS NOT DISTINCT FROM o_custkey)",
    "full_outer_diff": "WITH b AS (SELECT l_orderkey AS k, CASE WHEN max(l_returnflag) = 'N' THEN 'X' ELSE max(l_linestatus) END AS v FROM lineitem GROUP BY 1), x AS (SELECT coalesce(o_orderkey, b.k) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN o_orderstatus IS DISTINCT FROM b.v THEN 'changed' END AS change FROM orders FULL JOIN b ON o_orderkey = b.k) SELECT * FROM x WHERE change IS NOT NULL",
    "union_violations": """WITH f AS (SELECT 'duplicate_line' AS rule FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'no_order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'no_part' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'discount_range' FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05) SELECT rule, count(f.rule) AS n FROM (VALUES ('duplicate_line'), ('no_order'), ('no_part'), ('discount_range')) r(rule) LEFT JOIN f USING (rule) GROUP BY rule""",
    "paged_groups": "SELECT o_custkey, rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
}

for _more in (runs, relational, texts, links, bibliography, records):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
