"""Queries over verification ledgers and runs, which are read off the events table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import verification as V
from ..sources.tables import table

_SCOPES = ["fulltext_complete", "abstract_only", "preview_snippet", "abstract_only", "preview_snippet"]
_CAUSES = ["timeout", "contested_negative", "source_span_shift", "jury_exhausted", "audit_contested", "schema_invalid", "other"]
_OUTCOMES = ["supports", "partial", "contradicts", "related"]
RUNS = list(range(6))


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def states(spark: SparkSession, d: str) -> DataFrame:
    """Events as states of (claim, reference) pairs: the type gives the status, the value the outcome and cause."""
    e, n = table(spark, d, "events"), F.col("event_id")
    cents = F.floor(F.col("value") * 100).cast("long")
    status = F.when(F.col("event_type").isin("view", "purchase"), "accepted").when(F.col("event_type") == "click", "uncertain").when(F.col("event_type") == "signup", "open").when(cents % 2 == 0, "exhausted").otherwise("infrastructure_error")
    return e.select(
        F.col("user_id").alias("claim_id"), (n % 7).alias("ref_id"), _pick(_SCOPES, n).alias("scope"), F.col("ts").alias("terminal_at"), status.alias("status"), _pick(_OUTCOMES, cents).alias("outcome"),
        F.when(status.isin("uncertain", "exhausted", "infrastructure_error") & (n % 5 != 0), _pick(_CAUSES, cents)).alias("terminal_cause"), F.when(n % 3 == 0, "jury2_passed").when(n % 3 == 1, "contested").otherwise("jury1_only").alias("assurance"), n.alias("ordinal"))


def _attempts(spark, d):
    e = table(spark, d, "events")
    request = (F.col("event_id") / 4).cast("long")
    requests = e.select(request.alias("request_id"), "user_id", "event_id").groupBy("request_id").agg(F.min("user_id").alias("claim_id"), (F.min("event_id") % 7).alias("ref_id"))
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "abandoned").otherwise("started")
    events = e.select(request.alias("request_id"), F.col("event_id").alias("attempt_id"), kind.alias("event_type"), _pick(_CAUSES, F.floor(F.col("value") * 100).cast("long")).alias("cause"))
    return V.attempt_causes(requests, events)


def _cohorts(spark, d):
    e = table(spark, d, "events")
    pairs = e.select(F.col("user_id").alias("claim_id"), (F.col("event_id") % 8).alias("ref_id"))
    return V.cohorts(pairs, states(spark, d), e.select((F.col("event_id") % 7).alias("ref_id")).distinct())


def _run_rows(spark, d):
    """Events as verdicts of six runs of three models; some rows name another model or none."""
    e, n = table(spark, d, "events"), F.col("event_id")
    run = F.col("user_id") % 6
    model = F.when(n % 11 == 0, None).when(n % 10 == 0, "model_x").otherwise(F.concat(F.lit("model_"), (run % 3).cast("string")))
    return e.select(run.alias("run_id"), model.alias("model_id"), F.floor(n / 12).alias("claim_id"), (n % 2).alias("ref_id"), _pick(A.SCOPES[:3], F.floor(n / 2).cast("long")).alias("scope"), (F.col("event_type") != "error").alias("crediting"), _pick(_OUTCOMES, n + F.floor("value").cast("long") % 2).alias("outcome"))


def _items(spark, d):
    rows = _run_rows(spark, d)
    return A.crediting(rows).withColumn("item", F.concat_ws("|", "claim_id", "ref_id", "scope")), A.run_models(rows)


def _run_labels(spark, d):
    credited, models = _items(spark, d)
    return credited.join(models, "run_id").select("model_id", F.col("run_id").alias("rater"), "item", F.col("outcome").alias("label"))


def _jury_events(spark, d):
    kind = F.when(F.col("event_type") == "view", "admit").when(F.col("event_type") == "click", "no").when(F.col("event_type") == "purchase", "yes").when(F.col("event_type") == "error", "technical").otherwise("reject")
    return table(spark, d, "events").select(F.concat_ws("-", F.col("user_id"), F.col("event_id") % 40).alias("pair"), F.col("event_id").alias("seq"), kind.alias("kind"), _pick(_OUTCOMES, F.floor("value").cast("long")).alias("outcome"))


def _controls(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("run_id")).agg(F.lit("v1").alias("policy"), F.max(F.year("ts")).alias("year"), F.max(F.col("user_id") % 3).alias("model"), F.lit("c1").alias("code"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "terminal_states_by_scope": lambda s, d: V.latest_by_scope(states(s, d)),
    "verification_pairs": lambda s, d: (lambda p: p.withColumn("reliability", V.reliability(F.col("scope"), F.col("assurance"))))(V.pair_rows(states(s, d))),
    "terminal_cohorts": lambda s, d: _cohorts(s, d).groupBy("cohort", F.when(F.col("cohort") == "uncertain", F.coalesce("cause", F.lit("unknown"))).alias("cause")).agg(F.count(F.lit(1)).alias("pairs")),
    "isolated_pairs": lambda s, d: _cohorts(s, d).where("cause = 'contested_negative'").select("claim_id", "ref_id", "cohort"),
    "attempt_causes": lambda s, d: _attempts(s, d).select("claim_id", "ref_id", F.array_join("causes", ",").alias("causes")),
    "terminal_health": lambda s, d: V.health(_cohorts(s, d), _attempts(s, d)),
    "multisource_claims": lambda s, d: V.multisource_claims(states(s, d)),
    "verification_counts": lambda s, d: V.verification_counts(states(s, d)),
    "checked_unique": lambda s, d: V.checked_unique(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows")),
    "replayed_juries": lambda s, d: V.replayed(_jury_events(s, d), "medium", 3, 2),
    "drawn_lanes": lambda s, d: V.drawn(table(s, d, "events").select(F.col("event_id").alias("request_id")), "seed", 5),
    "run_models": lambda s, d: A.run_models(_run_rows(s, d)),
    "crediting_cells": lambda s, d: A.crediting(_run_rows(s, d)),
    "intrinsic_metrics": lambda s, d: A.intrinsic(_run_rows(s, d)),
    "within_model_agreement": lambda s, d: A.agreement(_run_labels(s, d), ["model_id"]),
    "between_model_agreement": lambda s, d: A.agreement(A.model_labels(*_items(s, d)), []),
    "discordant_items": lambda s, d: A.discordant_items(A.model_labels(*_items(s, d))),
    "outcome_matrix": lambda s, d: A.outcome_matrix(A.crediting(_run_rows(s, d)), RUNS),
    "comparison_preflight": lambda s, d: A.comparable(_controls(s, d), ["policy", "year"], ["model", "code"]),
    "phase_timings": lambda s, d: A.timings(table(s, d, "events").select(F.col("event_type").alias("phase"), (F.col("value") / 10).alias("seconds"))),
}


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_CENTS = "floor(value * 100)::BIGINT"
_STATUS = f"CASE WHEN event_type IN ('view', 'purchase') THEN 'accepted' WHEN event_type = 'click' THEN 'uncertain' WHEN event_type = 'signup' THEN 'open' WHEN {_CENTS} % 2 = 0 THEN 'exhausted' ELSE 'infrastructure_error' END"
_STATES = f"""states AS (SELECT *, CASE WHEN status IN ('uncertain', 'exhausted', 'infrastructure_error') AND ordinal % 5 <> 0 THEN {_list(_CAUSES)}[cents % 7 + 1] END AS terminal_cause FROM (
  SELECT user_id AS claim_id, event_id % 7 AS ref_id, {_list(_SCOPES)}[event_id % 5 + 1] AS scope, ts AS terminal_at, {_STATUS} AS status, {_CENTS} AS cents, {_list(_OUTCOMES)}[{_CENTS} % 4 + 1] AS outcome,
    CASE event_id % 3 WHEN 0 THEN 'jury2_passed' WHEN 1 THEN 'contested' ELSE 'jury1_only' END AS assurance, event_id AS ordinal FROM events))"""
_LATEST = f"""{_STATES}, latest AS (SELECT claim_id, ref_id, scope, terminal_at, terminal_cause, status, outcome, assurance FROM states WHERE status <> 'open'
  QUALIFY row_number() OVER (PARTITION BY claim_id, ref_id, scope ORDER BY terminal_at DESC, terminal_cause IS NOT NULL DESC, coalesce(terminal_cause, '') DESC, status DESC, outcome DESC, ordinal DESC) = 1)"""
_PAIRS = f"""{_LATEST}, wide AS (SELECT claim_id, ref_id, bool_or(scope = 'fulltext_complete') AS f, bool_or(scope = 'preview_snippet') AS p,
    bool_or(scope = 'abstract_only' AND outcome NOT IN ('partial', 'related') AND assurance <> 'contested' AND status = 'accepted') AS settled, bool_or(scope = 'abstract_only') AS a FROM latest GROUP BY ALL),
  chosen AS (SELECT claim_id, ref_id, CASE WHEN f THEN 'fulltext_complete' WHEN p AND NOT settled THEN 'preview_snippet' ELSE 'abstract_only' END AS scope FROM wide),
  pair_rows AS (SELECT latest.* FROM latest JOIN chosen USING (claim_id, ref_id, scope))"""
_COHORTS = f"""{_PAIRS}, known AS (SELECT DISTINCT user_id AS claim_id, event_id % 8 AS ref_id FROM events), usable AS (SELECT DISTINCT event_id % 7 AS ref_id FROM events),
  cohorts AS (SELECT claim_id, ref_id, CASE WHEN status = 'uncertain' THEN 'uncertain' WHEN status IN ('exhausted', 'infrastructure_error') THEN 'exhausted' WHEN status = 'accepted' THEN 'accepted' WHEN ref_id NOT IN (FROM usable) THEN 'no_usable_text' ELSE 'unaccounted' END AS cohort,
    CASE WHEN status <> 'accepted' THEN terminal_cause END AS cause FROM known LEFT JOIN pair_rows USING (claim_id, ref_id))"""
_ATTEMPTS = f"""calls AS (SELECT event_id // 4 AS request_id, min(user_id) AS claim_id, min(event_id) % 7 AS ref_id FROM events GROUP BY 1),
  dispatch AS (SELECT event_id // 4 AS request_id, event_id AS attempt_id, event_type, {_list(_CAUSES)}[{_CENTS} % 7 + 1] AS cause FROM events),
  attempts AS (SELECT claim_id, ref_id, list(cause ORDER BY attempt_id) AS causes FROM dispatch x JOIN calls USING (request_id) WHERE event_type IN ('error', 'signup') AND NOT EXISTS (SELECT 1 FROM dispatch y WHERE y.request_id = x.request_id AND y.event_type = 'purchase') GROUP BY ALL)"""
_NAMED = "CASE WHEN %s IN ('schema_invalid') OR starts_with(%s, 'source_span_') THEN 'mechanical' WHEN %s = 'contested_negative' OR ends_with(%s, '_contested') THEN 'semantic' WHEN %s = 'timeout' THEN 'infrastructure' ELSE 'unclassified' END"
_ROWS = f"""run_rows AS (SELECT user_id % 6 AS run_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'model_x' ELSE 'model_' || (user_id % 6 % 3) END AS model_id, event_id // 12 AS claim_id, event_id % 2 AS ref_id,
    {_list(A.SCOPES[:3])}[event_id // 2 % 3 + 1] AS scope, event_type <> 'error' AS crediting, {_list(_OUTCOMES)}[(event_id + floor(value)::BIGINT % 2) % 4 + 1] AS outcome FROM events),
  models AS (SELECT run_id, arg_min(model_id, struct_pack(n := -n, m := model_id)) AS model_id, count(*) AS models FROM (SELECT run_id, model_id, count(*) AS n FROM run_rows WHERE model_id IS NOT NULL GROUP BY ALL) GROUP BY run_id),
  credited AS (SELECT run_id, claim_id, ref_id, scope, min(outcome) AS outcome, count(*) AS copies FROM run_rows WHERE crediting GROUP BY ALL)"""
_AGREE = """common AS (SELECT g, item, count(*) AS k, count(DISTINCT label) AS kinds FROM labels GROUP BY ALL HAVING count(*) >= 2),
  met AS (SELECT x.g, x.rater AS a, y.rater AS b, x.label AS x, y.label AS y FROM labels x JOIN labels y ON x.g = y.g AND x.item = y.item AND x.rater < y.rater),
  tot AS (SELECT g, a, b, count(*) AS n, count(*) FILTER (x = y) AS same FROM met GROUP BY ALL),
  chance AS (SELECT g, a, b, sum(p * q) AS pq FROM (SELECT g, a, b, v, sum(p) AS p, sum(q) AS q FROM (SELECT g, a, b, x AS v, 1 AS p, 0 AS q FROM met UNION ALL SELECT g, a, b, y, 0, 1 FROM met) GROUP BY ALL) GROUP BY ALL),
  kappas AS (SELECT g, n, same, CASE WHEN pq / (n * n) >= 1 THEN 1.0 ELSE round((same / n - pq / (n * n)) / (1 - pq / (n * n)), 3) END AS kappa FROM tot JOIN chance USING (g, a, b)),
  c AS (SELECT g, count(*) AS common, round(count(*) FILTER (kinds = 1) / count(*), 3) AS unanimity FROM common GROUP BY g),
  k AS (SELECT g, round(sum(same) / sum(n), 3) AS agreement, round(avg(kappa), 3) AS kappa FROM kappas GROUP BY g), r AS (SELECT g, count(DISTINCT rater) AS raters FROM labels GROUP BY g)"""
_MODEL_LABELS = f"""{_ROWS}, votes AS (SELECT model_id, concat_ws('|', claim_id, ref_id, scope) AS item, outcome, count(*) AS n FROM credited JOIN models USING (run_id) GROUP BY ALL),
  labels AS (SELECT 0 AS g, model_id AS rater, item, arg_min(outcome, struct_pack(n := -n, o := outcome)) AS label FROM votes GROUP BY model_id, item)"""

ORACLE_SQL: dict[str, str] = {
    "terminal_states_by_scope": f"WITH {_LATEST} SELECT * FROM latest",
    "verification_pairs": f"WITH {_PAIRS} SELECT claim_id, ref_id, scope, status, outcome, terminal_cause, assurance, CASE WHEN scope = 'preview_snippet' THEN 'low' WHEN assurance = 'jury2_passed' THEN 'high' ELSE 'medium' END AS reliability FROM pair_rows",
    "terminal_cohorts": f"WITH {_COHORTS} SELECT cohort, CASE WHEN cohort = 'uncertain' THEN coalesce(cause, 'unknown') END AS cause, count(*) AS pairs FROM cohorts GROUP BY ALL",
    "isolated_pairs": f"WITH {_COHORTS} SELECT claim_id, ref_id, cohort FROM cohorts WHERE cause = 'contested_negative'",
    "attempt_causes": f"WITH {_ATTEMPTS} SELECT claim_id, ref_id, array_to_string(causes, ',') AS causes FROM attempts",
    "terminal_health": f"""WITH {_COHORTS}, {_ATTEMPTS}, x AS (SELECT cohort, coalesce(cause, '') AS cause, list_distinct(list_transform(list_filter(coalesce(causes, []), lambda c: c <> 'jury_exhausted'), lambda c: {_NAMED.replace('%s', 'c')})) AS kinds FROM cohorts LEFT JOIN attempts USING (claim_id, ref_id) WHERE cohort <> 'no_usable_text')
SELECT CASE WHEN cohort = 'accepted' THEN 'accepted' WHEN cause IN ('', 'jury_exhausted') THEN CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE 'unclassified' END ELSE {_NAMED.replace('%s', 'cause')} END AS dimension, count(*) AS pairs FROM x GROUP BY 1""",
    "multisource_claims": "SELECT user_id AS claim_id, count(DISTINCT event_id % 7) AS refs FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 7) > 1",
    "verification_counts": f"WITH {_STATES} SELECT CASE WHEN status = 'open' THEN 'open' ELSE coalesce(outcome, 'unavailable') END AS outcome, count(*) AS pairs FROM states GROUP BY 1",
    "checked_unique": "WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT lineitem) AS kinds FROM lineitem GROUP BY ALL) SELECT CASE WHEN kinds > 1 THEN 'diverging' WHEN copies > 1 THEN 'repeated' ELSE 'unique' END AS status, count(*) AS keys, sum(copies)::BIGINT AS rows FROM d GROUP BY 1",
    "drawn_lanes": "SELECT event_id AS request_id, list_reduce(list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256('seed' || chr(31) || event_id), i, 1)) - 1), lambda a, x: (a * 16 + x) % 5) % 5 AS lane FROM events",
    "run_models": f"WITH {_ROWS} SELECT * FROM models",
    "crediting_cells": f"WITH {_ROWS} SELECT * FROM credited",
    "intrinsic_metrics": f"""WITH {_ROWS}, cells AS (SELECT coalesce(run_rows.model_id, models.model_id) AS model, run_id, claim_id, ref_id, scope, bool_or(crediting) AS credited, min(outcome) FILTER (crediting) AS outcome FROM run_rows JOIN models USING (run_id) GROUP BY ALL),
kinds AS (SELECT model, string_agg(outcome || ':' || n, ' ' ORDER BY outcome || ':' || n) AS outcomes FROM (SELECT model, outcome, count(*) AS n FROM cells WHERE outcome IS NOT NULL GROUP BY ALL) GROUP BY model)
SELECT model AS model_id, count(DISTINCT run_id) AS runs, count(*) AS cells, round(count(*) FILTER (credited) / count(*), 3) AS crediting_rate, round(count(*) FILTER (NOT credited) / count(*), 3) AS noncrediting_rate, any_value(outcomes) AS outcomes FROM cells JOIN kinds USING (model) GROUP BY model""",
    "within_model_agreement": f"WITH {_ROWS}, labels AS (SELECT model_id AS g, run_id AS rater, concat_ws('|', claim_id, ref_id, scope) AS item, outcome AS label FROM credited JOIN models USING (run_id)), {_AGREE} SELECT g AS model_id, raters, common, unanimity, agreement, kappa FROM r JOIN c USING (g) JOIN k USING (g)",
    "between_model_agreement": f"WITH {_MODEL_LABELS}, {_AGREE} SELECT raters, common, unanimity, agreement, kappa FROM r JOIN c USING (g) JOIN k USING (g)",
    "discordant_items": f"WITH {_MODEL_LABELS} SELECT item, count(*) AS raters, string_agg(rater || ':' || label, ' ' ORDER BY rater || ':' || label) AS outcomes FROM labels GROUP BY item HAVING count(DISTINCT label) > 1",
    "outcome_matrix": f"WITH {_ROWS}, best AS (SELECT claim_id, ref_id, run_id, arg_min(outcome, struct_pack(r := list_position({_list(A.SCOPES)}, scope), o := outcome)) AS o FROM credited GROUP BY ALL) SELECT claim_id, ref_id, " + ", ".join(f"max(o) FILTER (run_id = {r}) AS run_{r}" for r in RUNS) + " FROM best GROUP BY ALL",
    "comparison_preflight": "WITH r AS (SELECT user_id % 6 AS run_id, max(year(ts)) AS y, max(user_id % 3) AS m FROM events GROUP BY 1) SELECT count(DISTINCT y) <= 1 AS accepted, CASE WHEN count(DISTINCT m) > 1 THEN 'model' ELSE '' END AS differing FROM r",
    "phase_timings": "SELECT event_type AS phase, count(*) AS n, round(sum(value / 10), 3) AS total, max(value / 10) AS longest FROM events GROUP BY 1",
}
