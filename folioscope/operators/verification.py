"""Verification ledgers: terminal states by scope, cohorts by cause, attempts, replayed juries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terminal statuses, those that count as exhausted, evidence scopes by rank, outcomes that settle nothing.
TERMINAL = ["accepted", "uncertain", "exhausted", "deadline_exceeded", "cancelled", "infrastructure_error"]
EXHAUSTED = ["exhausted", "deadline_exceeded", "cancelled", "infrastructure_error"]
ABSTRACTS = ["abstract_only", "abstract_fallback"]
INCONCLUSIVE = ["partial", "related", "off_topic", "non_decidable"]
#: Causes of each dimension; others go by prefix and suffix.
CAUSES = {
    "mechanical": ["malformed_json", "quote_missing", "schema_invalid"],
    "semantic": ["contested_negative", "isolated_uncertain", "majority_fallback"],
    "infrastructure": ["rate_limited", "timeout", "transport", "cancelled"],
    "deterministic_guard": ["source_integrity_unavailable", "structural_claim_contamination"],
}
#: Causes that take over the dimension of the attempts before them.
INHERITING = ["jury1_technical", "jury2_technical", "jury_exhausted"]


def latest_by_scope(states: DataFrame) -> DataFrame:
    """The last terminal row of each (claim_id, ref_id, scope), by time, cause present, cause, status, outcome and then ordinal.

    One map-side maximum over a struct; no window, so a claim with most of the rows costs a row for each task.
    """
    order = F.struct("terminal_at", F.col("terminal_cause").isNotNull().alias("has"), F.coalesce("terminal_cause", F.lit("")).alias("c"), "status", "outcome", "ordinal")
    last = F.max(F.struct(order.alias("o"), F.col("assurance").alias("assurance"))).alias("x")
    rows = states.where(F.col("status").isin(TERMINAL)).groupBy("claim_id", "ref_id", "scope").agg(last)
    return rows.select("claim_id", "ref_id", "scope", "x.o.terminal_at", F.nullif("x.o.c", F.lit("")).alias("terminal_cause"), "x.o.status", "x.o.outcome", "x.assurance")


def pair_rows(states: DataFrame) -> DataFrame:
    """One row for each (claim_id, ref_id): full text first; a preview gives way to an abstract that settles the matter; else the abstract."""
    row = F.struct("scope", "status", "outcome", "terminal_cause", "assurance")
    of = lambda scopes: F.max(F.when(F.col("scope").isin(scopes), row))
    by = latest_by_scope(states).groupBy("claim_id", "ref_id").agg(of(["fulltext_complete"]).alias("f"), of(["preview_snippet"]).alias("p"), of(ABSTRACTS).alias("a"))
    open_ended = F.col("a.outcome").isin(INCONCLUSIVE) | (F.col("a.assurance") == "contested") | F.col("a.status").isin([s for s in TERMINAL if s != "accepted"])
    chosen = F.when(F.col("f").isNotNull(), F.col("f")).when(F.col("p").isNotNull() & (F.col("a").isNull() | open_ended), F.col("p")).otherwise(F.col("a"))
    return by.select("claim_id", "ref_id", chosen.alias("x")).select("claim_id", "ref_id", "x.*").where("scope is not null")


def reliability(scope: Column, assurance: Column) -> Column:
    return F.when(scope == "preview_snippet", "low").when(assurance == "jury2_passed", "high").otherwise("medium")


def failure_dimension(cause: Column, attempts: Column) -> Column:
    """Dimension of a terminal cause; an inheriting or missing one takes that on which all causes of its attempts agree."""

    def named(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for dimension, causes in reversed(CAUSES.items()):
            out = F.when(c.isin(causes), dimension).otherwise(out)
        by_form = F.when(c.startswith("source_span_") | c.endswith("_protocol_invalid"), "mechanical").when(c.endswith("_contested") | c.endswith("_uncertain"), "semantic")
        return F.coalesce(out, by_form, F.lit("unclassified"))

    clean = F.filter(F.coalesce(attempts, F.array().cast("array<string>")), lambda a: (a != "") & (a != "jury_exhausted"))
    found = F.array_distinct(F.transform(clean, named))
    inherited = F.when((F.size(found) == 1) & (F.get(found, F.lit(0)) != "unclassified"), F.get(found, F.lit(0))).otherwise("unclassified")
    c = F.coalesce(cause, F.lit(""))
    return F.when((c == "") | c.isin(INHERITING), inherited).otherwise(named(c))


def attempt_causes(requests: DataFrame, events: DataFrame) -> DataFrame:
    """(claim_id, ref_id, causes): causes of the failed attempts of requests that never completed, in order of attempt."""
    completed = events.where("event_type = 'completed'").select("request_id").distinct()
    failed = events.where("event_type in ('failed', 'abandoned')").join(completed, "request_id", "left_anti")
    each = failed.join(requests, "request_id").select("claim_id", "ref_id", "attempt_id", "cause").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("attempt_id", "cause")))
    return each.groupBy("claim_id", "ref_id").agg(ordered.alias("x")).select("claim_id", "ref_id", F.col("x.cause").alias("causes"))


def cohorts(pairs: DataFrame, states: DataFrame, usable: DataFrame) -> DataFrame:
    """(claim_id, ref_id, cohort, cause) for every pair: accepted, uncertain, exhausted, no_usable_text or unaccounted."""
    final = pair_rows(states).select("claim_id", "ref_id", "status", F.col("terminal_cause").alias("cause"))
    known = pairs.select("claim_id", "ref_id").distinct().join(final, ["claim_id", "ref_id"], "left").join(usable.select("ref_id", F.lit(True).alias("usable")).distinct(), "ref_id", "left")
    cohort = F.when(F.col("status") == "uncertain", "uncertain").when(F.col("status").isin(EXHAUSTED), "exhausted").when(F.col("status") == "accepted", "accepted").when(F.col("usable").isNull(), "no_usable_text").otherwise("unaccounted")
    return known.select("claim_id", "ref_id", cohort.alias("cohort"), F.when(F.col("status") != "accepted", F.col("cause")).alias("cause"))


def health(cohort_rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """(dimension, pairs): accepted pairs, and the others of a lifecycle by the dimension of their failure."""
    eligible = cohort_rows.where("cohort <> 'no_usable_text'").join(attempts, ["claim_id", "ref_id"], "left")
    dimension = F.when(F.col("cohort") == "accepted", "accepted").otherwise(failure_dimension(F.col("cause"), F.col("causes")))
    return eligible.groupBy(dimension.alias("dimension")).agg(F.count(F.lit(1)).alias("pairs"))


def multisource_claims(citations: DataFrame) -> DataFrame:
    """(claim_id, refs) of claims that cite more than one distinct reference."""
    return citations.where("claim_id is not null and ref_id is not null").groupBy("claim_id").agg(F.countDistinct("ref_id").alias("refs")).where("refs > 1")


def verification_counts(states: DataFrame) -> DataFrame:
    """(outcome, pairs): open rows, and the terminal ones by outcome; a missing outcome is `unavailable`."""
    outcome = F.when(F.col("status") == "open", "open").otherwise(F.coalesce("outcome", F.lit("unavailable")))
    return states.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("pairs"))


def checked_unique(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies, status): `unique`, `repeated` (equal rows) or `diverging` (rows that differ); compared by digest, map-side."""
    rest = [c for c in records.columns if c not in keys]
    digest = F.xxhash64(*rest)
    by = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    return by.select(*keys, "copies", F.when(F.col("lo") != F.col("hi"), "diverging").when(F.col("copies") > 1, "repeated").otherwise("unique").alias("status"))


def replayed(events: DataFrame, level: str, cap: int, retries: int) -> DataFrame:
    """Final state of each pair, from its events in order (pair, seq, kind, outcome): (pair, phase, cycle, technical, outcome).

    Kinds: `admit` a candidate (its outcome), `reject` it mechanically, `technical` failure, second jury `yes` or `no`. `no`
    asks for another candidate until `cap` is reached; then the majority of the rejected ones stands (level medium) or the
    pair is exhausted. Terminal states do not change. The fold runs over one pair's sorted events.
    """
    start = F.struct(F.lit("open").alias("phase"), F.lit(0).alias("cycle"), F.lit(0).alias("technical"), F.lit(None).cast("string").alias("outcome"), F.array().cast("array<string>").alias("seen"))

    def state(phase, cycle, technical, outcome, seen):
        return F.struct(phase.alias("phase"), cycle.alias("cycle"), technical.alias("technical"), outcome.alias("outcome"), seen.alias("seen"))

    def capped(s, cycle, seen):
        """State after a candidate has gone: another cycle, or the end."""
        best = F.array_max(F.transform(F.array_distinct(seen), lambda o: F.struct(F.size(F.filter(seen, lambda x: x == o)).alias("n"), o.alias("o"))))
        wins = F.lit(level == "medium") & (2 * best["n"] > F.size(seen))
        last = F.when(wins, F.lit("accepted")).otherwise("exhausted")
        return state(F.when(cycle < cap, "open").otherwise(last), cycle, s["technical"], F.when((cycle >= cap) & wins, best["o"]), seen)

    def step(s, e):
        kind = e["kind"]
        admitted = state(F.lit("admitted"), s["cycle"] + 1, F.lit(0), e["outcome"], s["seen"])
        out = F.when(~s["phase"].isin("open", "admitted"), s)
        out = out.when((kind == "admit") & (s["phase"] == "open"), admitted)
        out = out.when((kind == "reject") & (s["phase"] == "open"), capped(s, s["cycle"] + 1, s["seen"]))
        out = out.when(kind == "technical", state(F.when(s["technical"] + 1 > retries, F.lit("technical_failure")).otherwise(s["phase"]), s["cycle"], s["technical"] + 1, s["outcome"], s["seen"]))
        out = out.when((kind == "yes") & (s["phase"] == "admitted"), state(F.lit("accepted"), s["cycle"], s["technical"], s["outcome"], s["seen"]))
        contested = state(F.lit("contested"), s["cycle"], s["technical"], s["outcome"], s["seen"])
        turned_down = contested if level == "low" else capped(s, s["cycle"], F.concat(s["seen"], F.array(s["outcome"])))
        return out.when((kind == "no") & (s["phase"] == "admitted"), turned_down).otherwise(s)

    folded = events.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "outcome"))).alias("e")).select("pair", F.aggregate("e", start, step).alias("s"))
    return folded.select("pair", "s.phase", "s.cycle", "s.technical", "s.outcome")


def drawn(requests: DataFrame, seed: str, lanes: int) -> DataFrame:
    """(request_id, lane): a lane for each request, the SHA-256 of its key, as a number, modulo the number of lanes."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("request_id").cast("string")), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64), F.lit(8)), lambda i: F.conv(F.substring(digest, i, F.lit(8)), 16, 10).cast("long"))
    return requests.select("request_id", F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * ((1 << 32) % lanes) + x) % lanes).alias("lane"))
