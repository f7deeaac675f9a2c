"""Agreement across runs and models: modal models, intrinsic metrics, pairwise agreement, outcome matrices, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Evidence scopes from best to worst.
SCOPES = ["fulltext_complete", "fulltext_trimmed", "rag", "abstract_only", "preview_snippet", "web_secondhand"]


def run_models(rows: DataFrame) -> DataFrame:
    """(run_id, model_id, models): the model that most rows of a run name (the least name where equal) and how many it mixes."""
    counts = rows.where("model_id is not null").groupBy("run_id", "model_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("run_id").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("models"))
    return counts.join(best, "run_id").where("n = top").groupBy("run_id", "models").agg(F.min("model_id").alias("model_id")).select("run_id", "model_id", "models")


def crediting(rows: DataFrame) -> DataFrame:
    """(run_id, claim_id, ref_id, scope, outcome, copies) of crediting rows; `copies` over 1 marks a broken ledger."""
    return rows.where("crediting").groupBy("run_id", "claim_id", "ref_id", "scope").agg(F.min("outcome").alias("outcome"), F.count(F.lit(1)).alias("copies"))


def intrinsic(rows: DataFrame) -> DataFrame:
    """(model_id, runs, cells, crediting_rate, noncrediting_rate, outcomes): cells are (run, claim, ref, scope) of a model.

    `outcomes`: counts of the crediting outcomes, as kind:count in order of kind.
    """
    model = F.coalesce(F.col("model_id"), F.col("modal"))
    named = rows.join(run_models(rows).select("run_id", F.col("model_id").alias("modal")), "run_id", "left").withColumn("model", model).where("model is not null")
    cells = named.groupBy("model", "run_id", "claim_id", "ref_id", "scope").agg(F.max("crediting").alias("credited"), F.min(F.when(F.col("crediting"), F.col("outcome"))).alias("outcome"))
    by_outcome = cells.groupBy("model", "outcome").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome").isNotNull(), F.concat_ws(":", "outcome", "n")))), " ")
    shown = by_outcome.groupBy("model").agg(kinds.alias("outcomes"))
    totals = cells.groupBy("model").agg(F.countDistinct("run_id").alias("runs"), F.count(F.lit(1)).alias("cells"), F.count_if("credited").alias("good"))
    rate = lambda x: F.round(x / F.col("cells"), 3)
    return totals.join(shown, "model").select(F.col("model").alias("model_id"), "runs", "cells", rate(F.col("good")).alias("crediting_rate"), rate(F.col("cells") - F.col("good")).alias("noncrediting_rate"), "outcomes")


def kappa_of(observed: Column, chance: Column) -> Column:
    """Cohen's kappa: 1 where chance agreement is total, to three places."""
    return F.when(chance >= 1, F.lit(1.0)).otherwise(F.round((observed - chance) / (1 - chance), 3))


def pairwise(labels: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b, n, same, kappa) for each two raters of a group with common items, from (group, rater, item, label).

    Items meet by an equality join on (group, item); raters are few, items many. Label counts are aggregated map-side.
    """
    other = labels.select(*group, "item", F.col("rater").alias("b"), F.col("label").alias("y"))
    met = labels.withColumnsRenamed({"rater": "a", "label": "x"}).join(other, [*group, "item"]).where("a < b")
    counts = met.groupBy(*group, "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    keys = [*group, "a", "b"]
    sides = counts.select(*keys, F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("n").alias("p"), F.lit(0).cast("long").alias("q")), F.struct(F.col("y").alias("v"), F.lit(0).cast("long").alias("p"), F.col("n").alias("q")))).alias("s"))
    chance = sides.groupBy(*keys, "s.v").agg((F.sum("s.p") * F.sum("s.q")).alias("pq")).groupBy(*keys).agg(F.sum("pq").alias("pq"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    return total.join(chance, keys).select(*keys, "n", "same", kappa_of(F.col("same") / F.col("n"), F.col("pq") / (F.col("n") * F.col("n"))).alias("kappa"))


def agreement(labels: DataFrame, group: list[str]) -> DataFrame:
    """(group, raters, common, unanimity, agreement, kappa): over items that two raters of a group or more have labelled."""
    items = labels.groupBy(*group, "item").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("k >= 2")
    common = items.groupBy(*group).agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("lo") == F.col("hi")).alias("agreed"))
    raters = labels.groupBy(*group).agg(F.countDistinct("rater").alias("raters"))
    pairs = pairwise(labels, group).groupBy(*group).agg(F.round(F.try_divide(F.sum("same"), F.sum("n")), 3).alias("agreement"), F.round(F.avg("kappa"), 3).alias("kappa"))
    joined = raters.join(common, group).join(pairs, group) if group else raters.crossJoin(common).crossJoin(pairs)  # one row each without groups
    return joined.select(*group, "raters", "common", F.round(F.try_divide("agreed", "common"), 3).alias("unanimity"), "agreement", "kappa")


def model_labels(credited: DataFrame, models: DataFrame) -> DataFrame:
    """(rater, item, label): each model's outcome of an item by majority over its runs; of equal ones the least."""
    votes = credited.join(models.select("run_id", "model_id"), "run_id").groupBy("model_id", "item", "outcome").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("model_id", "item").agg(F.max("n").alias("top"))
    return votes.join(top, ["model_id", "item"]).where("n = top").groupBy("model_id", "item").agg(F.min("outcome").alias("label")).withColumnRenamed("model_id", "rater")


def discordant_items(labels: DataFrame) -> DataFrame:
    """(item, raters, outcomes) of items on which raters differ; outcomes as rater:label in order."""
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rater", "label"))), " ")
    return labels.groupBy("item").agg(F.count(F.lit(1)).alias("raters"), F.min("label").alias("lo"), F.max("label").alias("hi"), shown.alias("outcomes")).where("lo <> hi").select("item", "raters", "outcomes")


def outcome_matrix(credited: DataFrame, runs: list[int]) -> DataFrame:
    """(claim_id, ref_id, run_<id> ...): each run's outcome of a pair, from its best scope; the runs are stated."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")), F.lit(0)), F.lit(10))
    best = credited.groupBy("claim_id", "ref_id", "run_id").agg(F.min(F.struct(rank.alias("r"), F.col("outcome"))).alias("x"))
    cells = [F.max(F.when(F.col("run_id") == r, F.col("x.outcome"))).alias(f"run_{r}") for r in runs]
    return best.groupBy("claim_id", "ref_id").agg(*cells)


def comparable(runs: DataFrame, controls: list[str], axes: list[str]) -> DataFrame:
    """One row: whether all runs share every control and at most one axis differs; the axes that differ, comma-joined."""
    x = runs.agg(*[F.countDistinct(c).alias(c) for c in [*controls, *axes]])
    differing = F.filter(F.array(*[F.when(F.col(a) > 1, a) for a in axes]), lambda a: a.isNotNull())
    same = F.lit(True)
    for c in controls:
        same = same & (F.col(c) <= 1)
    return x.select((same & (F.size(differing) <= 1)).alias("accepted"), F.array_join(differing, ",").alias("differing"))


def timings(events: DataFrame) -> DataFrame:
    """(phase, n, total, longest) by phase; order by total where it is shown."""
    return events.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("total"), F.max("seconds").alias("longest"))
