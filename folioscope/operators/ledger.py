"""Event ledgers and run analytics: current state, rollups, agreement, gaps, violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, value): each user's last event by time and id. A map-side maximum, no window."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")
    return events.groupBy("user_id").agg(last).select("user_id", "x.event_id", "x.event_type", "x.value")


def open_signups(events: DataFrame, hours: int = 48) -> DataFrame:
    """(event_id, user_id) of signups that no purchase of the same user follows within `hours`: an anti join by user and time."""
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    return events.where("event_type = 'signup'").join(bought, (events["user_id"] == bought["user_id"]) & (bought["bought"] > events["ts"]) & (bought["bought"] <= events["ts"] + F.expr(f"interval {hours} hours")), "left_anti").select("event_id", "user_id")


def failure_cohorts(events: DataFrame) -> DataFrame:
    """(day, errors, users, share): failing events of each day and their share of all."""
    error = F.col("event_type") == "error"
    days = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.sum(error.cast("long")).alias("errors"), F.countDistinct(F.when(error, F.col("user_id"))).alias("users"), F.count(F.lit(1)).alias("n"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "errors", "users", F.round(F.col("errors") / F.col("n"), 6).alias("share"))


def attempt_metrics(events: DataFrame) -> DataFrame:
    """Totals by event type with a grand total (`all`): attempts, distinct users, mean, least and greatest value."""
    x = events.rollup("event_type").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return x.withColumn("event_type", F.coalesce("event_type", F.lit("all")))


def outcome_pivot(events: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a user, one count column a kind; the kinds are stated, so no pass looks for them."""
    return events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Items, agreement and Cohen's kappa of two label columns; kappa is 1 where chance agreement is total; without items there are 0 and nulls."""
    pairs = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    sides = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("v")), F.struct(F.lit(1).alias("side"), F.col("b").alias("v")))).alias("x"), "n")
    by_label = sides.groupBy("x.v").agg((F.sum(F.when(F.col("x.side") == 0, F.col("n")).otherwise(0)) * F.sum(F.when(F.col("x.side") == 1, F.col("n")).otherwise(0))).alias("p"))
    chance = by_label.agg(F.sum("p").alias("p")).scalar()
    t = total.select(F.coalesce("items", F.lit(0)).alias("items"), F.try_divide("same", "items").alias("o"), F.try_divide(chance, F.col("items") * F.col("items")).alias("e"))
    return t.select("items", F.round("o", 6).alias("agreement"), F.when(F.col("e") >= 1, F.lit(1.0)).otherwise(F.round((F.col("o") - F.col("e")) / (1 - F.col("e")), 6)).alias("kappa"))


def discordant(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): counts of differing label pairs."""
    return labels.where(F.col(a) != F.col(b)).groupBy(F.col(a).alias("first"), F.col(b).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def strict_majority(events: DataFrame) -> DataFrame:
    """(user_id, winner, votes, cast): the type with more than half of a user's events; winner null without one."""
    votes = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("user_id").agg(F.max(F.struct("v", "event_type")).alias("top"), F.sum("v").alias("cast"))
    return best.select("user_id", F.when(2 * F.col("top.v") > F.col("cast"), F.col("top.event_type")).alias("winner"), F.col("top.v").alias("votes"), "cast")


def decision_tree(events: DataFrame) -> DataFrame:
    """(event_id, outcome): staged decision over type and value, the first stage that settles it wins."""
    outcome = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "retry").otherwise("drop")).when(F.col("event_type") == "purchase", "credit")
    return events.select("event_id", outcome.when(F.col("value") >= 90, "review").when(F.col("value").isNull(), "unknown").otherwise("pass").alias("outcome"))


def pacing_gaps(events: DataFrame) -> DataFrame:
    """(user_id, gaps, longest, breaches): seconds between a user's events; breaches are those under a minute."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.col("ts").cast("timestamp").cast("long")
    g = events.select("user_id", (sec - F.lag(sec).over(w)).alias("g")).where("g is not null")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.max("g").alias("longest"), F.count_if(F.col("g") < 60).alias("breaches"))


def decay_weights(events: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """(user_id, weight): events weighted by half for each half_life before the ledger's last event."""
    last = events.agg(F.max(F.col("ts").cast("timestamp").cast("long")).alias("t")).scalar()
    age = (last - F.col("ts").cast("timestamp").cast("long")) / 86400.0
    return events.groupBy("user_id").agg(F.round(F.sum(F.pow(F.lit(0.5), age / half_life_days)), 4).alias("weight"))


def turn_windows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, chars, so_far): each turn with the role before it and the running length."""
    w = W.partitionBy("conv_id").orderBy("turn")
    size = F.length("text")
    return turns.select("conv_id", "turn", "role", F.lag("role").over(w).alias("reply_to"), size.alias("chars"), F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("so_far"))
