"""Relational forms over keyed tables: upserts, paging, ranked and searched lookups, chains of rows, refresh and pacing by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new has not: a keyed upsert, by an anti join."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, and those of new whose key old has not; of rows of new with one key the least stays."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("x")).select(key, "x.*")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(old.columns))


def retired(rows: DataFrame, ids: DataFrame, key: str, active: str = "active") -> DataFrame:
    """rows with `active` false where the key is in ids: a soft delete, all rows stay."""
    gone = ids.select(key).distinct().withColumn("__gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn(active, F.col("__gone").isNull()).drop("__gone")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order: the limit is the feature."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def numbered_after(old: DataFrame, new: DataFrame, group: str, order: str, sequence: str) -> DataFrame:
    """new with `sequence` going on after the greatest of its group in old (from 1 where there is none)."""
    last = old.groupBy(group).agg(F.max(sequence).alias("__last"))
    run = F.row_number().over(W.partitionBy(group).orderBy(order))
    return new.withColumn("__run", run).join(last, group, "left").withColumn(sequence, F.coalesce("__last", F.lit(0)) + F.col("__run")).drop("__run", "__last")


def chain_breaks(rows: DataFrame, group: str, sequence: str, link: Column) -> DataFrame:
    """(group, breaks): rows that don't follow the one before by one, or whose `link` is not its sequence; null `link` starts a chain."""
    before = F.lag(sequence).over(W.partitionBy(group).orderBy(sequence))
    marked = rows.select(group, (~(F.col(sequence).eqNullSafe(F.coalesce(before, F.lit(0)) + 1)) | ~link.eqNullSafe(before)).alias("bad"))
    return marked.groupBy(group).agg(F.count_if("bad").alias("breaks")).where("breaks > 0")


def searched(rows: DataFrame, columns: list[str], needle: str, children: DataFrame, key: str) -> DataFrame:
    """Rows of which a column, or a child row of the same key, contains the needle without regard to case; semi join, no copies."""
    own = F.lit(False)
    for c in columns:
        own = own | F.contains(F.lower(c), F.lit(needle.lower()))
    hits = children.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select(key).union(rows.where(own).select(key)).distinct()
    return rows.join(hits, key, "left_semi")


def best_ranked(candidates: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The first candidate of each key by several ascending orders, as a map-side minimum over a struct."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *columns)
    return candidates.groupBy(key).agg(F.min(ranked).alias("x")).select(key, *[f"x.{c}" for c in columns])


def silences(events: DataFrame, key: str, longest: int) -> DataFrame:
    """(key, sessions, stale): runs of events without a gap over `longest` seconds, and how many such gaps; events (key, t)."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy(key).orderBy("t"))
    marked = events.select(key, (F.coalesce(gap, F.lit(0)) > longest).alias("broke"))
    return marked.groupBy(key).agg((F.count_if("broke") + 1).alias("sessions"), F.count_if("broke").alias("stale"))


def due(observations: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Keys whose last observation is `ttl` seconds old or older, with its age; observations (key, t)."""
    last = observations.groupBy("key").agg(F.max("t").alias("t"))
    return last.select("key", (now - F.col("t")).alias("age")).where(F.col("age") >= ttl)


#: First wait, factor, longest wait, successes that settle a wait, half-life of a learned wait in seconds.
BASELINE, FACTOR, CEILING, STABLE, HALF_LIFE = 5.0, 2.0, 300.0, 2, 86400.0


def backoff(events: DataFrame) -> DataFrame:
    """(key, applied, learned, open, successes): each key's waits after its events (key, seq, refused, floor) in order.

    A refusal waits for the baseline, the learned wait or the server's floor; another one of the same episode doubles the
    last wait. STABLE successes end the episode and learn its wait; further ones halve what was learned and forget it
    below the baseline. The fold runs over a key's sorted events.
    """
    start = F.struct(F.lit(0.0).alias("applied"), F.lit(0.0).alias("learned"), F.lit(False).alias("open"), F.lit(0).alias("successes"))

    def state(applied, learned, is_open, successes):
        return F.struct(applied.alias("applied"), learned.alias("learned"), is_open.alias("open"), successes.alias("successes"))

    def step(s, e):
        again = F.greatest(F.least(s["applied"] * FACTOR, F.lit(CEILING)), e["floor"])
        first = F.greatest(e["floor"], s["learned"])
        applied = F.least(F.when(s["open"] & (s["applied"] > 0), again).otherwise(F.when(first > 0, first).otherwise(BASELINE)), F.lit(CEILING))
        more = s["successes"] + 1
        settled = more >= STABLE
        halved = F.when(s["learned"] / 2 < BASELINE, 0.0).otherwise(s["learned"] / 2)
        closing = state(s["applied"], F.when(settled, s["applied"]).otherwise(s["learned"]), ~settled, F.when(settled, 0).otherwise(more))
        fading = state(s["applied"], F.when(settled, halved).otherwise(s["learned"]), F.lit(False), F.when(settled, 0).otherwise(more))
        return F.when(e["refused"], state(applied, s["learned"], F.lit(True), F.lit(0))).when(s["open"], closing).when(s["learned"] > 0, fading).otherwise(s)

    folded = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "refused", "floor"))).alias("e")).select("key", F.aggregate("e", start, step).alias("s"))
    return folded.select("key", "s.*")


def reloaded(learned: DataFrame, now: Column) -> DataFrame:
    """(key, seconds) of learned waits (key, seconds, updated) that, faded by half for each HALF_LIFE, are still at the baseline or over."""
    faded = F.col("seconds") * F.pow(F.lit(0.5), F.greatest(now - F.col("updated"), F.lit(0)) / HALF_LIFE)
    return learned.where("seconds > 0").select("key", F.round(F.least(faded, F.lit(CEILING)), 6).alias("seconds")).where(F.col("seconds") >= BASELINE)


def spine(lines: DataFrame) -> DataFrame:
    """(doc, entries, last): length and last number of each document's numbering spine, from (doc, pos, number).

    The first number is at most 3; each next one is one or two greater. Others are passed over.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(s, x):
        fits = F.when(s["n"] == 0, x["number"].between(1, 3)).otherwise((x["number"] == s["last"] + 1) | (x["number"] == s["last"] + 2))
        return F.when(fits & x["number"].between(1, 999), F.struct((s["n"] + 1).alias("n"), x["number"].alias("last"))).otherwise(s)

    folded = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("l")).select("doc", F.aggregate("l", start, step).alias("s"))
    return folded.select("doc", F.col("s.n").alias("entries"), F.col("s.last").alias("last"))
