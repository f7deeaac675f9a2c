"""Relational checks over keyed tables: null-safe matching, differences, violations, paging by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def null_safe_semi(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key, null included, occurs in right."""
    r = right.select(F.col(on).alias("__k")).distinct()
    return left.join(r, F.col(on).eqNullSafe(F.col("__k")), "left_semi")


def table_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): rows added, removed or changed from a to b, by a full outer join."""
    x = a.select(key, F.col(value).alias("x"), F.lit(1).alias("ina")).join(b.select(key, F.col(value).alias("y"), F.lit(1).alias("inb")), key, "full")
    change = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return x.select(key, change.alias("change")).where("change is not null")


def line_violations(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule: repeated (order, line), order or part missing, value out of range; 0 for a rule kept."""
    rules = [
        ("duplicate_line", lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("duplicate_line").alias("rule"))),
        ("no_order", lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("no_order").alias("rule"))),
        ("no_part", lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("no_part").alias("rule"))),
        ("discount_range", lineitem.where("l_discount < 0 or l_discount > 0.05").select(F.lit("discount_range").alias("rule"))),
    ]
    found = rules[0][1]
    for _, r in rules[1:]:
        found = found.unionByName(r)
    names = lineitem.sparkSession.createDataFrame([(k,) for k, _ in rules], "rule string")
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(orders: DataFrame, group: str, by: str, key: str, k: int) -> DataFrame:
    """The k rows of each group with the greatest `by`, ties by key: the rank limit is applied before the shuffle too."""
    w = W.partitionBy(group).orderBy(F.desc(by), key)
    return orders.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "rank", key, by)
