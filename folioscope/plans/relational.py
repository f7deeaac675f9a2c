"""Queries of relational and time-driven forms, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as R
from ..sources.tables import table


def _seconds(c="ts"):
    return F.col(c).cast("timestamp").cast("long")


def _joined(s, d):
    """Line items with order, customer, nation, region, part and supplier: small sides are for the planner to broadcast."""
    t = lambda n: table(s, d, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))


def _computed(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.coalesce(F.substring("o_orderpriority", 1, 1), F.lit("")).alias("slot"))
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber").cast("string") == F.col("slot"))).select("l_orderkey", "l_linenumber", "o_orderpriority")


def _old(s, d):
    return table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("old").alias("version")).distinct()


def _new(s, d):
    """A later version of orders, as the line items tell it, under shifted keys so that some are new."""
    sums = table(s, d, "lineitem").groupBy((F.col("l_orderkey") + 100).alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return sums.withColumn("version", F.lit("new"))


def _last_second(s, d):
    return table(s, d, "events").agg(F.max(_seconds()).alias("t")).scalar()


def _numbered(s, d):
    old = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_linenumber").alias("sequence"))
    return R.numbered_after(old, table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name").union(table(s, d, "part").select(F.col("p_partkey"), "p_name")), "l_suppkey", "s_name", "sequence")


def _spines(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("pos"), F.col("l_linenumber").alias("number"))
    return R.spine(lines)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "seven_way_join": lambda s, d: _joined(s, d).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.countDistinct("p_brand").alias("brands")),
    "computed_key_join": _computed,
    "any_violation": lambda s, d: table(s, d, "lineitem").where("l_quantity < 0").select(F.lit(1).alias("x")).union(table(s, d, "orders").where("o_totalprice < 0").select(F.lit(1))).limit(1).agg((F.count(F.lit(1)) > 0).alias("found")),
    "slot_counts": lambda s, d: table(s, d, "orders").where("o_orderstatus <> 'O'").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    "count_join": lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers")),
    "searched_orders": lambda s, d: R.searched(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "BUILD", table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("text")), "c_custkey").select("c_custkey", "c_name"),
    "best_candidate": lambda s, d: R.best_ranked(table(s, d, "orders"), "o_custkey", [F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), F.col("o_orderpriority"), -F.col("o_totalprice")], ["o_orderkey", "o_orderstatus"]),
    "tier_order": lambda s, d: table(s, d, "orders").groupBy(F.when(F.col("o_totalprice") >= 200000, "full").when(F.col("o_totalprice") >= 50000, "part").otherwise("none").alias("tier")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.element_at(F.create_map(*map(F.lit, ["full", 0, "part", 1, "none", 2])), F.col("tier"))).orderBy("rank"),
    "numbered_after": lambda s, d: _numbered(s, d).select("l_suppkey", "s_name", "sequence"),
    "upserted_orders": lambda s, d: R.upserted(_old(s, d), _new(s, d), "o_orderkey"),
    "inserted_orders": lambda s, d: R.inserted(_old(s, d), _new(s, d), "o_orderkey"),
    "distinct_insert": lambda s, d: table(s, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(),
    "retired_suppliers": lambda s, d: R.retired(table(s, d, "supplier").select("s_suppkey", "s_name"), table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey"),
    "chain_breaks": lambda s, d: R.chain_breaks(table(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", F.nullif(F.col("l_linenumber") - 1, F.lit(0))),
    "order_page": lambda s, d: R.page(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 25),
    "listed_orders": lambda s, d: table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority"),
    "entry_spines": _spines,
    "session_silences": lambda s, d: R.silences(table(s, d, "events").select("user_id", _seconds().alias("t")), "user_id", 7200),
    "due_refreshes": lambda s, d: R.due(table(s, d, "events").select(F.col("user_id").alias("key"), _seconds().alias("t")), _last_second(s, d), 3600),
    "host_backoff": lambda s, d: R.backoff(table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("refused"), F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0).alias("floor"))),
    "reloaded_waits": lambda s, d: R.reloaded(table(s, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("seconds"), F.max(_seconds()).alias("updated")), _last_second(s, d)),
}

_LAST = "(SELECT max(floor(epoch(ts))::BIGINT) FROM events)"
_OLD = "old AS (SELECT DISTINCT o_orderkey, o_totalprice AS price, 'old' AS version FROM orders), new AS (SELECT l_orderkey + 100 AS o_orderkey, round(sum(l_extendedprice), 2) AS price, 'new' AS version FROM lineitem GROUP BY 1)"
ORACLE_SQL: dict[str, str] = {
    "seven_way_join": "SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice), 2) AS price, count(DISTINCT p_brand) AS brands FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY ALL",
    "computed_key_join": "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND coalesce(substr(o_orderpriority, 1, 1), '') = l_linenumber::VARCHAR",
    "any_violation": "SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity < 0) OR EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS found",
    "slot_counts": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL",
    "count_join": "SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "searched_orders": "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%BUILD%' OR c_mktsegment ILIKE '%BUILD%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority ILIKE '%BUILD%')",
    "best_candidate": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, -o_totalprice, o_orderkey) = 1",
    "tier_order": "SELECT CASE WHEN o_totalprice >= 200000 THEN 'full' WHEN o_totalprice >= 50000 THEN 'part' ELSE 'none' END AS tier, count(*) AS n, CASE WHEN min(o_totalprice) >= 200000 THEN 0 WHEN min(o_totalprice) >= 50000 THEN 1 ELSE 2 END AS rank FROM orders GROUP BY 1 ORDER BY rank",
    "numbered_after": "WITH new AS (SELECT s_suppkey AS l_suppkey, s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part), old AS (SELECT l_suppkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey, s_name, coalesce(m, 0) + row_number() OVER (PARTITION BY l_suppkey ORDER BY s_name) AS sequence FROM new LEFT JOIN old USING (l_suppkey)",
    "upserted_orders": f"WITH {_OLD} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new",
    "inserted_orders": f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)",
    "distinct_insert": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "retired_suppliers": "SELECT s_suppkey, s_name, s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AS active FROM supplier",
    "chain_breaks": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM l) SELECT l_orderkey, count(*) AS breaks FROM g WHERE l_linenumber <> coalesce(b, 0) + 1 OR nullif(l_linenumber - 1, 0) IS DISTINCT FROM b GROUP BY 1",
    "order_page": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
    "listed_orders": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "entry_spines": "WITH l AS (SELECT l_suppkey AS doc, list(l_linenumber ORDER BY l_shipdate, l_orderkey, l_linenumber) AS l FROM lineitem GROUP BY 1), f AS (SELECT doc, list_reduce(list_prepend({'n': 0, 'last': 0}, list_transform(l, lambda x: {'n': 0, 'last': x::INT})), lambda s, x: CASE WHEN (s.n = 0 AND x.last <= 3) OR (s.n > 0 AND (x.last = s.last + 1 OR x.last = s.last + 2)) THEN {'n': s.n + 1, 'last': x.last} ELSE s END) AS s FROM l) SELECT doc, s.n AS entries, s.last AS last FROM f",
    "session_silences": "WITH g AS (SELECT user_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) SELECT user_id, count(*) FILTER (g > 7200) + 1 AS sessions, count(*) FILTER (g > 7200) AS stale FROM g GROUP BY 1",
    "due_refreshes": f"SELECT user_id AS key, {_LAST} - max(floor(epoch(ts))::BIGINT) AS age FROM events GROUP BY 1 HAVING {_LAST} - max(floor(epoch(ts))::BIGINT) >= 3600",
    "reloaded_waits": f"WITH l AS (SELECT user_id AS key, max(value) FILTER (event_type = 'error') AS s, max(floor(epoch(ts))::BIGINT) AS u FROM events GROUP BY 1), f AS (SELECT key, round(least(s * 0.5 ** (({_LAST} - u) / 86400.0), 300.0), 6) AS seconds FROM l WHERE s > 0) SELECT * FROM f WHERE seconds >= 5",
}
