"""Relational extensions over the star schema: joins, grouping sets, windows, set operations and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywork.operators.intervals import asof_join as asof
from tallywork.operators.intervals import interval_join
from tallywork.plans.catalogue import register, table
from tallywork.sources.io import shared_path
from tallywork.streaming import windows as W


@register(
    "revenue_by_nation",
    """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY n_name""",
)
def revenue_by_nation(spark, d):
    line = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    orders, customer, nation = (table(spark, d, n) for n in ("orders", "customer", "nation"))
    j = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@register("full_join", "SELECT coalesce(c.k, s.k) AS k, n_customers, n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.k = s.k")
def full_join(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "k", "full")


@register("range_join", "SELECT p_partkey, b.lo FROM part JOIN (VALUES (900, 1000), (1000, 1200), (1200, 3000)) b(lo, hi) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(spark, d):
    bands = spark.createDataFrame([(900, 1000), (1000, 1200), (1200, 3000)], "lo int, hi int")
    return interval_join(table(spark, d, "part"), bands, "p_retailprice", "lo", "hi").select("p_partkey", "lo")


@register(
    "interval_join_by_customer",
    """WITH i AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS low, o_totalprice * 1.1 AS high FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT k, count(*) AS n, max(o_orderkey) AS last FROM orders JOIN i ON o_custkey = c AND o_totalprice >= low AND o_totalprice < high GROUP BY k""",
)
def interval_join_by_customer(spark, d):
    """For each urgent order the customer's orders of up to a tenth more: an interval of its own for each row."""
    orders = table(spark, d, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("low"), (F.col("o_totalprice") * 1.1).alias("high"))
    met = interval_join(orders.select("o_custkey", "o_orderkey", "o_totalprice"), urgent, "o_totalprice", "low", "high", ["o_custkey"])
    return met.groupBy("k").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@register(
    "asof_join",
    """SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def asof_join(spark, d):
    e = table(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return asof(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@register("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@register(
    "ranking_windows",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def ranking_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    over = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "before": F.lag("o_totalprice"), "after": F.lead("o_totalprice")}
    columns = [f.over(w).alias(n) if n in ("before", "after") else f.over(w).cast("long").alias(n) for n, f in over.items()]
    return table(spark, d, "orders").select("o_orderkey", *columns, F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


@register("set_operations", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("kind"), "k").union(c.subtract(s).select(F.lit("only").alias("kind"), "k"))


@register("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@register("events_tumbling_1h", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling_1h(spark, d):
    out = W.windowed_counts(W.with_event_time(table(spark, d, "events")), "1 hour", None, "10 minutes", "event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("events_sliding", "WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, value FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1")
def events_sliding(spark, d):
    out = W.windowed_counts(W.with_event_time(table(spark, d, "events")), "2 hours", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round("total", 4).alias("total"))


@register(
    "events_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def events_sessions(spark, d):
    out = W.session_counts(W.with_event_time(table(spark, d, "events")))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def _streamed(spark, d, counts):
    """Counts over the events as a stream that takes in all files, in append mode: what is closed at its end."""
    stream = W.with_event_time(spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*"))
    return W.stream_to_files(counts(stream), shared_path(spark, "stream"))


@register(
    "events_sliding_stream",
    """WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, value FROM events)
    SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE s + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY s""",
)
def events_sliding_stream(spark, d):
    out = _streamed(spark, d, lambda events: W.windowed_counts(events, "2 hours", "1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round("total", 4).alias("total"))


@register(
    "events_sessions_stream",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def events_sessions_stream(spark, d):
    out = _streamed(spark, d, W.session_counts)
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
