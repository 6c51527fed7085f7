"""Window queries. Groups are evaluated by the hot-group-safe operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import ordered as o
from tidewright.operators.ranking import best_rows_with_ties, top_n_per_group
from tidewright.plans.registry import query
from tidewright.session import table


def _orders_by_month(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", month)


@query(
    "w55_rank",
    """SELECT o_orderkey, o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y-%m') DESC) AS rnk
       FROM orders""",
)
def w55(spark, sf):
    orders = _orders_by_month(spark, sf)
    ranked = o.ordered_measures(orders, ["o_orderpriority"], ["-month"], ["o_orderkey"], {"rnk": o.rank()})
    return ranked.select("o_orderkey", "o_orderpriority", "rnk")


@query(
    "w56_dense_rank",
    """SELECT s_suppkey, s_nationkey, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC) AS rnk
       FROM supplier""",
)
def w56(spark, sf):
    suppliers = table(spark, sf, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 1000))
    ranked = o.ordered_measures(suppliers, ["s_nationkey"], ["-band"], ["s_suppkey"], {"rnk": o.dense_rank()})
    return ranked.select("s_suppkey", "s_nationkey", "rnk")


@query(
    "w57_row_number",
    "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
)
def w57(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    numbered = o.ordered_measures(orders, ["o_custkey"], ["o_orderdate"], ["o_orderkey"], {"rn": o.row_number()})
    return numbered.select("o_orderkey", "o_custkey", "rn")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


@query(
    "w58_lag",
    "SELECT event_id, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
)
def w58(spark, sf):
    measured = o.ordered_measures(_events(spark, sf), ["user_id"], ["ts"], ["event_id"], {"previous": o.lag("value", 0.0)})
    return measured.select("event_id", "previous")


@query("w59_lead", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events")
def w59(spark, sf):
    measured = o.ordered_measures(_events(spark, sf), ["user_id"], ["ts"], ["event_id"], {"following": o.lead("value")})
    return measured.select("event_id", "following")


@query(
    "w60_running_total",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders""",
)
def w60(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", price.alias("price"))
    totals = o.ordered_measures(orders, ["o_custkey"], ["o_orderdate"], ["o_orderkey"], {"running": o.running_sum("price")})
    return totals.select("o_orderkey", F.col("running").cast("double").alias("running"))


@query(
    "w61_first_value",
    "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS opening FROM events",
)
def w61(spark, sf):
    measured = o.ordered_measures(_events(spark, sf), ["user_id"], ["ts"], ["event_id"], {"opening": o.first_value("event_id")})
    return measured.select("event_id", "opening")


@query(
    "w62_last_value",
    """SELECT event_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing FROM events""",
)
def w62(spark, sf):
    measured = o.ordered_measures(_events(spark, sf), ["user_id"], ["ts"], ["event_id"], {"closing": o.last_value("event_id")})
    return measured.select("event_id", "closing")


@query(
    "w63_global_ntile",
    "SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS quartile FROM orders",
)
def w63(spark, sf):
    # No partition key: always cut into ordered slices, or one task would sort the table.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    tiles = o.ordered_measures(orders, [], ["-o_totalprice"], ["o_orderkey"], {"quartile": o.ntile(4)}, group_limit=0)
    return tiles.select("o_orderkey", "quartile")


@query(
    "w63_keyed_ntile",
    "SELECT o_orderkey, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS tile FROM orders",
)
def w63_keyed(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    tiles = o.ordered_measures(orders, ["o_custkey"], ["-o_totalprice"], ["o_orderkey"], {"tile": o.ntile(3)})
    return tiles.select("o_orderkey", "tile")


@query(
    "w64_distributions",
    """SELECT s_suppkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd
       FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 500))""",
)
def w64(spark, sf):
    suppliers = table(spark, sf, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 500))
    measures = {"pr": o.percent_rank(), "cd": o.cume_dist()}
    return o.ordered_measures(suppliers, ["s_nationkey"], ["band"], ["s_suppkey"], measures).select("s_suppkey", "pr", "cd")


@query(
    "w65_top_n_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
)
def w65(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_n_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(
    "w66_best_row_per_key",
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_orderpriority, rnk FROM (SELECT o_custkey, o_orderkey, o_orderpriority,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rnk FROM orders) JOIN customer ON o_custkey = c_custkey
       WHERE rnk = 1""",
)
def w66(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    best = best_rows_with_ties(orders, ["o_custkey"], ["o_orderpriority"])
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = best.join(customers, best["o_custkey"] == customers["c_custkey"])
    return joined.select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderpriority", "rnk")


@query(
    "w67_shared_windows",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
       first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS opening,
       rank() OVER (PARTITION BY user_id ORDER BY ts) AS rnk FROM events""",
)
def w67(spark, sf):
    measures = {
        "nth": o.row_number(),
        "before": o.lag("event_id"),
        "opening": o.first_value("event_id"),
        "rnk": o.rank(),
    }
    return o.ordered_measures(_events(spark, sf), ["user_id"], ["ts"], ["event_id"], measures).select("event_id", *measures)
