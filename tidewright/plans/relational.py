"""Projection, filters, joins, aggregation, ordering and set queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import hierarchy, joins, sampling
from tidewright.operators.aggregates import money, money_sum, pivot_dynamic
from tidewright.operators.ranking import first_per_key
from tidewright.plans.registry import query
from tidewright.session import cut_lineage, fresh_name, table

# ---- projection, filter, null handling, conditionals


@query("w20_select_alias", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance FROM customer")
def w20(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("balance")
    )


@query(
    "w21_compound_filter",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O' "
    "AND o_orderdate >= TIMESTAMP '1998-01-01'",
)
def w21(spark, sf):
    since = F.lit("1998-01-01").cast("timestamp_ntz")
    orders = table(spark, sf, "orders")
    keep = (F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= since)
    return orders.filter(keep).select("o_orderkey", "o_totalprice", "o_orderdate")


@query(
    "w22_computed_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross, upper(l_returnflag) AS flag, "
    "CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem",
)
def w22(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns(
        {
            "gross": F.col("l_quantity") * F.col("l_extendedprice"),
            "flag": F.upper("l_returnflag"),
            "ship_year": F.year("l_shipdate"),
        }
    )
    return lines.select("l_orderkey", "l_linenumber", "gross", "flag", "ship_year")


@query("w23_rename_drop", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_mktsegment FROM customer")
def w23(spark, sf):
    return table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"}).drop("c_acctbal")


@query(
    "w24_casts",
    "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS qty, CAST(l_orderkey AS VARCHAR) AS key_text, "
    "TRY_CAST(l_returnflag AS INTEGER) AS not_a_number FROM lineitem",
)
def w24(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_orderkey").cast("string").alias("key_text"),
        F.col("l_returnflag").try_cast("int").alias("not_a_number"),
    )


@query(
    "w25_distinct_and_key_dedup",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn
         FROM orders) WHERE rn = 1""",
)
def w25(spark, sf):
    orders = table(spark, sf, "orders")
    firsts = first_per_key(
        orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"]
    )
    return firsts.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("w25_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def w25_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "w26_null_handling",
    """SELECT c_custkey, coalesce(o_orderkey, -1) AS order_key, coalesce(o_totalprice, 0.0) AS price,
              o_orderkey IS NULL AS no_order, coalesce(o_orderpriority, 'none') AS priority
       FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1997)
       ON c_custkey = o_custkey""",
)
def w26(spark, sf):
    pending = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "P") & (F.year("o_orderdate") == 1997))
    customers = table(spark, sf, "customer")
    joined = customers.join(pending, customers["c_custkey"] == pending["o_custkey"], "left")
    picked = joined.select(
        "c_custkey",
        F.coalesce("o_orderkey", F.lit(-1)).alias("order_key"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").isNull().alias("no_order"),
        F.col("o_orderpriority").alias("priority"),
    )
    return picked.fillna({"price": 0.0, "priority": "none"})


@query(
    "w27_case_bands",
    """SELECT band, count(*) AS orders FROM (SELECT CASE WHEN o_totalprice >= 400000 THEN 'large'
       WHEN o_totalprice >= 150000 THEN 'medium' ELSE 'small' END AS band FROM orders) GROUP BY band""",
)
def w27(spark, sf):
    price = F.col("o_totalprice")
    band = F.when(price >= 400000, "large").when(price >= 150000, "medium").otherwise("small")
    return table(spark, sf, "orders").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("orders"))


@query("w28_explicit_projection", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def w28(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "w29_parameterised_query",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000",
)
def w29(spark, sf):
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :floor",
        args={"status": "F", "floor": 300000},
        orders=table(spark, sf, "orders"),
    )


@query(
    "w30_scalar_results",
    "SELECT count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, "
    "min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders WHERE o_orderstatus = 'O'",
)
def w30(spark, sf):
    return (
        table(spark, sf, "orders")
        .filter(F.col("o_orderstatus") == "O")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            money_sum("o_totalprice").alias("total"),
            F.min("o_orderdate").alias("first_day"),
            F.max("o_orderdate").alias("last_day"),
        )
    )


@query(
    "w31_existence_flag",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'
       AND o_totalprice > 450000) AS has_large_pending FROM customer""",
)
def w31(spark, sf):
    large = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000))
    holders = large.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_hit", F.lit(True))
    flagged = table(spark, sf, "customer").join(holders, "c_custkey", "left")
    return flagged.select("c_custkey", F.col("_hit").isNotNull().alias("has_large_pending"))


# ---- joins


@query(
    "w32_inner_join",
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def w32(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice")


def _pending_1998(spark, sf):
    return table(spark, sf, "orders").filter((F.col("o_orderstatus") == "P") & (F.year("o_orderdate") == 1998))


@query(
    "w33_left_join",
    """SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN
       (SELECT * FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1998) ON c_custkey = o_custkey""",
)
def w33(spark, sf):
    pending = _pending_1998(spark, sf).withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf, "customer").join(pending, "c_custkey", "left").select("c_custkey", "c_name", "o_orderkey")


@query(
    "w34_right_and_full_join",
    """SELECT 'right' AS kind, c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN
       (SELECT * FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1998) ON c_custkey = o_custkey
       UNION ALL SELECT 'full', c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN
       (SELECT * FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1998) ON c_custkey = o_custkey""",
)
def w34(spark, sf):
    # The order side may hold a hot customer, so it stays on the splittable side of both joins.
    pending = _pending_1998(spark, sf).withColumn("k", F.col("o_custkey"))
    rich = table(spark, sf, "customer").filter(F.col("c_acctbal") > 5000).withColumn("k", F.col("c_custkey"))
    right = rich.join(pending, "k", "right").select(F.lit("right").alias("kind"), "c_custkey", "o_orderkey")
    full = joins.full_join_by_parts(pending, rich, "k").select(F.lit("full").alias("kind"), "c_custkey", "o_orderkey")
    return right.unionAll(full)


@query(
    "w35_small_cross_join",
    """SELECT r_name, c_mktsegment, count(o_orderkey) AS orders FROM
       (SELECT r_regionkey, r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)) g
       LEFT JOIN (SELECT n_regionkey, c_mktsegment AS seg, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
                  JOIN nation ON c_nationkey = n_nationkey) o
       ON g.r_regionkey = o.n_regionkey AND g.c_mktsegment = o.seg GROUP BY ALL""",
)
def w35(spark, sf):
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct()
    grid = joins.small_cross_join(segments, table(spark, sf, "region"))
    customers = table(spark, sf, "customer")
    nations = joins.broadcast_if_small(table(spark, sf, "nation"))
    placed = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"])
    per_cell = (
        table(spark, sf, "orders")
        .join(placed, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    filled = grid.join(per_cell, ["r_regionkey", "c_mktsegment"], "left").fillna({"orders": 0})
    return filled.select("r_name", "c_mktsegment", "orders")


@query(
    "w36_anti_join",
    """SELECT c_custkey FROM customer LEFT JOIN
       (SELECT * FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1998) ON c_custkey = o_custkey
       WHERE o_orderkey IS NULL""",
)
def w36(spark, sf):
    pending = _pending_1998(spark, sf).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey")


@query(
    "w37_in_subquery",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def w37(spark, sf):
    building = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, sf, "orders")
    return orders.join(building, orders["o_custkey"] == building["c_custkey"], "left_semi").select("o_orderkey", "o_custkey")


@query(
    "w38_correlated_subqueries",
    """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def w38(spark, sf):
    return spark.sql(
        """SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS largest
           FROM {customer} c
           WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
        orders=table(spark, sf, "orders"),
        customer=table(spark, sf, "customer"),
    )


@query(
    "w39_self_join",
    """SELECT a.s_nationkey, count(*) AS pairs, CAST(max(b.s_acctbal - a.s_acctbal) AS DECIMAL(18,2))::DOUBLE AS widest
       FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal
       GROUP BY a.s_nationkey""",
)
def w39(spark, sf):
    # For every ordered pair of suppliers of a nation: an ordered count, not the pairs themselves.
    suppliers = table(spark, sf, "supplier")
    levels = suppliers.groupBy("s_nationkey", "s_acctbal").agg(F.count(F.lit(1)).alias("n"))
    per_nation = suppliers.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("all"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high")
    )
    equal = levels.groupBy("s_nationkey").agg(F.sum(F.col("n") * F.col("n")).alias("equal"))
    pairs = per_nation.join(equal, "s_nationkey").withColumn("pairs", F.expr("(all * all - equal) div 2"))
    widest = (money("high") - money("low")).cast("double")
    return pairs.filter("pairs > 0").select("s_nationkey", "pairs", widest.alias("widest"))


@query(
    "w39_self_join_rows",
    """SELECT a.n_nationkey AS left_nation, b.n_nationkey AS right_nation, a.customers + b.customers AS customers
       FROM (SELECT n_nationkey, n_regionkey, count(c_custkey) AS customers FROM nation JOIN customer
             ON c_nationkey = n_nationkey GROUP BY ALL) a
       JOIN (SELECT n_nationkey, n_regionkey, count(c_custkey) AS customers FROM nation JOIN customer
             ON c_nationkey = n_nationkey GROUP BY ALL) b
       ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
)
def w39_rows(spark, sf):
    # Pairs of nations: customers are counted first, so the self-join sees one row per nation.
    per_nation = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    nations = table(spark, sf, "nation").join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"))
    a, b = nations.alias("a"), nations.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(
        F.col("a.n_nationkey").alias("left_nation"),
        F.col("b.n_nationkey").alias("right_nation"),
        (F.col("a.customers") + F.col("b.customers")).alias("customers"),
    )


@query(
    "w40_five_way_join",
    """SELECT r_name, n_name, c_mktsegment, count(*) AS lines,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def w40(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer")
    nations = joins.broadcast_if_small(table(spark, sf, "nation"))
    regions = joins.broadcast_if_small(table(spark, sf, "region"))
    # Lines collapse to one row per order before the wider joins.
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(money("l_extendedprice")).alias("total")
    )
    placed = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.sum("lines").alias("lines"), F.sum("total").alias("total"))
    )
    return (
        placed.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name", "c_mktsegment")
        .agg(F.sum("lines").alias("lines"), F.sum("total").cast("double").alias("total"))
    )


@query(
    "w41_broadcast_lookup",
    """SELECT n_name, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def w41(spark, sf):
    nations = joins.broadcast_if_small(table(spark, sf, "nation"))
    suppliers = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    per_supplier = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("q"))
    return (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("n_name")
        .agg(F.sum("lines").alias("lines"), F.sum("q").cast("long").alias("quantity"))
    )


@query(
    "w42_null_guarded_joins",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)
       SELECT 'inner' AS kind, count(*) AS n, count(c_custkey) AS matched FROM o JOIN customer ON k = c_custkey
       UNION ALL SELECT 'left', count(*), count(c_custkey) FROM o LEFT JOIN customer ON k = c_custkey""",
)
def w42(spark, sf):
    no_key = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", no_key.alias("k"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_custkey")
    counts = [
        joins.null_guarded_join(orders, customers, "k", kind).agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("matched")
        )
        for kind in ("inner", "left")
    ]
    return counts[0].unionAll(counts[1])


@query(
    "w43_salted_join",
    """SELECT l_orderkey, l_linenumber, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY ALL""",
)
def w43(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = joins.salted_join(lines, parts, "l_partkey", ["l_orderkey", "l_linenumber"])
    return joined.groupBy("l_orderkey", "l_linenumber", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w43_hot_key_join",
    """SELECT l_returnflag, l_linestatus, name, count(*) AS n FROM lineitem JOIN (VALUES ('A', 'back'), ('R', 'returned'), ('N', 'kept')) f(flag, name)
       ON l_returnflag = flag GROUP BY ALL""",
)
def w43_hot(spark, sf):
    # Three keys hold all rows: each is salted by its own count, and three rows are repeated.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    names = spark.createDataFrame([("A", "back"), ("R", "returned"), ("N", "kept")], "l_returnflag string, name string")
    joined = joins.hot_key_join(lines, names, "l_returnflag", ["l_orderkey", "l_linenumber"], limit=5_000)
    return joined.groupBy("l_returnflag", "l_linestatus", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w44_bucketed_join",
    """SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def w44(spark, sf):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    left = joins.write_bucketed(orders, "orders_by_customer", "o_custkey", buckets)
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    right = joins.write_bucketed(customers, "customer_by_key", "c_custkey", buckets)
    joined = joins.bucketed_join(spark, left, right, "o_custkey", "c_custkey")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("total")
    )


@query("w45_keyed_repartition", "SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey")
def w45(spark, sf):
    # One exchange on the key serves the aggregate that follows.
    by_customer = table(spark, sf, "orders").select("o_custkey", "o_totalprice").repartition("o_custkey")
    return by_customer.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"))


# ---- aggregation


@query(
    "w46_group_by",
    "SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
)
def w46(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("total")
    )


@query(
    "w47_basic_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
              sum(l_quantity) / count(*) AS mean_quantity, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
       FROM lineitem GROUP BY ALL""",
)
def w47(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").cast("long").alias("quantity"),
        money_sum("l_extendedprice").alias("price"),
        F.avg("l_quantity").alias("mean_quantity"),
        F.min("l_extendedprice").alias("lowest"),
        F.max("l_extendedprice").alias("highest"),
    )


@query(
    "w48_having",
    """SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1
       HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 2500000""",
)
def w48(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("total"))
    return totals.filter(F.col("total") > 2500000).withColumn("total", F.col("total").cast("double"))


@query(
    "w49_join_then_group",
    """SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS lines,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def w49(spark, sf):
    net = money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", net.alias("net"))
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("net").alias("net"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.groupBy("c_mktsegment", "order_year").agg(
        F.sum("lines").alias("lines"), F.sum("net").cast("double").alias("revenue")
    )


@query(
    "w50_grouping_sets",
    """SELECT c_mktsegment, o_orderstatus, CAST(grouping(c_mktsegment, o_orderstatus) AS BIGINT) AS level, count(*) AS orders
       FROM orders JOIN customer ON o_custkey = c_custkey
       GROUP BY GROUPING SETS ((c_mktsegment, o_orderstatus), (c_mktsegment), ())""",
)
def w50(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seg, status = F.col("c_mktsegment"), F.col("o_orderstatus")
    return orders.groupingSets([[seg, status], [seg], []], seg, status).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("orders")
    )


_PIVOT_SQL = """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
                count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


@query("w51_pivot", _PIVOT_SQL)
def w51(spark, sf):
    grouped = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"])
    return grouped.agg(F.count(F.lit(1))).fillna(0)


@query("w52_dynamic_pivot", _PIVOT_SQL)
def w52(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    return pivot_dynamic(orders, ["o_orderpriority"], "o_orderstatus", F.count(F.lit(1))).fillna(0)


@query(
    "w53_one_pass_conditional",
    """SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS closed,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O'), 0) AS DOUBLE) AS open_value
       FROM orders GROUP BY 1""",
)
def w53(spark, sf):
    is_open = F.col("o_orderstatus") == "O"
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("closed"),
        F.sum(F.when(is_open, money("o_totalprice")).otherwise(F.lit(0))).cast("double").alias("open_value"),
    )


@query(
    "w54_period_over_period",
    """WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, count(*) AS orders FROM orders GROUP BY ALL)
       SELECT o_orderstatus, strftime(month, '%Y-%m') AS month, orders,
              orders - lag(orders) OVER (PARTITION BY o_orderstatus ORDER BY month) AS change FROM m""",
)
def w54(spark, sf):
    from pyspark.sql import Window

    # Rows are aggregated to months first; the window sees months, not orders.
    monthly = (
        table(spark, sf, "orders")
        .groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    w = Window.partitionBy("o_orderstatus").orderBy("month")
    return monthly.withColumn("change", F.col("orders") - F.lag("orders").over(w))


# ---- sort, limit, layout


@query(
    "w68_order_by",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC, o_orderkey",
)
def w68(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders.orderBy(F.asc_nulls_last("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("w69_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def w69(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("w70_distribute_by", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def w70(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition("o_custkey")


@query(
    "w71_sort_within_partitions",
    "SELECT count(*) AS rows_seen, 0::BIGINT AS out_of_order FROM orders",
)
def w71(spark, sf):
    from pyspark.sql import Window

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey")
    rows = orders.sortWithinPartitions("o_custkey", "o_orderkey").withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(rows.withColumn("part", F.spark_partition_id()), "sorted")
    w = Window.partitionBy("part").orderBy("at")
    late = F.struct("o_custkey", "o_orderkey") < F.lag(F.struct("o_custkey", "o_orderkey")).over(w)
    checked = placed.withColumn("late", F.coalesce(late, F.lit(False)))
    return checked.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if("late").alias("out_of_order"))


@query(
    "w72_cluster_by",
    "SELECT count(DISTINCT o_custkey) AS customers, count(*) AS rows_seen, 0::BIGINT AS split_customers FROM orders",
)
def w72(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey").repartition("o_custkey").sortWithinPartitions("o_custkey")
    placed = cut_lineage(orders.withColumn("part", F.spark_partition_id()), "clustered")
    homes = placed.groupBy("o_custkey").agg(F.count_distinct("part").alias("homes"), F.count(F.lit(1)).alias("n"))
    return homes.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("n").alias("rows_seen"),
        F.count_if(F.col("homes") > 1).alias("split_customers"),
    )


@query(
    "w73_table_sample",
    "SELECT o_orderkey, o_custkey FROM orders WHERE CAST('0x' || substr(md5('s1|' || o_orderkey), 1, 15) AS BIGINT) < "
    f"{int(0.1 * 2**60)}",
)
def w73(spark, sf):
    return sampling.keep_share(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 0.1, "s1", "o_orderkey")


# ---- set operations, CTEs, recursion


@query(
    "w75_union",
    """SELECT 'all' AS kind, nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL
       UNION ALL SELECT 'distinct', nation, count(*) FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) GROUP BY ALL""",
)
def w75(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    every = customers.unionByName(suppliers).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    return every.select(F.lit("all").alias("kind"), "nation", "n").unionByName(
        every.select(F.lit("distinct").alias("kind"), "nation", F.lit(1).cast("long").alias("n"))
    )


@query(
    "w76_cte_chain",
    """WITH per_order AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1),
       big AS (SELECT * FROM per_order WHERE q > 150),
       tagged AS (SELECT o_orderpriority, q FROM big JOIN orders ON l_orderkey = o_orderkey)
       SELECT o_orderpriority, count(*) AS orders, CAST(max(q) AS BIGINT) AS most FROM tagged GROUP BY 1""",
)
def w76(spark, sf):
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    big = per_order.filter(F.col("q") > 150)
    tagged = big.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return tagged.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.max("q").alias("most"))


@query(
    "w77_temp_view",
    """WITH totals AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)
       SELECT c_name, total FROM customer JOIN totals ON c_custkey = o_custkey""",
)
def w77(spark, sf):
    view = fresh_name("customer_totals")
    orders = table(spark, sf, "orders")
    orders.groupBy("o_custkey").agg(money_sum("o_totalprice").alias("total")).createOrReplaceTempView(view)
    customers = table(spark, sf, "customer")
    totals = spark.table(view)
    return customers.join(totals, customers["c_custkey"] == totals["o_custkey"]).select("c_name", "total")


@query("w78_table_variable", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def w78(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name")


@query(
    "w79_nested_derived_tables",
    """SELECT bucket, count(*) AS customers FROM (SELECT o_custkey, CAST(floor(mean / 50000) AS BIGINT) AS bucket FROM
       (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM
        (SELECT * FROM orders) GROUP BY 1)) GROUP BY 1""",
)
def w79(spark, sf):
    means = table(spark, sf, "orders").groupBy("o_custkey").agg((money_sum("o_totalprice") / F.count(F.lit(1))).alias("mean"))
    return means.groupBy(F.floor(F.col("mean") / 50000).alias("bucket")).agg(F.count(F.lit(1)).alias("customers"))


@query(
    "w80_subquery_in_where",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >
       (SELECT 1.8 * CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM orders)""",
)
def w80(spark, sf):
    return spark.sql(
        """SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >
           (SELECT 1.8D * CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM {orders})""",
        orders=table(spark, sf, "orders"),
    )


@query(
    "w81_recursive_hierarchy",
    """WITH RECURSIVE node AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 10 END AS up FROM part),
       walk AS (SELECT id, id AS root, 0 AS depth FROM node WHERE up IS NULL UNION ALL
                SELECT c.id, w.root, w.depth + 1 FROM walk w JOIN node c ON c.up = w.id)
       SELECT id AS p_partkey, root, depth FROM walk""",
)
def w81(spark, sf):
    key = F.col("p_partkey")
    parent = F.when(key > 0, F.floor(key / 10))
    nodes = table(spark, sf, "part").select("p_partkey", parent.alias("parent_part"))
    return hierarchy.descend(nodes, "p_partkey", "parent_part")


@query(
    "w81_broken_hierarchy",
    """WITH RECURSIVE node AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 50 = 7 THEN p_partkey + 1000000000
           WHEN p_partkey % 50 = 8 THEN p_partkey + 1 WHEN p_partkey % 50 = 9 THEN p_partkey - 1 ELSE p_partkey // 10 END AS up FROM part),
       walk AS (SELECT id, id AS root, 0 AS depth FROM node WHERE up IS NULL UNION ALL SELECT c.id, w.root, w.depth + 1 FROM walk w JOIN node c ON c.up = w.id),
       lost AS (SELECT id FROM node WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM node) UNION ALL SELECT c.id FROM lost w JOIN node c ON c.up = w.id)
       SELECT n.id AS p_partkey, w.root, CAST(w.depth AS BIGINT) AS depth,
           CASE WHEN w.id IS NULL THEN CASE WHEN n.id IN (SELECT id FROM lost) THEN 'missing parent' ELSE 'cycle' END END AS problem
       FROM node n LEFT JOIN walk w ON w.id = n.id""",
)
def w81_broken(spark, sf):
    key = F.col("p_partkey")
    odd = F.when(key % 50 == 7, key + 1000000000).when(key % 50 == 8, key + 1).when(key % 50 == 9, key - 1)
    parent = F.when(key > 0, F.coalesce(odd, F.floor(key / 10)))
    return hierarchy.rooted(table(spark, sf, "part").select("p_partkey", parent.alias("parent_part")), "p_partkey", "parent_part")


@query("w81_deep_chain", "SELECT c_custkey, 0 AS root, c_custkey AS depth, CAST(NULL AS VARCHAR) AS problem FROM customer")
def w81_deep(spark, sf):
    # Every customer hangs below the one before: as deep as the table is long.
    parent = F.when(F.col("c_custkey") > 0, F.col("c_custkey") - 1)
    return hierarchy.rooted(table(spark, sf, "customer").select("c_custkey", parent.alias("above")), "c_custkey", "above")


@query(
    "w82_graph_reach",
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
                UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
                UNION SELECT 'c' || o_custkey, 'p' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
                UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
       walk(node, step) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION SELECT dst, step + 1 FROM walk JOIN e ON src = node)
       SELECT node, min(step) AS step FROM walk GROUP BY node""",
)
def w82(spark, sf):
    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    lines = table(spark, sf, "lineitem")
    bought = table(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = (
        table(spark, sf, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
        .unionAll(table(spark, sf, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
        .unionAll(bought.select(name("c", "o_custkey"), name("p", "l_partkey")))
        .unionAll(lines.select(name("p", "l_partkey"), name("s", "l_suppkey")))
    )
    return hierarchy.reach(edges, table(spark, sf, "region").select(name("r", "r_regionkey").alias("node")))
