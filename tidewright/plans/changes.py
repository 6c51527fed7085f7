"""Row-changing and procedural constructs as set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import changes
from tidewright.operators import stored_changes as stored
from tidewright.operators.aggregates import money
from tidewright.plans.registry import ORACLES, query
from tidewright.session import cut_lineage, fresh_name, scratch_path, table


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(
    "w103_update_where",
    """SELECT o_orderkey, CASE WHEN CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END < '1997-01-01' THEN 'processed'
       ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def w103(spark, sf):
    # Every ninth order has no date: its predicate is NULL and the row must stay as it is.
    dated = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    orders = _orders(spark, sf).withColumn("o_orderdate", dated)
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return changes.update_where(orders, old, {"o_orderstatus": F.lit("processed")}).select("o_orderkey", "o_orderstatus")


@query(
    "w104_cursor_to_update",
    """SELECT o_orderstatus, count(*) AS orders FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'processed' ELSE o_orderstatus END
       AS o_orderstatus FROM orders) GROUP BY 1""",
)
def w104(spark, sf):
    updated = changes.update_where(
        _orders(spark, sf), F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("processed")}
    )
    return updated.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "w105_nested_cursors",
    """SELECT c_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey
       ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def w105(spark, sf):
    from tidewright.operators import ordered as o

    customers = table(spark, sf, "customer").select("c_custkey")
    lines = _orders(spark, sf).withColumn("price", money("o_totalprice"))
    joined = customers.join(lines, F.col("c_custkey") == F.col("o_custkey"))
    spent = o.ordered_measures(joined, ["c_custkey"], ["o_orderdate"], ["o_orderkey"], {"spent": o.running_sum("price")})
    return spent.select("c_custkey", "o_orderkey", F.col("spent").cast("double").alias("spent"))


@query(
    "w106_delete_where",
    "SELECT o_orderkey FROM orders WHERE NOT coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END < 100000, false)",
)
def w106(spark, sf):
    priced = _orders(spark, sf).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")))
    return changes.delete_where(priced, F.col("o_totalprice") < 100000).select("o_orderkey")


@query(
    "w107_delete_row_count",
    """SELECT count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 50000) AS affected,
       count(*) FILTER (NOT (o_orderstatus = 'F' AND o_totalprice < 50000)) AS remaining FROM orders""",
)
def w107(spark, sf):
    return changes.affected_rows(_orders(spark, sf), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000))


_CHANGES_SQL = """SELECT o_orderkey, o_custkey, 'M' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"""


def _change_set(spark, sf):
    orders = table(spark, sf, "orders")
    known = orders.filter("o_totalprice > 400000").select(
        "o_orderkey", "o_custkey", F.lit("M").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice")
    )
    new = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        (F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice"
    )
    return known.unionByName(new)


_MERGE_SQL = f"""WITH chg AS ({_CHANGES_SQL})
    SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
           coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice,
           t.o_orderdate AS o_orderdate FROM orders t FULL JOIN chg s ON t.o_orderkey = s.o_orderkey"""


@query("w108_merge", _MERGE_SQL)
def w108(spark, sf):
    return changes.upsert(_orders(spark, sf), _change_set(spark, sf), ["o_orderkey"])


def _stored_orders(spark, sf):
    """Orders in partitions of a thousand keys; changed rows keep their place, new ones have places of their own."""
    place = F.floor(F.col("o_orderkey") / 1000).cast("int").alias("part")
    return stored.store(_orders(spark, sf).select("*", place), scratch_path(spark, "orders"), "part")


@query("w108_merge_stored", _MERGE_SQL)
def w108_stored(spark, sf):
    target = _stored_orders(spark, sf)
    place = F.floor(F.col("o_orderkey") / 1000).cast("int").alias("part")
    stored.merge_into(target, _change_set(spark, sf).select("*", place), ["o_orderkey"])
    return target.rows().drop("part")


@query(
    "w107_delete_stored",
    """SELECT count(*) FILTER (o_orderdate < '1994-01-01' AND o_totalprice < 50000) AS deleted,
       count(*) FILTER (NOT (o_orderdate < '1994-01-01' AND o_totalprice < 50000)) AS remaining,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (NOT (o_orderdate < '1994-01-01' AND o_totalprice < 50000)) AS DOUBLE) AS value FROM orders""",
)
def w107_stored(spark, sf):
    # The count comes with the write; partitions of later years are not read.
    target = stored.store(_orders(spark, sf).withColumn("year", F.year("o_orderdate")), scratch_path(spark, "orders"), "year")
    old = F.col("o_orderdate") < F.lit("1994-01-01").cast("timestamp_ntz")
    counts = stored.delete_from(target, old & (F.col("o_totalprice") < 50000) & (F.col("year") < 1994))
    left = target.rows().agg(F.count(F.lit(1)).alias("remaining"), F.sum(money("o_totalprice")).cast("double").alias("value"))
    return left.select(F.lit(counts["deleted"]).cast("long").alias("deleted"), "remaining", "value")


@query(
    "w109_update_else_insert",
    """SELECT c_custkey, CASE WHEN m.nation IS NOT NULL THEN m.nation ELSE c.c_nationkey END AS c_nationkey FROM customer c LEFT JOIN
       (SELECT c_custkey AS k, c_nationkey + 100 AS nation FROM customer WHERE c_acctbal < 0) m ON c_custkey = k
       UNION ALL SELECT c_custkey + 5000000000, c_nationkey FROM customer WHERE c_acctbal > 9000""",
)
def w109(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    moved = customers.filter("c_acctbal < 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"))
    new_key = (F.col("c_custkey") + 5000000000).alias("c_custkey")
    new = customers.filter("c_acctbal > 9000").select(new_key, "c_nationkey")
    return changes.upsert(customers.drop("c_acctbal"), moved.unionByName(new), ["c_custkey"])


@query(
    "w110_temp_table_merge",
    f"SELECT o_orderstatus, count(*) AS orders FROM ({_MERGE_SQL}) GROUP BY 1",
)
def w110(spark, sf):
    staged = fresh_name("staged_changes")
    cut_lineage(_change_set(spark, sf), "staged").createOrReplaceTempView(staged)
    merged = changes.upsert(_orders(spark, sf), spark.table(staged), ["o_orderkey"])
    return merged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "w111_scd_type_2",
    """WITH d AS (SELECT c_custkey, c_nationkey, c_mktsegment, '2020-01-01' AS valid_from, CAST(NULL AS VARCHAR) AS valid_to, true AS is_current
                 FROM customer WHERE c_acctbal <= 8000),
       n AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 1000 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer)
       SELECT d.c_custkey, d.c_nationkey, d.c_mktsegment, d.valid_from, CASE WHEN d.c_mktsegment <> n.c_mktsegment THEN '2024-06-01' END AS valid_to,
              d.c_mktsegment = n.c_mktsegment AS is_current FROM d JOIN n ON d.c_custkey = n.c_custkey
       UNION ALL SELECT n.c_custkey, n.c_nationkey, n.c_mktsegment, '2024-06-01', NULL, true FROM n LEFT JOIN d ON d.c_custkey = n.c_custkey
       WHERE d.c_custkey IS NULL OR d.c_mktsegment <> n.c_mktsegment""",
)
def w111(spark, sf):
    first, incoming = _dimension(spark, sf)
    return changes.scd2(first, incoming, "c_custkey", ["c_nationkey", "c_mktsegment"], F.lit("2024-06-01"))


def _dimension(spark, sf):
    customers = table(spark, sf, "customer")
    first = customers.filter(F.col("c_acctbal") <= 8000).select(
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        F.lit("2020-01-01").alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    segment = F.when(F.col("c_acctbal") < 1000, "MOVED").otherwise(F.col("c_mktsegment"))
    return first, customers.select("c_custkey", "c_nationkey", segment.alias("c_mktsegment"))


@query("w111_scd_type_2_stored", ORACLES["w111_scd_type_2"])
def w111_stored(spark, sf):
    first, incoming = _dimension(spark, sf)
    place = lambda key: F.pmod(key, F.lit(16)).cast("int")
    target = stored.store(first.withColumn("slot", place(F.col("c_custkey"))), scratch_path(spark, "dimension"), "slot")
    stored.scd2_into(target, incoming, "c_custkey", ["c_nationkey", "c_mktsegment"], F.lit("2024-06-01"), place)
    return target.rows().drop("slot")


@query(
    "w112_balanced_updates",
    """WITH d AS (SELECT c_custkey AS k, CAST(-100 AS DECIMAL(18,2)) AS delta FROM customer WHERE c_mktsegment = 'BUILDING'
                  UNION ALL SELECT c_custkey + 1, 100 FROM customer WHERE c_mktsegment = 'BUILDING')
       SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) + coalesce((SELECT sum(delta) FROM d WHERE k = c_custkey), 0) AS DOUBLE) AS balance
       FROM customer""",
)
def w112(spark, sf):
    accounts = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", money("c_acctbal").alias("balance"))
    payers = accounts.filter(F.col("c_mktsegment") == "BUILDING")
    amount = F.lit(100).cast("decimal(18,2)")
    deltas = payers.select("c_custkey", (-amount).alias("delta")).unionByName(
        payers.select((F.col("c_custkey") + 1).alias("c_custkey"), amount.alias("delta"))
    )
    moved = changes.apply_deltas(accounts, deltas, "c_custkey", "balance", "delta")
    return moved.select("c_custkey", F.col("balance").cast("double").alias("balance"))


@query("w114_bulk_read", "SELECT o_orderkey, o_totalprice FROM orders")
def w114(spark, sf):
    # A bulk fetch into host arrays becomes a plain projection that stays distributed.
    return _orders(spark, sf).select("o_orderkey", "o_totalprice")


@query(
    "w115_stored_function",
    "SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'large' WHEN o_totalprice >= 150000 THEN 'medium' ELSE 'small' END AS band FROM orders",
)
def w115(spark, sf):
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION price_band(price DOUBLE) RETURNS STRING
           RETURN CASE WHEN price >= 400000 THEN 'large' WHEN price >= 150000 THEN 'medium' ELSE 'small' END"""
    )
    return spark.sql("SELECT o_orderkey, price_band(o_totalprice) AS band FROM {o}", o=_orders(spark, sf))


@query(
    "w116_set_returning_procedure",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 350000",
)
def w116(spark, sf):
    from tidewright.sources.readers import catalog_table

    stored = catalog_table(spark, f"{sf}/orders.parquet", "orders")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION orders_above(wanted STRING, floor_price DOUBLE)
            RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE)
            RETURN SELECT o_orderkey, o_totalprice FROM {stored} WHERE o_orderstatus = wanted AND o_totalprice >= floor_price"""
    )
    return spark.sql("SELECT * FROM orders_above('O', 350000D)")
