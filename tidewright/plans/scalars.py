"""Scalar-function and nested-data queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.functions import legacy
from tidewright.operators.ranking import bounded_lists
from tidewright.plans.registry import query
from tidewright.session import table

_NULLABLE = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END"


def _orders_with_gaps(spark, sf):
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    return table(spark, sf, "orders").withColumn("status", status)


@query(
    "w83_null_replacement",
    f"""SELECT o_orderkey, coalesce({_NULLABLE}, 'none') AS coalesced, ifnull({_NULLABLE}, 'none') AS nvl_value,
        coalesce({_NULLABLE}, o_orderpriority) AS isnull_value, {_NULLABLE} IS NULL AS is_missing FROM orders""",
)
def w83(spark, sf):
    return _orders_with_gaps(spark, sf).select(
        "o_orderkey",
        F.coalesce("status", F.lit("none")).alias("coalesced"),
        F.nvl(F.col("status"), F.lit("none")).alias("nvl_value"),
        legacy.tsql_isnull(F.col("status"), F.col("o_orderpriority")).alias("isnull_value"),
        F.isnull("status").alias("is_missing"),
    )


@query(
    "w84_nullif",
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice / nullif(o_orderkey % 3, 0) AS share FROM orders",
)
def w84(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        (F.col("o_totalprice") / F.nullif(F.col("o_orderkey") % 3, F.lit(0))).alias("share"),
    )


@query(
    "w85_decode",
    f"""SELECT o_orderkey, CASE WHEN s = 'F' THEN 'closed' WHEN s = 'O' THEN 'open' WHEN s IS NULL THEN 'unknown'
        ELSE 'other' END AS decoded FROM (SELECT o_orderkey, {_NULLABLE} AS s FROM orders)""",
)
def w85(spark, sf):
    decoded = legacy.oracle_decode(
        F.col("status"),
        F.lit("F"), F.lit("closed"),
        F.lit("O"), F.lit("open"),
        F.lit(None), F.lit("unknown"),
        F.lit("other"),
    )
    return _orders_with_gaps(spark, sf).select("o_orderkey", decoded.alias("decoded"))


@query(
    "w86_case_trim_length",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed,
              CAST(length(p_name) AS INTEGER) AS size, nullif(trim(replace(p_type, 'ECONOMY', '')), '') AS oracle_empty FROM part""",
)
def w86(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.lower("p_brand").alias("low"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"),
        F.length("p_name").alias("size"),
        legacy.oracle_text(F.trim(F.replace("p_type", F.lit("ECONOMY"), F.lit("")))).alias("oracle_empty"),
    )


@query(
    "w87_substring",
    "SELECT c_custkey, substr(c_name, 1, 8) AS head, substr(c_name, -4, 4) AS tail, substr(c_name, 10) AS rest FROM customer",
)
def w87(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.substring("c_name", 1, 8).alias("head"),
        F.substring("c_name", -4, 4).alias("tail"),
        F.substr("c_name", F.lit(10)).alias("rest"),
    )


@query(
    "w88_convert",
    """SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS bad,
              CAST(p_size AS DOUBLE) AS size FROM part""",
)
def w88(spark, sf):
    number = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    return table(spark, sf, "part").select(
        "p_partkey",
        number.try_cast("int").alias("brand_no"),
        F.col("p_name").try_cast("double").alias("bad"),
        F.col("p_size").cast("double").alias("size"),
    )


@query(
    "w89_rounding",
    """SELECT s_suppkey, CAST(round(CAST(s_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS rounded, CAST(floor(s_acctbal) AS BIGINT) AS low,
              CAST(ceil(s_acctbal) AS BIGINT) AS high, abs(s_acctbal) AS size FROM supplier""",
)
def w89(spark, sf):
    balance = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        F.round(balance.cast("decimal(18,2)"), 1).cast("double").alias("rounded"),
        F.floor(balance).alias("low"),
        F.ceil(balance).alias("high"),
        F.abs(balance).alias("size"),
    )


@query(
    "w90_date_trunc",
    """SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week
       FROM events""",
)
def w90(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"),
    )


@query(
    "w91_date_arithmetic",
    """SELECT o_orderkey, date_diff('day', o_orderdate, DATE '2001-12-31') AS days, date_diff('month', o_orderdate, DATE '2001-12-31') AS months,
       date_diff('year', o_orderdate, DATE '2001-12-31') AS years, strftime(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH, '%Y-%m-%d') AS due
       FROM orders""",
)
def w91(spark, sf):
    as_of = F.lit("2001-12-31").cast("date")
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        legacy.tsql_datediff("day", day, as_of).alias("days"),
        legacy.tsql_datediff("month", day, as_of).alias("months"),
        legacy.tsql_datediff("year", day, as_of).alias("years"),
        F.date_format(legacy.tsql_dateadd("month", F.lit(3), day), "yyyy-MM-dd").alias("due"),
    )


@query(
    "w92_to_date",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM orders",
)
def w92(spark, sf):
    text = F.date_format("o_orderdate", "dd-MMM-yyyy")
    parsed = legacy.oracle_to_date(text, "DD-MON-YYYY")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(F.date_add(parsed, 1), "yyyy-MM-dd").alias("next_day")
    )


@query(
    "w93_as_of_age",
    "SELECT o_orderstatus, min(date_diff('day', o_orderdate, DATE '2002-01-01')) AS youngest, count(*) AS orders FROM orders GROUP BY 1",
)
def w93(spark, sf, as_of: str = "2002-01-01"):
    # The moving "now" of the source dialects is an argument, so a rerun gives the same rows.
    age = F.datediff(F.lit(as_of).cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.min(age).cast("long").alias("youngest"), F.count(F.lit(1)).alias("orders")
    )


@query(
    "w94_date_range",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS orders FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '2000-01-01' GROUP BY 1",
)
def w94(spark, sf):
    low, high = F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz")
    recent = table(spark, sf, "orders").filter((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high))
    return recent.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "w95_string_functions",
    """SELECT p_partkey, p_brand || '/' || p_type AS label, regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2 \\1') AS swapped,
              replace(p_name, ' ', '_') AS slug, CAST(instr(p_name, ' ') AS INTEGER) AS gap FROM part""",
)
def w95(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat_ws("/", "p_brand", "p_type").alias("label"),
        F.regexp_replace("p_name", "([a-z]+) ([a-z]+)", "$2 $1").alias("swapped"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"),
        F.instr("p_name", " ").alias("gap"),
    )


@query("w96_sha2", "SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS digest FROM customer")
def w96(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("digest"))


# ---- nested data


@query(
    "w97_explode",
    """SELECT label, CAST(pos - 1 AS BIGINT) AS pos, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM
       (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL""",
)
def w97(spark, sf):
    items = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return items.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total")
    )


@query(
    "w97_lateral_view",
    "SELECT doc_id, count(*) AS words FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1",
)
def w97_lateral(spark, sf):
    return spark.sql(
        """SELECT doc_id, count(*) AS words FROM {docs} LATERAL VIEW explode(split(text, ' ')) w AS word
           WHERE word <> '' GROUP BY doc_id""",
        docs=table(spark, sf, "documents").select("doc_id", "text"),
    )


ARRAY_LIMIT = 100


def _customer_orders(spark, sf):
    """Per customer arrays of orders; customers without any get NULL."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    arrays = bounded_lists(orders, ["c_custkey"], "o_orderkey", ["o_orderkey"], ARRAY_LIMIT)
    return table(spark, sf, "customer").select("c_custkey").join(arrays, "c_custkey", "left")


@query(
    "w98_explode_outer",
    """SELECT c_custkey, o_orderkey AS order_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def w98(spark, sf):
    return _customer_orders(spark, sf).select("c_custkey", F.explode_outer("values").alias("order_key"))


@query(
    "w99_nested_explode",
    """SELECT o_custkey, l_orderkey AS order_key, l_linenumber AS line, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       GROUP BY ALL""",
)
def w99(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    lists = bounded_lists(lines, ["l_orderkey"], "l_linenumber", ["l_linenumber"], ARRAY_LIMIT)
    heads = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    orders = heads.join(lists, heads["o_orderkey"] == lists["l_orderkey"])
    # The order's array sits in a struct of the customer's array: two levels to unpack.
    nested = orders.select("o_custkey", F.array(F.struct("o_orderkey", F.col("values").alias("lines"))).alias("orders"))
    level1 = nested.select("o_custkey", F.explode("orders").alias("o"))
    level2 = level1.select("o_custkey", F.col("o.o_orderkey").alias("order_key"), F.explode("o.lines").alias("line"))
    return level2.groupBy("o_custkey", "order_key", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w100_array_columns",
    """SELECT l_orderkey, (rn - 1) // 100 AS piece, CAST(count(*) AS INTEGER) AS lines, string_agg(l_partkey, ',' ORDER BY rn) AS parts FROM
       (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn FROM lineitem) GROUP BY ALL""",
)
def w100(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    arrays = bounded_lists(lines, ["l_orderkey"], "l_partkey", ["l_partkey"], ARRAY_LIMIT)
    parts = F.array_join(F.transform("values", lambda x: x.cast("string")), ",")
    return arrays.select("l_orderkey", "piece", F.size("values").alias("lines"), parts.alias("parts"))


@query(
    "w101_struct_columns",
    "SELECT c_custkey, c_name || '@' || c_nationkey AS tag, c_acctbal AS balance FROM customer",
)
def w101(spark, sf):
    account = F.struct(
        F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("owner"),
        F.col("c_acctbal").alias("balance"),
    )
    typed = table(spark, sf, "customer").select("c_custkey", account.alias("account"))
    tag = F.concat(F.col("account.owner.name"), F.lit("@"), F.col("account.owner.nation").cast("string"))
    return typed.select("c_custkey", tag.alias("tag"), F.col("account.balance").alias("balance"))


def _parse_props(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        k = batch["props"].str.extract(r'"k":\s*(-?\d+)', expand=False)
        yield pd.DataFrame(
            {"event_id": batch["event_id"], "event_type": batch["event_type"], "k": pd.to_numeric(k).astype("Int64")}
        )


@query(
    "w102_script_transform",
    "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def w102(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "props")
    return events.mapInPandas(_parse_props, "event_id long, event_type string, k long")


@F.udtf(returnType="o_custkey bigint, o_orderkey bigint, above double", useArrow=False)
class RecordOrders:
    """A pipelined function: the orders of a customer, in the order they come, that are larger than all before, and by how much. Holds one number for a customer."""

    def __init__(self):
        self._most = None

    def eval(self, row: Row):
        price = row["o_totalprice"]
        if self._most is None or price > self._most:
            yield row["o_custkey"], row["o_orderkey"], None if self._most is None else round(price - self._most, 2)
            self._most = price


@query(
    "w102_pipelined_function",
    """SELECT o_custkey, o_orderkey, round(o_totalprice - most, 2) AS above FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM orders) WHERE most IS NULL OR o_totalprice > most""",
)
def w102_pipelined(spark, sf):
    # The rows of a customer stream through one instance, sorted by the engine; nothing is collected.
    spark.udtf.register("record_orders", RecordOrders)
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return spark.sql("SELECT * FROM record_orders(TABLE(SELECT * FROM {orders}) PARTITION BY o_custkey ORDER BY (o_orderdate, o_orderkey))", orders=orders)
