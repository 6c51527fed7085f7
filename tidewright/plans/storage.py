"""Source and sink queries: every one writes or registers real rows and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.operators.aggregates import money_sum
from tidewright.plans.registry import query
from tidewright.session import fresh_name, scratch_path, spread, table
from tidewright.sources import effects, readers, writers

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("total"))


_BY_STATUS = """SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
                FROM orders GROUP BY 1"""


@query("w01_catalog_table", _BY_STATUS)
def w01(spark, sf):
    return _by_status(spark.read.table(readers.catalog_table(spark, f"{sf}/orders.parquet", "orders")))


@query("w02_parquet_path", "SELECT o_orderkey, o_totalprice FROM orders")
def w02(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("w03_orc_round_trip", _BY_STATUS)
def w03(spark, sf):
    path = scratch_path(spark, "orc")
    _orders(spark, sf).write.orc(path)
    return _by_status(spark.read.orc(path))


@query("w04_delimited_rows", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def w04(spark, sf):
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", segment)
    path = scratch_path(spark, "delimited")
    rows.write.option("sep", "|").option("nullValue", "\\N").csv(path)
    return readers.delimited(spark, path, rows.schema, sep="|")


_DOC_SCHEMA = "doc_id long, lang string, n_chars long"


def document_lines(spark, sf) -> DataFrame:
    """The documents as JSONL, some lines broken or blank as in a real dump."""
    whole = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    broken = F.expr("substring(line, 1, length(line) - 3)")
    value = F.when(F.col("doc_id") % 17 == 3, broken).when(F.col("doc_id") % 13 == 5, F.lit("  ")).otherwise(F.col("line"))
    return table(spark, sf, "documents").withColumn("line", whole).select(value.alias("value"))


@query(
    "w05_json_lines",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 17 <> 3 AND doc_id % 13 <> 5",
)
def w05(spark, sf):
    path = scratch_path(spark, "jsonl")
    document_lines(spark, sf).write.text(path)
    return readers.json_lines(spark, path, StructType.fromDDL(_DOC_SCHEMA))


@query("w06_whole_texts", "SELECT lang, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def w06(spark, sf):
    # One folder per language, lines as written; every file is read back as one text.
    path = scratch_path(spark, "texts")
    flat = F.replace("text", F.lit("\n"), F.lit("\x1f"))
    rows = table(spark, sf, "documents").select("lang", flat.alias("value"))
    rows.write.partitionBy("lang").option("maxRecordsPerFile", 10_000).text(path)
    lang = F.regexp_extract(F.col("_metadata.file_path"), "lang=([^/]+)", 1)
    texts = spark.read.text(path + "/*", wholetext=True).select(lang.alias("lang"), F.col("value").alias("text"))
    lines = texts.select("lang", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line") != "")
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("w08_configured_table", _BY_STATUS)
def w08(spark, sf):
    config = {"source_table": readers.catalog_table(spark, f"{sf}/orders.parquet", "orders")}
    return _by_status(readers.configured_table(spark, config, "source_table"))


def _dated_orders(spark, sf):
    orders = _orders(spark, sf)
    return orders.withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})


@query(
    "w09_partition_pruning",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) IN (3, 4)",
)
def w09(spark, sf):
    path = scratch_path(spark, "by-month")
    writers.write_partitioned(_dated_orders(spark, sf), path, ["year", "month"])
    pruned = spark.read.parquet(path).filter((F.col("year") == 1997) & F.col("month").isin(3, 4))
    return pruned.select("o_orderkey", "o_totalprice")


@query(
    "w10_multi_level_partitions",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS orders
       FROM orders GROUP BY ALL""",
)
def w10(spark, sf):
    path = scratch_path(spark, "by-month")
    writers.write_partitioned(_dated_orders(spark, sf), path, ["year", "month"])
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("orders"))


@query("w11_overwrite", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def w11(spark, sf):
    path = scratch_path(spark, "overwrite")
    kept = _orders(spark, sf).select("o_orderkey", "o_orderstatus")
    writers.overwrite(kept, path)
    writers.overwrite(kept.filter(F.col("o_orderstatus") != "P"), path)
    return spark.read.parquet(path)


@query(
    "w12_insert_select",
    """SELECT o_custkey, count(*) AS summaries, CAST(sum(total) AS DOUBLE) AS total FROM (SELECT o_custkey, o_orderstatus,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY ALL) GROUP BY 1""",
)
def w12(spark, sf):
    name, path = fresh_name("summary"), scratch_path(spark, "summary")
    orders = _orders(spark, sf)
    for finished in (True, False):
        part = orders.filter((F.col("o_orderstatus") == "F") == F.lit(finished))
        totals = part.groupBy("o_custkey", "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
        writers.append_table(totals, name, path)
    stored = spark.table(name)
    return stored.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("summaries"), F.sum("total").cast("double").alias("total")
    )


@query("w13_partitioned_write", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def w13(spark, sf):
    path = scratch_path(spark, "by-year")
    writers.write_partitioned(_dated_orders(spark, sf).drop("month"), path, ["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.max("o_totalprice").alias("largest"))


@query(
    "w14_dynamic_partition_insert",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders, count(*) FILTER (o_orderstatus = 'X') AS marked FROM
       (SELECT o_orderdate, CASE WHEN year(o_orderdate) = 1998 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1""",
)
def w14(spark, sf):
    path = scratch_path(spark, "dynamic")
    orders = _dated_orders(spark, sf).drop("month")
    writers.write_partitioned(orders, path, ["year"])
    corrected = orders.filter(F.col("year") == 1998).withColumn("o_orderstatus", F.lit("X"))
    writers.overwrite_partitions(corrected, path, ["year"])
    marked = F.count_if(F.col("o_orderstatus") == "X").alias("marked")
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("orders"), marked)


@query(
    "w15_multi_insert",
    """SELECT 'large' AS target, count(*) AS n, max(o_totalprice) AS highest FROM orders WHERE o_totalprice > 300000
       UNION ALL SELECT 'pending', count(*), max(o_totalprice) FROM orders WHERE o_orderstatus = 'P'""",
)
def w15(spark, sf):
    orders = _orders(spark, sf)
    columns = ["o_orderkey", "o_totalprice"]
    targets = {
        "large": (F.col("o_totalprice") > 300000, columns),
        "pending": (F.col("o_orderstatus") == "P", columns),
    }
    paths = writers.multi_insert(orders, targets)
    found = [
        writers.read_sink(spark, path, orders.schema).agg(
            F.lit(label).alias("target"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("highest")
        )
        for label, path in paths.items()
    ]
    return found[0].unionAll(found[1])


@query(
    "w17_versioned_table",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'processed' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def w17(spark, sf):
    base = scratch_path(spark, "versioned")
    writers.write_version(_orders(spark, sf).select("o_orderkey", "o_orderstatus"), base)
    current = writers.read_version(spark, base)
    done = F.when(F.col("o_orderstatus") == "P", "processed").otherwise(F.col("o_orderstatus"))
    writers.write_version(current.withColumn("o_orderstatus", done), base)
    return writers.read_version(spark, base)


@query("w18_batch_write", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS doubled FROM orders")
def w18(spark, sf):
    path = scratch_path(spark, "batch")
    doubled = (F.col("o_totalprice").cast("decimal(18,2)") * 2).cast("double").alias("doubled")
    _orders(spark, sf).select("o_orderkey", doubled).write.parquet(path)
    return spark.read.parquet(path)


@query("w117_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ALL_TABLES))
def w117(spark, sf):
    counts = [table(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in ALL_TABLES]
    return reduce(DataFrame.unionAll, counts)


@query("w118_create_as_select", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
def w118(spark, sf):
    name = writers.create_table_as(_orders(spark, sf), "order_copy")
    view = fresh_name("status_counts")
    spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")).createOrReplaceTempView(view)
    return spark.table(view)


@query(
    "w19_committed_effects",
    "SELECT event_id, user_id, 'alert for user ' || user_id AS note FROM events WHERE event_type = 'error'",
)
def w19(spark, sf):
    """An alert for each failed event, sent by the tasks and made to count by one commit."""
    failed = spread(table(spark, sf, "events").filter(F.col("event_type") == "error"))
    alerts = failed.select("event_id", "user_id", F.concat(F.lit("alert for user "), F.col("user_id").cast("string")).alias("note"))
    path = scratch_path(spark, "alerts")
    effects.write_effects(alerts, path)
    return effects.read_effects(spark, path, alerts.schema)
