"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewright.session import fresh_name

BAD_LINE = "_bad"


def catalog_table(spark: SparkSession, path: str, label: str) -> str:
    """Register a parquet path in the catalog without copying it; returns the table name."""
    name = fresh_name(label)
    spark.catalog.createTable(name, path=path, source="parquet")
    return name


def configured_table(spark: SparkSession, config: dict[str, str], entry: str) -> DataFrame:
    """The table a job configuration names, in place of a query text glued together at run time."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": config[entry]})


def delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "\x01") -> DataFrame:
    """ROW FORMAT DELIMITED rows; the schema is given, never inferred from the data."""
    return spark.read.schema(schema).option("sep", sep).option("nullValue", "\\N").csv(path)


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: name without the extension, and the whole text."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("source"), F.col("value").alias("text"))


def parse_json_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """Typed rows from a ``value`` column; blank lines vanish, bad ones keep their text in ``_bad``."""
    with_bad = StructType([*schema.fields, StructField(BAD_LINE, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    full = lines.filter(F.trim("value") != "")
    return full.select(F.from_json("value", with_bad, options).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSONL file: blank and malformed lines are skipped."""
    parsed = parse_json_lines(spark.read.text(path), schema)
    return parsed.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def jdbc_options(url: str, table: str, column: str, low: int, high: int, parts: int, fetch: int = 10_000) -> dict[str, str]:
    """Options for a partitioned JDBC read: ``parts`` range queries instead of one connection."""
    if parts < 1 or low >= high:
        raise ValueError("need parts >= 1 and low < high")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(parts),
        "fetchsize": str(fetch),
    }


def jdbc_table(spark: SparkSession, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
