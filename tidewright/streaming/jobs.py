"""Streaming jobs over file sources: each runs over what has arrived, then stops.

Output goes to file sinks, which record finished batches in their own log: a retried batch
is not written twice, and readers see only whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(
    stream: DataFrame, out: str | None = None, checkpoint: str | None = None, partition_by: tuple[str, ...] = ()
) -> str:
    """Append everything available to a parquet sink and stop; returns the sink's path.

    Pass the same ``out`` and ``checkpoint`` again to go on where the last run ended.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out)
    query = writer.option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def score_arrivals(spark: SparkSession, path: str, schema, review: Callable[[DataFrame], DataFrame], **sink) -> str:
    """Score newly arrived rows with the same stateless function the batch job uses."""
    return drain(review(file_stream(spark, path, schema)), **sink)


def with_audit(inserts: DataFrame, key: str, note: Column, at: Column) -> DataFrame:
    """Rows for an AFTER INSERT trigger: the row itself and its audit entry, tagged by ``kind``.

    Both leave in one sink batch, so a base row never lands without its audit row.
    """
    audit = F.struct(F.col(key).cast("string").alias("audit_key"), note.alias("audit_note"), at.alias("audit_at"))
    kinds = F.array(
        F.struct(F.lit("base").alias("kind"), F.lit(None).cast("struct<audit_key:string,audit_note:string,audit_at:timestamp>").alias("a")),
        F.struct(F.lit("audit").alias("kind"), audit.alias("a")),
    )
    return inserts.select("*", F.inline(kinds)).select(*inserts.columns, "a.*", "kind")
