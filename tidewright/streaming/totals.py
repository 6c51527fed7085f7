"""Running totals kept by a stream that can be stopped and resumed, readable at any time.

The counters live in the state store; update mode brings, each batch, the new totals of the groups that the batch touched. They go to a folder of their own for
each batch id, overwritten if Spark runs the batch again, so a batch counts once however often it is tried. Every ``every`` batches the
newest total of each group is written as one whole table, and changes that older whole tables cover are removed.

    base/changes/batch=7     the totals that batch 7 changed
    base/whole/upto=15       all totals after batch 15

A reader takes the newest finished whole table and the finished changes after it: a few folders, whatever the stream's age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 16


def _folders(spark: SparkSession, path: str, label: str) -> dict[int, str]:
    """Number and path of the finished folders ``label=number`` under ``path``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(f"{label}=") and fs.exists(jvm.Path(status.getPath(), "_SUCCESS")):
                found[int(name.split("=")[1])] = status.getPath().toString()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_totals(spark: SparkSession, base: str, keys: list[str], schema, upto: int | None = None) -> DataFrame:
    """The newest total of each group, after batch ``upto`` or the last one."""
    schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    whole = {n: p for n, p in _folders(spark, f"{base}/whole", "upto").items() if upto is None or n <= upto}
    start = max(whole, default=-1)
    changes = {n: p for n, p in _folders(spark, f"{base}/changes", "batch").items() if n > start and (upto is None or n <= upto)}
    parts = [spark.read.schema(schema).parquet(whole[start]).withColumn("_batch", F.lit(start))] if whole else []
    parts += [spark.read.schema(schema).parquet(p).withColumn("_batch", F.lit(n)) for n, p in sorted(changes.items())]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    values = [c for c in schema.fieldNames() if c not in keys]
    newest = F.max_by(F.struct(*values), "_batch")
    return rows.groupBy(*keys).agg(newest.alias("_now")).select(*keys, "_now.*").select(*schema.fieldNames())


def keep_totals(totals: DataFrame, keys: list[str], base: str, checkpoint: str, every: int = EVERY) -> None:
    """Bring ``base`` up to date with all that has arrived, then stop. Call it again to go on.

    ``totals`` is an aggregate of a stream by ``keys``. ``base`` and ``checkpoint`` belong together: a lost checkpoint would start
    the batch numbers anew, so totals without one are refused.
    """
    spark, schema = totals.sparkSession, totals.schema
    jvm = spark._jvm.org.apache.hadoop.fs
    offsets = jvm.Path(f"{checkpoint}/offsets")
    if _folders(spark, f"{base}/changes", "batch") and not offsets.getFileSystem(spark._jsc.hadoopConfiguration()).exists(offsets):
        raise ValueError(f"{base} holds totals of another checkpoint")

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")
        if (number + 1) % every:
            return
        covered = max((n for n in _folders(session, f"{base}/whole", "upto") if n < number), default=-1)
        read_totals(session, base, keys, schema, number).write.mode("overwrite").parquet(f"{base}/whole/upto={number}")
        # Readers may still be at the whole table before this one, so only what that one covers goes.
        for n, path in _folders(session, f"{base}/changes", "batch").items():
            if n <= covered:
                _remove(session, path)
        for n, path in _folders(session, f"{base}/whole", "upto").items():
            if n < covered:
                _remove(session, path)

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(take).start().awaitTermination()
