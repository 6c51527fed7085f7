"""Writers and versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewright.session import fresh_name, scratch_path


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, name: str, path: str) -> None:
    """INSERT INTO .. SELECT: creates the table at ``path`` on first use."""
    df.write.mode("append").format("parquet").option("path", path).saveAsTable(name)


def write_partitioned(df: DataFrame, path: str, columns: list[str]) -> None:
    """Directory-partitioned write.

    Rows are brought together by partition value, so a value is not scattered over as many
    files as there are tasks; the rebalance lets AQE split a value that holds much of the data.
    """
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    """Dynamic partition insert: only the partitions present in ``df`` are replaced."""
    writer = df.write.mode("overwrite").partitionBy(*columns).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_branches(df: DataFrame, path: str, column: str, branches: int) -> None:
    """Write a folder for each of the few values of ``column``, as rows come.

    With one open file a branch a task need not sort its rows by branch first, which would hold all of them.
    """
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(max(branches, int(before))))
    try:
        df.write.partitionBy(column).parquet(path)
    finally:
        conf.set(key, before)


def multi_insert(source: DataFrame, targets: dict[str, tuple[Column, list[str]]]) -> dict[str, str]:
    """One scan feeding several filtered writes; returns the path of each target.

    ``targets`` maps a label to (predicate, columns). All rows go out in a single
    partitioned write, tagged with every label they belong to.
    """
    labels = F.array_compact(F.array(*[F.when(p, F.lit(label)) for label, (p, _) in targets.items()]))
    path = scratch_path(source.sparkSession, "multi-insert")
    write_branches(source.withColumn("_target", F.explode(labels)), path, "_target", len(targets))
    return {label: f"{path}/_target={label}" for label in targets}


def split_rows(df: DataFrame, accepted: Column) -> tuple[str, str]:
    """Two sinks from one evaluation: accepted and rejected rows. NULL counts as rejected."""
    verdict = F.when(accepted, "accepted").otherwise("rejected")
    path = scratch_path(df.sparkSession, "split")
    write_branches(df.withColumn("_verdict", verdict), path, "_verdict", 2)
    return f"{path}/_verdict=accepted", f"{path}/_verdict=rejected"


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read one branch of a split or multi-insert; a branch that got no rows reads as empty."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _versions(spark: SparkSession, base: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(marker):
            done.append(int(name[2:]))
    return sorted(done)


def write_version(df: DataFrame, base: str) -> int:
    """Write the next version folder of a table. ``df`` may read the current version.

    A version counts only once its write has finished, so a failed job leaves the table as it was.
    """
    version = max(_versions(df.sparkSession, base), default=0) + 1
    df.write.mode("overwrite").parquet(f"{base}/v={version}")
    return version


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    known = _versions(spark, base)
    if not known:
        raise FileNotFoundError(f"no finished version under {base}")
    return spark.read.parquet(f"{base}/v={version or known[-1]}")


def create_table_as(df: DataFrame, label: str) -> str:
    name = fresh_name(label)
    df.write.format("parquet").option("path", scratch_path(df.sparkSession, name)).saveAsTable(name)
    return name


def each_partition(df: DataFrame, effect: Callable[[Iterable[Row]], None]) -> None:
    """Side effects once per partition, for work no column expression can do."""
    df.foreachPartition(effect)


def schema_rows(df: DataFrame) -> DataFrame:
    """The columns of ``df`` as rows (position, name, type, nullable)."""
    listed = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(listed, "position int, name string, type string, nullable boolean")
