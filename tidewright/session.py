"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
#: Rows of a file of texts that work heavy per row reads.
ROWS_PER_FILE = 50_000


def local_session(cpus: str = "*", app: str = "tidewright") -> SparkSession:
    """Single-machine session for tests and the bench; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="tidewright-")
    return _local_scratch[sc.applicationId]


def application_scratch(spark: SparkSession) -> str:
    """This application's own folder under the scratch root."""
    return f"{scratch_root(spark)}/tidewright/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path in this application's scratch folder."""
    return f"{application_scratch(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def fresh_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Unlike cached blocks the files outlive an executor, and every later use sees the
    same rows even if the plan that made them was not repeatable (partition ids).
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a scan that arrives in few partitions, such as one small file.

    For scans that feed work heavy per row; asking a frame with shuffles would run them. A large table already has more partitions than cores and
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this package wrote for this application, when no result that reads it is needed any more. Other applications' files stay."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(application_scratch(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        del _stored[key]


_stored: dict[tuple[str, ...], str] = {}


def stored_once(df_of, spark: SparkSession, *key: str) -> DataFrame:
    """A derived table written once per application and read by every query that needs it.

    Files hold a bounded number of rows: Spark packs files into a task by their bytes, and texts that compress well would come millions to a task.
    """
    full_key = (spark.sparkContext.applicationId, *key)
    if full_key not in _stored:
        path = scratch_path(spark, key[0])
        df_of().write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
        _stored[full_key] = path
    return spark.read.parquet(_stored[full_key])
