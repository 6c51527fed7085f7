"""Sources and sinks."""

import glob
import os
import re
import tempfile
import time

import pyarrow as pa
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.conftest import rows
from tidewright.session import application_scratch, scratch_path
from tidewright.sources import readers, writers


def test_named_formats(spark):
    df = spark.range(20).select("id", F.concat(F.lit("n"), "id").alias("name"))
    for fmt in ("orc", "parquet", "csv", "json"):
        path = scratch_path(spark, fmt)
        df.write.format(fmt).save(path)
        assert rows(spark.read.schema(df.schema).format(fmt).load(path)) == rows(df)
    path = scratch_path(spark, "text")
    df.select("name").write.text(path)
    assert rows(spark.read.text(path)) == rows(df.select("name"))


def test_whole_texts_one_row_per_file(spark):
    folder = tempfile.mkdtemp(prefix="tidewright-")
    for name in ("a", "b"):
        with open(os.path.join(folder, f"{name}.txt"), "w") as f:
            f.write(f"{name}1\n\n{name}2\n")
    assert rows(readers.whole_texts(spark, folder)) == [("a", "a1\n\na2\n"), ("b", "b1\n\nb2\n")]


def test_json_lines_skip_blank_and_bad(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("  ",), ('{"a": ',), ('{"a": null}',)], "value string")
    parsed = readers.parse_json_lines(lines, StructType.fromDDL("a int"))
    assert rows(parsed) == sorted([(1, None), (None, '{"a": '), (None, None)], key=repr)


def test_jdbc_options():
    options = readers.jdbc_options("jdbc:x", "t", "id", 0, 1000, 8)
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id" and options["upperBound"] == "1000"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", "id", 5, 5, 8)


def test_partition_filter_prunes(spark):
    path = scratch_path(spark, "pruned")
    writers.write_partitioned(spark.range(100).withColumn("p", F.col("id") % 4), path, ["p"])
    pruned = spark.read.parquet(path).filter("p = 2")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and pruned.count() == 25


def test_versions_and_unfinished_writes(spark):
    base = scratch_path(spark, "versions")
    assert writers.write_version(spark.range(3), base) == 1
    assert writers.write_version(writers.read_version(spark, base).filter("id > 0"), base) == 2
    os.makedirs(f"{base}/v=3")  # a job that died before its commit
    assert writers.read_version(spark, base).count() == 2
    assert writers.read_version(spark, base, 1).count() == 3
    with pytest.raises(FileNotFoundError):
        writers.read_version(spark, base + "-none")


def test_split_and_multi_insert(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    good, bad = writers.split_rows(df, F.col("ok"))
    assert rows(writers.read_sink(spark, good, df.schema).select("id")) == [(1,)]
    assert rows(writers.read_sink(spark, bad, df.schema).select("id")) == [(2,), (3,)]
    paths = writers.multi_insert(df, {"all": (F.col("id") > 0, ["id"]), "none": (F.col("id") > 9, ["id"]), "two": (F.col("id") == 2, ["id"])})
    counts = {k: writers.read_sink(spark, p, df.schema).count() for k, p in paths.items()}
    assert counts == {"all": 3, "none": 0, "two": 1}


def test_split_writes_rows_as_they_come(spark):
    """A task has both files open before its last row is made: it holds no rows to sort them by branch."""
    root = application_scratch(spark).removeprefix("file://")

    def watched(batches):
        known = set(glob.glob(f"{root}/split-*"))
        for batch in batches:
            yield batch
        for _ in range(100):
            opened = {re.search("_verdict=([a-z]+)", f)[1] for f in glob.glob(f"{root}/split-*/_temporary/**/*.parquet", recursive=True) if f.split("/_temporary")[0] in known}
            if len(opened) == 2:
                break
            time.sleep(0.1)
        yield pa.RecordBatch.from_arrays([pa.array([-len(opened)], pa.int64())], schema=batch.schema)

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(0, 400_000, 1, 1).mapInArrow(watched, "id long")
    good, bad = writers.split_rows(df, F.col("id") % 2 == 0)
    assert spark.read.parquet(good).count() + spark.read.parquet(bad).count() == 400_001
    assert spark.read.parquet(good).union(spark.read.parquet(bad)).agg(F.min("id")).first()[0] == -2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_dynamic_overwrite_touches_one_partition(spark):
    path = scratch_path(spark, "dyn")
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    writers.write_partitioned(df, path, ["p"])
    writers.overwrite_partitions(spark.createDataFrame([(99, 1)], "id long, p long"), path, ["p"])
    assert rows(spark.read.parquet(path).select("id")) == sorted([(i,) for i in (0, 2, 4, 6, 8, 99)], key=repr)


def test_effects_per_partition_and_schema_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(part):
        seen.add(sum(1 for _ in part))

    df = spark.range(50).repartition(4)
    writers.each_partition(df, count)
    assert seen.value == 50
    assert rows(writers.schema_rows(df)) == [(0, "id", "bigint", False)]


def test_persist_and_release(spark):
    df = spark.range(10).persist(StorageLevel.MEMORY_AND_DISK)
    assert df.count() == 10 and df.is_cached
    df.unpersist()
    assert not df.is_cached


def test_scratch_needs_a_shared_folder_off_local():
    from tidewright import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.scratch_root(Session())
