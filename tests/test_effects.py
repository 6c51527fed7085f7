"""Side effects that count once."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.session import scratch_path
from tidewright.sources import effects


def test_each_row_counts_once(spark):
    path = scratch_path(spark, "effects")
    df = spark.range(100).repartition(4).withColumn("note", F.concat(F.lit("é \n "), F.col("id")))
    effects.write_effects(df, path)
    effects.write_effects(df.filter("id < 5"), path)
    effects.write_effects(df.limit(0), path)
    got = effects.read_effects(spark, path, df.schema)
    assert rows(got) == sorted([tuple(r) for r in df.collect()] + [tuple(r) for r in df.filter("id < 5").collect()], key=repr)
    assert effects.read_effects(spark, scratch_path(spark, "none"), df.schema).count() == 0
    with pytest.raises(Exception, match="append"):
        df.write.format(effects.FORMAT).mode("overwrite").save(path)


def test_a_repeated_attempt_leaves_one_copy(spark):
    path = f"file:{scratch_path(spark, 'effects')}"
    writer = effects.EffectsWriter(path)

    def lost():
        yield Row(id=1)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    doubled, kept, empty = writer.write(iter([Row(id=1)])), writer.write(iter([Row(id=1)])), writer.write(iter([]))
    writer.commit([kept, empty, None])
    schema = spark.createDataFrame([], "id long").schema
    assert rows(effects.read_effects(spark, path, schema)) == [(1,)]
    writer.abort([doubled, None])
    other = writer.write(iter([Row(id=2)]))
    writer.abort([other])
    assert rows(effects.read_effects(spark, path, schema)) == [(1,)]


def test_a_failed_job_leaves_nothing(spark):
    path = scratch_path(spark, "effects")
    bad = spark.range(20).repartition(4).withColumn("x", F.when(F.col("id") == 13, F.raise_error(F.lit("bad row"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="bad row"):
        effects.write_effects(bad, path)
    assert effects.committed_files(path) == []


@pytest.mark.parametrize("uri, path", [("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("file:///a/b", "/a/b")])
def test_paths_and_uris(uri, path):
    assert effects.file_system(uri)[1] == path
