"""Shared frames: one evaluation, nothing left."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators.shared import SharedFrames, write_outputs
from tidewright.session import application_scratch


def files_below(spark, label):
    root = application_scratch(spark).removeprefix("file:")
    return [d for d in os.listdir(root) if d.startswith(label)] if os.path.isdir(root) else []


def counted(spark, evaluations):
    def seen(x):
        evaluations.add(1)
        return x

    return spark.range(20).coalesce(1).select(F.udf(seen, "long")("id").alias("id"))


@pytest.mark.parametrize("keep", ["files", "memory"])
def test_outputs_come_from_one_evaluation(spark, keep):
    evaluations = spark.sparkContext.accumulator(0)
    outputs = {"low": lambda df: df.filter("id < 5"), "sum": lambda df: df.agg(F.sum("id").alias("s")), "high": lambda df: df.filter("id >= 5")}
    paths = write_outputs(counted(spark, evaluations), outputs, keep)
    assert evaluations.value == 20
    assert rows(spark.read.parquet(paths["sum"])) == [(190,)] and spark.read.parquet(paths["low"]).count() == 5
    assert files_below(spark, "shared-") == []
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    with pytest.raises(ValueError):
        write_outputs(spark.range(1), {}, "nowhere")


def test_an_error_releases_too(spark):
    with pytest.raises(ZeroDivisionError), SharedFrames(spark) as shared:
        shared.stored(spark.range(3), "kept").count()
        shared.persisted(spark.range(4)).count()
        assert len(files_below(spark, "kept-")) == 1
        raise ZeroDivisionError
    assert files_below(spark, "kept-") == []
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    with pytest.raises(RuntimeError):
        shared.stored(spark.range(1))
