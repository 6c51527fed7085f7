"""Both routes of the ordered-group operator must give the same rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators import ordered as o

MEASURES = {
    "rn": o.row_number(),
    "rk": o.rank(),
    "dr": o.dense_rank(),
    "pr": o.percent_rank(),
    "cd": o.cume_dist(),
    "nt": o.ntile(7),
    "rs": o.running_sum("v"),
    "lg": o.lag("id", -1),
    "ld": o.lead("id"),
    "fv": o.first_value("id"),
    "lv": o.last_value("id"),
}


def data(spark, values):
    # one key holds most rows; a third of its rows share one order value
    df = spark.range(900).withColumn("k", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)))
    df = df.withColumn("x", F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.hash("id"), F.lit(values))))
    v = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 13)
    return df.withColumn("k", F.when(F.col("id") % 90 == 89, None).otherwise(F.col("k"))).withColumn("v", v)


@pytest.mark.parametrize("values", [4, 400])
@pytest.mark.parametrize("order", [["x"], ["-x"]])
def test_sliced_equals_plain(spark, values, order):
    df = data(spark, values)
    plain = o.ordered_measures(df, ["k"], order, ["id"], MEASURES)
    sliced = o.ordered_measures(df, ["k"], order, ["id"], MEASURES, group_limit=20, slices=9)
    assert rows(sliced) == rows(plain)


def test_global_tiles(spark):
    df = data(spark, 400)
    plain = o._plain(df, [], ["x"], ["id"], MEASURES)
    sliced = o.ordered_measures(df, [], ["x"], ["id"], MEASURES, group_limit=10, slices=8)
    assert rows(sliced) == rows(plain)


def test_more_tiles_than_rows(spark):
    df = spark.range(5).withColumn("x", F.col("id"))
    m = {"t": o.ntile(8)}
    assert rows(o.ordered_measures(df, [], ["x"], [], m, 1, 3)) == rows(o._plain(df, [], ["x"], [], m))
