"""Joins, row changes, trees and ranking helpers."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.functions import legacy
from tidewright.operators import changes, hierarchy, joins
from tidewright.operators.aggregates import pivot_values
from tidewright.operators.ranking import best_rows_with_ties, bounded_lists, first_per_key, top_n_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    big = spark.range(600).withColumn("k", F.when(F.col("id") < 250, 1).otherwise(F.col("id") % 20))
    small = spark.range(0, 15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(skewed, how):
    big, small = skewed
    assert rows(joins.salted_join(big, small, "k", ["id"], 4, how).select("id")) == rows(big.join(small, "k", how).select("id"))


def test_repeated_rows_are_never_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 10 AS k").write.parquet(f"{tmp_path}/big")
    spark.range(10).selectExpr("id AS k", "id AS v").write.parquet(f"{tmp_path}/small")
    big, small = spark.read.parquet(f"{tmp_path}/big"), spark.read.parquet(f"{tmp_path}/small")
    plain = big.join(small, "k")
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().executedPlan().toString()
    for joined in (joins.salted_join(big, small, "k", ["id"], 1000), joins.hot_key_join(big, small, "k", ["id"], 50)):
        assert joined.count() == plain.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"Broadcast(HashJoin|NestedLoopJoin)[^\n]*_salt", plan)


def test_salting_refuses_outer_joins(skewed):
    with pytest.raises(ValueError):
        joins.salted_join(*skewed, "k", ["id"], 4, "full")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_null_guard_changes_no_row(skewed, how):
    big, small = skewed
    gaps = big.withColumn("k", F.when(F.col("id") % 3 != 0, F.col("k")))
    some = small.withColumn("k", F.when(F.col("k") != 2, F.col("k")))
    guarded = joins.null_guarded_join(gaps, some, "k", how)
    assert rows(guarded.select("id")) == rows(gaps.join(some, "k", how).select("id"))


def test_broadcast_only_when_small(skewed):
    big, small = skewed
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(joins.broadcast_if_small(small)).lower()
    assert "broadcast" not in plan(joins.broadcast_if_small(big, limit=10)).lower()
    with pytest.raises(ValueError):
        joins.small_cross_join(big, big, limit=5)


def test_bucketed_join_has_no_exchange(spark, skewed):
    big, small = skewed
    left, right = joins.write_bucketed(big, "l", "k", 4), joins.write_bucketed(small, "r", "k", 4)
    joined = joins.bucketed_join(spark, left, right, "k", "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == big.join(small, "k").count()


def test_null_predicate_leaves_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, x int")
    assert rows(changes.update_where(df, F.col("x") > 10, {"x": F.lit(0)})) == [(1, 5), (2, None), (3, 0)]
    assert rows(changes.delete_where(df, F.col("x") > 10)) == [(1, 5), (2, None)]
    assert rows(changes.affected_rows(df, F.col("x") > 10)) == [(1, 2)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, v double")
    source = spark.createDataFrame([(2, None), (3, "c")], "id int, s string")
    assert rows(changes.upsert(target, source, ["id"])) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)]
    with pytest.raises(ValueError):
        changes.upsert(target, source.unionByName(source), ["id"])


def test_balanced_updates_keep_other_accounts_and_the_total(spark):
    accounts = spark.createDataFrame([(1, 100), (2, 50), (3, 7)], "id int, balance int")
    deltas = spark.createDataFrame([(1, -100), (2, 100)], "id int, delta int")
    assert rows(changes.apply_deltas(accounts, deltas, "id", "balance", "delta")) == [(1, 0), (2, 150), (3, 7)]


def test_scd2_has_one_current_row_per_key(spark):
    schema = "id int, c string, valid_from string, valid_to string, is_current boolean"
    history = [(1, "w", "2019", "2020", False), (1, "x", "2020", None, True), (2, "y", "2020", None, True), (4, None, "2020", None, True)]
    dim = spark.createDataFrame(history, schema)
    incoming = spark.createDataFrame([(1, "z"), (2, "y"), (3, "n"), (4, None)], "id int, c string")
    got = changes.scd2(dim, incoming, "id", ["c"], F.lit("2024"))
    assert rows(got) == sorted(
        [history[0], (1, "x", "2020", "2024", False), (1, "z", "2024", None, True), history[2], (3, "n", "2024", None, True), history[3]],
        key=repr,
    )
    assert got.filter("is_current").groupBy("id").count().filter("count > 1").isEmpty()


def test_reach_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(hierarchy.reach(edges, start, 10)) == [("a", 0), ("b", 1), ("c", 2)]


def test_descend(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id int, up int")
    assert rows(hierarchy.descend(nodes, "id", "up", 5)) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)]


def test_top_n_with_and_without_salts(skewed):
    big, _ = skewed
    order = [F.desc("id")]
    assert rows(top_n_per_group(big, ["k"], order, 3)) == rows(top_n_per_group(big, ["k"], order, 3, spread_by=["id"]))


def test_best_rows_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 2, 1), ("b", None, 1), ("b", 3, 2), (None, 4, 4)], "k string, x int, y int")
    assert rows(best_rows_with_ties(df, ["k"], ["x"]).select("k", "x", "y")) == sorted([("a", 1, 5), ("a", 1, 6), ("b", None, 1), (None, 4, 4)], key=repr)
    assert rows(best_rows_with_ties(df, ["k"], ["-x", "y"]).select("k", "x", "y")) == sorted([("a", 2, 1), ("b", 3, 2), (None, 4, 4)], key=repr)


def test_first_per_key_and_bounded_lists(skewed):
    big, _ = skewed
    assert first_per_key(big, ["k"], ["id"], ["id"]).filter("k = 1").first()["id"] == 0
    pieces = bounded_lists(big, ["k"], "id", ["id"], 40)
    assert pieces.filter(F.size("values") > 40).isEmpty()
    assert rows(pieces.select("k", F.explode("values").alias("id"))) == rows(big.select("k", "id"))


def test_pivot_refuses_unbounded_values(skewed):
    with pytest.raises(ValueError):
        pivot_values(skewed[0], "id", limit=100)


def test_legacy_meanings(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) n, '' e, 'x' x, DATE'2023-12-31' a, DATE'2024-01-01' b, '05-MAR-2024' t")
    row = df.select(
        legacy.tsql_isnull(F.col("n"), F.col("x")).alias("isnull"),
        legacy.oracle_decode(F.col("n"), F.lit(None), F.lit("null"), F.lit("other")).alias("decode"),
        legacy.oracle_decode(F.col("x"), F.lit("y"), F.lit(1)).alias("no_default"),
        legacy.oracle_text(F.col("e")).alias("empty"),
        legacy.tsql_datediff("year", F.col("a"), F.col("b")).alias("years"),
        legacy.tsql_datediff("month", F.col("a"), F.col("b")).alias("months"),
        legacy.tsql_dateadd("month", F.lit(2), F.col("a")).cast("string").alias("later"),
        legacy.oracle_to_date(F.initcap("t"), "DD-MON-YYYY").cast("string").alias("date"),
        F.substring("x", -1, 1).alias("tail"),
    ).first()
    assert tuple(row) == ("x", "null", None, None, 1, 1, "2024-02-29", "2024-03-05", "x")


def test_bad_cast_is_null_only_with_try(spark):
    df = spark.createDataFrame([("12",), ("x",)], "s string")
    assert [r[0] for r in df.select(F.col("s").try_cast("int")).collect()] == [12, None]
    with pytest.raises(Exception):
        df.select(F.col("s").cast("int")).collect()


def test_keep_share_is_exact_at_the_ends(spark):
    from tidewright.operators import sampling

    df = spark.range(20_000)
    assert sampling.keep_share(df, 1.0, "s", "id").count() == 20_000
    assert sampling.keep_share(df, 0.0, "s", "id").count() == 0
    assert abs(sampling.keep_share(df, 0.5, "s", "id").count() - 10_000) < 300
    assert sampling.keep_share(spark.range(2_000_000), 1e-5, "s", "id").count() > 0
    with pytest.raises(ValueError):
        sampling.keep_share(df, 1.5, "s", "id")


def test_hierarchies_end_only_when_nothing_is_left(spark):
    chain = spark.range(30).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS up")
    assert hierarchy.descend(chain, "id", "up").count() == 30
    edges = chain.filter("up IS NOT NULL").selectExpr("up AS src", "id AS dst")
    start = spark.createDataFrame([(0,)], "node long")
    assert hierarchy.reach(edges, start).count() == 30
    with pytest.raises(ValueError):
        hierarchy.descend(chain, "id", "up", 3)
    with pytest.raises(ValueError):
        hierarchy.reach(edges, start, 3)
    assert hierarchy.descend(chain, "id", "up", 29).count() == 30


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain(skewed, how):
    big, small = skewed
    gaps = big.withColumn("k", F.when(F.col("id") % 7 != 0, F.col("k")))
    assert rows(joins.hot_key_join(gaps, small, "k", ["id"], 50, how).select("id")) == rows(gaps.join(small, "k", how).select("id"))
    with pytest.raises(ValueError):
        joins.hot_key_join(big, small, "k", ["id"], how="full")


def test_only_hot_keys_are_repeated(spark, skewed):
    big, small = skewed
    hot = joins.hot_keys(big, "k", 50)
    assert rows(hot) == [(1, 250 + big.filter("id >= 250 AND id % 20 = 1").count())]
    joined = joins.hot_key_join(big, small, "k", ["id"], 50)
    assert joined.count() == big.join(small, "k").count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the other side only, and there only a key with salts has more than one
    names = spark.createDataFrame([("x",)] * 40 + [("y",), (None,)], "name string")
    assert rows(joins.hot_keys(names, "name", 10)) == [("x", 40)]
    assert joins.hot_keys(names.limit(0), "name", 10).count() == 0


def test_rooted_reports_orphans_and_cycles(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, None), (10, 99), (11, 10), (12, 11), (20, 21), (21, 22), (22, 20), (23, 22), (24, 23), (30, 30)]
    nodes = spark.createDataFrame(edges, "id long, up long")
    lost = [(k, None, None, "missing parent") for k in (10, 11, 12)] + [(k, None, None, "cycle") for k in (20, 21, 22, 23, 24, 30)]
    assert rows(hierarchy.rooted(nodes, "id", "up")) == sorted([(1, 1, 0, None), (2, 1, 1, None), (3, 1, 2, None), (4, 4, 0, None), *lost], key=repr)
    assert hierarchy.rooted(nodes.limit(0), "id", "up").count() == 0


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = hierarchy.cut_lineage
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df, label: (rounds.append(label), cut(df, label))[1])
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    deepest = hierarchy.rooted(chain, "id", "up").agg(F.max("depth"), F.count_if(F.col("problem").isNull())).first()
    assert tuple(deepest) == (9_999, 10_000)
    assert len(rounds) < 20
