"""Physical plans: what reaches the scan, and what must never appear."""

import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return entry_module.queries()


def test_filters_and_columns_reach_the_scan(spark, sf, queries):
    plan = plan_of(queries["w28_explicit_projection"](spark, sf))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>", plan)
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(queries["w94_date_range"](spark, sf))


def test_top_n_is_cut_before_the_shuffle(spark, sf, queries):
    plan = plan_of(queries["w65_top_n_per_group"](spark, sf))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(queries["w69_top_n"](spark, sf))


def test_windows_share_one_exchange(spark, sf, queries):
    assert plan_of(queries["w67_shared_windows"](spark, sf)).count("Exchange hashpartitioning") == 1


def test_lookup_is_broadcast(spark, sf, queries):
    assert "BroadcastHashJoin" in plan_of(queries["w41_broadcast_lookup"](spark, sf))


def test_keyword_scores_are_summed_where_the_document_is(spark, sf, queries):
    plan = plan_of(queries["j54_bm25_top_k"](spark, sf))
    assert "REPARTITION_BY_COL" in plan
    assert not re.search(r"Exchange hashpartitioning\(item_id#\d+L, doc_id", plan)


@pytest.mark.parametrize(
    "name", ["j06_language_label", "j17_complexity", "j28_semantic_score", "j29_code_lint", "j32_risk_score", "j39_token_alignment"]
)
def test_script_checks_stay_in_the_jvm(spark, sf, queries, name):
    plan = plan_of(queries[name](spark, sf))
    assert "EvalPython" not in plan and "MapInPandas" not in plan


def test_row_local_reports_do_not_shuffle(spark, sf, queries):
    for name in ("j16_lexical_features", "j20_analysis", "j27_validation_score", "j35_review_report", "j36_pair_validation"):
        assert "Exchange" not in plan_of(queries[name](spark, sf)), name


def test_no_cartesian_product(spark, sf, queries):
    names = [n for n in queries if re.match(r"w(3|4|8)", n)]
    for name in names:
        plan = plan_of(queries[name](spark, sf))
        assert "CartesianProduct" not in plan, name
        if name != "w35_small_cross_join":
            assert "NestedLoop" not in plan, name


def test_expensive_arrays_are_evaluated_once(spark):
    from tidewright.functions import rules

    df = spark.createDataFrame([("a b",)], "t string")
    plan = plan_of(rules.unnest(df, [], F.split("t", " "), "w"))
    assert plan.count("split(") == 1


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry_module.__file__.rsplit("/", 1)[0])
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 190
