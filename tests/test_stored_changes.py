"""Statements on stored tables: results, counts, and what they leave alone."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import formatted_plan, rows
from tidewright.operators import stored_changes as sc
from tidewright.session import scratch_path


def table_of(spark, data, schema="k long, v string, n int, part int"):
    return sc.store(spark.createDataFrame(data, schema), scratch_path(spark, "stored"), "part")


def files(table):
    found = [os.path.join(d, f) for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")]
    return {os.path.relpath(f, table.path): os.stat(f).st_mtime_ns for f in found}


def folders(table):
    return {f for f in os.listdir(table.path) if f.startswith("part=")}


DATA = [(k, f"v{k}", k, k // 10) for k in range(60)] + [(100, "none", 1, None)]


def test_merge_rewrites_touched_partitions_only(spark):
    table = table_of(spark, DATA)
    before = files(table)
    source = spark.createDataFrame([(3, "new", 0), (71, "added", 7), (None, "lost key", 2)], "k long, v string, part int")
    assert sc.merge_into(table, source, ["k"]) == {"updated": 1, "inserted": 2}
    want = [(k, "new" if k == 3 else v, n, p) for k, v, n, p in DATA] + [(71, "added", None, 7), (None, "lost key", None, 2)]
    assert rows(table.rows()) == sorted(want, key=repr)
    after = files(table)
    for part in (1, 3, 4, 5):
        kept = {f: t for f, t in before.items() if f.startswith(f"part={part}/")}
        assert kept and kept.items() <= after.items()


def test_merge_moves_rows_and_updates_only(spark):
    table = table_of(spark, [(1, "a", 1, 0), (2, "b", 2, 1), (3, "c", 3, None)])
    moved = spark.createDataFrame([(1, 5), (3, 1), (9, 9)], "k long, part int")
    assert sc.merge_into(table, moved, ["k"], insert=False) == {"updated": 2, "inserted": 0}
    assert rows(table.rows()) == [(1, "a", 1, 5), (2, "b", 2, 1), (3, "c", 3, 1)]
    assert folders(table) == {"part=1", "part=5"}  # emptied partitions are gone
    with pytest.raises(ValueError):
        sc.merge_into(table, moved.unionByName(moved), ["k"])
    nothing = spark.createDataFrame([], "k long, part int")
    assert sc.merge_into(table, nothing, ["k"]) == {"updated": 0, "inserted": 0}
    without_place = spark.createDataFrame([(2, "bb"), (8, "h")], "k long, v string")
    assert sc.merge_into(table, without_place, ["k"]) == {"updated": 1, "inserted": 1}
    assert rows(table.rows()) == sorted([(1, "a", 1, 5), (2, "bb", 2, 1), (3, "c", 3, 1), (8, "h", None, None)], key=repr)


def test_untouched_target_is_neither_read_nor_shuffled(spark):
    table = table_of(spark, DATA)
    source = spark.createDataFrame([(3, "new", 0)], "k long, v string, part int")
    plan = formatted_plan(sc.merged_rows(table, [0], source, ["k"]))
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert "PartitionFilters: [isnotnull(part" in plan


def test_delete_counts_in_the_same_pass(spark):
    table = table_of(spark, [*DATA, (200, None, None, 5)])
    before = files(table)
    assert sc.delete_from(table, (F.col("n") < 12) & (F.col("k") < 90)) == {"deleted": 12}
    assert rows(table.rows()) == sorted([r for r in [*DATA, (200, None, None, 5)] if not (r[2] is not None and r[2] < 12 and r[0] < 90)], key=repr)
    assert "part=0" not in folders(table)
    after = files(table)
    kept = {f: t for f, t in before.items() if not f.startswith(("part=0/", "part=1/"))}
    assert len(kept) >= 5 and kept.items() <= after.items()
    assert sc.delete_from(table, F.lit(None).cast("boolean")) == {"deleted": 0}


def test_scd2_on_a_stored_dimension(spark):
    schema = "key long, city string, valid_from string, valid_to string, is_current boolean, slot int"
    place = lambda key: F.pmod(key, F.lit(4)).cast("int")
    first = [(k, "a", "2020", None, True, k % 4) for k in range(8)] + [(0, "z", "2019", "2020", False, 0)]
    table = sc.store(spark.createDataFrame(first, schema), scratch_path(spark, "dimension"), "slot")
    incoming = spark.createDataFrame([(0, "b"), (1, "a"), (12, "c"), (4, None)], "key long, city string")
    assert sc.scd2_into(table, incoming, "key", ["city"], F.lit("2024"), place) == {"closed": 2, "opened": 3}
    want = [(k, "a", "2020", None, True, k % 4) for k in (1, 2, 3, 5, 6, 7)] + [(0, "z", "2019", "2020", False, 0)]
    want += [(k, "a", "2020", "2024", False, 0) for k in (0, 4)]
    want += [(0, "b", "2024", None, True, 0), (4, None, "2024", None, True, 0), (12, "c", "2024", None, True, 0)]
    assert rows(table.rows()) == sorted(want, key=repr)
    assert sc.scd2_into(table, incoming, "key", ["city"], F.lit("2025"), place) == {"closed": 0, "opened": 0}
