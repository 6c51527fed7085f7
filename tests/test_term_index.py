"""The term-ordered index against brute force, and what a search reads."""

import random

import pytest

from tests.conftest import formatted_plan
from tests.test_retrieval import brute_bm25
from tidewright.operators import term_index as ti
from tidewright.session import scratch_path

COMMON = "the of a in and".split()


def corpus(seed, n):
    rng = random.Random(seed)
    rare = [f"term{i}" for i in range(120)]
    docs = [(i, " ".join(rng.choices(COMMON, k=rng.randrange(3, 12)) + rng.choices(rare, k=rng.randrange(8)))) for i in range(n)]
    docs[9] = (9, docs[4][1])  # an exact copy: must tie
    asked = [(i, " ".join(rng.choices(rare, k=rng.randrange(1, 6)) + rng.choices(COMMON + ["absent"], k=2))) for i in range(12)]
    return docs, asked


@pytest.mark.parametrize("block, k, rare_only", [(4, 3, True), (128, 6, True), (4, 3, False)])
def test_same_as_brute_force(spark, block, k, rare_only):
    docs, asked = corpus(k, 200)
    if rare_only:
        asked = [(i, " ".join(w for w in t.split() if w.startswith("term"))) for i, t in asked]
    base = scratch_path(spark, "terms")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(asked, "item_id long, text string")
    assert ti.build_index(d, "doc_id", base, block=block) == 1
    got = ti.indexed_top_k(ti.open_index(spark, base), "doc_id", q, "item_id", k)
    assert got.columns == ["item_id", "doc_id", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_bm25(docs, asked, k)


def test_two_sessions_one_build_and_versions(spark, monkeypatch):
    docs, asked = corpus(1, 60)
    base = scratch_path(spark, "terms")
    ti.build_index(spark.createDataFrame(docs[:20], "doc_id long, text string"), "doc_id", base)
    assert ti.build_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", base) == 2

    def never(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(ti, "postings", never)
    other = spark.newSession()
    index = ti.open_index(other, base)
    assert (index.version, index.documents) == (2, 60)
    got = ti.indexed_top_k(index, "doc_id", other.createDataFrame(asked, "item_id long, text string"), "item_id", 4)
    assert sorted(map(tuple, got.collect())) == brute_bm25(docs, asked, 4)
    assert ti.open_index(other, base, 1).documents == 20
    # An unfinished build has no manifest and is not seen.
    other.createDataFrame([(1,)], "x int").write.parquet(f"{base}/build-unfinished/blocks")
    assert ti.open_index(other, base).version == 2


def test_files_of_unasked_terms_are_not_read(spark):
    docs, _ = corpus(2, 300)
    base = scratch_path(spark, "terms")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # so small a table would be one part
    try:
        ti.build_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", base)
    finally:
        spark.conf.unset(setting)
    index = ti.open_index(spark, base)
    asked = ti.asked_terms(index, spark.createDataFrame([(1, "term7")], "item_id long, text string"), "item_id")
    chosen = ti.asked_blocks(index, asked)
    plan = formatted_plan(chosen)
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    parts = {r.part for r in chosen.select("part").distinct().collect()}
    holding = {r.part for r in index.blocks.filter("term = 'term7'").select("part").distinct().collect()}
    every = {r.part for r in index.blocks.select("part").distinct().collect()}
    assert parts == holding and len(holding) < len(every)


def test_bounds_leave_documents_out(spark):
    """A strong rare word fixes the score to reach, so a weak common word brings no document of its own."""
    docs = [(i, "weak " + ("strong " * 3 if i < 8 else "") + f"x{i}") for i in range(400)] + [(1000 + i, f"other{i} words") for i in range(600)]
    base = scratch_path(spark, "terms")
    ti.build_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", base, block=16)
    index = ti.open_index(spark, base)
    asked = ti.asked_terms(index, spark.createDataFrame([(1, "strong weak")], "item_id long, text string"), "item_id")
    reached = ti.with_reached(index, asked, index.blocks, 5)
    assert reached.first()["reached"] > 0
    weak = reached.filter("term = 'weak'").first()
    assert weak.bound < weak.reached
    got = ti.indexed_top_k(index, "doc_id", spark.createDataFrame([(1, "strong weak")], "item_id long, text string"), "item_id", 5)
    assert sorted(map(tuple, got.collect())) == brute_bm25(docs, [(1, "strong weak")], 5)


def test_empty_index_and_string_ids(spark):
    base = scratch_path(spark, "terms")
    ti.build_index(spark.createDataFrame([], "name string, text string"), "name", base)
    q = spark.createDataFrame([(1, "any words")], "item_id long, text string")
    assert ti.indexed_top_k(ti.open_index(spark, base), "name", q, "item_id", 3).count() == 0
    ti.build_index(spark.createDataFrame([("a", "green apple"), ("b", "red apple"), ("c", None), ("d", "blue sky")], "name string, text string"), "name", base)
    got = ti.indexed_top_k(ti.open_index(spark, base), "name", spark.createDataFrame([(1, "green")], "item_id long, text string"), "item_id", 3)
    assert [(r.name, r["rank"]) for r in got.collect()] == [("a", 1)]
