"""Bucketed vector search against brute force over the same buckets."""

import numpy as np
import pytest

from tidewright.operators import retrieval as rt
from tidewright.operators import vector_index as vi
from tidewright.session import scratch_path


def frame(spark, rows, key="vec_id"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<float>")


def brute_force(rows, queries, k, tables, bits, probes):
    cuts, out = vi.planes(tables, bits, len(rows[0][1])), []

    def sides(v):
        whole = np.floor(np.array(v, np.float32).astype(float) * vi.SCALE).astype(np.int64)
        return (cuts @ whole).reshape(tables, bits)

    buckets = {i: [sum(1 << b for b in range(bits) if m[b] >= 0) for m in sides(v)] for i, v in rows}
    for q, v in queries:
        asked = []
        for m in sides(v):
            own = sum(1 << b for b in range(bits) if m[b] >= 0)
            efforts = sorted((sum(abs(int(m[b])) for b in range(bits) if mask >> b & 1), mask) for mask in range(1 << bits))
            asked.append({own ^ mask for _, mask in efforts[:probes]})
        scores = []
        for i, w in rows:
            if any(b in a for b, a in zip(buckets[i], asked)):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                both = np.linalg.norm(x) * np.linalg.norm(y)
                scores.append((-round(float(x @ y / both), 9) if both else -0.0, i))
        out += [(q, i, round(-s, 4), r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_same_buckets_as_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12)) for i in range(150)]
    rows += [(200 + i, np.ones(12)) for i in range(40)] + [(300, np.zeros(12))]  # one bucket holds many equal vectors
    queries = [(1, rng.normal(size=12)), (2, np.ones(12)), (3, np.zeros(12)), (4, -np.ones(12))]
    base = scratch_path(spark, "vectors")
    odd = frame(spark, [*rows, (400, None), (401, [None] + [1.0] * 11)])
    assert vi.build_index(odd.repartition(5), "vec_id", base, tables=3, bits=4) == 1
    index = vi.open_index(spark, base)
    assert index.rows.count() == 3 * len(rows)
    got = vi.probed_top_k(index, frame(spark, [*queries, (9, None)], "q"), "q", 7, probes=3, doc_id="vec_id")
    assert sorted(map(tuple, got.collect())) == brute_force(rows, queries, 7, 3, 4, 3)


def test_near_vectors_are_found_in_few_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32)) for i in range(3000)]
    queries = [(q, rows[q * 100][1] + rng.normal(size=32) * 0.25) for q in range(30)]
    base = scratch_path(spark, "vectors")
    corpus, asked = frame(spark, rows), frame(spark, queries, "q")
    vi.build_index(corpus, "vec_id", base, bits=9)
    index = vi.open_index(spark.newSession(), base)  # another session, nothing but the path
    asked = index.rows.sparkSession.createDataFrame(asked.collect(), asked.schema)
    got = vi.probed_top_k(index, asked, "q", 1, probes=8, doc_id="vec_id")
    assert sum(r.vec_id == r.q * 100 for r in got.collect()) >= 29
    probes = vi.bucket_rows(asked, "q", "embedding", index.tables, index.bits, index.size, 8).select("q", "table", "bucket")
    met = index.rows.join(probes, ["table", "bucket"]).select("q", "key").distinct().count()
    assert met < 0.25 * len(rows) * len(queries)


def test_search_reads_columns_and_shuffles_no_vector(spark):
    base = scratch_path(spark, "vectors")
    rng = np.random.default_rng(3)
    vi.build_index(frame(spark, [(i, rng.normal(size=8)) for i in range(50)]), "vec_id", base)
    found = vi.probed_top_k(vi.open_index(spark, base), frame(spark, [(1, np.ones(8))], "q"), "q", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any("vector#" in line and "Exchange hashpartitioning" in line for line in plan.splitlines())


def test_empty_index_and_recall(spark):
    base = scratch_path(spark, "vectors")
    vi.build_index(frame(spark, []), "vec_id", base)
    index = vi.open_index(spark, base)
    assert vi.probed_top_k(index, frame(spark, [], "q"), "q", 3).count() == 0
    rng = np.random.default_rng(4)
    corpus = frame(spark, [(i, rng.normal(size=16)) for i in range(300)])
    asked = corpus.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "q")
    vi.build_index(corpus, "vec_id", base, tables=12, bits=4)
    exact = rt.vector_top_k(corpus, "vec_id", asked, "q", 5)
    wide = vi.probed_top_k(vi.open_index(spark, base), asked, "q", 5, probes=12, doc_id="vec_id")
    assert vi.recall(wide, exact, "q", "vec_id").first()["recall"] == pytest.approx(1, abs=0.1)
    assert vi.open_index(spark, base, 1).rows.count() == 0  # the older version is still there
