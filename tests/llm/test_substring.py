"""Repeated word windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import common, minimisers, queries, substring_dedup


def brute_force(rows, k=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if counts[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed=7):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    made = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(0, 150))]
        at = rng.randrange(len(own) + 1)
        made.append(" ".join(own[:at] + passage[rng.randrange(10) : 60 - rng.randrange(16)] + own[at:]) if i % 2 else " ".join(own))
    return made + made[:3] + ["", None, "from " * 120, "a b " * 60, " ".join(passage[:34]), " ".join(passage[:35]), "x\x0by\n z"]


@pytest.mark.parametrize("limit", [20_000, 3])
def test_edges_and_hot_buckets(spark, limit):
    rows = [(None if i == 4 else i // 2 if i > 60 else i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, chunk string, row int, c0 int").repartition(3)
    got = substring_dedup.removal_digests(df, limit=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)
    cleaned = substring_dedup.without_repeats(df, limit=limit)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    sizes = sorted((str(r.doc_id), len((r.text or "").split())) for r in cleaned.collect())
    assert sizes == sorted((str(d), n - gone) for d, n, gone, _ in brute_force(rows))
    assert substring_dedup.removal_digests(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op10_substring_dedup"](spark, sf).collect()), key=str) == brute_force(rows)


def test_few_texts_are_objects_at_a_time(monkeypatch):
    """A batch of any size becomes Python objects in parts of some 2 MB of text; its rows keep their order."""
    seen = []
    monkeypatch.setattr(minimisers, "byte_texts", lambda batch: seen.append(batch.num_rows) or common.byte_texts(batch))
    texts = ["word " * 100_000, None, "", "é " * 1_200_000, "a b", *["x " * 50_000] * 40]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "row": pa.array(range(len(texts)))})
    rows = [r for (own,), words, _ in minimisers.documents(iter([batch]), ["row"]) for r in own if len(words) == len(own)]
    assert rows == list(range(len(texts))) and max(seen) <= 20 and len(seen) >= 4


def test_texts_travel_once(spark, tmp_path):
    """A task of ``without_repeats`` gets each column once, the text too, whatever its name."""
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, body string").write.parquet(f"{tmp_path}/docs")
    got = substring_dedup.without_repeats(spark.read.parquet(f"{tmp_path}/docs"), text_col="body")
    assert sorted(map(tuple, got.collect())) == [(1, "a b"), (2, None)]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Project \[doc_id#\d+L AS c0#\d+L, body#\d+ AS c1#\d+, concat_ws", plan)


def test_window_runs():
    rng = np.random.default_rng(3)
    hashes = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 4, 5, 80, 6, 200)]
    runs = minimisers.window_runs(hashes, 6, 2)
    for doc, h in enumerate(hashes):
        mine = runs.doc == doc
        assert runs.count[mine].sum() == max(len(h) - 5, 0)
        own = {}
        for start, count, value in zip(runs.start[mine], runs.count[mine], runs.value[mine], strict=True):
            assert len({tuple(h[s : s + 6]) for s in range(start, start + count)}) == count
            for s in range(start, start + count):
                assert own.setdefault(tuple(h[s : s + 6]), value) == value
