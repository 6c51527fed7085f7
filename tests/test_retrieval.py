"""Retrieval against brute force on small inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators import retrieval as rt

WORDS = "group by order window rank filter join select table spark the the the of of a".split()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    docs = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 25)))) for i in range(60)]
    docs[10] = (10, docs[3][1])  # an exact copy: must tie
    return docs, [(i, " ".join(rnd.choices(WORDS, k=6))) for i in range(8)]


def brute_bm25(docs, queries, k):
    def words(t):
        return [w for w in re.findall(r"[a-zA-Z0-9_]+", t.lower()) if len(w) > 1]

    split = {i: words(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, split.values())) / len(docs)
    df = Counter(w for ws in split.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = []
    for q, text in queries:
        scores = []
        for i, ws in split.items():
            tf = Counter(ws)
            s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in words(text))
            if round(s, 9) > 0:
                scores.append((-round(s, 9), i))
        out += [(q, i, round(-s, 4), r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("broadcast_limit", [2_000_000, 1])
def test_bm25_equals_brute_force(spark, texts, monkeypatch, broadcast_limit):
    monkeypatch.setattr(rt, "QUERY_TERMS_BROADCAST", broadcast_limit)
    docs, queries = texts
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    got = rt.keyword_top_k(rt.keyword_index(d, "doc_id"), "doc_id", q, "item_id", 7)
    assert sorted(tuple(r) for r in got.select("item_id", "doc_id", "score", "rank").collect()) == brute_bm25(docs, queries, 7)


@pytest.mark.parametrize("block", [4096, 2])
def test_cosine_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "VECTOR_QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(80, 8))
    vectors[20] = vectors[4] * 2  # same direction: must tie
    queries = rng.normal(size=(5, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q long, embedding array<double>")
    got = rt.vector_top_k(corpus.repartition(4), "vec_id", asked, "q", 6)
    want = []
    for i, q in enumerate(queries):
        sims = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
        best = sorted((-round(s, 9), j) for j, s in enumerate(sims))[:6]
        want += [(i, j, round(-s, 4), r + 1) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got.select("q", "vec_id", "score", "rank").collect()) == sorted(want)


def test_fusion_merges_equal_texts(spark):
    hits = "q long, doc_id long, text string, rank long"
    vector = spark.createDataFrame([(1, 1, "A", 1), (1, 2, "B", 2)], hits)
    keyword = spark.createDataFrame([(1, 3, "B", 1), (1, 4, "C", 2)], hits)
    got = rows(rt.fuse(vector, keyword, "q", "doc_id"))
    both = round(0.6 / 62 + 0.4 / 61, 6)
    assert got == sorted([(1, 3, both, 1), (1, 1, round(0.6 / 61, 6), 2), (1, 4, round(0.4 / 62, 6), 3)], key=repr)


def test_second_query_adds_only_unseen(spark):
    hits = "q long, doc_id long, text string, rank long"
    first = spark.createDataFrame([(1, 1, "A", 1), (1, 2, "B", 2)], hits)
    second = spark.createDataFrame([(1, 5, "B", 1), (1, 6, "C", 2), (1, 7, "C", 3)], hits)
    assert rows(rt.append_unseen(first, second, "q", "doc_id")) == [(1, 1, 1), (1, 2, 2), (1, 6, 3)]


def test_chunks_and_tokens(spark):
    text = "short\n\n" + "a" * 31 + "  \n\n" + "b" * 30 + "\n\n" + "c" * 40
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert rows(rt.chunks(df, ["id"])) == [(1, 0, "a" * 31), (1, 1, "c" * 40)]
    words = df.select(rt.tokens(F.lit("df.groupBy(x1).withColumn A")).alias("t")).first()[0]
    assert words == ["df", "group", "by", "x1", "with", "column"]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_postings_are_scored_in_blocks_of_queries_without_rows_of_pairs(spark, texts, monkeypatch, kind):
    docs, queries = texts
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    whole = rt.keyword_top_k(rt.keyword_index(d, "doc_id"), "doc_id", q, "item_id", 7)
    assert "MapInArrow" in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rt, "KEYWORD_QUERY_BLOCK", 2)
    got = rt.keyword_top_k(rt.keyword_index(d, "doc_id"), "doc_id", q, "item_id", 7)
    assert sorted((int(r[0]), *r[1:]) for r in got.collect()) == sorted((int(r[0]), *r[1:]) for r in whole.collect()) == brute_bm25(docs, queries, 7)
