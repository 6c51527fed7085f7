"""Repeated passages against brute force."""

import random
import re
from collections import Counter

from tidewright.llm import queries, suffix_dedup


def brute_force(rows, k=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        passages = []
        for i in range(len(w) - k + 1):
            if counts[tuple(w[i : i + k])] > 1:
                if passages and i <= passages[-1][1]:
                    passages[-1][1] = i + k
                else:
                    passages.append([i, i + k])
        out += [(doc, a, b, b - a) for a, b in passages]
    return sorted(out, key=str)


def texts():
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (50, 70, 200)]
    made = []
    for i in range(45):
        own = [word() for _ in range(rng.randrange(0, 150))]
        at = rng.randrange(len(own) + 1)
        made.append(" ".join(own[:at] + (passages[i % 3] if i % 4 else []) + own[at:]))
    return made + made[:2] + ["", None, " ".join(passages[2][:49]), " ".join(passages[2][100:160])]


def test_edges(spark):
    rows = [(None if i == 4 else i // 2 if i > 43 else i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, chunk string, row int, ids int").repartition(3)
    assert sorted(map(tuple, suffix_dedup.repeated_passages(df).collect()), key=str) == brute_force(rows)
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, texts()[2]), (2, "from " * 120)], "doc_id long, text string")
    assert [tuple(r) for r in suffix_dedup.repeated_passages(alone).collect()] == [(2, 0, 120, 120)]


def test_common_ends(spark):
    """Passages of two documents whose last words are those of hundreds of others."""
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(50_000)}"
    texts = []
    for size, tail, others in ((55, 30, 300), (52, 30, 400), (55, 35, 400), (60, 25, 300), (52, 44, 300), (70, 40, 300)) * 3:
        end = [word() for _ in range(tail)]
        passage = [word() for _ in range(size - tail)] + end
        for own in [end] * others + [passage] * 2:
            texts.append(" ".join([word() for _ in range(30)] + own + [word() for _ in range(rng.randrange(30))]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = brute_force(rows)
    assert len(found) == 36
    assert sorted(map(tuple, suffix_dedup.repeated_passages(df).collect()), key=str) == found


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op7_suffix_dedup"](spark, sf).collect()), key=str) == brute_force(rows)
