"""The n-gram Jaccard join against brute force."""

import random
import re

import pytest

from tidewright.llm import graph, jaccard_join, queries


def brute_force(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        near = {j for g in s for j in holders.get(g, ())}
        for j in near:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[top(i)] = top(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=str)


def family(seed, size, words, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


def test_families_and_edges(spark):
    texts = family(1, 60, 150, 6) + family(2, 25, 40, 3) + family(3, 10, 12, 1)
    texts += ["", None, "", "a b", "A B", "a b c d e", "a  b\tC d e ", "x", "é É", "same words here now ok", "same words here now ok", "tail word " * 30, "tail word " * 31]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, cid string, n_shingles int")
    assert sorted(map(tuple, jaccard_join.near_components(df).collect()), key=str) == brute_force(rows)
    assert jaccard_join.near_components(df.limit(0)).count() == 0
    wanted = sorted((d for d, _, c in brute_force(rows) if d == c), key=str)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == wanted


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op9_jaccard_join"](spark, sf).collect()), key=str) == brute_force(rows)


def test_word_hashes(monkeypatch):
    rng = random.Random(7)
    words = [bytes(rng.choice(b"abcz\x00\xc3\xa9~") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + [b"w" * 40, b"a", b"aa"]
    line = b" ".join(words)
    whole = jaccard_join.word_hashes(line)
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    by_word = {w: jaccard_join.word_hashes(w)[0] for w in words}
    assert whole.tolist() == [by_word[w] for w in words]
    jaccard_join.hash_tables.cache_clear()
    monkeypatch.setattr(jaccard_join, "HASHED", 64)  # lines are cut between words
    try:
        assert jaccard_join.word_hashes(line).tolist() == whole.tolist()
        assert len(jaccard_join.word_hashes(b"x " + b"y" * 200 + b" z")) == 3
    finally:
        jaccard_join.hash_tables.cache_clear()
    assert len(jaccard_join.word_hashes(b"")) == 0


@pytest.mark.parametrize("edges, parts", [([], {}), ([(i + 1, i) for i in range(40)], {0: 41}), ([(1, 2), (3, 2), (9, 8), (5, 5)], {1: 3, 8: 2})])
def test_components(spark, edges, parts):
    found = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    sizes = {}
    for r in found:
        sizes[r.component] = sizes.get(r.component, 0) + 1
    assert sizes == parts


def test_chance_meetings_are_not_listed(spark, monkeypatch):
    """Documents that share a few n-grams by chance make no entries and no texts; those near each other are all found."""
    rng, written = random.Random(11), {}
    common = [" ".join(f"c{rng.randrange(10**6)}" for _ in range(6)) for _ in range(40)]
    chance = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(120)] + [rng.choice(common)] + [f"w{rng.randrange(10**6)}" for _ in range(120)]) for _ in range(200)]
    near = family(12, 12, 100, 2)
    rows = list(enumerate(chance + near))
    cut = jaccard_join.cut_lineage

    def kept(df, label="cut"):
        written.setdefault(label, []).append(cut(df, label))
        return written[label][-1]

    monkeypatch.setattr(jaccard_join, "cut_lineage", kept)
    found = sorted(map(tuple, jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == brute_force(rows)
    assert written["prefixes"][0].select("cid").distinct().count() <= len(near) + 5
    assert all(texts.count() <= 4 * len(near) for texts in written["texts"])


@pytest.mark.parametrize("percent", [5, 50, 80, 95])
def test_linked_sets_share_enough(percent):
    """Sets that reach the threshold share the needed n-grams in their counted prefixes."""
    rng, linked = random.Random(percent), 0
    for _ in range(3000):
        n = rng.randrange(1, 80)
        a = set(rng.sample(range(1000), n))
        b = set(rng.sample(sorted(a), rng.randrange(n * percent // 100, n + 1))) | set(rng.sample(range(1000), rng.randrange(1 + n // 5)))
        if b and 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            first = [set(sorted(x)[: jaccard_join.prefix_length(len(x), percent) + jaccard_join.more(len(x), percent)]) for x in (a, b)]
            assert len(first[0] & first[1]) >= max(jaccard_join.shared_needed(len(x), percent) for x in (a, b))
    assert linked > 100
