"""The SimHash components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tidewright.llm import queries, simhash_dedup


def plain_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    values = np.array(sorted(parent), np.uint64)
    for i, p in enumerate(values):
        for q in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ p) <= 4]:
            parent[top(int(p))] = top(int(q))
    return {p: top(p) for p in parent}


def brute_force(rows):
    prints = [plain_print(t) for _, t in rows]
    tops = grouped(set(prints))
    low = {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            low[tops[p]] = min(doc, low.get(tops[p], doc))
    return sorted(((doc, f"{p:016x}", low.get(tops[p])) for (doc, _), p in zip(rows, prints, strict=True)), key=str)


def test_code_is_perfect_and_keys_meet():
    _, errors = simhash_dedup.tables()
    assert np.bitwise_count(errors).max() == 3 and len(set(errors.tolist())) == 2048
    rng = random.Random(1)
    for width in (23, 22, 21):
        for _ in range(300):
            word = rng.getrandbits(width)
            other = word
            for b in rng.sample(range(width), rng.randrange(3)):
                other ^= 1 << b
            _, (a, b) = simhash_dedup.keys(np.array([word, other]), width)
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_numbers_meet_up_to_four_bits():
    rng = random.Random(2)
    for _ in range(3000):
        one = rng.getrandbits(64)
        other = one
        for b in rng.sample(range(64), 4):
            other ^= 1 << b
        places, found = simhash_dedup.numbers(np.array([one, other], np.uint64))
        assert set(found[places == 0]) & set(found[places == 1])
    # Each way of laying four bits into three segments.
    at = [range(0, 22), range(22, 43), range(43, 64)]
    for split in itertools.product(range(5), repeat=3):
        if sum(split) <= 4:
            for _ in range(40):
                one = rng.getrandbits(64)
                other = one
                for bits, n in zip(at, split, strict=True):
                    for b in rng.sample(bits, n):
                        other ^= 1 << b
                places, found = simhash_dedup.numbers(np.array([one, other], np.uint64))
                assert set(found[places == 0]) & set(found[places == 1])


@pytest.mark.parametrize("slice_rows", [3, 8192])
def test_links_of_prints(spark, slice_rows):
    rng = random.Random(3)
    values = {0, 1, 31, (1 << 64) - 1}
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            value = center
            for b in rng.sample(range(64), rng.randrange(8)):
                value ^= 1 << b
            values.add(value)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash_dedup.links(spark.createDataFrame(signed, "print long"), slice_rows=slice_rows).collect()
    parent = {v: v for v in values}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for u, v in found:
        u, v = u % (1 << 64), v % (1 << 64)
        assert (u ^ v).bit_count() <= 4
        parent[top(u)] = top(v)
    want = grouped(values)
    assert len({top(v) for v in values}) == len(set(want.values()))
    assert len({(top(v), want[v]) for v in values}) == len(set(want.values()))


def test_texts_and_edges(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "a", "A", "a b c", "a b c d", "A  b\tc\nd", "é É ß", "x y " * 3000, "x y " * 3001, texts[0], texts[0].upper()]
    rows = [(None if i in (3, 150) else i % 140, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, text string, print string, number int, component_id int")
    found = simhash_dedup.near_components(df)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows)
    assert simhash_dedup.near_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash_dedup.near_components(df, near=5)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_simhash_dedup"](spark, sf).collect()), key=str) == brute_force(rows)


def test_table_rows_are_made_by_number_of_fingerprints(spark):
    """Some 80 rows are made of a fingerprint, so tasks follow from their number, not from the bytes of a small file."""
    prints = spark.range(1001).selectExpr("xxhash64(id) AS print").coalesce(1)
    spread = simhash_dedup.spread_prints(prints, 100)
    assert spread.rdd.getNumPartitions() == 11
    assert sorted(spread.collect()) == sorted(prints.collect())
    assert simhash_dedup.spread_prints(prints.limit(0)).count() == 0
