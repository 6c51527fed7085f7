"""Fingerprints: the contract's columns against plain Python, the walk against a character by character one."""

import hashlib
import random

import numpy as np
import pytest

from tidewright.llm import fingerprints, queries

E = ["", None, "a", "ab", "é中𝄞xyz" * 20, "long text " * 3000, "same", "same"]


def walk(text):
    """The writing of one text, a step at a time."""
    line, at, out = fingerprints.symbols(text), 0, []
    while line[at]:
        out.append(int(line[at]))
        at += int(fingerprints.walk_bits()[(len(out) - 1) % fingerprints.PERIOD, line[at]])
    return out


def test_walks_agree():
    rng = random.Random(5)
    texts = ["", "q"] + ["".join(rng.choice("abc def") for _ in range(n)) for n in (5, 31, 32, 33, 64, 500, 3000)]
    last, samples, early = fingerprints.fingerprints(texts)
    for t, top, got, before in zip(texts, last, samples, early, strict=True):
        out = walk(t)
        assert top == max(fingerprints.BASE, (len(out) - 1).bit_length() - 1 if len(out) > 1 else 0)
        for k in range(fingerprints.OCTAVES):
            octave = top - fingerprints.OCTAVES + 1 + k
            if octave >= fingerprints.BASE:
                wanted = [out[s] % 15 + 1 if s < len(out) else 0 for s in fingerprints.sampled_steps(octave)]
                assert got[k].tolist() == wanted
        octaves = range(fingerprints.BASE, top - fingerprints.OCTAVES + 1)
        for octave in octaves:
            assert before[octave - fingerprints.BASE].tolist() == [out[s] % 15 + 1 for s in fingerprints.sampled_steps(octave)[::8]]
        again = fingerprints.from_text(fingerprints.as_text(top, got, before))
        assert again[0] == top and again[1].tolist() == got.tolist() and again[2].tolist() == before[: len(octaves)].tolist()


def test_openings_tell_texts_apart():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ij") for _ in range(4000)) for _ in range(40)]
    other = ["".join(rng.choice("abcdefgh ij") for _ in range(200)) + t[200:] for t in texts]
    prints = [fingerprints.as_text(*p) for p in zip(*fingerprints.fingerprints(texts + other), strict=True)]
    assert len(set(prints)) == 80


def test_bands_of_two_are_compared_once(spark):
    """The first round compares both nodes of a band of two; only a larger band may hold other links between its components."""
    rows = [("two", "a", "a"), ("two", "b", "b"), ("three", "a", "a"), ("three", "b", "b"), ("three", "c", "c"), ("done", "a", "a"), ("done", "d", "a"), ("done", "e", "a")]
    labelled = spark.createDataFrame(rows, "band string, node string, c string")
    assert [tuple(r) for r in fingerprints.open_bands(labelled).collect()] == [("three", 1)]


def test_near_prints_share_a_band():
    """Of the pairs that reach the threshold nearly all are candidates, on either side of an octave's border too; of texts with an edit for 200 characters
    some seven in ten reach it."""
    rng, near, met = random.Random(11), 0, 0
    pairs = []
    for _ in range(250):
        one = [rng.choice("abcdefgh ijklmno") for _ in range(rng.randrange(300, 4000))]
        other = list(one)
        for _ in range(max(1, len(one) // 200)):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], ["x"], ["q", other[at]]])
        pairs += ["".join(one), "".join(other)]
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i]))
    found = dict(zip(order, zip(*fingerprints.fingerprints([pairs[i] for i in order]), strict=True), strict=True))
    for i in range(0, len(pairs), 2):
        a, b = found[i], found[i + 1]
        if fingerprints.likeness(a, b) >= 0.8:
            near += 1
            met += bool(set(fingerprints.bands(*a[:2])) & set(fingerprints.bands(*b[:2])))
    assert near >= 0.6 * 250 and met >= 0.95 * near


def check(rows, got):
    """rows: (id, text); ids distinct here."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = {r.doc_id: r for r in got}
    prints = {}
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", found[doc]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, p) == p
        if text == after:
            assert r.near_next == 1.0


def test_edges(spark, monkeypatch):
    rows = [(None if i == 2 else i, t) for i, t in enumerate(E)] + [(i, f"text {i} " * 9) for i in range(20, 60)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, range int, fingerprint string")
    for per in (2000, 5):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", per)
        check(rows, fingerprints.edited_fingerprints(df).collect())
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (1, "zz")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(twice).count() == 4
    assert fingerprints.edited_fingerprints(twice.limit(1)).first().near_next == 1.0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op4_fingerprints"](spark, sf).collect()
    check(rows, got)
    large = [r for r in got if r.n_chars > 200]
    assert np.mean([r.near_edited for r in large]) > 0.6 and np.mean([r.near_edited > r.near_next for r in large]) > 0.95


def test_edits_stay_near(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(1500)) for _ in range(12)]
    edited = [b[:40] + b[41:700] + "xy" + b[700:] for b in base]
    df = spark.createDataFrame(list(enumerate(base + edited + base[:2])), "doc_id long, text string")
    prints = fingerprints.edited_fingerprints(df)
    found = {r.doc_id: r.class_id for r in fingerprints.near_classes(prints, 0.6).collect()}
    hits = sum(found[i] == found[i + 12] for i in range(12))
    assert hits >= 9 and found[24] == found[0] and found[25] == found[1]
    assert len({found[i] for i in range(12)}) == 12


def brute_classes(prints, least):
    """Smallest member of each component of the pairs that share a band and reach ``least``."""
    own = [fingerprints.from_text(p) for p in prints]
    keys = [set(fingerprints.bands(*p[:2])) for p in own]
    part = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if part[i] != part[j] and keys[i] & keys[j] and fingerprints.likeness(own[i], own[j]) >= least:
                low, high = sorted((part[i], part[j]))
                part = [low if x == high else x for x in part]
    return dict(enumerate(part))


def test_classes_equal_brute_force(spark, monkeypatch):
    """Near pairs among many prints that share one band; some of it reach the threshold only over a third print."""
    rng = np.random.default_rng(3)
    made = lambda: (rng.integers(2, 16, (fingerprints.OCTAVES, fingerprints.SAMPLES)).astype(np.uint8), rng.integers(2, 16, (1, fingerprints.EARLY)).astype(np.uint8))
    octaves, places = (x[0] for x in fingerprints.band_places(9))
    hot = rng.integers(2, 16, fingerprints.BAND).astype(np.uint8)
    prints = []
    for i in range(40):
        samples, early = made()
        if i < 15:
            samples[octaves - 6, places] = hot
        chain = [samples]
        for _ in range(2):
            changed = chain[-1].copy()
            touched = rng.random(changed.shape) < 0.12
            if i < 15:
                touched[octaves - 6, places] = False
            changed[touched] = changed[touched] % 15 + 1
            chain.append(changed)
        prints += [(x, early) for x in chain]
    for _ in range(120):
        samples, early = made()
        samples[octaves - 6, places] = hot
        prints.append((samples, early))
    prints = [fingerprints.as_text(9, *p) for p in prints]
    wanted = brute_classes(prints, 0.8)
    assert sum(k != v for k, v in wanted.items()) >= 60
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    for most in (1000, 25):
        monkeypatch.setattr(fingerprints, "SLICE", most)
        assert {r.doc_id: r.class_id for r in fingerprints.near_classes(df).collect()} == wanted


def test_links_are_a_forest():
    _, samples, early = fingerprints.fingerprints(["same words in every text " * 40] * 30)
    prints = [bytes.fromhex(fingerprints.as_text(10, s, e)) for s, e in zip(samples, early, strict=True)]
    nodes = [bytes([i]) for i in range(30)]
    assert len(fingerprints.links_across(nodes, prints, nodes, 0.8)) == 29


def plain_likeness(a, b):
    """Octave by octave: all samples where both keep them, else every eighth of those steps."""
    top, agree, total = max(a[0], b[0]), 0.0, 0.0
    for octave in range(5, top + 1):
        rows = []
        for last, samples, early in (a, b):
            k = octave - last + 3
            rows.append(early[octave - 5].tolist() if k < 0 else samples[k].tolist() if k < 4 else [0] * 64)
        if octave <= top - 4:
            rows = [r if len(r) == 8 else r[::8] for r in rows]
        weight = 2.0 ** max(octave - 6, 0) * 64 / len(rows[0])
        agree += weight * sum(x == y > 0 for x, y in zip(*rows, strict=True))
        total += weight * sum(x > 0 or y > 0 for x, y in zip(*rows, strict=True))
    return agree / total if total else 1.0


def test_likeness_of_many():
    rng = random.Random(6)
    base = "".join(rng.choice("abcdef gh") for _ in range(900))
    texts = ["", "a", base[:20], base, base[:300] + base[310:], base[:450], base * 20, base * 20 + "end", base[5:] * 9]
    last, samples, early = fingerprints.fingerprints(texts)
    each = list(zip(last.tolist(), samples, early, strict=True))
    for one in each:
        found = fingerprints.likeness_to(*one, last, samples, early).tolist()
        assert found == [plain_likeness(one, other) for other in each] == [fingerprints.likeness(one, other) for other in each]


def test_query_classes(spark, sf):
    got = sorted(queries.QUERIES["op4_fingerprints"](spark, sf).collect(), key=lambda r: r.doc_id)
    wanted = brute_classes([r.fingerprint for r in got], 0.8)
    alone = {}  # equal fingerprints without a band
    for i, r in enumerate(got):
        first = alone.setdefault(r.fingerprint, i)
        wanted[i] = min(wanted[i], wanted[first])
    assert [r.class_id for r in got] == [got[wanted[i]].doc_id for i in range(len(got))]


def test_large_family_gives_an_edge_a_member(spark, monkeypatch):
    """The edges handed on grow with the members of a family, not with the bands they share; groups compared together give the links of each alone."""
    rng, edges = random.Random(31), []
    base = [f"w{rng.randrange(10**5)}" for _ in range(250)]
    texts = [" ".join(base)] + [" ".join(f"n{rng.randrange(10**5)}" if rng.random() < 0.004 else w for w in base) for _ in range(250)]
    last, samples, early = fingerprints.fingerprints(texts)
    rows = [(i, fingerprints.as_text(int(k), s, e)) for i, (k, s, e) in enumerate(zip(last, samples, early, strict=True))]
    joined = fingerprints.components

    def counted(links):
        edges.append(links.count())
        return joined(links)

    monkeypatch.setattr(fingerprints, "components", counted)
    fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert edges and max(edges) <= 2 * len({p for _, p in rows})
    prints = [bytes.fromhex(p) for _, p in rows[:90]]
    nodes = [bytes([i]) for i in range(90)]
    parts = [bytes([i % 25]) for i in range(90)]
    apart = [fingerprints.links_across(nodes[a:b], prints[a:b], parts[a:b], 0.8) for a, b in ((0, 2), (2, 50), (50, 90))]
    assert fingerprints.links_across(nodes, prints, parts, 0.8, [2, 48, 40]) == sum(apart, [])
