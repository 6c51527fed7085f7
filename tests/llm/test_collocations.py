"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm import collocations as co
from tidewright.llm import common


def brute_force(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found, n = [], totals[lang]
        often = {p: a for p, a in f.items() if a >= least}
        for p, a in often.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "new", "York", "é", "ß", "x", "of", "a", "\x01b", "b\x01", "ü" * 30]
    fixed = ["ad hoc basis", "in the long run we all", "New York", "a a a", "go go go go go go go"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(40))]
        out.append(("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for p in parts), rng.choice(["en", "de", None, "und", "x\ny"])))
    return out


def found(df, **options):
    got = co.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("least, top, slice_rows", [(3, 25, 100_000), (8, 2000, 5)])
def test_against_plain_counting(spark, least, top, slice_rows):
    rows = texts(least, 300) + [("", "en"), (None, "en"), (None, None), ("one", "lone"), ("word " * 20_000, "de"), ("same pair, " * 500, "en")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "text string, lang string, name string, phrase int").repartition(7)
    want = brute_force(rows, least, top)
    assert len(want) > 50
    assert found(df, least=least, top=top, slice_rows=slice_rows) == want


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert found(empty) == []
    assert found(spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")) == []
    with pytest.raises(ValueError):
        co.collocations(empty, least=0)


def test_many_held_phrases(spark, monkeypatch):
    monkeypatch.setattr(co, "HELD", 20)
    monkeypatch.setattr(co, "HASHES", 50)
    rows = texts(9, 120)
    df = spark.createDataFrame(rows, "text string, lang string")
    everything = spark.sparkContext.broadcast(np.full(1 << 20, 2**64 - 1, np.uint64))
    shards = co.shard_automata(co.named(df, "text", "lang"), [everything], [(b"en", b"new")])
    assert shards.filter("data IS NOT NULL").count() > 1
    assert found(df, least=4, top=50) == brute_force(rows, 4, 50)


def test_full_bit_sets_change_nothing(spark, monkeypatch):
    """A bit set that lets everything through costs work, not rows."""
    rows = texts(12, 150)
    monkeypatch.setattr(co, "bit_filter", lambda *_: np.full(1 << 20, 2**64 - 1, np.uint64))
    assert found(spark.createDataFrame(rows, "text string, lang string"), least=5, top=40) == brute_force(rows, 5, 40)


def test_automata():
    rng = random.Random(3)
    keys = {tuple(rng.choice("abcd") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 50) for _ in range(600)}
    automaton = co.Automaton(co.automaton_of(keys))
    assert list(automaton.paths()) == sorted(keys.items())
    assert all(automaton.weight(k) == n for k, n in keys.items())
    assert automaton.weight(("e",)) is None and automaton.weight(()) is None and automaton.weight(("a",) * 7) is None
    same = {(x, y, z): 5 + 3 * (x == "b") for x in "ab" for y in "cdef" for z in "gh"}
    builder = co.Builder()
    for k in sorted(same):
        builder.add(k, same[k])
    builder.finish()
    assert len(builder.closed) == 3  # equal continuations are one state
    bounds = [("a", "c"), ("b",), ("b", "d", "h")]
    parts = dict(co.by_range(same, bounds))
    assert sorted(k for d in parts.values() for k, _ in co.Automaton(d).paths()) == sorted(same)
    for r, d in parts.items():
        assert all(co.bisect_right(bounds, k) == r for k, _ in co.Automaton(d).paths())
    assert list(co.Automaton(co.automaton_of({})).paths()) == []


def test_word_codes_are_stored_by_text(spark):
    """A row per text: rows of many texts made batches of some 60 MB, in the JVM and in Python."""
    rows = [(f"word{i} of text, {i} " * 20, "en") for i in range(400)] + [(None, "de"), ("", None)]
    stored = co.coded(co.named(spark.createDataFrame(rows, "text string, lang string").coalesce(1), "text", "lang"))
    assert stored.count() == len(rows)
    assert stored.selectExpr("max(length(codes)) AS most").first().most <= 4 * 20 * 6
    assert stored.groupBy("name").sum("words").filter("name = CAST('en' AS BINARY)").first()[1] == 400 * 20 * 4


@pytest.mark.parametrize("limit", [50, 10**6])
def test_often_hashes_are_counted_in_blocks(spark, limit):
    """Hashes are shuffled in rows of many, not one each, and counted as grouping would."""
    rng = random.Random(limit)
    values = [rng.getrandbits(63) - rng.getrandbits(63) for _ in range(300)]
    drawn = [rng.choice(values[: rng.choice([5, 300])]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in drawn], "hash long").repartition(5)

    def hashes_of(batches):
        return (batch.column(0).to_numpy().view(np.uint64) for batch in batches)

    counted = Counter(drawn)
    for least in (1, 2, 9):
        found = common.often_hashes(df, hashes_of, least, limit)
        assert sorted(r.hash for r in found.collect()) == sorted(v for v, n in counted.items() if n >= least)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert common.often_hashes(df.limit(0), hashes_of, 1).count() == 0
