"""Conversation repair against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewright.llm import conversation_repair as cr
from tidewright.llm import queries

FORM = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, lines) by a plain search from the back, trying every edit and up to three inserts at each place."""

    def follows(state, initial):
        return (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @functools.cache
    def best(i, state, left):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text = rows[i]
            c, a, lines = best(i + 1, state, 3)
            found.append((c + 2, "D" + a, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                for edit, cost, name in (("K", more, role), ("R", more + 1, "user"), ("R", more + 1, "assistant")):
                    if follows(state, name[:1]):
                        c, a, lines = best(i + 1, name[:1], 3)
                        found.append((c + cost, edit + a, (f"{name}:{text}", *lines)))
        if left:
            for name in ("user", "assistant"):
                if follows(state, name[0]):
                    c, a, lines = best(i, name[0], left - 1)
                    found.append((c + 5, "I" + a, (f"{name}:", *lines)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 3)


def tie(conv, role, text):
    """Rows of one turn and role come in the order of this digest."""
    name = "-0:" if conv is None else f"+{len(str(conv))}:{conv}"
    return hashlib.md5(f"{name}{len(role)}:{role}{text}".encode()).digest()


def brute_force(rows):
    by_conv = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        by_conv[conv].append((turn, role, text))
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], tie(conv, r[1], r[2])))
        pairs = [(role, text) for _, role, text in own]
        kinds = faults(pairs)
        turns = {t for t, *_ in own if t is not None}
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
        cost, audit, lines = cheapest(pairs, kinds)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, cr.damaged_and_repaired(df).collect()), key=str)


def many_rows(seed, convs, most):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        n = rng.randrange(1, most)
        for turn in rng.sample(range(-3, 2 * most), n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User"])
            rows.append((conv, turn, role, rng.choice(["yes.", "no!", "why?", "cut", "  ", "", "end. \t", "é", "ß.", f"r{rng.random()}."])))
    return rows


def test_solver_follows_every_way():
    """All sequences of up to four rows, with rules and without."""
    texts = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "o": ("tool", ".")}
    alphabet = ["s", "u", "a", "o", "S", "U", "A", "O", "x"]
    plain, shared = cr.Solver([]), cr.Solver(["ua", "au", "ĀĀ", "su", "Ux", "xu", "aU", "oo"])
    for n in range(5):
        for seq in itertools.product(alphabet, repeat=n):
            if n == 4 and hash(seq) % 7:
                continue
            rows = [texts[s.lower()] if s != "x" else ("user", "") for s in seq]
            kinds = ["blank" if s == "x" else "truncated" if s.isupper() else "" for s in seq]
            want = cheapest(rows, kinds)
            assert plain.solve("".join(seq)) == shared.solve("".join(seq)) == want[:2]
            lines = tuple(f"{r}:{t}" for _, r, t in cr.edited(want[1], ((r, t, 1) for r, t in rows)))
            assert lines == want[2] and FORM.match("".join(line[0] for line in lines))


def test_conversations_and_edges(spark):
    rows = many_rows(1, 150, 9) + [(500, None, "user", "hm."), (500, None, "assistant", None), (500, 3, None, "x."), (501, None, None, None), (502, 7, "assistant", "a."), (503, 1, "user", "same."), (503, 2, "user", "same."), (503, 2, "user", "same."), (503, 9, "assistant", "same."), (None, 4, "user", "lost."), (None, 5, "assistant", "found.")]
    drops = next((k, 0, "user", "one row.") for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append(drops)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, same string, n int")
    got = found(df)
    assert got == brute_force(rows)
    assert (drops[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert found(df.limit(0)) == []


def test_long_conversation_is_cut_into_fragments(spark, monkeypatch):
    monkeypatch.setattr(cr, "FRAGMENT", 7)
    rng = random.Random(6)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(40)}{rng.choice(['.', ''])}") for k in range(400)]
    rows = list({(c, t, r): (c, t, r, x) for c, t, r, x in rows}.values()) + [(2, 1, "user", "only.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    assert found(df) == brute_force(rows)


def test_repaired_rows(spark):
    rows = [("a", 1, "user", "hello."), ("a", 2, "user", "hello."), ("a", 3, "user", "more?"), ("a", 4, "assistant", "yes."), ("b", 1, "system", "be kind.")]
    got = sorted(map(tuple, cr.repair(spark.createDataFrame(rows, "conv_id string, turn short, role string, text string")).collect()))
    want = cheapest([r[2:] for r in rows[:4]], ["", "duplicate", "", ""])
    assert [f"{r[3]}:{r[4]}" for r in got if r[0] == "a"] == list(want[2])
    assert [r for r in got if r[0] == "b"] == []


def test_grammar_is_bounded(spark):
    rows = [("uaua" * 5,), ("suaua",), ("uauaxx",), ("oUoA",)] * 3
    rules = cr.grammar(spark.createDataFrame(rows, "seq string"), rounds=3, most=2)
    assert 0 < len(rules) <= 6 and len(cr.rewritten("uaua" * 5, rules)) < 8


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_conversation_repair"](spark, sf).collect()), key=str) == brute_force(rows)
