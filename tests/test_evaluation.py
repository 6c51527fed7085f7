"""Published counts must come out of a results table laid out to them."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators import evaluation as ev

# Passed rows of 120 per language, and failure labels (syntax, semantic, operations) on the rest.
PASSED = {"sql": 77, "hiveql": 89, "plsql": 68, "stored_procedure": 39}
LABELS = {"sql": (38, 11, 3), "hiveql": (21, 9, 5), "plsql": (39, 10, 16), "stored_procedure": (66, 26, 34)}
DIFFICULTY = {"easy": (130, 93), "medium": (160, 92), "hard": (135, 62), "expert": (55, 26)}
COLUMNS = (
    "id long, model string, model_order int, family string, is_finetuned boolean, source_language string, difficulty string, "
    "syntax_valid boolean, has_pyspark_ops boolean, semantic_sim boolean, overall boolean"
)


@pytest.fixture(scope="module")
def results(spark):
    passing = [d for d, (_, ok) in DIFFICULTY.items() for _ in range(ok)]
    failing = [d for d, (n, ok) in DIFFICULTY.items() for _ in range(n - ok)]
    out = []
    for lang, ok in PASSED.items():
        failed = 120 - ok
        syntax, semantic, ops = LABELS[lang]
        for i in range(120):
            bad = i - ok
            s = 0 <= bad < syntax
            # The other labels fill the rows from the far end, so that every failed row has one.
            m = bad >= 0 and bad >= failed - semantic
            p = bad >= 0 and (bad + ops >= failed if semantic + syntax >= failed else failed - semantic - ops <= bad < failed - semantic)
            flags = (not s, not p, not m)
            diff = passing.pop() if bad < 0 else failing.pop()
            out.append((len(out), "tuned", 1, "f", True, lang, diff, *flags, all(flags)))
    base = [(1000 + i, "base", 0, "f", False, "sql", "easy", False, False, True, False) for i in range(10)]
    return spark.createDataFrame(out + base, COLUMNS)


def test_leaderboard(results):
    board = {r["model"]: r for r in ev.leaderboard(results).collect()}
    tuned = board["tuned"]
    for lang, ok in PASSED.items():
        assert tuned[lang] == ok / 120
    assert tuned["overall"] == 273 / 480 and round(tuned["overall"] * 100, 1) == 56.9
    assert board["base"]["overall"] == 0.0


def test_best_gain_and_difficulty(results):
    assert rows(ev.best_tuned(results)) == [("tuned", 273 / 480)]
    assert rows(ev.tuning_gain(results)) == [("f", 0.0, 273 / 480, 273 / 480)]
    by = {r["difficulty"]: (r["scripts"], r["overall"]) for r in ev.metric_breakdown(results.filter("is_finetuned"), ["difficulty"]).collect()}
    assert by == {d: (n, ok / n) for d, (n, ok) in DIFFICULTY.items()}


def test_failures(results):
    tuned = results.filter("is_finetuned")
    got = {(r["source_language"], r["category"]): r["n"] for r in ev.failure_categories(tuned).collect()}
    for lang, (syntax, semantic, ops) in LABELS.items():
        assert got[lang, "syntax_error"] == syntax
        assert got[lang, "low_semantic_alignment"] == semantic
        assert got[lang, "missing_dataframe_ops"] == ops
    main = {r["source_language"]: (r["category"], r["n"], r["failed"]) for r in ev.main_failure(tuned).collect()}
    assert main == {lang: ("syntax_error", LABELS[lang][0], 120 - ok) for lang, ok in PASSED.items()}
    best = ev.strongest_weakest(tuned).first()
    assert (best["strongest"], best["weakest"]) == ("hiveql", "stored_procedure")


@pytest.mark.parametrize("limit", [5_000_000, 50])
def test_rolling_rate(results, monkeypatch, limit):
    from tidewright.operators import ordered

    real = ordered.ordered_measures
    monkeypatch.setattr(ev.o, "ordered_measures", lambda *a: real(*a, group_limit=limit))
    got = {r["id"]: r["rolling_rate"] for r in ev.rolling_rate(results, "model", "id").collect()}
    flags = {r["id"]: r["overall"] for r in results.filter(F.col("model") == "tuned").collect()}
    for i in (0, 5, 19, 20, 100, 479):
        window = [flags[j] for j in range(max(0, i - 19), i + 1)]
        assert got[i] == sum(window) / len(window)


def test_last_script_with_the_prefix_wins(spark):
    long = "s" * 90
    scripts = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, "t")], "pair_id long, source_code string")
    found = spark.createDataFrame([(10, long), (11, "t"), (12, "none")], "id long, source_code string")
    assert rows(ev.attach_scripts(found, scripts, "pair_id").select("id", "script_id")) == [(10, 2), (11, 3), (12, None)]
