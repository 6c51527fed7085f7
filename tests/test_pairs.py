"""Training-pair jobs: one failing pair per check, and the promises of merge and split."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.functions import fixed_values as fv
from tidewright.operators import pairs as pr
from tidewright.operators import sampling
from tidewright.plans import corpus

GOOD = {
    "source_language": "sql",
    "difficulty": "easy",
    "source_code": "DELETE FROM parcels WHERE weight IS NULL AND depot NOT IN (SELECT depot FROM open_depots)",
    "pyspark_code": "kept = spark.table('parcels').filter('weight is not null').unionByName(late)\nkept.join(spark.table('open_depots'), 'depot', 'left_semi').write.save(out)",
    "features": ["delete", "anti join"],
    "generated_by": fv.ORIGINS[0],
}
CASES = {
    "good": (json.dumps(GOOD), None),
    "missing": (json.dumps({k: v for k, v in GOOD.items() if k != "pyspark_code"}), "required_fields"),
    "language": (json.dumps({**GOOD, "source_language": "cobol"}), "field_values"),
    "features": (json.dumps({**GOOD, "features": "x"}), "field_values"),
    "null code": (json.dumps({**GOOD, "pyspark_code": None}), "field_values"),
    "number code": (json.dumps({**GOOD, "pyspark_code": 5}), "field_values"),
    "short": (json.dumps({**GOOD, "pyspark_code": "df.count()"}), "minimum_length"),
    "syntax": (json.dumps({**GOOD, "pyspark_code": "spark.table('parcels') drop duplicates on depot"}), "pyspark_syntax"),
    "null byte": (json.dumps({**GOOD, "pyspark_code": GOOD["pyspark_code"] + "\0"}), "pyspark_syntax"),
    "no ops": (json.dumps({**GOOD, "pyspark_code": "def weigh(parcel):\n    return parcel.weight or 0"}), "dataframe_operations"),
    "todo": (json.dumps({**GOOD, "pyspark_code": GOOD["pyspark_code"] + "\n# FIXME: add the other depots"}), "no_placeholder_text"),
    "suffix": (json.dumps({**GOOD, "pyspark_code": GOOD["pyspark_code"] + "\noperand"}), "no_placeholder_text"),
    "unrelated": (
        json.dumps({**GOOD, "source_code": "SELECT barometer_qx7 FROM lighthouse_readings_kk", "pyspark_code": "spark.range(9).distinct().show()"}),
        "source_pyspark_alignment",
    ),
    "broken": (json.dumps(GOOD)[:-4], "invalid_json"),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    lines = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("blank", "  ")], "case string, value string")
    return {r["case"]: r for r in pr.validate_lines(lines).collect()}


@pytest.mark.parametrize("case", CASES)
def test_first_failed_check(verdicts, case):
    assert verdicts[case]["failed_check"] == CASES[case][1]
    assert verdicts[case]["valid"] == (CASES[case][1] is None)


def test_blank_lines_and_reasons(verdicts):
    assert "blank" not in verdicts
    assert verdicts["missing"]["reason"] == "Missing fields: pyspark_code"
    assert verdicts["short"]["reason"] == "pyspark_code too short (10 chars)"
    assert verdicts["null byte"]["reason"].startswith("Parse error: source code")
    assert verdicts["todo"]["reason"] == "Placeholder text found: 'FIXME: add'"
    assert verdicts["unrelated"]["reason"].startswith("Low alignment between source and pyspark (0%")


def test_split_is_disjoint_and_fills_quotas(spark, sf):
    pairs = corpus.pairs(spark, sf)
    test = pr.test_split(pairs, "seed")
    report = sampling.quota_report(pairs, ["source_language", "difficulty"], pr.quota_table(spark, fv.TEST_QUOTAS))
    taken = {(r[0], r[1]): r[2] for r in test.groupBy("source_language", "difficulty").count().collect()}
    assert taken == {(r["source_language"], r["difficulty"]): r["taken"] for r in report.collect() if r["taken"]}
    train = pr.train_without(pairs, test, "pair_id", "source_code")
    key = pr.source_key(F.col("source_code")).alias("k")
    assert train.select("pair_id").intersect(test.select("pair_id")).isEmpty()
    assert train.select(key).intersect(test.select(key)).isEmpty()
    assert rows(test.select("pair_id")) == rows(pr.test_split(pairs, "seed").select("pair_id"))


def test_short_stratum_gives_all_it_has(spark):
    df = spark.range(5).withColumn("s", F.when(F.col("id") < 2, "a").otherwise("b"))
    quotas = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "s string, quota int")
    got = sampling.quota_sample(df, ["s"], quotas, "x", "id").groupBy("s").count()
    assert rows(got) == [("a", 2), ("b", 2)]


@pytest.mark.parametrize("aim, spare", [(1.5, 4), (0.05, 0)])
def test_quota_sample_is_the_start_of_the_hash_order(spark, monkeypatch, aim, spare):
    monkeypatch.setattr(sampling, "AIM", aim)  # the second draw is short of rows at first
    monkeypatch.setattr(sampling, "SPARE", spare)
    df = spark.range(6000).withColumn("s", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 40, "b").otherwise("c"))
    quotas = spark.createDataFrame([("a", 50), ("b", 30), ("c", 9)], "s string, quota int")
    want = {s: sorted(hashed)[:n] for s, n in (("a", 50), ("b", 30), ("c", 9)) for hashed in [[(r.h, r.id) for r in df.filter(F.col("s") == s).withColumn("h", sampling.hash_order("z", "id")).collect()]]}
    got = sampling.quota_sample(df, ["s"], quotas, "z", "id")
    assert got.columns == df.columns
    assert rows(got) == sorted(((i, s) for s, picked in want.items() for _, i in picked), key=repr)


def test_few_rows_are_ranked(spark):
    df = spark.range(50_000).withColumn("s", F.col("id") % 2)
    wanted = spark.createDataFrame([(0, 400, 25_000, 400), (1, 400, 25_000, 400)], "s long, quota int, _size long, _wanted long")
    near = df.join(wanted, "s").filter(sampling.place_of("z", "id") < ((sampling.AIM * F.col("quota") + sampling.SPARE) / F.col("_size") * float(2**60)).cast("long"))
    assert near.count() <= 2 * 800


def test_requests_without_a_pool_get_no_example(spark):
    rows_of = [(1, "sql", "easy"), (2, "sql", "hard"), (3, "plsql", "easy")]
    requests = spark.createDataFrame(rows_of, "pair_id long, source_language string, difficulty string")
    pool = spark.createDataFrame([(10, "sql", "easy"), (11, "sql", "easy"), (12, "hiveql", "easy")], "pair_id long, source_language string, difficulty string")
    got = {r.pair_id: (r.example_id, r.same_difficulty) for r in pr.pick_examples(requests, pool, "s").collect()}
    assert got[1][0] in (10, 11) and got[1][1] is True
    assert got[2][0] in (10, 11) and got[2][1] is False
    assert got[3] == (None, None)


def test_merge_prefers_seeds_and_drops_blanks(spark):
    text = "x" * 100
    df = spark.createDataFrame([(1, "bulk", text + "1"), (2, "seed", "  " + text + "2"), (3, "bulk", "   "), (4, "bulk", "other")], "id long, origin string, text string")
    kept = pr.merge_by_priority(df, "text", "id", F.when(F.col("origin") == "seed", 0).otherwise(1))
    assert rows(kept.select("id")) == [(2,), (4,)]


def test_prompt_text(spark):
    df = spark.createDataFrame([("sql", "easy", "SELECT 1", ["a", "b"], ["t1", "t2", "t3", "t4"])], "l string, d string, s string, f array<string>, c array<string>")
    notes = pr.prompt_notes(F.col("f"), F.col("c"))
    text = df.select(pr.prompt_text(F.col("l"), F.col("d"), F.col("s"), notes)).first()[0]
    assert text.startswith("### Instruction:\nConvert the following SQL code to PySpark.\nDifficulty: easy\n\nNote: ")
    assert "- a\n- b\n" in text and "t1\n\nt2\n\nt3\n" in text and "t4" not in text
    assert text.endswith("### Input:\nSELECT 1\n\n### Response:\n")


def test_answers(spark):
    marked = "===FEATURES===\na, b\n===SOURCE_CODE===\nSELECT id FROM t\n===PYSPARK_CODE===\ndf = spark.table('t')\n===END==="
    headed = "## Features:\n- `a`\n- b\n### Source Code:\n```sql\nSELECT id FROM t\n```\n#### PySpark Code\n```python\ndf = spark.table('t')\n```"
    short = marked.replace("SELECT id FROM t", "SELECT")
    df = spark.createDataFrame([(1, marked), (2, headed), (3, short), (4, "nothing here")], "id int, raw string")
    got = rows(pr.parse_answer(df).select("id", "features", "source_code", "pyspark_code"))
    expected = (["a", "b"], "SELECT id FROM t", "df = spark.table('t')")
    assert got == [(1, *expected), (2, *expected)]


def test_an_answer_is_read_once(spark):
    answers = spark.createDataFrame([(1, "#### Source Code:\nSELECT 1 FROM t\n### PySpark_Code:\nspark.table('t')\n### END")], "id int, raw string")
    parsed = pr.parse_answer(answers.select("id", F.concat("raw", F.lit(" ")).alias("raw")))
    assert parsed.select("source_code", "pyspark_code").first() == ("SELECT 1 FROM t", "spark.table('t')")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?i)#{1,4}\s*FEATURES") == 1
