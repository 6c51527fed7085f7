"""Review of generated code on hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import masks
from tidewright.functions.python_check import parse_result
from tidewright.operators import review as rv
from tidewright.operators import scripts as sc

GOOD = """from pyspark.sql import Window, functions as F
w = Window.partitionBy('line').orderBy('opened')
valves = spark.sql('SELECT valve, line, opened FROM valves')
valves.join(spark.table('lines'), on='line').withColumn('nth', F.row_number().over(w)).where('nth = 1').write.orc('/out/first_valves')
"""
BAD = "readings = []\nwhile pending(df):\n    readings.extend(df.collect())\n"
SQL = "SELECT valve, ROW_NUMBER() OVER (PARTITION BY line ORDER BY opened) AS nth FROM valves JOIN lines USING (line)"


def review(spark, source, code):
    df = spark.createDataFrame([(source, code)], "raw_source string, pyspark_code string")
    return rv.full_review(sc.with_features(df, "raw_source")).first()


def test_good_code_passes(spark):
    row = review(spark, SQL, GOOD)
    assert row["passed"] and row["validation_score"] == 1.0 and row["semantic_score"] == 1.0
    assert row["lint_score"] == 1.0 and row["status"] == "success" and row["issues"] == []
    assert row["null_warnings"] == [
        "JOIN on lines — no null safety check detected. Add .filter(F.col('join_key').isNotNull()) before join"
    ]
    assert (row["risk_score"], row["risk_level"], row["manual_review"]) == (0.5, "medium", False)


def test_bad_code(spark):
    row = review(spark, SQL, BAD)
    severities = {f["name"]: f["severity"] for f in row["lint"]}
    assert severities["collect() on potentially large DataFrame"] == "high"
    assert row["lint_high"] == 1 and row["lint_score"] == 0.8
    assert not row["has_operations"] and not row["tables_match"] and row["validation_score"] == 0.5 and row["status"] == "failed"


@pytest.mark.parametrize("code", ["", "  \n ", None])
def test_empty_code(spark, code):
    row = review(spark, SQL, code)
    assert (row["validation_score"], row["passed"], row["semantic_score"]) == (0.0, False, 0.0)
    assert row["issues"] == ["Empty PySpark code returned"] and row["lint"] == []


def test_syntax_messages():
    assert parse_result("return while")[0] is False
    assert parse_result("x = 1") == (True, None, None)
    assert parse_result("a\0b")[0] is False
    assert parse_result(None) == (None, None, None)


def test_sensitive_columns(spark):
    row = review(spark, "SELECT id, pan_number, email, amount, customer_pan FROM t", GOOD)
    assert row["pii_columns"] == ["email", "pan_number"]
    assert row["risk_level"] != "low" and row["manual_review"]


def test_catalog_columns_count_too(spark):
    df = spark.createDataFrame([("SELECT 1", "x = 1", ["Email", "amount"])], "raw_source string, pyspark_code string, known array<string>")
    row = rv.with_risk(sc.with_features(df, "raw_source"), "known").first()
    assert row["pii_columns"] == ["email"]


def test_masks_leave_nothing_to_find(spark):
    text = "mail a.b@c.org card 4111-1111-1111-1234 phone 9876543210 id 234567890123 pan ABCDE1234F"
    masked = spark.createDataFrame([(text,)], "t string").select(masks.mask_text(F.col("t")).alias("t"))
    row = masked.select("t", masks.value_counts(F.col("t")).alias("c")).first()
    hits = {c["kind"]: c["hits"] for c in row["c"]}
    assert {k: hits[k] for k in ("email", "card", "phone", "aadhaar")} == {"email": 0, "card": 0, "phone": 0, "aadhaar": 0}
    # The fixed PAN mask keeps the shape of a PAN; the value itself is gone.
    assert "ABCDE1234" not in row["t"] and "XXXXX0000F" in row["t"]


def test_unbounded_and_bounded_value_scan(spark):
    df = spark.createDataFrame([("card 9876543298765432 pan ABCDE1234F ifsc HDFC0001234",)], "t string")
    loose = {c["kind"]: c["hits"] for c in df.select(masks.value_counts(F.col("t"))).first()[0]}
    strict = {c["kind"]: c["hits"] for c in df.select(masks.value_counts(F.col("t"), bounded=True)).first()[0]}
    assert loose["card"] == 1 and loose["phone"] == 1 and loose["aadhaar"] == 1
    assert strict == {"pan": 1, "aadhaar": 0, "card": 1, "email": 0, "phone": 0, "ifsc": 1}


def test_column_catalog(spark):
    names = [("email",), ("EMAIL_ID",), ("customer_pan",), ("passport_no",), ("amount",)]
    df = masks.classify_columns(spark.createDataFrame(names, "column_name string"))
    assert {r[0]: r[1] for r in df.collect()} == {
        "email": True, "EMAIL_ID": True, "customer_pan": False, "passport_no": True, "amount": False,
    }


def test_light_status_and_clean_output(spark):
    raw = "```python\nx = 1\n```\n### Instruction: more"
    df = spark.createDataFrame([(raw, True), ("y = 2 ### End rest", False)], "raw string, passed boolean")
    got = df.select(rv.clean_output(F.col("raw")), rv.light_status(F.col("passed"))).collect()
    assert [tuple(r) for r in got] == [("x = 1", "success"), ("y = 2", "low_confidence")]
