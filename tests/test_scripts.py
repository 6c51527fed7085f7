"""Script classification and features on hand-written inputs with stated results."""

import pytest
from pyspark.sql import functions as F

from tidewright import session
from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.operators import scripts as sc
from tidewright.plans import corpus

HIVE = "SELECT route, halt, minutes FROM timetable LATERAL VIEW OUTER EXPLODE(halts) hs AS halt CLUSTER BY route"
PLSQL = "BEGIN UPDATE boilers SET pressure = 0 WHERE pressure < 0; DBMS_LOCK.SLEEP(5); DELETE FROM boiler_alarms WHERE cleared = 1; END;"


@pytest.fixture(scope="module")
def features(spark):
    cases = {
        "simple": "SELECT DISTINCT gauge FROM boilers WHERE pressure >= 9 ORDER BY gauge",
        "join": "SELECT gauge FROM boilers CROSS JOIN shifts RIGHT OUTER JOIN fitters f ON f.badge = fitter_badge",
        "window": "SELECT badge, LEAD(started) OVER (ORDER BY started) - started AS gap FROM shifts",
        "aggregates": "SELECT AVG(pressure), MAX(pressure) FROM boilers HAVING MAX(pressure) > 3",
        "garbage": "%% half a thought, no statement ??",
        "hive": HIVE,
        "distribute": "SELECT gauge FROM boilers TABLESAMPLE(5 ROWS) b",
        "procedure": "ALTER PROCEDURE vent_all AS UPDATE boilers SET pressure = 1",
        "plsql": PLSQL,
        "empty": "",
        "blank": " \n\t ",
        "nested": "SELECT gauge FROM boilers WHERE pressure > (SELECT AVG(p) FROM (SELECT pressure AS p FROM old_boilers) o)",
        "cte": "WITH hot AS (SELECT gauge FROM boilers) SELECT gauge FROM hot WHERE EXISTS (SELECT 1 FROM fitters)",
        "udf": "SELECT to_bar(pressure) FROM boilers WHERE gauge IN (1, 2)",
        "assignment": "pressure := 1",
    }
    df = spark.createDataFrame(list(cases.items()), "case string, source string")
    return {r["case"]: r for r in sc.with_analysis(sc.with_features(df)).collect()}


@pytest.mark.parametrize(
    "case, language, score",
    [
        ("simple", "sql", 1),
        ("join", "sql", 2),
        ("window", "sql", 3),
        ("aggregates", "sql", 2),
        ("garbage", "sql", 1),
        ("hive", "hiveql", 1),
        ("distribute", "hiveql", 1),
        ("procedure", "stored_procedure", 3),
        ("plsql", "plsql", 4),
        ("empty", "sql", 1),
        ("blank", "sql", 1),
        ("nested", "sql", 3),
        ("cte", "sql", 3),
        ("udf", "sql", 4),
        ("assignment", "sql", 1),
    ],
)
def test_language_and_complexity(features, case, language, score):
    row = features[case]
    assert (row["source_language"], row["complexity_score"]) == (language, score)
    assert row["complexity_label"] == fv.COMPLEXITY_LABELS[score - 1]


def test_features(features):
    join = features["join"]["joins"]
    assert [(j["type"], j["table"], j["on"]) for j in join] == [("CROSS", "shifts", ""), ("RIGHT OUTER", "fitters", "f.badge = fitter_badge")]
    assert features["window"]["window_functions"] == ["LEAD"]
    assert features["aggregates"]["aggregations"] == ["AVG", "MAX"]
    assert features["join"]["tables"] == ["boilers", "fitters", "shifts"]
    assert features["nested"]["subquery_depth"] == 2 and features["nested"]["tables"] == ["boilers", "old_boilers"]
    assert features["cte"]["subquery_depth"] == 0 and features["cte"]["ctes"] == ["hot"]
    assert features["plsql"]["procedural_flags"] == ["DBMS package detected — no direct PySpark equivalent, manual review required"]


def test_analysis(features):
    plsql = features["plsql"]
    assert plsql["needs_procedural_context"]
    assert plsql["review_time"] == "approximately 60 min plus manual review of flagged constructs"
    assert "Window functions detected — verify PARTITION BY logic" in features["window"]["risk_notes"]
    assert features["simple"]["query_text"] == "migrate sql to pyspark Tables: boilers complexity simple"


def test_parameters_and_blocks(spark):
    text = "CREATE PROC p @Id INT, @Name VARCHAR(20) = 'x', @Total INT OUTPUT AS SELECT a FROM t WHERE a = 1; SELECT a FROM t WHERE a = 1; DELETE FROM u;"
    df = spark.createDataFrame([(text,)], "s string")
    row = df.select(
        sc.parameters(F.col("s")).alias("p"), sc.statement_blocks(F.col("s"), fv.TSQL_BLOCKS).alias("b"), sc.object_name(F.col("s")).alias("o")
    ).first()
    # The type pattern takes a comma that touches the type along; that is part of the agreed result.
    assert [tuple(p) for p in row["p"]] == [("@id", "INT,", "INPUT"), ("@name", "VARCHAR(20)", "INPUT"), ("@total", "INT", "OUTPUT")]
    assert row["b"] == ["SELECT a FROM t WHERE a = 1", "DELETE FROM u"]
    assert row["o"] == ""


def test_missing_field_is_noted_and_filled(spark):
    df = spark.createDataFrame([("sql", None)], "source_language string, tables array<string>")
    row = sc.complete_ir(df).first()
    assert "Missing required IR field: tables" in row["notes"] and row["tables"] == []
    wrong = spark.createDataFrame([("1",)], "subquery_depth string")
    assert "Field subquery_depth expected int, got string" in sc.complete_ir(wrong).first()["notes"]


def test_hive_notes_need_single_spaces(spark):
    df = spark.createDataFrame([("a distribute  by x",), ("a distribute by x",)], "s string")
    found = [r[0] for r in df.select(rules.keyword_hits(F.col("s"), fv.HIVE_NOTES)).collect()]
    assert found == [[], [fv.HIVE_NOTES[0][1]]]


@pytest.mark.parametrize(
    "script, tables",
    [
        ("SELECT o.id FROM sales.orders o LEFT SEMI JOIN crm.customers c ON o.cid = c.id", ["customers", "orders"]),
        ('SELECT id FROM "Orders" JOIN [dbo].[Lines] ON 1 = 1', ["lines", "orders"]),
        ("SELECT a.x FROM a, s.b AS y , c WHERE a.x IN (1, 2)", ["a", "b", "c"]),
        ("SELECT EXTRACT(YEAR FROM d), TRIM(BOTH FROM n) FROM t -- from nowhere", ["t"]),
        ("SELECT 'copied from x' FROM t /* from y */ ORDER BY p, q", ["t"]),
    ],
)
def test_table_names_of_ordinary_sql(spark, script, tables):
    df = spark.createDataFrame([(1, script)], "script_id int, source string")
    assert sc.with_features(df).first().tables == tables


@pytest.mark.parametrize(
    "script, columns",
    [
        ("SELECT b.gauge FROM plant.boilers b LEFT SEMI JOIN plant.fitters f ON b.badge = f.badge", ["badge", "gauge"]),
        ("SELECT serial, cost FROM spares", ["cost", "serial"]),
        ('SELECT "Gauge" AS g, [Cost] c, b.`PartNo`, 7, NULL FROM `my plant`.`the boilers` b', ["cost", "gauge", "partno"]),
        ("SELECT max(pressure), round(cost, 2) AS r, count(DISTINCT badge), count(*), tools.scale(x) FROM plant.spares", ["badge", "cost", "pressure", "x"]),
        ("SELECT gauge FROM boilers WHERE badge IN (SELECT ALL holder FROM badges, plant.keys)", ["gauge", "holder"]),
    ],
)
def test_columns_of_ordinary_sql(spark, script, columns):
    df = spark.createDataFrame([(1, script)], "script_id int, source string")
    assert sc.with_features(df).first()["columns"] == columns


def test_nested_window_arguments_and_built_ins(spark):
    sql = "SELECT SUM(COALESCE(a, ABS(b))) OVER (PARTITION BY c), CONCAT(x, REPLACE(y, 'a', 'b')), EXTRACT(YEAR FROM d) FROM t"
    row = sc.with_features(spark.createDataFrame([(1, sql)], "script_id int, source string")).first()
    assert row.window_functions == ["SUM"] and not row.has_udf and row.complexity_label == "complex"
    odd = "SELECT my_score(a) FROM s.t NATURAL JOIN u"
    row = sc.with_features(spark.createDataFrame([(1, odd)], "script_id int, source string")).first()
    assert row.has_udf and [(j["type"], j["table"]) for j in row.joins] == [("NATURAL", "u")]


def test_required_words_stand_in_every_match():
    assert rules.required(r"\bCREATE\s+(OR\s+REPLACE\s+)?(FUNCTION|TRIGGER)\b") == ("CREATE",)
    assert rules.required(r"(UPDATE\s+\w+\s+SET\s+.+?(?:WHERE\s+.+?)?);") == ("UPDATE", "SET", ";")
    assert rules.required(r"a(bc)+d(ef)?g{0,3}hi{2}[^]x)]\.k(?=never)") == ("a", "bc", "d", "h", ".k")
    assert rules.required(r"left|right") == rules.required(r"[ab]c?\w") == ()


def test_guarded_patterns_find_what_plain_ones_find(spark):
    patterns = [*fv.PROCEDURE_PATTERNS, *fv.PLSQL_PATTERNS, *fv.HIVEQL_PATTERNS, *fv.PLSQL_BLOCKS, *fv.TSQL_BLOCKS, sc.JOIN_PATTERN, sc.CTE_PATTERN, sc.SELECT_LIST, sc.WINDOW_PATTERN]
    texts = [*corpus.SCRIPTS, *map(str.lower, corpus.SCRIPTS), "", None, "ſelect ß from ıN", "exec\tX"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = [rules.matches(F.col("t"), p).eqNullSafe(F.col("t").rlike(rules.ANYWHERE + p)) for p in patterns]
    same += [rules.all_matches(F.col("t"), p).eqNullSafe(F.regexp_extract_all("t", F.lit(rules.ANYWHERE + p), F.lit(1))) for p in patterns if "(" in p and "(?i" not in p and "(OR" not in p and "ROW" not in p and p not in fv.PLSQL_PATTERNS and p not in fv.HIVEQL_PATTERNS]
    assert df.select(*[F.min(s).alias(str(i)) for i, s in enumerate(same)]).first() == tuple([True] * len(same))


def test_a_stored_table_has_files_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_FILE", 10)
    stored = session.stored_once(lambda: spark.range(100).coalesce(1), spark, "bounded-files", "test")
    assert len(stored.inputFiles()) == 10 and stored.count() == 100
