"""A table of legacy scripts, and of generated code for them, derived from ``orders``.

No given table holds scripts, so each order selects one of the texts below and fills in its
table name, column name and number. The tables grow with ``orders``; the checking engine
builds the same rows from the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.plans.registry import quote, quoted_list
from tidewright.session import spread, stored_once, table

# Names that fill a text: each row takes one given table, with three of its columns.
TABLE_NAMES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "events")
COLUMN_NAMES = ("c_acctbal", "o_totalprice", "l_extendedprice", "p_retailprice", "s_acctbal", "n_regionkey", "value")
KEY_NAMES = ("c_custkey", "o_orderkey", "l_orderkey", "p_partkey", "s_suppkey", "n_nationkey", "event_id")
LABEL_NAMES = ("c_mktsegment", "o_orderpriority", "l_returnflag", "p_brand", "s_name", "n_name", "event_type")

# Twelve texts per language (sql, hiveql, plsql, stored_procedure), each with its nesting depth of subqueries. A text is there for the rules it meets or just misses.
TEXTS = (
    ("SELECT s_name, count(*) AS offered FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_name HAVING count(*) > {n}", 0),
    ("SELECT {key}, LAG({col}, 2, 0) OVER (ORDER BY {key}) AS two_before, {col} / NULLIF(SUM({col}) OVER (), 0) AS share FROM {tbl}", 0),
    ("SELECT n_name, r_name FROM nation NATURAL JOIN region UNION ALL SELECT s_name, s_name FROM supplier WHERE s_acctbal < -{n}", 0),
    (
        "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > {n}),\n"
        "quiet AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM big))\nSELECT count(c_custkey) FROM quiet",
        1,
    ),
    ("SELECT p_brand, p_type FROM part WHERE p_size = (SELECT max(p_size) FROM part WHERE p_retailprice < (SELECT avg(p_retailprice) + {n} FROM part))", 2),
    (
        "SELECT c.c_name, l.l_partkey, p.p_name, s.s_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey\n"
        "JOIN part p ON p.p_partkey = l.l_partkey RIGHT JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE c.c_acctbal > {n}",
        0,
    ),
    ("SELECT fiscal_band({col}), grade_of({key}, {n}) FROM {tbl} -- both written in house, from an old schema", 0),
    ("SELECT CASE WHEN {col} IS NULL THEN 'none' WHEN {col} < {n} THEN 'low' ELSE 'rest' END AS band, MIN({key}), MAX({key}) FROM {tbl} GROUP BY 1", 0),
    ('SELECT "{lab}", [{col}] FROM "warehouse"."{tbl}" /* {n} rows from one site */ WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = {n})', 0),
    ("SELECT email, phone_number, dob FROM client_contacts cc FULL OUTER JOIN customer c ON c.c_custkey = cc.client WHERE cc.opted_in = {n}", 0),
    ("SELECT a.{key} FROM {tbl} a LEFT ANTI JOIN {tbl}_old b ON a.{key} = b.{key} CROSS JOIN region, nation WHERE EXTRACT(YEAR FROM a.seen) = {n}", 0),
    ("SELECT x.k FROM (SELECT y.k FROM (SELECT z.{key} AS k FROM (SELECT {key} FROM {tbl}) z) y) x WHERE x.k <> {n}", 3),
    ("SELECT {key}, tag FROM {tbl} LATERAL VIEW OUTER EXPLODE(tags) tg AS tag WHERE {col} > {n} CLUSTER BY {key}", 0),
    ("INSERT OVERWRITE TABLE {tbl}_daily PARTITION (ds) SELECT {lab}, sum({col}), ds FROM {tbl} GROUP BY {lab}, ds DISTRIBUTE BY ds", 0),
    ("CREATE TABLE {tbl}_archive ({key} BIGINT, {lab} STRING) PARTITIONED BY (yr INT) STORED AS PARQUET", 0),
    ("SELECT smp.{key} FROM {tbl} TABLESAMPLE (BUCKET 3 OUT OF 32 ON {key}) smp", 0),
    ("SELECT yr, word, COUNT(1) AS seen FROM notes LATERAL VIEW EXPLODE(words) w AS word LATERAL VIEW EXPLODE(years) y AS yr GROUP BY yr, word SORT BY seen DESC", 0),
    ("FROM {tbl} SELECT TRANSFORM ({lab}) USING '/bin/cat' AS (line) DISTRIBUTE BY {key} SORT BY {key}, line", 0),
    ("CREATE EXTERNAL TABLE IF NOT EXISTS {tbl}_in ({key} INT, note STRING) ROW FORMAT DELIMITED FIELDS TERMINATED BY ';' STORED AS TEXTFILE", 0),
    ("SELECT ROW_NUMBER() OVER (PARTITION BY {lab} ORDER BY {col}) AS pos, {key} FROM {tbl} DISTRIBUTE BY {lab} SORT BY pos", 0),
    ("SELECT o.o_orderpriority, SUM(l.l_quantity) FROM lineitem l LEFT SEMI JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority CLUSTER BY o_orderpriority", 0),
    ("SET hive.exec.parallel = true; SELECT {lab} FROM {tbl} WHERE {key} IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > {n})", 1),
    ("WITH daily AS (SELECT {key}, {col} FROM {tbl}) SELECT {key}, AVG({col}) AS level FROM daily GROUP BY {key} DISTRIBUTE BY {key}, level LIMIT {n}", 0),
    ("SELECT get_json_object(props, '$.k') AS k, event_type FROM events LATERAL VIEW EXPLODE(pieces) pr AS piece DISTRIBUTE BY event_type ORDER BY k", 0),
    (
        "DECLARE\n  n_seen PLS_INTEGER := 0;\nBEGIN\n  SELECT COUNT(*) INTO n_seen FROM {tbl} WHERE {col} > {n};\n"
        "  IF n_seen > 10 THEN DBMS_OUTPUT.PUT_LINE('many ' || n_seen); END IF;\nEND;",
        0,
    ),
    ("CREATE OR REPLACE TRIGGER {tbl}_stamp BEFORE UPDATE ON {tbl} FOR EACH ROW\nBEGIN\n  INSERT INTO change_log VALUES (:new.{key}, SYSDATE);\nEND;", 0),
    (
        "DECLARE\n  CURSOR late IS SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_quantity < {n};\nBEGIN\n  OPEN late;\n"
        "  FETCH late INTO v_key, v_day;\n  CLOSE late;\nEND;",
        0,
    ),
    (
        "CREATE FUNCTION credit_of(p_id NUMBER) RETURN NUMBER IS\n  v_sum NUMBER;\nBEGIN\n  SELECT c.c_acctbal INTO v_sum FROM customer c INNER JOIN nation n\n"
        "    ON n.n_nationkey = c.c_nationkey WHERE c.c_custkey = p_id;\n  RETURN v_sum;\nEXCEPTION\n  WHEN NO_DATA_FOUND THEN RETURN {n};\nEND;",
        0,
    ),
    (
        "BEGIN\n  FOR r IN (SELECT {key}, {col} FROM {tbl} ORDER BY {col}) LOOP\n    UPDATE totals SET amount = amount + r.{col} WHERE id = r.{key};\n"
        "  END LOOP;\nEND;",
        0,
    ),
    ("DECLARE\n  i NUMBER := 1;\nBEGIN\n  WHILE i < {n} LOOP\n    DELETE FROM {tbl} WHERE {key} = i;\n    i := i + 1;\n  END LOOP;\nEND;", 0),
    (
        "DECLARE\n  TYPE key_list IS VARRAY(50) OF NUMBER;\n  picked key_list;\nBEGIN\n  SELECT {key} BULK COLLECT INTO picked FROM {tbl} WHERE ROWNUM <= 50;\n"
        "  FORALL k IN 1 .. picked.COUNT UPDATE {tbl} SET {col} = 0 WHERE {key} = picked(k);\nEND;",
        0,
    ),
    (
        "CREATE OR REPLACE PACKAGE BODY {tbl}_tools AS\n  FUNCTION all_keys RETURN key_table PIPELINED IS BEGIN\n"
        "    FOR q IN (SELECT {key} FROM {tbl}) LOOP PIPE ROW(q.{key}); END LOOP; RETURN;\n  END;\nEND;",
        0,
    ),
    ("BEGIN\n  EXECUTE IMMEDIATE 'TRUNCATE TABLE {tbl}_tmp';\n  DBMS_STATS.GATHER_TABLE_STATS('own', '{tbl}');\n  UTL_FILE.FCLOSE_ALL;\nEND;", 0),
    (
        "DECLARE v NUMBER; BEGIN\n  MERGE INTO part p USING (SELECT ps_key, ps_cost FROM price_feed) f ON (p.p_partkey = f.ps_key)\n"
        "  WHEN MATCHED THEN UPDATE SET p.p_retailprice = f.ps_cost;\n  COMMIT;\nEND;",
        1,
    ),
    ("CREATE OR REPLACE PACKAGE shapes AS\n  OBJECT TYPE address;\n  TYPE spots IS NESTED TABLE OF address;\n  PROCEDURE fill(p_rows NUMBER);\nEND;", 0),
    ("DECLARE worst NUMBER; BEGIN\n  SELECT MAX(total) INTO worst FROM (SELECT l_suppkey, SUM(l_tax) AS total FROM lineitem GROUP BY l_suppkey) WHERE total < {n};\nEND;", 1),
    (
        "CREATE PROCEDURE dbo.raise_{tbl} @floor INT, @pct DECIMAL(5,2) = 3, @changed INT OUTPUT AS\nBEGIN\n"
        "  UPDATE {tbl} SET {col} = {col} * (1 + @pct) WHERE {key} > @floor;\n  SELECT @changed = @@ROWCOUNT;\nEND",
        0,
    ),
    (
        "ALTER PROCEDURE nightly_{tbl} AS\nSET NOCOUNT ON;\nSELECT {key}, SUM({col}) AS total INTO #sums FROM {tbl} GROUP BY {key};\n"
        "INSERT INTO #sums SELECT {key}, 0 FROM {tbl} WHERE {col} IS NULL;\nEXEC post_totals @day = '1997-05-01'",
        0,
    ),
    ("CREATE PROC tidy AS\nBEGIN TRY\n  BEGIN TRAN;\n  DELETE FROM {tbl} WHERE {key} = {n};\n  COMMIT TRAN;\nEND TRY\nBEGIN CATCH\n  ROLLBACK;\n  THROW;\nEND CATCH", 0),
    (
        "CREATE PROCEDURE spread_{tbl} AS\nDECLARE keys CURSOR FOR SELECT {key} FROM {tbl} WHERE {col} > {n};\nOPEN keys;\nFETCH NEXT FROM keys INTO @k;\n"
        "WHILE @@FETCH_STATUS = 0 BEGIN\n  UPDATE {tbl} SET {col} = 0 WHERE {key} = @k;\n  FETCH NEXT FROM keys INTO @k;\nEND",
        0,
    ),
    ("CREATE PROCEDURE guard AS\nIF EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)\n  RAISERROR('negative order', 16, 1);\nELSE\n  PRINT 'clean';", 0),
    (
        "CREATE PROCEDURE fold_prices AS\nMERGE part AS p USING price_feed AS f ON p.p_partkey = f.part_no WHEN MATCHED THEN UPDATE SET p.p_retailprice = f.price\n"
        "WHEN NOT MATCHED THEN INSERT (p_partkey) VALUES (f.part_no);",
        0,
    ),
    (
        "CREATE PROCEDURE remote_rates AS\nSELECT r.code, r.rate FROM OPENROWSET('provider', 'host', 'select code, rate from rates') r WHERE r.rate > {n};\n"
        "-- reached through a linked server",
        0,
    ),
    (
        "CREATE PROCEDURE keep_top @many INT AS\nDECLARE @best TABLE (k BIGINT, v FLOAT);\nINSERT INTO @best SELECT TOP (5) {key}, {col} FROM {tbl} ORDER BY {col} DESC;\n"
        "SELECT b.k, n.n_name FROM @best b LEFT JOIN nation n ON n.n_nationkey = b.k;",
        0,
    ),
    ("SET XACT_ABORT ON; EXEC archive_{tbl} {n}; EXEC purge_{tbl}", 0),
    ("CREATE PROCEDURE ranked AS\nSELECT c_custkey, NTILE(10) OVER (ORDER BY c_acctbal DESC) AS decile, COUNT(*) OVER (PARTITION BY c_nationkey) AS peers FROM customer;", 0),
    (
        "CREATE PROCEDURE yearly AS\nWITH per_year AS (SELECT YEAR(o_orderdate) AS y, SUM(o_totalprice) AS t FROM orders GROUP BY YEAR(o_orderdate))\n"
        "SELECT y, t FROM per_year WHERE t > (SELECT AVG(t) FROM per_year);",
        1,
    ),
    (
        "CREATE PROCEDURE find_card @card_no VARCHAR(19), @ssn VARCHAR(11) AS\nSELECT x.card_no, x.ssn, x.email FROM card_owners x\n"
        "WHERE x.card_no = @card_no AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = x.holder);",
        0,
    ),
)
SCRIPTS = tuple(text for text, _ in TEXTS)
DEPTHS = tuple(depth for _, depth in TEXTS)
SCRIPTS_PER_LANGUAGE = 12
DECLARED = ("sql", "hiveql", "plsql", "stored_procedure")

# Generated code for a script; where a text is not valid Python, what the compiler says of it is stated next to it.
CODES = (
    (
        "from pyspark.sql import functions as F\n\nrows = spark.table('{tbl}')\nout = rows.where(F.col('{col}') > {n}).select('{key}', '{col}')\n"
        "out.write.format('orc').save('/lake/{tbl}')\n",
        None,
    ),
    (
        "from pyspark.sql import Window, functions as F\n# REVIEW the order of ties is not fixed\nw = Window.orderBy(F.desc('{col}'))\n"
        "top = spark.read.parquet('/lake/{tbl}').withColumn('place', F.row_number().over(w)).limit({n})\n",
        None,
    ),
    ("limit = {n}\nnames = sorted(['{lab}', '{key}'])\nassert limit >= 0, names", None),
    ("spark.sql('SELECT {key} FROM {tbl}').show()  # lorem ipsum, to be written", None),
    ("best = spark.table('{tbl}').groupBy('{lab}').count()\nmonitor", None),
    ("cut = spark.table('{tbl}').filter(\n    '{col} > {n}'\nprint(cut.count())", "line 1: '(' was never closed"),
    ("other = spark.read.json('/in/telemetry')\nother.agg({'x': 'max'}).show()", None),
    ("kept = []\nfor row in spark.table('{tbl}').toLocalIterator():\n    kept.append(row)\nkeys = spark.table('{tbl}').collect()\n", None),
    (
        "from pyspark.sql import functions as F\nslow = F.udf(str.upper)\nleft = spark.table('{tbl}').cache()\n"
        "wide = left.crossJoin(left.select('*')).repartition(600).cache()\nfor part in parts:\n    wide.filter(part).collect()\n",
        None,
    ),
    ("df.count()", None),
    (" \t\n", None),
    (
        "a, b, c, d = (spark.read.table(t) for t in ('{tbl}', 'nation', 'region', 'supplier'))\nj = a.join(b, 'k').join(c, 'k').dropna(subset=['k']).join(d, 'k')\n"
        "j.write.mode('error').json('/lake/joined')\n",
        None,
    ),
    ("select {key} from {tbl} where {col} > {n}", "line 1: invalid syntax"),
    ("df = spark.table('{tbl}')\ndf = df.union(df).distinct().orderBy('{key}').drop('{lab}')\ndf.createOrReplaceTempView('both')\n", None),
    (
        "import pyspark.sql.functions as F\n# TODO manual step for the cursor\nstage = spark.table('{tbl}').groupBy('{lab}').agg(F.sum('{col}').alias('total'), F.max('{key}'))\n"
        "spark.table('nation').join(F.broadcast(stage), F.col('n_name') == F.col('{lab}'), 'left').show()\n",
        None,
    ),
    ("if True:\nspark.table('{tbl}').show()", "line 2: expected an indented block after 'if' statement on line 1"),
    (
        "from delta.tables import DeltaTable\nt = DeltaTable.forName(spark, '{tbl}')\n"
        "t.alias('o').merge(spark.table('feed').alias('n'), 'o.{key} = n.{key}').whenMatchedUpdateAll().execute()\n",
        None,
    ),
)
VALID_CODES = tuple(fault is None for _, fault in CODES)

_LANGUAGE_SQL = quoted_list(DECLARED)
_FILLERS = (("{tbl}", TABLE_NAMES), ("{col}", COLUMN_NAMES), ("{key}", KEY_NAMES), ("{lab}", LABEL_NAMES))


def _fill_sql(text: str) -> str:
    for mark, names in _FILLERS:
        text = f"replace({text}, '{mark}', {quoted_list(names)}[o_custkey % {len(names)} + 1])"
    return f"replace({text}, '{{n}}', CAST(o_custkey AS VARCHAR))"


_TEMPLATE_SQL = f"o_orderkey % {len(SCRIPTS)}"
_CODE_SQL = f"(o_orderkey // {len(SCRIPTS)}) % {len(CODES)}"
SCRIPTS_SQL = (
    f"SELECT o_orderkey AS script_id, CAST({_TEMPLATE_SQL} AS INTEGER) AS template_id, "
    + _fill_sql(quoted_list(SCRIPTS) + f"[{_TEMPLATE_SQL} + 1]")
    + " AS source FROM orders"
)
PAIRS_SQL = (
    f"SELECT o_orderkey AS pair_id, CAST({_TEMPLATE_SQL} AS INTEGER) AS template_id, CAST({_CODE_SQL} AS INTEGER) AS code_id, "
    + f"{_LANGUAGE_SQL}[({_TEMPLATE_SQL}) // {SCRIPTS_PER_LANGUAGE} + 1] AS source_language, "
    + "['easy', 'medium', 'hard', 'expert'][o_custkey % 4 + 1] AS difficulty, "
    + _fill_sql(quoted_list(SCRIPTS) + f"[{_TEMPLATE_SQL} + 1]")
    + " AS source_code, "
    + _fill_sql(quoted_list(c for c, _ in CODES) + f"[{_CODE_SQL} + 1]")
    + f" AS pyspark_code, CASE WHEN o_custkey % 3 = 0 THEN '{fv.ORIGINS[0]}' ELSE '{fv.ORIGINS[1]}' END AS generated_by FROM orders"
)
#: What the compiler says of a code, by its number; null where it has nothing to say.
FAULT_SQL = "[" + ", ".join("NULL" if fault is None else quote(fault) for _, fault in CODES) + "]"
DEPTH_SQL = "[" + ", ".join(map(str, DEPTHS)) + "]"
VALID_CODE_SQL = "[" + ", ".join("true" if v else "false" for v in VALID_CODES) + "]"


def _pick(texts, index: Column) -> Column:
    """One of a fixed list of texts; the list is a single literal in the plan."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (index + 1).cast("int"))


def _fill(text: Column) -> Column:
    for mark, names in _FILLERS:
        text = F.replace(text, F.lit(mark), _pick(names, F.col("o_custkey") % len(names)))
    return F.replace(text, F.lit("{n}"), F.col("o_custkey").cast("string"))


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """``(script_id, template_id, source)``, one row per order, stored as a table."""
    return stored_once(lambda: _scripts(spark, sf), spark, "scripts", sf)


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    template = F.col("o_orderkey") % len(SCRIPTS)
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(
        F.col("o_orderkey").alias("script_id"),
        template.cast("int").alias("template_id"),
        _fill(_pick(SCRIPTS, template)).alias("source"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Script and generated code, with the labels a training pair carries, stored as a table."""
    return stored_once(lambda: _pairs(spark, sf), spark, "pairs", sf)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    template = F.col("o_orderkey") % len(SCRIPTS)
    code = F.floor(F.col("o_orderkey") / len(SCRIPTS)) % len(CODES)
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(
        F.col("o_orderkey").alias("pair_id"),
        template.cast("int").alias("template_id"),
        code.cast("int").alias("code_id"),
        _pick(DECLARED, F.floor(template / SCRIPTS_PER_LANGUAGE)).alias("source_language"),
        _pick(("easy", "medium", "hard", "expert"), F.col("o_custkey") % 4).alias("difficulty"),
        _fill(_pick(SCRIPTS, template)).alias("source_code"),
        _fill(_pick([c for c, _ in CODES], code)).alias("pyspark_code"),
        F.array(F.lit("feature_a"), F.concat(F.lit("f"), F.col("o_custkey") % 5)).alias("features"),
        F.when(F.col("o_custkey") % 3 == 0, fv.ORIGINS[0]).otherwise(fv.ORIGINS[1]).alias("generated_by"),
    )
