"""Script-corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.operators import scripts as sc
from tidewright.plans import corpus
from tidewright.plans.registry import query, quote, quoted_list

# ---- SQL fragments for the checking engine


def sql_any(text: str, patterns, flags: str = "(?is)") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quote(flags + p)})" for p in patterns) + ")"


def sql_hits(text: str, rule_rows, flags: str = "(?is)") -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {quote(flags + r[0])}) THEN {quote(r[1])} END" for r in rule_rows)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_all(text: str, pattern: str, group: int = 1, flags: str = "(?is)") -> str:
    return f"regexp_extract_all({text}, {quote(flags + pattern)}, {group})"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sql_language(text: str = "source") -> str:
    return (
        f"CASE WHEN {sql_any(text, fv.PROCEDURE_PATTERNS)} THEN 'stored_procedure' WHEN {sql_any(text, fv.PLSQL_PATTERNS)} THEN 'plsql' "
        f"WHEN {sql_any(text, fv.HIVEQL_PATTERNS)} THEN 'hiveql' ELSE 'sql' END"
    )


def sql_joined(array: str, sep: str = " | ") -> str:
    return f"coalesce(array_to_string({array}, '{sep}'), '')"


_LABELLED = f"scr AS ({corpus.SCRIPTS_SQL}), labelled AS (SELECT *, {sql_language()} AS source_language FROM scr)"
_FLAGS = (
    f"CASE source_language WHEN 'plsql' THEN {sql_hits('source', fv.PLSQL_FLAGS)} "
    f"WHEN 'stored_procedure' THEN {sql_hits('source', fv.TSQL_FLAGS)} ELSE [] END"
)


def _sql_blocks(text: str, patterns) -> str:
    found = ", ".join(sql_all(text, p) for p in patterns)
    return f"flatten([{found}])"


# Blocks come out of the lists row by row; the first of each 50-character start is kept by a window.
_BLOCKS = f"""blk AS (SELECT script_id, unnest(b) AS block, generate_subscripts(b, 1) AS pos FROM (SELECT script_id,
    list_filter(list_transform(CASE source_language WHEN 'plsql' THEN {_sql_blocks('upper(source)', fv.PLSQL_BLOCKS)}
        WHEN 'stored_procedure' THEN {_sql_blocks('source', fv.TSQL_BLOCKS)} END, lambda x: {sql_strip('x')}), lambda x: length(x) > 10) AS b
    FROM labelled WHERE source_language IN ('plsql', 'stored_procedure'))),
  firsts AS (SELECT script_id, block, pos FROM (SELECT *, row_number() OVER (PARTITION BY script_id, substr(block, 1, 50) ORDER BY pos) AS rn FROM blk)
    WHERE rn = 1)"""
_UNITS = f"""{_LABELLED}, {_BLOCKS},
  units AS (SELECT script_id, regexp_replace(unit, {quote('(?is)' + sc.NOISE)}, ' ', 'g') AS unit FROM
    (SELECT script_id, source AS unit FROM labelled WHERE source_language IN ('sql', 'hiveql') UNION ALL SELECT script_id, block FROM firsts))"""

_BARE = r"regexp_replace(unit, '(?i)\b(?:INTO|TABLE|PROCEDURE|FUNCTION)\s+\w+\s*\(|\)\s*\w+\s*\(', ' ', 'g')"
_KNOWN = "[" + ", ".join(quote(n) for n in fv.KNOWN_FUNCTIONS + sc.NOT_CALLS + sc.BUILT_IN) + "]"
# Nesting depth is fixed by the script text: stated with each text, not computed a second time.
_DEPTHS = corpus.DEPTH_SQL


def _sql_list(name: str, element: str) -> str:
    return f"list_sort(list_distinct(flatten(list({element})))) AS {name}"


_IR = f"""{_UNITS},
  per_unit AS (SELECT script_id,
    list_transform(list_concat(flatten(list_transform({sql_all('unit', sc.FROM_LIST)}, lambda names: list_transform(string_split(names, ','),
      lambda n: regexp_extract(n, {quote(chr(94) + chr(92) + 's*' + sc.NAME_PATH)}, 1)))), {sql_all('unit', sc.JOINED)}), lambda x: lower(x)) AS t, list_transform({sql_all('unit', sc.CTE_PATTERN)}, lambda x: lower(x)) AS c,
    list_transform({sql_all('unit', sc.AGGREGATE_PATTERN)}, lambda x: upper(x)) AS a, list_transform({sql_all('unit', sc.WINDOW_PATTERN)}, lambda x: upper(x)) AS w,
    list_transform(list_zip({sql_all('unit', sc.JOIN_PATTERN, 1)}, {sql_all('unit', sc.JOIN_PATTERN, 2)}, {sql_all('unit', sc.JOIN_PATTERN, 3)}),
      lambda j: CASE WHEN coalesce(j[1], '') = '' THEN 'JOIN' ELSE upper(regexp_replace(j[1], '\\s+', ' ', 'g')) END || '>' || lower(j[2]) || '>' || coalesce(j[3], '')) AS j,
    len(list_filter(list_transform({sql_all(_BARE, sc.CALL_PATTERN)}, lambda x: lower(x)), lambda x: NOT list_contains({_KNOWN}, x))) > 0 AS u
    FROM units),
  merged AS (SELECT script_id, {_sql_list('tb', 't')}, {_sql_list('ctes', 'c')}, {_sql_list('aggregations', 'a')}, {_sql_list('window_functions', 'w')},
    list_sort(list_distinct(flatten(list(j)))) AS joins, bool_or(u) AS has_udf FROM per_unit GROUP BY 1),
  ir0 AS (SELECT l.*, {_FLAGS} AS procedural_flags, coalesce(m.ctes, []) AS ctes, coalesce(m.aggregations, []) AS aggregations,
    coalesce(m.window_functions, []) AS window_functions, coalesce(m.joins, []) AS joins, coalesce(m.has_udf, false) AS has_udf,
    CASE WHEN source_language = 'stored_procedure' THEN list_sort(list_distinct(list_concat(coalesce(tb, []),
      list_transform({sql_all('source', fv.TEMP_TABLE)}, lambda x: lower(x))))) ELSE coalesce(tb, []) END AS tables,
    {_DEPTHS}[template_id + 1] AS subquery_depth FROM labelled l LEFT JOIN merged m USING (script_id)),
  ir1 AS (SELECT *, CASE WHEN has_udf OR len(procedural_flags) > 0 OR subquery_depth > 2 THEN 4
    WHEN len(window_functions) > 0 OR len(ctes) > 0 OR subquery_depth > 0 OR source_language IN ('plsql', 'stored_procedure') THEN 3
    WHEN len(joins) > 0 OR len(aggregations) > 0 THEN 2 ELSE 1 END AS complexity_score FROM ir0),
  ir AS (SELECT *, ['simple', 'moderate', 'complex', 'expert'][complexity_score] AS complexity_label FROM ir1)"""
IR_SQL = _IR


def labelled(spark, sf):
    scripts = corpus.scripts(spark, sf)
    return scripts.withColumn("source_language", sc.language(F.col("source")))


def ir(spark, sf):
    return sc.with_features(corpus.scripts(spark, sf))


# ---- queries


@query("j06_language_label", f"WITH {_LABELLED} SELECT template_id, source_language, count(*) AS scripts FROM labelled GROUP BY ALL")
def j06(spark, sf):
    return labelled(spark, sf).groupBy("template_id", "source_language").agg(F.count(F.lit(1)).alias("scripts"))


def _flag_rows(rule_rows, lang):
    return f"""WITH {_LABELLED} SELECT flag, count(*) AS scripts FROM (SELECT unnest({sql_hits('source', rule_rows)}) AS flag FROM labelled
               WHERE source_language = '{lang}') GROUP BY 1"""


def _flag_counts(spark, sf, lang, rule_rows):
    chosen = labelled(spark, sf).filter(F.col("source_language") == lang)
    flags = rules.unnest(chosen, [], rules.hits(F.col("source"), rule_rows), "flag")
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("scripts"))


@query("j07_plsql_flags", _flag_rows(fv.PLSQL_FLAGS, "plsql"))
def j07(spark, sf):
    return _flag_counts(spark, sf, "plsql", fv.PLSQL_FLAGS)


@query("j08_tsql_flags", _flag_rows(fv.TSQL_FLAGS, "stored_procedure"))
def j08(spark, sf):
    return _flag_counts(spark, sf, "stored_procedure", fv.TSQL_FLAGS)


_NOTE_CASES = ", ".join(f"CASE WHEN contains(upper(source), {quote(k)}) THEN {quote(m)} END" for k, m in fv.HIVE_NOTES)


@query(
    "j09_hive_notes",
    f"""WITH {_LABELLED} SELECT script_id, {sql_joined(f'list_filter([{_NOTE_CASES}], lambda x: x IS NOT NULL)')} AS notes
        FROM labelled WHERE source_language = 'hiveql'""",
)
def j09(spark, sf):
    hive = labelled(spark, sf).filter(F.col("source_language") == "hiveql")
    notes = rules.keyword_hits(F.col("source"), fv.HIVE_NOTES)
    return hive.select("script_id", F.array_join(notes, " | ").alias("notes"))


@query(
    "j10_hive_columns",
    f"""WITH {_LABELLED}, c AS (SELECT script_id, [lower(regexp_extract(source, {quote('(?is)' + fv.LATERAL_VIEW)}, 1)),
          lower(regexp_extract(source, {quote('(?is)' + fv.LATERAL_VIEW)}, 2))] || list_transform(string_split(
          regexp_extract(source, {quote('(?is)' + fv.DISTRIBUTE_BY)}, 1), ','), lambda x: {sql_strip('lower(x)')}) AS found
          FROM labelled WHERE source_language = 'hiveql'),
        e AS (SELECT script_id, unnest(found) AS col, generate_subscripts(found, 1) AS pos FROM c)
        SELECT script_id, col, min(pos) AS pos FROM e WHERE col <> '' GROUP BY ALL""",
)
def j10(spark, sf):
    hive = labelled(spark, sf).filter(F.col("source_language") == "hiveql")
    view = rules.ANYWHERE + fv.LATERAL_VIEW
    source = F.col("source")
    listed = F.regexp_extract(source, rules.ANYWHERE + fv.DISTRIBUTE_BY, 1)
    slots = F.concat(
        F.array(F.lower(F.regexp_extract(source, view, 1)), F.lower(F.regexp_extract(source, view, 2))),
        F.transform(F.split(listed, ","), lambda c: rules.strip(F.lower(c))),
    )
    named = hive.select("script_id", slots.alias("slots"), sc.hive_columns(source).alias("found"))
    rows = rules.unnest(named, ["script_id", "slots"], F.col("found"), "col")
    return rows.select("script_id", "col", F.array_position("slots", F.col("col")).alias("pos"))


@query(
    "j11_parameters",
    f"""WITH {_LABELLED}, p AS (SELECT script_id, unnest({sql_all('source', fv.PARAMETER, 1)}) AS name, unnest({sql_all('source', fv.PARAMETER, 2)}) AS type,
          unnest({sql_all('source', fv.PARAMETER, 3)}) AS mark FROM labelled WHERE source_language = 'stored_procedure')
        SELECT script_id, lower(name) AS name, upper(type) AS type,
          CASE WHEN upper(trim(coalesce(mark, ''))) IN ('OUTPUT', 'OUT') THEN 'OUTPUT' ELSE 'INPUT' END AS direction FROM p""",
)
def j11(spark, sf):
    chosen = labelled(spark, sf).filter(F.col("source_language") == "stored_procedure")
    listed = rules.unnest(chosen, ["script_id"], sc.parameters(F.col("source")), "p")
    return listed.select("script_id", "p.name", "p.type", "p.direction")


@query(
    "j12_temp_tables",
    f"""WITH {_LABELLED} SELECT DISTINCT script_id, lower(unnest({sql_all('source', fv.TEMP_TABLE)})) AS temp_table FROM labelled
        WHERE source_language = 'stored_procedure'""",
)
def j12(spark, sf):
    chosen = labelled(spark, sf).filter(F.col("source_language") == "stored_procedure")
    return rules.unnest(chosen, ["script_id"], sc.temp_tables(F.col("source")), "temp_table")


@query(
    "j13_object_names",
    f"""WITH scr AS ({corpus.SCRIPTS_SQL}) SELECT script_id, lower(regexp_extract(source, {quote('(?i)' + fv.OBJECT_NAME)}, 1)) AS object_name FROM scr
        WHERE regexp_matches(source, {quote('(?i)' + fv.OBJECT_NAME)})""",
)
def j13(spark, sf):
    named = corpus.scripts(spark, sf).select("script_id", sc.object_name(F.col("source")).alias("object_name"))
    return named.filter(F.col("object_name") != "")


@query("j14_statement_blocks", f"WITH {_LABELLED}, {_BLOCKS} SELECT script_id, block FROM firsts")
def j14(spark, sf):
    text, lang = F.col("source"), F.col("source_language")
    chosen = labelled(spark, sf).filter(lang.isin(*fv.PROCEDURAL_LANGUAGES))
    return rules.unnest(chosen, ["script_id"], sc.blocks_of(text, lang), "block")


@query(
    "j15_tables_read",
    f"""WITH scr AS ({corpus.SCRIPTS_SQL}), e AS (SELECT DISTINCT script_id, unnest({sql_all('lower(source)', fv.TABLE_READ, flags='')}) AS t FROM scr)
        SELECT t AS table_name, count(*) AS scripts FROM e GROUP BY 1""",
)
def j15(spark, sf):
    edges = rules.unnest(corpus.scripts(spark, sf), ["script_id"], sc.tables_read(F.col("source")), "table_name")
    return edges.groupBy("table_name").agg(F.count(F.lit(1)).alias("scripts"))


@query(
    "j16_lexical_features",
    f"""WITH {_IR} SELECT script_id, {sql_joined('joins')} AS joins, {sql_joined('aggregations')} AS aggregations,
        {sql_joined('window_functions')} AS window_functions, {sql_joined('ctes')} AS ctes, CAST(subquery_depth AS INTEGER) AS subquery_depth, has_udf FROM ir""",
)
def j16(spark, sf):
    joined = F.array_sort(F.transform("joins", lambda j: F.concat_ws(">", j["type"], j["table"], j["on"])))
    return ir(spark, sf).select(
        "script_id",
        F.array_join(joined, " | ").alias("joins"),
        *[F.array_join(c, " | ").alias(c) for c in ("aggregations", "window_functions", "ctes")],
        "subquery_depth",
        "has_udf",
    )


_BODY = f"regexp_replace(unit, {quote('(?is)' + sc.SOURCES)}, ' FROM ', 'g')"


@query(
    "j16_columns",
    f"""WITH {_UNITS}, b AS (SELECT script_id, {_BODY} AS body FROM units), l AS (SELECT script_id, body, {sql_all('body', sc.SELECT_LIST)} AS lists FROM b),
      c AS (SELECT script_id, lower(unnest(
          list_transform(list_filter(list_zip({sql_all('body', sc.QUALIFIED_PATTERN, 1)}, {sql_all('body', sc.QUALIFIED_PATTERN, 2)}), lambda d: coalesce(d[2], '') = ''), lambda d: d[1])
          || list_transform(flatten(list_transform(lists, lambda l: string_split(regexp_replace(l, {quote(sc.ARGUMENTS)}, '()', 'g'), ','))), lambda i: regexp_extract(i, {quote('(?is)' + sc.LISTED_COLUMN)}, 1))
          || flatten(list_transform(lists, lambda l: {sql_all('l', sc.ARGUMENT_COLUMN)})))) AS col FROM l
        UNION ALL SELECT script_id, unnest([lower(regexp_extract(source, {quote('(?is)' + fv.LATERAL_VIEW)}, 1)), lower(regexp_extract(source, {quote('(?is)' + fv.LATERAL_VIEW)}, 2))]
          || list_transform(string_split(regexp_extract(source, {quote('(?is)' + fv.DISTRIBUTE_BY)}, 1), ','), lambda x: {sql_strip('lower(x)')})) FROM labelled WHERE source_language = 'hiveql')
      SELECT DISTINCT script_id, col FROM c WHERE col <> '' AND NOT list_contains({quoted_list(sc.NOT_COLUMNS)}, col)""",
)
def j16_columns(spark, sf):
    return rules.unnest(ir(spark, sf), ["script_id"], F.col("columns"), "col")


@query(
    "j17_complexity",
    f"WITH {_IR} SELECT template_id, source_language, complexity_score, complexity_label, count(*) AS scripts FROM ir GROUP BY ALL",
)
def j17(spark, sf):
    keys = ["template_id", "source_language", "complexity_score", "complexity_label"]
    return ir(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("scripts"))


@query(
    "j18_merged_blocks",
    f"""WITH {_IR} SELECT script_id, {sql_joined('tables')} AS tables, {sql_joined('aggregations')} AS aggregations, has_udf FROM ir
        WHERE source_language IN ('plsql', 'stored_procedure')""",
)
def j18(spark, sf):
    merged = ir(spark, sf).filter(F.col("source_language").isin(*fv.PROCEDURAL_LANGUAGES))
    tables, aggs = F.array_join("tables", " | "), F.array_join("aggregations", " | ")
    return merged.select("script_id", tables.alias("tables"), aggs.alias("aggregations"), "has_udf")


@query(
    "j19_ir_completeness",
    f"""WITH {_IR} SELECT script_id, {sql_joined("list_filter([CASE WHEN script_id % 11 = 0 THEN 'Missing required IR field: tables' END, "
        "CASE WHEN script_id % 7 = 0 THEN 'Missing required IR field: has_udf' END, 'Missing required IR field: parse_errors'], lambda x: x IS NOT NULL)")} AS notes,
        CAST(len(CASE WHEN script_id % 11 = 0 THEN [] ELSE tables END) AS INTEGER) AS n_tables,
        CASE WHEN script_id % 7 = 0 THEN false ELSE has_udf END AS has_udf FROM ir""",
)
def j19(spark, sf):
    gaps = (
        ir(spark, sf)
        .withColumn("tables", F.when(F.col("script_id") % 11 != 0, F.col("tables")))
        .withColumn("has_udf", F.when(F.col("script_id") % 7 != 0, F.col("has_udf")))
        .withColumns({"dialect": F.lit("ansi"), "raw_source": F.col("source")})
    )
    return sc.complete_ir(gaps).select(
        "script_id", F.array_join("notes", " | ").alias("notes"), F.size("tables").alias("n_tables"), "has_udf"
    )


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(str(v))}" for k, v in table.items()) + " END"


_JOIN_TYPES = "list_sort(list_distinct(list_transform(joins, lambda j: string_split(j, '>')[1])))"
_DETECTED = f"""list_filter([CASE WHEN len(joins) > 0 THEN len(joins) || ' JOIN(s): ' || array_to_string({_JOIN_TYPES}, ', ') END,
  CASE WHEN len(aggregations) > 0 THEN 'Aggregations: ' || array_to_string(aggregations, ', ') END,
  CASE WHEN len(window_functions) > 0 THEN 'Window functions: ' || array_to_string(window_functions, ', ') END,
  CASE WHEN len(ctes) > 0 THEN 'CTEs: ' || array_to_string(ctes, ', ') END, CASE WHEN subquery_depth > 0 THEN 'Subquery depth: ' || subquery_depth END,
  CASE WHEN has_udf THEN 'UDF detected' END, CASE WHEN len(tables) > 0 THEN 'Tables: ' || array_to_string(tables, ', ') END,
  CASE WHEN len(procedural_flags) > 0 THEN len(procedural_flags) || ' procedural construct(s) flagged' END], lambda x: x IS NOT NULL)"""
_RISKS = """list_filter([CASE WHEN len(window_functions) > 0 THEN 'Window functions detected — verify PARTITION BY logic' END,
  CASE WHEN subquery_depth > 1 THEN 'Deep subquery nesting — review restructuring' END, CASE WHEN has_udf THEN 'UDF detected — may need custom PySpark implementation' END,
  CASE WHEN len(joins) > 3 THEN 'Multiple JOINs — verify join order and broadcast hints' END,
  CASE WHEN len(ctes) > 0 THEN 'CTE detected — converts to intermediate DataFrames' END], lambda x: x IS NOT NULL) || procedural_flags"""


@query(
    "j20_analysis",
    f"""WITH {_IR}, f AS (SELECT *, {_DETECTED} AS detected FROM ir)
        SELECT script_id, {sql_joined('detected')} AS detected, {sql_joined(_RISKS)} AS risks, {_case(fv.STRATEGY, 'source_language')} AS strategy,
        {_case(fv.REVIEW_TIME, 'complexity_label')} || CASE WHEN len(procedural_flags) > 0 THEN ' plus manual review of flagged constructs' ELSE '' END AS review_time,
        'migrate ' || source_language || ' to pyspark ' || CASE WHEN len(detected) > 0 THEN array_to_string(detected, ' ') || ' ' ELSE '' END
          || 'complexity ' || complexity_label AS query_text FROM f""",
)
def j20(spark, sf):
    return sc.with_analysis(ir(spark, sf)).select(
        "script_id",
        F.array_join("detected_features", " | ").alias("detected"),
        F.array_join("risk_notes", " | ").alias("risks"),
        "strategy",
        "review_time",
        "query_text",
    )


@query(
    "j21_corpus_report",
    f"""WITH {_IR} SELECT coalesce(source_language, 'all') AS source_language, coalesce(complexity_label, 'all') AS complexity_label, count(*) AS scripts,
        CAST(sum({_case(fv.REVIEW_MINUTES, 'complexity_label')}::INTEGER) AS BIGINT) AS review_minutes FROM ir
        GROUP BY GROUPING SETS ((source_language, complexity_label), (source_language), ())""",
)
def j21(spark, sf):
    slim = sc.with_analysis(ir(spark, sf)).select("source_language", "complexity_label", "review_minutes")
    lang, label = F.col("source_language"), F.col("complexity_label")
    report = slim.groupingSets([[lang, label], [lang], []], lang, label).agg(
        F.count(F.lit(1)).alias("scripts"), F.sum("review_minutes").alias("review_minutes")
    )
    return report.fillna("all", ["source_language", "complexity_label"])


@query(
    "j21_construct_frequency",
    f"""WITH {_IR}, u AS (SELECT source_language, unnest(procedural_flags || list_transform(aggregations, lambda x: 'aggregate ' || x)
          || list_transform(window_functions, lambda x: 'window ' || x)) AS construct FROM ir)
        SELECT source_language, construct, count(*) AS scripts FROM u GROUP BY ALL""",
)
def j21_constructs(spark, sf):
    named = F.concat(
        F.col("procedural_flags"),
        F.transform("aggregations", lambda a: F.concat(F.lit("aggregate "), a)),
        F.transform("window_functions", lambda w: F.concat(F.lit("window "), w)),
    )
    rows = rules.unnest(ir(spark, sf), ["source_language"], named, "construct")
    return rows.groupBy("source_language", "construct").agg(F.count(F.lit(1)).alias("scripts"))
