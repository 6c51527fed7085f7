"""Queries over (script, generated code) rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.functions.python_check import python_syntax
from tidewright.operators import review as rv
from tidewright.operators import scripts as sc
from tidewright.plans import corpus
from tidewright.plans.registry import query, quote
from tidewright.plans.scripts import IR_SQL, sql_any, sql_hits, sql_joined

_PAIRS = f"pr AS ({corpus.PAIRS_SQL})"


def reviewed_rows(spark, sf):
    """Pairs with the features of their scripts; the label is the detected language."""
    pairs = corpus.pairs(spark, sf).drop("source_language", "features").withColumn("raw_source", F.col("source_code"))
    return sc.with_features(pairs, "source_code")


@query(
    "j22_python_syntax",
    f"WITH {_PAIRS} SELECT pair_id, {corpus.VALID_CODE_SQL}[code_id + 1] AS ok FROM pr",
)
def j22(spark, sf):
    return corpus.pairs(spark, sf).select("pair_id", python_syntax("pyspark_code").alias("r")).select("pair_id", "r.ok")


@query(
    "j23_session_reference",
    f"WITH {_PAIRS} SELECT pair_id, {sql_any('pyspark_code', fv.SESSION_PATTERNS, '')} AS has_session FROM pr",
)
def j23(spark, sf):
    hit = rules.any_match(F.col("pyspark_code"), fv.SESSION_PATTERNS, rules.AS_WRITTEN)
    return corpus.pairs(spark, sf).select("pair_id", hit.alias("has_session"))


@query(
    "j24_dataframe_operations",
    f"""WITH {_PAIRS} SELECT pair_id, {sql_any('pyspark_code', fv.REVIEW_OPERATIONS, '')} AS review_list,
        {sql_any('pyspark_code', fv.DATASET_OPERATIONS, '')} AS dataset_list FROM pr""",
)
def j24(spark, sf):
    code = F.col("pyspark_code")
    return corpus.pairs(spark, sf).select(
        "pair_id",
        rules.any_match(code, fv.REVIEW_OPERATIONS, rules.AS_WRITTEN).alias("review_list"),
        rules.any_match(code, fv.DATASET_OPERATIONS, rules.AS_WRITTEN).alias("dataset_list"),
    )


_ROWS = f"""{IR_SQL}, {_PAIRS}, rw AS (SELECT pair_id, code_id, pyspark_code AS code, lower(pyspark_code) AS lc, source_code,
    ir.source_language AS lang, tables, joins, aggregations, window_functions, ctes, subquery_depth, has_udf, procedural_flags, complexity_label,
    len(list_filter(tables, lambda t: contains(lower(pyspark_code), t))) AS found, NOT regexp_matches(pyspark_code, '\\S') AS blank
    FROM pr JOIN ir ON pair_id = script_id)"""

_VALID = f"""{_ROWS}, v0 AS (SELECT *, NOT blank AND {corpus.VALID_CODE_SQL}[code_id + 1] AS syntax_valid,
    NOT blank AND {sql_any('code', fv.SESSION_PATTERNS, '')} AS has_session, NOT blank AND {sql_any('code', fv.REVIEW_OPERATIONS, '')} AS has_operations,
    NOT blank AND (len(tables) = 0 OR found >= greatest(1, 0.5 * len(tables))) AS tables_match,
    NOT blank AND (len(procedural_flags) = 0 OR {sql_any('code', fv.REVIEW_MARKERS, '(?i)')}) AS flags_surfaced FROM rw),
  v1 AS (SELECT *, (CASE WHEN syntax_valid THEN 30 ELSE 0 END + CASE WHEN has_session THEN 20 ELSE 0 END + CASE WHEN has_operations THEN 25 ELSE 0 END
    + CASE WHEN tables_match THEN 15 ELSE 0 END + CASE WHEN len(procedural_flags) > 0 THEN CASE WHEN flags_surfaced THEN 10 ELSE 0 END
    WHEN tables_match THEN 10 ELSE 0 END) AS points FROM v0),
  v AS (SELECT *, points / 100 AS validation_score, points >= 60 AS passed FROM v1)"""


@query("j25_tables_mentioned", f"WITH {_VALID} SELECT pair_id, CAST(found AS INTEGER) AS found, tables_match FROM v")
def j25(spark, sf):
    rows = reviewed_rows(spark, sf)
    code = F.col("pyspark_code")
    covered = ~rules.is_blank(code) & rv.tables_covered("tables", code)
    return rows.select("pair_id", rv._mentioned("tables", code).alias("found"), covered.alias("tables_match"))


@query("j26_flags_surfaced", f"WITH {_VALID} SELECT pair_id, flags_surfaced FROM v")
def j26(spark, sf):
    code = F.col("pyspark_code")
    marked = rules.any_match(code, fv.REVIEW_MARKERS, "(?i)")
    surfaced = ~rules.is_blank(code) & ((F.size("procedural_flags") == 0) | marked)
    return reviewed_rows(spark, sf).select("pair_id", surfaced.alias("flags_surfaced"))


@query(
    "j27_validation_score",
    f"""WITH {_VALID} SELECT pair_id, syntax_valid, has_session, has_operations, tables_match, flags_surfaced, validation_score, passed FROM v""",
)
def j27(spark, sf):
    return rv.with_validation(reviewed_rows(spark, sf)).select(
        "pair_id", "syntax_valid", "has_session", "has_operations", "tables_match", "flags_surfaced", "validation_score", "passed"
    )


_SEMANTIC = f"""{_VALID}, s0 AS (SELECT *, len(tables) - found AS missing,
    CASE WHEN lang IN ('plsql', 'stored_procedure') THEN greatest(1, len(tables)) + len(list_filter(procedural_flags,
      lambda f: regexp_matches(upper(f), 'INSERT|UPDATE|DELETE|MERGE'))) ELSE 1 END AS blocks,
    greatest(len(regexp_extract_all(code, 'spark\\.read\\.')), len(regexp_extract_all(code, '\\bdf\\w*\\s*=')) + len(regexp_extract_all(code, '\\bresult\\w*\\s*=')), 1) AS chains FROM v),
  s AS (SELECT *, CASE WHEN blank THEN 0 ELSE greatest(0, 100 - 15 * missing - CASE WHEN len(joins) > 0 AND NOT contains(code, '.join(') THEN 20 ELSE 0 END
    - CASE WHEN len(window_functions) > 0 AND NOT contains(code, 'Window') AND NOT contains(code, '.over(') THEN 20 ELSE 0 END
    - CASE WHEN lang IN ('plsql', 'stored_procedure') AND len(procedural_flags) > 0 AND blocks > 2 AND chains < 2 THEN 15 ELSE 0 END
    - CASE WHEN NOT contains(code, 'import') THEN 5 ELSE 0 END) END / 100 AS semantic_score FROM s0)"""


@query(
    "j28_semantic_score",
    f"""WITH {_SEMANTIC} SELECT pair_id, semantic_score, CASE WHEN blank THEN 0 ELSE found END::INTEGER AS tables_covered, len(tables)::INTEGER AS total_tables FROM s""",
)
def j28(spark, sf):
    rows = rv.with_semantics(reviewed_rows(spark, sf))
    return rows.select("pair_id", "semantic_score", "tables_covered", "total_tables")


def _lint_points(severity: str) -> str:
    return " + ".join(
        f"CASE WHEN regexp_matches(code, {quote('(?im)' + p)}) THEN 1 ELSE 0 END" for p, _, _, s in fv.LINT_RULES if s == severity
    )


_LINT = f"""pl AS (SELECT pair_id, pyspark_code AS code FROM pr), l AS (SELECT *, {_lint_points('high')} AS hi, {_lint_points('medium')} AS mid,
    {_lint_points('low')} AS lo, {sql_hits('code', fv.LINT_RULES, '(?im)')} AS names, {sql_hits('code', fv.LINT_SUGGESTIONS, '(?s)')} AS advice FROM pl)"""


@query(
    "j29_code_lint",
    f"""WITH {_PAIRS}, {_LINT} SELECT pair_id, {sql_joined('names')} AS findings, {sql_joined('advice')} AS suggestions,
        greatest(0, 100 - 20 * hi - 10 * mid - 5 * lo) / 100 AS lint_score, CAST(hi AS INTEGER) AS lint_high FROM l""",
)
def j29(spark, sf):
    linted = rv.with_lint(corpus.pairs(spark, sf))
    return linted.select(
        "pair_id",
        F.array_join(F.transform("lint", lambda f: f["name"]), " | ").alias("findings"),
        F.array_join("lint_suggestions", " | ").alias("suggestions"),
        "lint_score",
        "lint_high",
    )


_COST = " + ".join(f"CASE WHEN regexp_matches(code, {quote('(?s)' + p)}) THEN {w} ELSE 0 END" for p, _, w in fv.COST_RULES)


@query(
    "j30_cost_flags",
    f"""WITH {_PAIRS}, c AS (SELECT pair_id, pyspark_code AS code FROM pr) SELECT pair_id, {sql_joined(sql_hits('code', fv.COST_RULES, '(?s)'))} AS cost_flags,
        CAST({_COST} AS DOUBLE) AS cost FROM c""",
)
def j30(spark, sf):
    code = F.col("pyspark_code")
    flags = F.array_join(rules.hits(code, fv.COST_RULES, rules.DOTALL), " | ")
    return corpus.pairs(spark, sf).select("pair_id", flags.alias("cost_flags"), rv.cost_weight(code).alias("cost"))


@query(
    "j30_guidance_flags",
    rf"""WITH {_PAIRS}, n AS (SELECT pair_id, pyspark_code AS code, list_distinct(regexp_extract_all(pyspark_code, '(?m)^\s*(\w+)\s*=\s*.*spark\.(?:read|table|sql)', 1)) AS names,
          regexp_extract_all(pyspark_code, '\w+') AS words FROM pr)
        SELECT pair_id, regexp_matches(code, '\.write\.') AND NOT contains(code, 'partitionBy(') AS unpartitioned,
          len(list_filter(names, lambda x: len(list_filter(words, lambda w: w = x)) > 3)) > 0 AND NOT regexp_matches(code, '\.cache\(|\.persist\(') AS uncached FROM n""",
)
def j30_guidance(spark, sf):
    flags = corpus.pairs(spark, sf).select("pair_id", rv.guidance_flags(F.col("pyspark_code")).alias("f"))
    return flags.select(
        "pair_id",
        F.array_contains("f", fv.GUIDANCE_UNPARTITIONED_WRITE).alias("unpartitioned"),
        F.array_contains("f", fv.GUIDANCE_UNCACHED_REUSE).alias("uncached"),
    )


_WORDS = rf"\b(?:{'|'.join(fv.SENSITIVE_NAMES)})\b"
_RISK = f"""{_SEMANTIC}, r0 AS (SELECT *, CASE WHEN regexp_matches(code, {quote(fv.JOIN_CALL)}) AND NOT {sql_any('code', fv.NULL_CHECKS, '')} THEN len(joins) ELSE 0 END AS warnings,
    list_sort(list_distinct(regexp_extract_all(lower(source_code), {quote(_WORDS)}))) AS pii FROM s),
  r AS (SELECT *, len(pii) * 1.5 + CAST({_COST} AS DOUBLE) + warnings * 0.5 + CASE WHEN lang IN ('plsql', 'stored_procedure') THEN len(procedural_flags) * 0.5 ELSE 0 END AS risk FROM r0)"""
_LEVEL = "CASE WHEN risk = 0 THEN 'low' WHEN risk <= 3 THEN 'medium' WHEN risk <= 7 THEN 'high' ELSE 'critical' END"
_STATUS = "CASE WHEN passed AND semantic_score >= 0.5 THEN 'success' WHEN passed THEN 'low_confidence' ELSE 'failed' END"


@query("j31_null_warnings", f"WITH {_RISK} SELECT pair_id, CAST(warnings AS INTEGER) AS warnings FROM r WHERE warnings > 0")
def j31(spark, sf):
    warned = rv.with_risk(reviewed_rows(spark, sf)).filter(F.size("null_warnings") > 0)
    return warned.select("pair_id", F.size("null_warnings").alias("warnings"))


@query(
    "j32_risk_score",
    f"""WITH {_RISK} SELECT pair_id, CAST(risk AS DOUBLE) AS risk_score, {_LEVEL} AS risk_level, {sql_joined('pii')} AS pii_columns,
        len(procedural_flags) > 0 OR len(pii) > 0 AS manual_review FROM r""",
)
def j32(spark, sf):
    rows = rv.with_risk(reviewed_rows(spark, sf))
    pii = F.array_join("pii_columns", " | ").alias("pii_columns")
    return rows.select("pair_id", "risk_score", "risk_level", pii, "manual_review")


@query("j33_final_status", f"WITH {_SEMANTIC} SELECT {_STATUS} AS status, count(*) AS pairs FROM s GROUP BY 1")
def j33(spark, sf):
    rows = rv.with_semantics(rv.with_validation(reviewed_rows(spark, sf)))
    status = rv.final_status(F.col("passed"), F.col("semantic_score"))
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("pairs"))


_RAW_SQL = """CASE pair_id % 4 WHEN 0 THEN '```python' || chr(10) || trim(pyspark_code) || chr(10) || '```' WHEN 1 THEN pyspark_code || chr(10) || '### End' || chr(10) || 'more'
    WHEN 2 THEN '```' || trim(pyspark_code) || '```' ELSE pyspark_code || '### Instruction: again' END"""


@query(
    "j34_clean_output",
    rf"WITH {_PAIRS} SELECT pair_id, regexp_replace(CASE WHEN pair_id % 4 IN (0, 2) THEN trim(pyspark_code) ELSE pyspark_code END, '^\s+|\s+$', '', 'g') AS code FROM pr",
)
def j34(spark, sf):
    code, kind = F.col("pyspark_code"), F.col("pair_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("```python\n"), F.trim(code), F.lit("\n```")))
        .when(kind == 1, F.concat(code, F.lit("\n### End\nmore")))
        .when(kind == 2, F.concat(F.lit("```"), F.trim(code), F.lit("```")))
        .otherwise(F.concat(code, F.lit("### Instruction: again")))
    )
    answers = corpus.pairs(spark, sf).select("pair_id", raw.alias("raw"))
    return answers.select("pair_id", rv.clean_output(F.col("raw")).alias("code"))


@query(
    "j35_review_report",
    f"""WITH {_RISK}, {_LINT} SELECT r.pair_id, {_STATUS} AS status, lang AS source_language, complexity_label, CAST(points AS BIGINT) AS validation_percent,
        semantic_score, CAST(risk AS DOUBLE) AS risk_score, {_LEVEL} AS risk_level, CAST(hi + mid + lo AS INTEGER) AS lint_count,
        len(procedural_flags)::INTEGER AS flags FROM r JOIN l ON r.pair_id = l.pair_id""",
)
def j35(spark, sf):
    report = rv.full_review(sc.with_analysis(reviewed_rows(spark, sf)))
    return report.select(
        "pair_id",
        "status",
        "source_language",
        "complexity_label",
        F.round(F.col("validation_score") * 100).cast("long").alias("validation_percent"),
        "semantic_score",
        "risk_score",
        "risk_level",
        "lint_count",
        F.size("procedural_flags").alias("flags"),
    )
