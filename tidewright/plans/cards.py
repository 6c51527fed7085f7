"""The report card of a script and what the single checks say in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import masks, rules
from tidewright.operators import pairs as pr
from tidewright.operators import review as rv
from tidewright.operators import scripts as sc
from tidewright.plans import corpus
from tidewright.plans.registry import ORACLES, query, quote
from tidewright.plans.review import _LEVEL, _LINT, _PAIRS, _RISK, _STATUS, _VALID, reviewed_rows
from tidewright.plans.scripts import IR_SQL, ir, sql_hits, sql_joined

_CATALOG_NAMES = rf"\b(?:{'|'.join(fv.SENSITIVE_NAMES + fv.GUIDANCE_NAMES)})\b"


@query(
    "j01_column_catalog",
    f"""SELECT col AS column_name, count(*) AS scripts, regexp_matches(col, {quote(_CATALOG_NAMES)}) AS sensitive
        FROM ({ORACLES['j16_columns']}) GROUP BY 1""",
)
def j01_catalog(spark, sf):
    """Every column that a script reads, with the number of scripts and whether its name is sensitive."""
    named = rules.unnest(ir(spark, sf), ["script_id"], F.col("columns"), "column_name")
    return masks.classify_columns(named.groupBy("column_name").agg(F.count(F.lit(1)).alias("scripts")))


@query(
    "j18_merged_fields",
    f"""WITH {IR_SQL} SELECT script_id, {sql_joined('tables')} AS tables, {sql_joined('joins')} AS joins, {sql_joined('aggregations')} AS aggregations,
        {sql_joined('window_functions')} AS window_functions, {sql_joined('ctes')} AS ctes, CAST(subquery_depth AS INTEGER) AS subquery_depth, has_udf, complexity_label
        FROM ir WHERE source_language IN ('plsql', 'stored_procedure')""",
)
def j18_fields(spark, sf):
    """All that a procedural script's statements add to its description."""
    merged = ir(spark, sf).filter(F.col("source_language").isin(*fv.PROCEDURAL_LANGUAGES))
    joins = F.array_sort(F.transform("joins", lambda j: F.concat_ws(">", j["type"], j["table"], j["on"])))
    lists = [F.array_join(c, " | ").alias(c) for c in ("tables", "aggregations", "window_functions", "ctes")]
    return merged.select("script_id", *lists, F.array_join(joins, " | ").alias("joins"), "subquery_depth", "has_udf", "complexity_label")


_WARNING = f"list_transform(joins, lambda j: {quote(fv.NULL_WARNING[0])} || string_split(j, '>')[2] || {quote(fv.NULL_WARNING[1])})"


@query("j31_warning_texts", f"WITH {_RISK} SELECT pair_id, array_to_string(list_sort({_WARNING}), ' | ') AS warnings FROM r WHERE warnings > 0")
def j31_texts(spark, sf):
    warned = rv.with_risk(reviewed_rows(spark, sf)).filter(F.size("null_warnings") > 0)
    return warned.select("pair_id", F.array_join(F.array_sort("null_warnings"), " | ").alias("warnings"))


@query("j33_light_status", f"WITH {_VALID} SELECT CASE WHEN passed THEN 'success' ELSE 'low_confidence' END AS status, count(*) AS pairs FROM v GROUP BY 1")
def j33_light(spark, sf):
    checked = rv.with_validation(reviewed_rows(spark, sf))
    return checked.groupBy(rv.light_status(F.col("passed")).alias("status")).agg(F.count(F.lit(1)).alias("pairs"))


_ISSUES = f"""CASE WHEN blank THEN [{quote(fv.ISSUE_EMPTY)}] ELSE list_filter([
    CASE WHEN NOT syntax_valid THEN {quote(fv.ISSUE_SYNTAX)} || regexp_replace({corpus.FAULT_SQL}[code_id + 1], '^line ', {quote(fv.ISSUE_SYNTAX_LINE)}) END,
    CASE WHEN NOT has_session THEN {quote(fv.ISSUE_SESSION)} END, CASE WHEN NOT has_operations THEN {quote(fv.ISSUE_OPERATIONS)} END,
    CASE WHEN NOT tables_match THEN {quote(fv.ISSUE_TABLES)} || array_to_string(tables, ', ') END,
    CASE WHEN len(procedural_flags) > 0 AND NOT flags_surfaced THEN {quote(fv.ISSUE_FLAGS)} END], lambda x: x IS NOT NULL) END"""
_COMPLIANCE = f"""list_concat(list_concat(list_concat(CASE WHEN len(pii) > 0 THEN [{quote(fv.COMPLIANCE_PII[0])} || array_to_string(pii, ', ') || {quote(fv.COMPLIANCE_PII[1])}] ELSE [] END,
    {sql_hits('r.code', fv.COST_RULES, '(?s)')}), CASE WHEN warnings > 0 THEN list_sort({_WARNING}) ELSE [] END),
    CASE WHEN lang IN ('plsql', 'stored_procedure') AND len(procedural_flags) > 0 THEN [{quote(fv.COMPLIANCE_PROCEDURAL)}] ELSE [] END)"""
_PATTERNS = "[" + ", ".join(f"CASE WHEN list_contains(names, {quote(n)}) THEN {quote(f'{n}: {advice}')} END" for _, n, advice, _ in fv.LINT_RULES) + "]"


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(str(v))}" for k, v in table.items()) + " END"


@query(
    "j35_review_card",
    f"""WITH {_RISK}, {_LINT} SELECT r.pair_id, {_STATUS} AS status, lang AS source_language, complexity_label AS complexity,
        CAST(points AS BIGINT) AS validation_score, {sql_joined(_ISSUES)} AS validation_issues, CAST(risk AS DOUBLE) AS risk_score, upper({_LEVEL}) AS risk_level,
        {sql_joined('pii')} AS pii_columns, {sql_joined(_COMPLIANCE)} AS compliance_flags, {sql_joined('procedural_flags')} AS procedural_flags,
        {sql_joined(f'list_filter({_PATTERNS}, lambda x: x IS NOT NULL)')} AS anti_patterns, CASE WHEN blank THEN '' ELSE {sql_joined('advice')} END AS performance_notes,
        {_case(fv.REVIEW_TIME, 'complexity_label')} || CASE WHEN len(procedural_flags) > 0 THEN {quote(fv.REVIEW_TIME_FLAGGED)} ELSE '' END AS review_time
        FROM r JOIN l ON r.pair_id = l.pair_id""",
)
def j35_card(spark, sf):
    """The whole card of a pair: scores, and every list in words."""
    report = rv.full_review(sc.with_analysis(reviewed_rows(spark, sf)))

    def listed(column):
        return F.array_join(column, " | ")

    # Warnings come in the order of the joins; a card lists them sorted.
    others = F.filter("compliance_flags", lambda c: ~F.array_contains(F.col("null_warnings"), c))
    procedural = F.filter(others, lambda c: c == fv.COMPLIANCE_PROCEDURAL)
    findings = F.concat(F.filter(others, lambda c: c != fv.COMPLIANCE_PROCEDURAL), F.array_sort("null_warnings"), procedural)
    return report.select(
        "pair_id",
        "status",
        "source_language",
        F.col("complexity_label").alias("complexity"),
        F.round(F.col("validation_score") * 100).cast("long").alias("validation_score"),
        listed("issues").alias("validation_issues"),
        "risk_score",
        F.upper("risk_level").alias("risk_level"),
        listed("pii_columns").alias("pii_columns"),
        listed(findings).alias("compliance_flags"),
        listed("procedural_flags").alias("procedural_flags"),
        listed(F.transform("lint", lambda f: F.concat(f["name"], F.lit(": "), f["suggestion"]))).alias("anti_patterns"),
        listed("lint_suggestions").alias("performance_notes"),
        "review_time",
    )


_NOTES = f"""CASE WHEN len(procedural_flags) > 0 THEN {quote(fv.PROMPT_FLAGS[0])} || array_to_string(list_transform(procedural_flags[1:5], lambda f: '- ' || f), chr(10))
    || {quote(fv.PROMPT_FLAGS[1])} ELSE '' END || CASE WHEN p.difficulty <> 'easy' THEN {quote(fv.PROMPT_CONTEXT)} || {_case(fv.STRATEGY, 'ir.source_language')} || chr(10) || chr(10)
    || {_case(fv.REVIEW_TIME, 'complexity_label')} || chr(10) ELSE '' END"""


@query(
    "j46_prompt_with_notes",
    f"""WITH {IR_SQL}, {_PAIRS} SELECT pair_id, {quote(fv.PROMPT_START)} || upper(ir.source_language) || {quote(fv.PROMPT_DIFFICULTY)} || p.difficulty || chr(10) || {_NOTES}
        || {quote(fv.PROMPT_INPUT)} || p.source_code || {quote(fv.PROMPT_RESPONSE)} AS prompt FROM pr p JOIN ir ON p.pair_id = ir.script_id""",
)
def j46_notes(spark, sf):
    """The prompt of a script with its review note and reference texts; an easy one gets no reference."""
    rows = reviewed_rows(spark, sf)
    strategy = sc.lookup(fv.STRATEGY, F.col("source_language"))
    context = F.when(F.col("difficulty") != "easy", F.array(strategy, sc.lookup(fv.REVIEW_TIME, F.col("complexity_label")))).otherwise(F.array().cast("array<string>"))
    notes = pr.prompt_notes(F.col("procedural_flags"), context)
    prompt = pr.prompt_text(F.col("source_language"), F.col("difficulty"), F.col("source_code"), notes)
    return rows.select("pair_id", prompt.alias("prompt"))
