"""Checks over rows of (script features, generated code).

Input columns: ``pyspark_code``, ``raw_source`` and the feature columns of
``operators.scripts.with_features``. Every step is a per-row expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import masks, rules
from tidewright.functions.python_check import python_syntax

CODE = "pyspark_code"


def _weight(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def _mentioned(tables: str, code: Column) -> Column:
    lowered = F.lower(code)
    return F.size(F.filter(tables, lambda t: F.contains(lowered, F.lower(t))))


def tables_covered(tables: str, code: Column, share: float = 0.5) -> Column:
    n = F.size(tables)
    return (n == 0) | (_mentioned(tables, code) >= F.greatest(F.lit(1.0), n * share))


def with_validation(rows: DataFrame) -> DataFrame:
    """Five checks, a weighted score, the issues found and the verdict."""
    blank = rules.is_blank(F.col(CODE))
    flagged = F.size("procedural_flags") > 0
    checked = rows.withColumn("_syntax", python_syntax(F.when(~blank, F.col(CODE))))
    checked = checked.withColumns(
        {
            "syntax_valid": F.coalesce(F.col("_syntax.ok"), F.lit(False)),
            "has_session": ~blank & rules.any_match(F.col(CODE), fv.SESSION_PATTERNS, rules.AS_WRITTEN),
            "has_operations": ~blank & rules.any_match(F.col(CODE), fv.REVIEW_OPERATIONS, rules.AS_WRITTEN),
            "tables_match": ~blank & tables_covered("tables", F.col(CODE)),
            "flags_surfaced": ~blank & (~flagged | rules.any_match(F.col(CODE), fv.REVIEW_MARKERS, "(?i)")),
        }
    )
    last = F.when(flagged, _weight(F.col("flags_surfaced"), 0.10)).otherwise(_weight(F.col("tables_match"), 0.10))
    score = (
        _weight(F.col("syntax_valid"), 0.30)
        + _weight(F.col("has_session"), 0.20)
        + _weight(F.col("has_operations"), 0.25)
        + _weight(F.col("tables_match"), 0.15)
        + last
    )
    error = F.concat(
        F.lit(fv.ISSUE_SYNTAX_LINE), F.col("_syntax.line").cast("string"), F.lit(": "), F.col("_syntax.message")
    )
    issues = F.when(blank, F.array(F.lit(fv.ISSUE_EMPTY))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.col("syntax_valid"), F.concat(F.lit(fv.ISSUE_SYNTAX), F.coalesce(error, F.col("_syntax.message")))),
                F.when(~F.col("has_session"), fv.ISSUE_SESSION),
                F.when(~F.col("has_operations"), fv.ISSUE_OPERATIONS),
                F.when(
                    ~F.col("tables_match"),
                    F.concat(F.lit(fv.ISSUE_TABLES), F.array_join("tables", ", ")),
                ),
                F.when(
                    flagged & ~F.col("flags_surfaced"),
                    fv.ISSUE_FLAGS,
                ),
            )
        )
    )
    scored = checked.withColumn("_score", score)
    return scored.withColumns(
        {"validation_score": F.round("_score", 3), "passed": F.col("_score") >= 0.60, "issues": issues}
    ).drop("_score", "_syntax")


def dataframe_chains(code: Column) -> Column:
    reads = F.regexp_count(code, F.lit(r"spark\.read\."))
    assigned = F.regexp_count(code, F.lit(r"\bdf\w*\s*=")) + F.regexp_count(code, F.lit(r"\bresult\w*\s*="))
    return F.greatest(reads, assigned, F.lit(1))


def expected_blocks() -> Column:
    """Statement blocks to expect in the code, estimated from tables and changing constructs."""
    changing = F.size(F.filter("procedural_flags", lambda f: F.upper(f).rlike("INSERT|UPDATE|DELETE|MERGE")))
    procedural = F.col("source_language").isin(*fv.PROCEDURAL_LANGUAGES)
    return F.when(procedural, F.greatest(F.lit(1), F.size("tables")) + changing).otherwise(F.lit(1))


def with_semantics(rows: DataFrame) -> DataFrame:
    """How much of the script's meaning the code carries over, 1.0 minus deductions."""
    blank = rules.is_blank(F.col(CODE))
    missing = F.size("tables") - _mentioned("tables", F.col(CODE))
    no_join = (F.size("joins") > 0) & ~F.contains(F.col(CODE), F.lit(".join("))
    no_window = (F.size("window_functions") > 0) & ~F.contains(F.col(CODE), F.lit("Window")) & ~F.contains(F.col(CODE), F.lit(".over("))
    procedural = F.col("source_language").isin(*fv.PROCEDURAL_LANGUAGES) & (F.size("procedural_flags") > 0)
    no_blocks = procedural & (expected_blocks() > 2) & (dataframe_chains(F.col(CODE)) < 2)
    no_import = ~F.contains(F.col(CODE), F.lit("import"))
    score = (
        F.lit(1.0)
        - F.lit(0.15) * missing
        - _weight(no_join, 0.20)
        - _weight(no_window, 0.20)
        - _weight(no_blocks, 0.15)
        - _weight(no_import, 0.05)
    )
    absent = F.filter("tables", lambda t: ~F.contains(F.lower(F.col(CODE)), F.lower(t)))
    issues = F.when(blank, F.array(F.lit(fv.SEMANTIC_EMPTY))).otherwise(
        F.array_compact(
            F.array(
                F.when(missing > 0, F.concat(F.lit(fv.SEMANTIC_TABLES), F.array_join(absent, ", "))),
                F.when(no_join, fv.SEMANTIC_JOINS),
                F.when(no_window, fv.SEMANTIC_WINDOWS),
                F.when(
                    no_blocks,
                    F.concat(
                        F.lit(fv.SEMANTIC_BLOCKS[0]),
                        expected_blocks().cast("string"),
                        F.lit(fv.SEMANTIC_BLOCKS[1]),
                        dataframe_chains(F.col(CODE)).cast("string"),
                        F.lit(fv.SEMANTIC_BLOCKS[2]),
                    ),
                ),
                F.when(no_import, fv.SEMANTIC_IMPORTS),
            )
        )
    )
    return rows.withColumns(
        {
            "semantic_score": F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 3))),
            "semantic_issues": issues,
            "tables_covered": F.when(blank, 0).otherwise(_mentioned("tables", F.col(CODE))),
            "total_tables": F.size("tables"),
        }
    )


def lint_findings(code: Column) -> Column:
    """``array<struct<name,suggestion,severity>>`` of the rules that match."""
    found = [
        F.when(
            rules.matches(code, pattern, rules.LINEWISE),
            F.struct(F.lit(name).alias("name"), F.lit(advice).alias("suggestion"), F.lit(severity).alias("severity")),
        )
        for pattern, name, advice, severity in fv.LINT_RULES
    ]
    return F.array_compact(F.array(*found))


def with_lint(rows: DataFrame) -> DataFrame:
    blank = rules.is_blank(F.col(CODE))
    found = rows.withColumn("lint", lint_findings(F.col(CODE)))

    def count(severity):
        return F.size(F.filter("lint", lambda f: f["severity"] == severity))

    penalty = count("high") * 0.20 + count("medium") * 0.10 + count("low") * 0.05
    return found.withColumns(
        {
            "lint_suggestions": F.when(blank, F.array().cast("array<string>")).otherwise(
                rules.hits(F.col(CODE), fv.LINT_SUGGESTIONS, rules.DOTALL)
            ),
            "lint_score": F.greatest(F.lit(0.0), F.round(F.lit(1.0) - penalty, 3)),
            "lint_count": F.size("lint"),
            "lint_high": count("high"),
        }
    )


def cost_weight(code: Column) -> Column:
    total = F.lit(0.0)
    for pattern, _, weight in fv.COST_RULES:
        total = total + _weight(rules.matches(code, pattern, rules.DOTALL), weight)
    return total


def guidance_flags(code: Column) -> Column:
    """Two more cost findings, advice only: they carry no weight.

    A frame counts as reused when one assigned name is read at least three times more.
    """
    names = F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?m)^\s*(\w+)\s*=\s*.*spark\.(?:read|table|sql)"), F.lit(1)))
    words = F.regexp_extract_all(code, F.lit(r"\w+"), F.lit(0))
    reused = F.exists(names, lambda n: F.size(F.filter(words, lambda w: w == n)) > 3)
    kept = rules.any_match(code, (r"\.cache\(", r"\.persist\("), rules.AS_WRITTEN)
    writes = rules.matches(code, r"\.write\.", rules.AS_WRITTEN) & ~F.contains(code, F.lit("partitionBy("))
    return F.array_compact(
        F.array(F.when(writes, fv.GUIDANCE_UNPARTITIONED_WRITE), F.when(reused & ~kept, fv.GUIDANCE_UNCACHED_REUSE))
    )


def with_risk(rows: DataFrame, catalog: str | None = None) -> DataFrame:
    """Sensitive columns, cost flags, null-safety warnings and the combined risk score.

    Columns that a script names are words of its text, which is scanned as a whole; ``catalog`` names a list of further columns from elsewhere.
    """
    unchecked = rules.matches(F.col(CODE), fv.JOIN_CALL, rules.AS_WRITTEN) & ~rules.any_match(F.col(CODE), fv.NULL_CHECKS, rules.AS_WRITTEN)

    def warn(j):
        return F.concat(F.lit(fv.NULL_WARNING[0]), j["table"], F.lit(fv.NULL_WARNING[1]))

    written = masks.sensitive_words(F.col("raw_source"))
    if catalog is not None:
        listed = F.filter(catalog, lambda c: F.size(masks.sensitive_words(c)) > 0)
        written = F.array_sort(F.array_distinct(F.concat(written, F.transform(listed, F.lower))))
    found = rows.withColumns(
        {
            "pii_columns": written,
            "cost_flags": rules.hits(F.col(CODE), fv.COST_RULES, rules.DOTALL),
            "null_warnings": F.when(unchecked, F.transform("joins", warn)).otherwise(F.array().cast("array<string>")),
        }
    )
    flags = F.size("procedural_flags")
    procedural = F.col("source_language").isin(*fv.PROCEDURAL_LANGUAGES)
    score = (
        F.size("pii_columns") * 1.5
        + cost_weight(F.col(CODE))
        + F.size("null_warnings") * 0.5
        + F.when(procedural, flags * 0.5).otherwise(0.0)
    )
    note = F.concat(
        F.lit(fv.COMPLIANCE_PII[0]), F.array_join("pii_columns", ", "), F.lit(fv.COMPLIANCE_PII[1])
    )
    procedural_note = F.lit(fv.COMPLIANCE_PROCEDURAL)
    compliance = F.concat(
        F.array_compact(F.array(F.when(F.size("pii_columns") > 0, note))),
        F.col("cost_flags"),
        F.col("null_warnings"),
        F.array_compact(F.array(F.when(procedural & (flags > 0), procedural_note))),
    )
    scored = found.withColumn("risk_score", F.round(score, 2))
    risk = F.col("risk_score")
    level = F.when(risk == 0, "low").when(risk <= 3, "medium").when(risk <= 7, "high").otherwise("critical")
    return scored.withColumns(
        {
            "risk_level": level,
            "compliance_flags": compliance,
            "manual_review": (flags > 0) | (F.size("pii_columns") > 0),
        }
    )


def final_status(passed: Column, semantic: Column) -> Column:
    return F.when(passed & (semantic >= 0.5), "success").when(passed, "low_confidence").otherwise("failed")


def light_status(passed: Column) -> Column:
    """The shorter run without a semantic score."""
    return F.when(passed, "success").otherwise("low_confidence")


def clean_output(raw: Column) -> Column:
    """Code out of a raw model answer: cut at echoed prompt markers, drop fences, trim."""

    def cut(text, marker):
        return F.when(F.contains(text, F.lit(marker)), rules.strip(F.substring_index(text, marker, 1))).otherwise(text)

    text = raw
    for marker in fv.ECHO_MARKERS:
        text = cut(text, marker)
    text = rules.strip(text)
    text = F.regexp_replace(text, r"^(?:```python)?(?:```)?", "")
    text = F.regexp_replace(text, r"```\z", "")
    for marker in fv.TAIL_MARKERS:
        text = cut(text, marker)
    return rules.strip(text)


def full_review(rows: DataFrame) -> DataFrame:
    """Validation, semantics, lint, risk and status in one lazy, shuffle-free chain."""
    reviewed = with_risk(with_lint(with_semantics(with_validation(rows))))
    return reviewed.withColumn("status", final_status(F.col("passed"), F.col("semantic_score")))
