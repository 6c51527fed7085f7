"""Classification and feature extraction over a table of scripts.

All steps are column expressions on ``source``; none needs a shuffle. Features are lexical:
they are read off the text by pattern, not from a syntax tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules

# A table name: the last part of a dotted path, each part plain or in one of the dialects' quotes.
NAME_PATH = r"""(?:["`\[]?\w+["`\]]?\s*\.\s*)*["`\[]?([A-Za-z_]\w*)["`\]]?"""
_NAME = NAME_PATH.replace("([A-Za-z_]\\w*)", "[A-Za-z_]\\w*")
FROM_LIST = rf"\bFROM\s+({_NAME}(?:\s+(?:AS\s+)?\w+)?(?:\s*,\s*{_NAME}(?:\s+(?:AS\s+)?\w+)?)*)"
JOINED = r"\bJOIN\s+" + NAME_PATH
# Comments, string literals, and calls whose arguments are set apart by FROM.
NOISE = r"--[^\n]*|/\*.*?\*/|'[^']*'|\b(?:EXTRACT|TRIM|SUBSTRING|OVERLAY)\s*\([^()]*\)"
JOIN_PATTERN = (
    r"\b(?:((?:NATURAL\s+)?(?:LEFT|RIGHT|FULL)(?:\s+(?:OUTER|SEMI|ANTI))?|INNER|CROSS|NATURAL|SEMI|ANTI)\s+)?JOIN\s+" + NAME_PATH +
    r"(?:(?:\s+(?:AS\s+)?[A-Za-z_]\w*)?\s+ON\s+\(?([\w.]+\s*=\s*[\w.]+))?"
)
CTE_PATTERN = r"\b([A-Za-z_]\w*)\s+AS\s*\(\s*(?:SELECT|WITH)\b"
CALL_PATTERN = r"\b([A-Za-z_]\w*)\s*\("
# A dotted name and the bracket that makes it a call; what a FROM or JOIN names is taken out before.
QUALIFIED_PATTERN = r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)(\s*\()?"
SOURCES = rf"\b(?:FROM|JOIN)\s+{_NAME}(?:(?:\s+(?:AS\s+)?\w+)?\s*,\s*{_NAME})*"
SELECT_LIST = r"\bSELECT\s+(?:DISTINCT\s+|ALL\s+)?(.*?)\s+(?:FROM|INTO)\b"
# An item of a select list that is a column, with or without another name.
LISTED_COLUMN = r"""^\s*(?:["`\[]?\w+["`\]]?\s*\.\s*)*["`\[]?([A-Za-z_]\w*)["`\]]?(?:\s+(?:AS\s+)?["`\[]?\w+["`\]]?)?\s*$"""
# A column as the first argument of a call.
ARGUMENT_COLUMN = r"\w\s*\(\s*(?:DISTINCT\s+)?([A-Za-z_]\w*)\s*[,)]"
NOT_COLUMNS = ("null", "true", "false", "select", "from", "case", "current_date", "current_timestamp", "sysdate")
# Arguments may hold calls, three levels deep.
ARGUMENTS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
WINDOW_PATTERN = r"\b(" + "|".join(fv.WINDOW_FUNCTIONS + fv.AGGREGATES) + rf")\s*{ARGUMENTS}\s*OVER\b"
AGGREGATE_PATTERN = r"\b(" + "|".join(fv.AGGREGATES) + r")\s*\("
NOT_CALLS = (
    "in", "values", "and", "or", "on", "as", "over", "from", "where", "exists", "not", "when", "then", "else", "by",
    "table", "explode", "transform", "tablesample", "using", "varchar", "varchar2", "nvarchar", "number", "decimal",
    "char", "varray", "openrowset", "raiserror", "is",
)
# Public built-in functions of the four dialects that the common list leaves out.
BUILT_IN = (
    "concat", "concat_ws", "replace", "greatest", "least", "power", "sqrt", "exp", "ln", "log", "mod", "sign", "ceiling",
    "ltrim", "rtrim", "lpad", "rpad", "instr", "position", "reverse", "repeat", "left", "right", "len", "initcap", "ascii",
    "extract", "year", "month", "day", "hour", "minute", "second", "date_add", "date_sub", "add_months", "months_between",
    "last_day", "to_char", "to_number", "to_timestamp", "sysdate", "getdate", "current_timestamp", "trunc", "nvl", "nvl2",
    "decode", "if", "iif", "isnull", "case", "try_cast", "stddev", "variance", "median", "string_agg", "listagg",
    "group_concat", "collect_list", "collect_set", "array_agg", "percent_rank", "cume_dist", "nth_value", "regexp_replace",
    "regexp_extract", "regexp_like", "split", "size", "map", "array", "struct", "named_struct", "unix_timestamp",
    "from_unixtime", "date_format", "get_json_object", "grouping", "approx_count_distinct", "percentile", "rand", "hash", "md5",
)
PAREN_TOKEN = r"(?:\b(?:AS|EXISTS)\s*\(\s*(?:SELECT|WITH)\b|\(\s*SELECT\b|\(|\))"


def language(source: Column) -> Column:
    """Label by the first rule set that matches; anything else, blank text included, is sql."""
    return (
        F.when(rules.any_match(source, fv.PROCEDURE_PATTERNS), "stored_procedure")
        .when(rules.any_match(source, fv.PLSQL_PATTERNS), "plsql")
        .when(rules.any_match(source, fv.HIVEQL_PATTERNS), "hiveql")
        .otherwise("sql")
    )


def procedural_flags(source: Column, lang: Column) -> Column:
    return (
        F.when(lang == "plsql", rules.hits(source, fv.PLSQL_FLAGS))
        .when(lang == "stored_procedure", rules.hits(source, fv.TSQL_FLAGS))
        .otherwise(F.array().cast("array<string>"))
    )


def hive_columns(source: Column) -> Column:
    """Columns named by LATERAL VIEW EXPLODE and DISTRIBUTE BY, each once, in that order."""
    view = rules.ANYWHERE + fv.LATERAL_VIEW
    listed = F.regexp_extract(source, rules.ANYWHERE + fv.DISTRIBUTE_BY, 1)
    spread = F.transform(F.split(listed, ","), lambda c: rules.strip(F.lower(c)))
    exploded = F.transform(F.array(F.regexp_extract(source, view, 1), F.regexp_extract(source, view, 2)), F.lower)
    return F.array_distinct(F.filter(F.concat(exploded, spread), lambda c: c != ""))


def parameters(source: Column) -> Column:
    """Procedure parameters as ``array<struct<name,type,direction>>``."""
    parts = F.arrays_zip(
        rules.all_matches(source, fv.PARAMETER, 1).alias("name"),
        rules.all_matches(source, fv.PARAMETER, 2).alias("type"),
        rules.all_matches(source, fv.PARAMETER, 3).alias("mark"),
    )

    def typed(p):
        out = F.upper(rules.strip(F.coalesce(p["mark"], F.lit("")))).isin("OUTPUT", "OUT")
        direction = F.when(out, "OUTPUT").otherwise("INPUT")
        return F.struct(F.lower(p["name"]).alias("name"), F.upper(p["type"]).alias("type"), direction.alias("direction"))

    return F.transform(parts, typed)


def temp_tables(source: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(rules.all_matches(source, fv.TEMP_TABLE), F.lower)))


def object_name(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, "(?i)" + fv.OBJECT_NAME, 1))


def tables_read(source: Column) -> Column:
    return F.array_distinct(rules.all_matches(F.lower(source), fv.TABLE_READ, flags=rules.AS_WRITTEN))


def without_noise(text: Column) -> Column:
    """Text without comments, string literals and calls that use FROM between their arguments."""
    return F.regexp_replace(text, rules.ANYWHERE + NOISE, " ")


def table_names(text: Column) -> Column:
    """Lower-case names after FROM (comma lists too) and JOIN, without schema and quotes."""
    lists = rules.all_matches(text, FROM_LIST)
    listed = F.flatten(F.transform(lists, lambda names: F.transform(F.split(names, ","), lambda n: F.regexp_extract(n, r"^\s*" + NAME_PATH, 1))))
    return F.transform(F.concat(listed, rules.all_matches(text, JOINED)), F.lower)


def columns_read(text: Column) -> Column:
    """Lower-case columns of a statement: those with an alias in front anywhere, and those that a select list names alone or as the first argument of a call.
    Names with blanks in quotes are not read."""
    body = F.regexp_replace(text, rules.ANYWHERE + SOURCES, " FROM ")
    dotted = F.arrays_zip(rules.all_matches(body, QUALIFIED_PATTERN, 1).alias("name"), rules.all_matches(body, QUALIFIED_PATTERN, 2).alias("call"))
    qualified = F.transform(F.filter(dotted, lambda d: F.coalesce(d["call"], F.lit("")) == ""), lambda d: d["name"])
    lists = rules.all_matches(body, SELECT_LIST)
    # Arguments go before the list is cut at its commas.
    items = F.flatten(F.transform(lists, lambda l: F.split(F.regexp_replace(l, ARGUMENTS, "()"), ",")))
    listed = F.transform(items, lambda i: F.regexp_extract(i, rules.ANYWHERE + LISTED_COLUMN, 1))
    arguments = F.flatten(F.transform(lists, lambda l: rules.all_matches(l, ARGUMENT_COLUMN)))
    found = F.transform(F.concat(qualified, listed, arguments), F.lower)
    return F.filter(found, lambda c: (c != "") & ~c.isin(*NOT_COLUMNS))


def statement_blocks(source: Column, patterns) -> Column:
    """Embedded statements in pattern order; the first of those sharing a 50-character start stays."""
    found = F.flatten(F.array(*[rules.all_matches(source, p) for p in patterns]))
    blocks = F.filter(F.transform(found, rules.strip), lambda b: F.length(b) > fv.BLOCK_MIN_CHARS)

    none = F.array().cast("array<string>")

    # A fold reads the block list once; a filter that looks back at the list would rebuild it
    # for every block, there being no shared subexpressions inside a lambda.
    def keep_first(state, block):
        key = F.substring(block, 1, fv.BLOCK_KEY_CHARS)
        more = F.struct(
            F.array_append(state["kept"], block).alias("kept"), F.array_append(state["keys"], key).alias("keys")
        )
        return F.when(F.array_contains(state["keys"], key), state).otherwise(more)

    start = F.struct(none.alias("kept"), none.alias("keys"))
    return F.aggregate(blocks, start, keep_first, lambda s: s["kept"])


def blocks_of(source: Column, lang: Column) -> Column:
    return (
        F.when(lang == "plsql", statement_blocks(F.upper(source), fv.PLSQL_BLOCKS))
        .when(lang == "stored_procedure", statement_blocks(source, fv.TSQL_BLOCKS))
        .otherwise(F.array(source))
    )


def subquery_depth(text: Column) -> Column:
    """Deepest nesting of ``( SELECT``; a CTE body or EXISTS test is not a subquery level.

    The fold keeps the open brackets as a string: ``s`` for a subquery, ``p`` for any other.
    """
    tokens = F.transform(rules.all_matches(text, PAREN_TOKEN, 0), F.upper)

    def step(state, token):
        opened = F.when(token.rlike(r"^\(\s*SELECT"), "s").otherwise("p")
        popped = F.substring(state["open"], F.lit(1), F.greatest(F.length(state["open"]) - 1, F.lit(0)))
        now = F.when(token == ")", popped).otherwise(F.concat(state["open"], opened))
        depth = F.length(F.replace(now, F.lit("p"), F.lit("")))
        return F.struct(now.alias("open"), F.greatest(state["deepest"], depth).alias("deepest"))

    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("deepest"))
    # Most texts have no subquery at all.
    return F.when(rules.matches(text, r"\(\s*SELECT"), F.aggregate(tokens, start, step, lambda s: s["deepest"])).otherwise(0)


def calls_unknown(text: Column) -> Column:
    """True if a function that is neither built in nor a keyword is called."""
    bare = F.regexp_replace(text, r"(?i)\b(?:INTO|TABLE|PROCEDURE|FUNCTION)\s+\w+\s*\(|\)\s*\w+\s*\(", " ")
    names = F.transform(rules.all_matches(bare, CALL_PATTERN), F.lower)
    return F.exists(names, lambda n: ~n.isin(*fv.KNOWN_FUNCTIONS, *NOT_CALLS, *BUILT_IN))


def joins(text: Column) -> Column:
    parts = F.arrays_zip(
        rules.all_matches(text, JOIN_PATTERN, 1).alias("type"),
        rules.all_matches(text, JOIN_PATTERN, 2).alias("table"),
        rules.all_matches(text, JOIN_PATTERN, 3).alias("on"),
    )

    def typed(j):
        kind = F.upper(F.regexp_replace(j["type"], r"\s+", " "))
        kind = F.when(kind == "", "JOIN").otherwise(kind)
        return F.struct(kind.alias("type"), F.lower(j["table"]).alias("table"), j["on"].alias("on"))

    return F.transform(parts, typed)


def _distinct_sorted(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(texts))


def _over_units(extract) -> Column:
    """A feature over all statement units of the script, united and sorted."""
    return F.flatten(F.transform("units", extract))


def with_features(scripts: DataFrame, source: str = "source") -> DataFrame:
    """Add the intermediate-representation columns to ``scripts``.

    SQL and HiveQL are read whole; procedural scripts contribute the statements embedded in
    them, their features united over the blocks.
    """
    text = F.col(source)
    labelled = scripts.withColumn("source_language", language(text))
    lang = F.col("source_language")
    units = labelled.withColumns(
        {
            "procedural_flags": procedural_flags(text, lang),
            "units": F.transform(blocks_of(text, lang), without_noise),
            "temp_tables": F.when(lang == "stored_procedure", temp_tables(text)).otherwise(F.array().cast("array<string>")),
        }
    )
    read = _over_units(table_names)
    cte_names = _over_units(lambda u: F.transform(rules.all_matches(u, CTE_PATTERN), F.lower))
    featured = units.withColumns(
        {
            "ctes": _distinct_sorted(cte_names),
            "tables": _distinct_sorted(F.concat(read, F.col("temp_tables"))),
            "columns": _distinct_sorted(
                F.concat(
                    _over_units(columns_read),
                    F.when(lang == "hiveql", hive_columns(text)).otherwise(F.array().cast("array<string>")),
                )
            ),
            "joins": F.array_distinct(_over_units(joins)),
            "aggregations": _distinct_sorted(
                _over_units(lambda u: F.transform(rules.all_matches(u, AGGREGATE_PATTERN), F.upper))
            ),
            "window_functions": _distinct_sorted(
                _over_units(lambda u: F.transform(rules.all_matches(u, WINDOW_PATTERN), F.upper))
            ),
            "subquery_depth": F.coalesce(F.array_max(F.transform("units", subquery_depth)), F.lit(0)),
            "has_udf": F.exists("units", calls_unknown),
        }
    )
    score = complexity_score()
    return featured.withColumn("complexity_score", score).withColumn("complexity_label", complexity_label())


def complexity_score() -> Column:
    """1 simple .. 4 expert from the feature columns; procedural scripts start at 3."""
    depth = F.col("subquery_depth")
    flagged = F.size("procedural_flags") > 0
    deep = (F.size("window_functions") > 0) | (F.size("ctes") > 0) | (depth > 0)
    wide = (F.size("joins") > 0) | (F.size("aggregations") > 0)
    procedural = F.col("source_language").isin(*fv.PROCEDURAL_LANGUAGES)
    return (
        F.when(F.col("has_udf") | flagged | (depth > 2), 4).when(deep | procedural, 3).when(wide, 2).otherwise(1)
    )


def complexity_label(score: str = "complexity_score") -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in fv.COMPLEXITY_LABELS]), F.col(score).cast("int"))


def lookup(table: dict[str, object], key: Column, default=None) -> Column:
    """A small fixed table as a CASE expression: no join, no shuffle."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def join_types() -> Column:
    return _distinct_sorted(F.transform("joins", lambda j: j["type"]))


def with_analysis(ir: DataFrame) -> DataFrame:
    """Detected features, risk notes, strategy, review time and the retrieval query text."""
    lang, label = F.col("source_language"), F.col("complexity_label")
    n_joins, n_flags = F.size("joins"), F.size("procedural_flags")

    def listed(name):
        return F.array_join(name, ", ")

    features = F.array_compact(
        F.array(
            F.when(n_joins > 0, F.concat(n_joins.cast("string"), F.lit(fv.FEATURE_JOINS), F.array_join(join_types(), ", "))),
            F.when(F.size("aggregations") > 0, F.concat(F.lit(fv.FEATURE_AGGREGATES), listed("aggregations"))),
            F.when(F.size("window_functions") > 0, F.concat(F.lit(fv.FEATURE_WINDOWS), listed("window_functions"))),
            F.when(F.size("ctes") > 0, F.concat(F.lit(fv.FEATURE_CTES), listed("ctes"))),
            F.when(F.col("subquery_depth") > 0, F.concat(F.lit(fv.FEATURE_DEPTH), F.col("subquery_depth").cast("string"))),
            F.when(F.col("has_udf"), F.lit(fv.FEATURE_UDF)),
            F.when(F.size("tables") > 0, F.concat(F.lit(fv.FEATURE_TABLES), listed("tables"))),
            F.when(n_flags > 0, F.concat(n_flags.cast("string"), F.lit(fv.FEATURE_FLAGS))),
        )
    )
    risks = F.concat(
        F.array_compact(
            F.array(
                F.when(F.size("window_functions") > 0, F.lit(fv.RISK_WINDOWS)),
                F.when(F.col("subquery_depth") > 1, F.lit(fv.RISK_DEPTH)),
                F.when(F.col("has_udf"), F.lit(fv.RISK_UDF)),
                F.when(n_joins > 3, F.lit(fv.RISK_JOINS)),
                F.when(F.size("ctes") > 0, F.lit(fv.RISK_CTES)),
            )
        ),
        F.col("procedural_flags"),
    )
    review = F.concat(
        lookup(fv.REVIEW_TIME, label, fv.REVIEW_TIME_UNKNOWN),
        F.when(n_flags > 0, fv.REVIEW_TIME_FLAGGED).otherwise(""),
    )
    query_text = F.concat_ws(
        " ",
        F.concat(F.lit("migrate "), lang, F.lit(" to pyspark")),
        F.col("detected_features"),
        F.concat(F.lit("complexity "), label),
    )
    return (
        ir.withColumn("detected_features", features)
        .withColumns(
            {
                "risk_notes": risks,
                "strategy": lookup(fv.STRATEGY, lang, fv.STRATEGY["sql"]),
                "needs_procedural_context": lang.isin(*fv.PROCEDURAL_LANGUAGES),
                "review_time": review,
                "review_minutes": lookup(fv.REVIEW_MINUTES, label, 15),
            }
        )
        .withColumn("query_text", query_text)
    )


def retrieval_query() -> Column:
    """Query text built from the feature columns alone."""

    def words(name):
        return F.array_join(name, " ")

    return F.concat_ws(
        " ",
        F.concat(F.lit("migrate "), F.col("source_language"), F.lit(" to pyspark")),
        F.when(F.size("joins") > 0, F.concat(F.array_join(join_types(), " "), F.lit(" join"))),
        F.when(F.size("aggregations") > 0, F.concat(F.lit("aggregations "), words("aggregations"))),
        F.when(F.size("window_functions") > 0, F.concat(F.lit("window functions "), words("window_functions"))),
        F.when(F.size("ctes") > 0, F.lit("CTE with clause pyspark")),
        F.when(F.size("procedural_flags") > 0, F.lit("procedural cursor loop exception handler")),
        F.concat(F.lit("complexity "), F.col("complexity_label")),
    )


IR_DEFAULTS = {
    "source_language": "string",
    "tables": "array<string>",
    "columns": "array<string>",
    "joins": "array<struct<type:string,table:string,on:string>>",
    "aggregations": "array<string>",
    "window_functions": "array<string>",
    "ctes": "array<string>",
    "subquery_depth": "int",
    "has_udf": "boolean",
    "complexity_score": "int",
    "complexity_label": "string",
    "procedural_flags": "array<string>",
    "dialect": "string",
    "raw_source": "string",
    "parse_errors": "array<string>",
}


def _empty(kind: str) -> Column:
    if kind.startswith("array"):
        return F.array().cast(kind)
    return {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}[kind]


def complete_ir(ir: DataFrame) -> DataFrame:
    """Fill missing fields with an empty value of their type and note each one.

    A column that is absent or NULL counts as missing; a column of another type is kept as
    text elsewhere and noted here.
    """
    present = set(ir.columns)
    notes, filled = [], {}
    for name, kind in IR_DEFAULTS.items():
        missing = F.lit(fv.MISSING_FIELD + name)
        if name not in present:
            notes.append(missing)
            filled[name] = _empty(kind)
            continue
        found = ir.schema[name].dataType.simpleString()
        if found != kind:
            notes.append(F.lit(f"Field {name} expected {kind}, got {found}"))
        else:
            notes.append(F.when(F.col(name).isNull(), missing))
            filled[name] = F.coalesce(F.col(name), _empty(kind))
    return ir.withColumn("notes", F.array_compact(F.array(*notes))).withColumns(filled)
