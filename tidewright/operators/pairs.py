"""Training-pair jobs: parse, validate, merge, split, format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.functions.python_check import python_syntax
from tidewright.operators import ordered as o
from tidewright.operators.joins import broadcast_if_small
from tidewright.operators.ranking import first_per_key
from tidewright.operators.sampling import hash_order, in_share, quota_sample

TEXT_FIELDS = ("source_language", "difficulty", "source_code", "pyspark_code", "generated_by")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Fields, key list and value types of JSON lines; blank lines are dropped.

    A missing key, a null value and a value of another type are three different findings,
    so keys and types are read from the document itself, not from a typed schema.
    """
    doc = F.try_parse_json("value")
    parsed = lines.filter(~rules.is_blank(F.col("value"))).withColumn("_doc", doc)
    found = {"is_json": F.col("_doc").isNotNull(), "keys": F.coalesce(F.json_object_keys("value"), F.array())}
    for field in TEXT_FIELDS:
        found[field] = F.try_variant_get("_doc", f"$.{field}", "string")
    for field in ("features", "source_code", "pyspark_code"):
        found[f"{field}_type"] = F.schema_of_variant(F.try_variant_get("_doc", f"$.{field}", "variant"))
    found["features"] = F.try_variant_get("_doc", "$.features", "array<string>")
    return parsed.withColumns(found).drop("_doc")


def _finding(check: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(check).alias("failed_check"), reason.alias("reason"))


def _python_none(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("None"))


def _invalid(field: str, allowed) -> Column:
    bad = ~F.coalesce(F.col(field).isin(*allowed), F.lit(False))
    return F.when(bad, F.concat(F.lit(f"Invalid {field}: "), _python_none(field)))


def placeholder_found(code: Column, source: Column) -> Column:
    """The first placeholder marker in code or source, or NULL."""
    both = F.lower(F.concat(code, F.lit(" "), source))
    return F.coalesce(*[F.when(F.contains(both, F.lit(m.lower())), F.lit(m)) for m in fv.PLACEHOLDERS])


def cut_off(code: Column) -> Column:
    """Ends in the middle of an expression. A plain suffix test: a last word ``color`` counts too."""
    text = rules.strip(code)
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(e)) for e in fv.CUT_ENDINGS])


def source_identifiers(source: Column) -> Column:
    words = F.array_distinct(rules.all_matches(F.lower(source), fv.IDENTIFIER, 0, rules.AS_WRITTEN))
    return F.array_except(words, F.array(*[F.lit(k) for k in fv.SQL_KEYWORDS]))


def alignment(source: Column, code: Column) -> Column:
    """Share of the source's identifiers that occur in the code; NULL when there are none."""
    lowered = F.lower(code)

    def count(state, word):
        hit = F.contains(lowered, word).cast("int")
        return F.struct((state["n"] + 1).alias("n"), (state["hits"] + hit).alias("hits"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"))
    share = lambda s: F.when(s["n"] > 0, s["hits"] / s["n"])
    return F.aggregate(source_identifiers(source), start, count, share)


def validate_lines(lines: DataFrame) -> DataFrame:
    """Verdict per JSON line: ``valid``, the first failed check and its reason.

    Checks run in a fixed order. The syntax check is the only one that leaves the JVM; it
    sees just the rows that passed the cheaper checks before it.
    """
    parsed = parse_lines(lines)
    missing = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in fv.PAIR_FIELDS]), F.col("keys")))
    source_chars = F.length(rules.strip(F.col("source_code")))
    code_chars = F.length(rules.strip(F.col("pyspark_code")))

    def too_short(field, chars, least):
        text = F.concat(F.lit(f"{field} too short ("), chars.cast("string"), F.lit(" chars)"))
        return F.when(chars < least, _finding("minimum_length", text))

    def wrong_type(field, prefix, reason):
        bad = ~F.coalesce(F.startswith(F.col(f"{field}_type"), F.lit(prefix)), F.lit(False))
        return F.when(bad, F.lit(reason))

    value_problem = F.coalesce(
        _invalid("source_language", fv.LANGUAGES),
        _invalid("difficulty", fv.DIFFICULTIES),
        _invalid("generated_by", fv.ORIGINS),
        wrong_type("features", "ARRAY", fv.REASON_FEATURES),
        wrong_type("source_code", "STRING", fv.REASON_SOURCE),
        wrong_type("pyspark_code", "STRING", fv.REASON_CODE),
    )
    early = F.coalesce(
        F.when(~F.col("is_json"), _finding("invalid_json", "not a JSON document")),
        F.when(F.size(missing) > 0, _finding("required_fields", F.concat(F.lit(fv.REASON_FIELDS), F.array_join(missing, ", ")))),
        F.when(value_problem.isNotNull(), _finding("field_values", value_problem)),
        too_short("source_code", source_chars, fv.MIN_SOURCE_CHARS),
        too_short("pyspark_code", code_chars, fv.MIN_CODE_CHARS),
    )
    first = parsed.withColumn("_early", early)
    first = first.withColumn("_syntax", python_syntax(F.when(F.col("_early").isNull(), F.col("pyspark_code"))))
    code, source = F.col("pyspark_code"), F.col("source_code")
    at_line = F.concat(
        F.lit(fv.REASON_SYNTAX_LINE), F.col("_syntax.line").cast("string"), F.lit(": "), F.col("_syntax.message")
    )
    marker = placeholder_found(code, source)
    share = alignment(source, code)
    low = F.concat(
        F.lit(fv.REASON_ALIGNMENT[0]),
        F.bround(share * 100).cast("int").cast("string"),  # half to even
        F.lit(fv.REASON_ALIGNMENT[1]),
    )
    verdict = F.coalesce(
        F.col("_early"),
        F.when(~F.col("_syntax.ok"), _finding("pyspark_syntax", F.coalesce(at_line, F.concat(F.lit(fv.REASON_PARSE), F.col("_syntax.message"))))),
        F.when(
            ~rules.any_match(code, fv.DATASET_OPERATIONS, rules.AS_WRITTEN),
            _finding("dataframe_operations", fv.REASON_OPERATIONS),
        ),
        F.when(
            marker.isNotNull(),
            _finding("no_placeholder_text", F.concat(F.lit(fv.REASON_PLACEHOLDER), marker, F.lit("'"))),
        ),
        F.when(cut_off(code), _finding("no_placeholder_text", fv.REASON_CUT_OFF)),
        F.when(share < fv.MIN_ALIGNMENT, _finding("source_pyspark_alignment", low)),
    )
    judged = first.withColumn("_verdict", verdict)
    flat = judged.withColumns(
        {
            "valid": F.col("_verdict").isNull(),
            "failed_check": F.col("_verdict.failed_check"),
            "reason": F.col("_verdict.reason"),
        }
    )
    return flat.drop("_early", "_syntax", "_verdict", "keys", "is_json", *[f"{f}_type" for f in ("features", "source_code", "pyspark_code")])


def validation_summary(verdicts: DataFrame) -> DataFrame:
    """Totals, failures by check, valid rows by language, totals and pass rate by origin, in one pass."""
    slim = verdicts.select(
        F.coalesce("failed_check", F.lit("-")).alias("failed_check"),
        F.coalesce("source_language", F.lit("unknown")).alias("source_language"),
        F.coalesce("generated_by", F.lit("unknown")).alias("generated_by"),
        "valid",
    )
    check, lang, origin = F.col("failed_check"), F.col("source_language"), F.col("generated_by")
    # grouping_id has one bit per column, set where the column is rolled up.
    facet = (
        F.when(F.grouping_id() == 0b111, "all")
        .when(F.grouping_id() == 0b011, "failed_check")
        .when(F.grouping_id() == 0b101, "source_language")
        .otherwise("generated_by")
    )
    grouped = slim.groupingSets([[], [check], [lang], [origin]], check, lang, origin).agg(
        facet.alias("facet"), F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid")
    )
    name = F.coalesce("failed_check", "source_language", "generated_by", F.lit("all"))
    rate = F.round(F.col("valid") * 100 / F.col("total"), 2)
    return grouped.select("facet", name.alias("name"), "total", "valid", rate.alias("pass_rate"))


def source_key(text: Column, chars: int = fv.SOURCE_KEY_CHARS) -> Column:
    return F.substring(rules.strip(text), 1, chars)


def merge_by_priority(rows: DataFrame, text: str, row_id: str, priority: Column) -> DataFrame:
    """Keep one row per text start, the lowest ``priority`` first, then the lowest id.

    Only key, priority and id are shuffled; the wide rows are picked by a semi-join on id.
    """
    slim = rows.select(source_key(F.col(text)).alias("_key"), priority.alias("_priority"), F.col(row_id))
    winners = first_per_key(slim.filter(F.col("_key") != ""), ["_key"], ["_priority", row_id], [row_id])
    return rows.join(winners.select(row_id), row_id, "left_semi")


def train_without(rows: DataFrame, test: DataFrame, row_id: str, text: str) -> DataFrame:
    """All rows that are neither in ``test`` nor share a text start with one of its rows.

    A test split of the usual size is broadcast, so the training rows are not shuffled at all.
    """
    keyed = rows.withColumn("_key", source_key(F.col(text)))
    test_keys = test.select(source_key(F.col(text)).alias("_key")).distinct()
    kept = keyed.join(broadcast_if_small(test.select(row_id)), row_id, "left_anti")
    kept = kept.join(broadcast_if_small(test_keys), "_key", "left_anti")
    return kept.drop("_key")


def quota_table(spark, quotas: dict[str, dict[str, int]]) -> DataFrame:
    listed = [(lang, diff, n) for lang, by in quotas.items() for diff, n in by.items()]
    return spark.createDataFrame(listed, "source_language string, difficulty string, quota int")


def test_split(pairs: DataFrame, seed: str, row_id: str = "pair_id") -> DataFrame:
    quotas = quota_table(pairs.sparkSession, fv.TEST_QUOTAS)
    return quota_sample(pairs, ["source_language", "difficulty"], quotas, seed, row_id)


def train_eval(rows: DataFrame, seed: str, row_id: str, share: float = fv.EVAL_SHARE) -> DataFrame:
    part = F.when(in_share(share, seed, row_id), "eval").otherwise("train")
    return rows.withColumn("part", part)


def prompt_text(lang: Column, difficulty: Column, source: Column, notes: Column | None = None) -> Column:
    """Instruction prompt of a pair, up to the response."""
    return F.concat(
        F.lit(fv.PROMPT_START),
        F.upper(lang),
        F.lit(fv.PROMPT_DIFFICULTY),
        difficulty,
        F.lit("\n"),
        F.lit("") if notes is None else notes,
        F.lit(fv.PROMPT_INPUT),
        source,
        F.lit(fv.PROMPT_RESPONSE),
    )


def training_text(lang: Column, difficulty: Column, source: Column, code: Column) -> Column:
    return F.concat(prompt_text(lang, difficulty, source), code, F.lit(fv.PROMPT_END))


def prompt_notes(flags: Column, context: Column) -> Column:
    """Review note for at most five flags, then at most three context texts."""
    listed = F.array_join(F.transform(F.slice(flags, 1, 5), lambda f: F.concat(F.lit("- "), f)), "\n")
    flag_note = F.concat(
        F.lit(fv.PROMPT_FLAGS[0]),
        listed,
        F.lit(fv.PROMPT_FLAGS[1]),
    )
    hints = F.concat(F.lit(fv.PROMPT_CONTEXT), F.array_join(F.slice(context, 1, 3), "\n\n"), F.lit("\n"))
    return F.concat(
        F.when(F.size(flags) > 0, flag_note).otherwise(""),
        F.when(F.size(context) > 0, hints).otherwise(""),
    )


def parse_answer(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Features, source and code out of delimited answers; incomplete or too short ones are dropped."""
    text = rules.strip(F.col(raw))
    headed = text
    for pattern, marker in fv.ANSWER_HEADINGS:
        headed = F.regexp_replace(headed, pattern, marker)
    marked = rules.evaluated(rows, F.when(F.contains(F.col(raw), F.lit("#")), headed).otherwise(text), "_text")

    any_marker = "===(?:" + "|".join(fv.ANSWER_SECTIONS) + ")==="

    def section(name):
        return rules.strip(F.regexp_extract("_text", rf"(?s)==={name}===(.*?)(?:{any_marker}|\z)", 1))

    def unfenced(body):
        body = F.regexp_replace(body, r"^```\w*\n?", "")
        return rules.strip(F.regexp_replace(body, r"\n?```\z", ""))

    complete = marked.filter(F.contains("_text", F.lit("===SOURCE_CODE===")) & F.contains("_text", F.lit("===PYSPARK_CODE===")))
    listed = F.regexp_replace(section("FEATURES"), r"(?m)^\s*[-*]\s*`?", "")
    features = F.transform(F.split(F.replace(listed, F.lit("`"), F.lit("")), r"[,\n]"), rules.strip)
    parts = F.struct(
        unfenced(section("SOURCE_CODE")).alias("source_code"),
        unfenced(section("PYSPARK_CODE")).alias("pyspark_code"),
        F.filter(features, lambda f: f != "").alias("features"),
    )
    found = rules.evaluated(complete, parts, "_parts")
    out = found.withColumns({name: F.col(f"_parts.{name}") for name in ("source_code", "pyspark_code", "features")}).drop("_parts")
    long_enough = (F.length("source_code") >= fv.MIN_SECTION_CHARS) & (F.length("pyspark_code") >= fv.MIN_SECTION_CHARS)
    return out.filter(long_enough).drop("_text")


def pick_examples(requests: DataFrame, pool: DataFrame, seed: str) -> DataFrame:
    """One example per request: of its language and difficulty, else of its language, else null.

    Each pool is numbered once and a request draws a number from its own hash, so a request
    meets a single example instead of the whole pool.
    """
    pool = pool.select("source_language", "difficulty", F.col("pair_id").alias("example_id"))
    drawn = F.conv(F.substring(hash_order(seed, "pair_id"), 1, 8), 16, 10).cast("long")

    def numbered(keys):
        sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        places = o.ordered_measures(pool, keys, ["example_id"], [], {"_place": o.row_number()})
        return sizes, places.select(*keys, "_place", "example_id")

    fine_sizes, fine = numbered(["source_language", "difficulty"])
    wide_sizes, wide = numbered(["source_language"])
    asked = requests.select("pair_id", "source_language", "difficulty", drawn.alias("_draw"))
    sized = asked.join(fine_sizes.withColumnRenamed("_size", "_fine"), ["source_language", "difficulty"], "left")
    sized = sized.join(wide_sizes.withColumnRenamed("_size", "_wide"), "source_language", "left")
    placed = sized.withColumn("_place", F.col("_draw") % F.coalesce("_fine", "_wide") + 1)
    exact = placed.filter(F.col("_fine").isNotNull()).join(fine, ["source_language", "difficulty", "_place"])
    near = placed.filter(F.col("_fine").isNull() & F.col("_wide").isNotNull()).join(wide, ["source_language", "_place"])
    columns = ["pair_id", "source_language", "difficulty", "example_id"]
    none = placed.filter(F.col("_fine").isNull() & F.col("_wide").isNull()).withColumn("example_id", F.lit(None).cast(pool.schema["example_id"].dataType))
    parts = [part.select(*columns, F.lit(same).cast("boolean").alias("same_difficulty")) for part, same in ((exact, True), (near, False), (none, None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
