"""Scoring generated code and reporting over a table of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.functions.python_check import python_syntax
from tidewright.operators import ordered as o
from tidewright.operators.ranking import top_n_per_group
from tidewright.operators.scripts import lookup, tables_read
from tidewright.session import cut_lineage

CATEGORIES = ("syntax_error", "missing_dataframe_ops", "low_semantic_alignment")


def source_tables_named(source: Column, code: Column) -> Column:
    """At least 60 % of the tables the source reads occur in the code; no tables is a pass."""
    tables = tables_read(source)
    lowered = F.lower(code)
    found = F.size(F.filter(tables, lambda t: F.contains(lowered, t)))
    return F.when(F.size(tables) > 0, found / F.size(tables) >= fv.MIN_TABLE_SHARE).otherwise(True)


def with_scores(rows: DataFrame, operations=fv.EVALUATION_OPERATIONS) -> DataFrame:
    code = F.col("pyspark_code")
    scored = rows.withColumns(
        {
            "syntax_valid": F.coalesce(python_syntax(code)["ok"], F.lit(False)),
            "op_count": rules.count_matches(code, operations),
            "semantic_sim": source_tables_named(F.col("source_code"), code),
        }
    )
    enough = F.col("op_count") >= fv.MIN_OPERATIONS
    return scored.withColumns(
        {"has_pyspark_ops": enough, "overall": F.col("syntax_valid") & enough & F.col("semantic_sim")}
    )


def rate(flag: str | Column) -> Column:
    return F.count_if(flag) / F.count(F.lit(1))


def leaderboard(results: DataFrame) -> DataFrame:
    """Pass rate of every model per language and overall, from one pass over the results."""
    lang = F.col("source_language")
    per_language = [
        (F.count_if(F.col("overall") & (lang == name)) / F.nullif(F.count_if(lang == name), F.lit(0))).alias(name)
        for name in fv.LANGUAGES
    ]
    filled = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(per_language, fv.LANGUAGES)]
    return results.groupBy("model").agg(*filled, rate("overall").alias("overall"))


def best_tuned(results: DataFrame) -> DataFrame:
    """The fine-tuned model with the highest pass rate; of equals the one listed first."""
    rates = results.filter("is_finetuned").groupBy("model", "model_order").agg(rate("overall").alias("pass_rate"))
    return rates.orderBy(F.desc("pass_rate"), "model_order").limit(1).select("model", "pass_rate")


def tuning_gain(results: DataFrame) -> DataFrame:
    tuned = F.col("is_finetuned")

    def part(cond):
        return F.count_if(F.col("overall") & cond) / F.count_if(cond)

    both = results.groupBy("family").agg(part(~tuned).alias("base_rate"), part(tuned).alias("tuned_rate"))
    return both.withColumn("delta", F.col("tuned_rate") - F.col("base_rate"))


def metric_breakdown(results: DataFrame, keys: list[str]) -> DataFrame:
    flags = ("syntax_valid", "has_pyspark_ops", "semantic_sim", "overall")
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("scripts"), *[rate(f).alias(f) for f in flags])


def failure_labels() -> Column:
    checks = zip(("syntax_valid", "has_pyspark_ops", "semantic_sim"), CATEGORIES)
    found = F.array_compact(F.array(*[F.when(~F.col(flag), F.lit(label)) for flag, label in checks]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def failure_categories(results: DataFrame) -> DataFrame:
    """Failure labels per language with their share of the language's labels."""
    labels = rules.unnest(results.filter(~F.col("overall")), ["source_language"], failure_labels(), "category")
    counts = labels.groupBy("source_language", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source_language").agg(F.sum("n").alias("_all"))
    joined = counts.join(totals, "source_language")
    return joined.select("source_language", "category", "n", (F.col("n") / F.col("_all")).alias("share"))


def main_failure(results: DataFrame) -> DataFrame:
    """The most frequent label per language, its share of the failed rows, and the advice for it."""
    counts = failure_categories(results).select("source_language", "category", "n")
    failed = results.filter(~F.col("overall")).groupBy("source_language").agg(F.count(F.lit(1)).alias("failed"))
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    ranked = counts.withColumn("_order", order)
    top = top_n_per_group(ranked, ["source_language"], [F.desc("n"), F.asc("_order")], 1)
    advice = lookup(fv.FAILURE_ADVICE, F.col("category"), "Review training data quality for this language.")
    joined = top.join(failed, "source_language")
    return joined.select(
        "source_language", "category", "n", "failed", (F.col("n") / F.col("failed")).alias("share"), advice.alias("advice")
    )


def strongest_weakest(results: DataFrame) -> DataFrame:
    """Languages with the best and the worst pass rate; of equals the one listed first."""
    rates = results.groupBy("source_language").agg(rate("overall").alias("pass_rate"))
    place = F.array_position(F.array(*[F.lit(n) for n in fv.LANGUAGES]), F.col("source_language"))
    ranked = rates.withColumn("_place", place)
    high = F.max_by("source_language", F.struct("pass_rate", -F.col("_place")))
    low = F.min_by("source_language", F.struct("pass_rate", "_place"))
    return ranked.agg(
        high.alias("strongest"), F.max("pass_rate").alias("best_rate"), low.alias("weakest"), F.min("pass_rate").alias("worst_rate")
    )


def rolling_rate(results: DataFrame, key: str, order: str, width: int = 20, flag: str = "overall") -> DataFrame:
    """Pass rate over the last ``width`` rows of each key.

    Two running totals ``width`` places apart give the sum in between, so a key with a third
    of all rows is handled by slices like any other ordered group.
    """
    ones = results.select(key, order, F.col(flag).cast("long").alias("_one"))
    measures = {"_place": o.row_number(), "_total": o.running_sum("_one")}
    totals = cut_lineage(o.ordered_measures(ones, [key], [order], [], measures).drop("_one"), "rolling")
    earlier = totals.select(key, (F.col("_place") + width).alias("_place"), F.col("_total").alias("_before"))
    joined = totals.join(earlier, [key, "_place"], "left")
    passed = F.col("_total") - F.coalesce("_before", F.lit(0))
    return joined.select(key, order, (passed / F.least(F.col("_place"), F.lit(width))).alias("rolling_rate"))


def attach_scripts(results: DataFrame, scripts: DataFrame, row_id: str, chars: int = 80) -> DataFrame:
    """Look results up in the scripts by the start of the source text; the last script wins."""
    key = F.substring("source_code", 1, chars)
    last = scripts.groupBy(key.alias("_key")).agg(F.max(row_id).alias("script_id"))
    return results.withColumn("_key", key).join(last, "_key", "left").drop("_key")
