"""Evaluation queries over scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.operators import evaluation as ev
from tidewright.operators import sampling
from tidewright.operators.ranking import top_n_per_group
from tidewright.plans import corpus
from tidewright.plans.registry import query, quote, quoted_list
from tidewright.session import stored_once

# Three families, each with a base and a tuned model; a pair is the output of one of them.
MODELS = ("alpha-base", "alpha-tuned", "beta-base", "beta-tuned", "gamma-base", "gamma-tuned")
FAMILIES = ("alpha", "beta", "gamma")


def results(spark, sf):
    """One scored output per pair. A base model's output keeps only its text, as an untuned one would."""
    return stored_once(lambda: _results(spark, sf), spark, "results", sf)


def _results(spark, sf):
    order = (F.col("pair_id") % 7 + F.floor(F.col("pair_id") / 312)) % len(MODELS)
    pairs = corpus.pairs(spark, sf).withColumn("model_order", order.cast("int"))
    labelled = pairs.withColumns(
        {
            "model": F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("model_order") + 1),
            "family": F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.floor(F.col("model_order") / 2).cast("int") + 1),
            "is_finetuned": F.col("model_order") % 2 == 1,
        }
    )
    # Untuned models answer in prose for two scripts out of three.
    prose = ~F.col("is_finetuned") & (F.col("pair_id") % 3 != 0)
    answered = labelled.withColumn("pyspark_code", F.when(prose, "Here is the code").otherwise(F.col("pyspark_code")))
    return ev.with_scores(answered).drop("features")


def _ops(patterns) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(code, {quote(p)}) THEN 1 ELSE 0 END" for p in patterns)


_TABLES = f"list_distinct(regexp_extract_all(lower(source_code), {quote(fv.TABLE_READ)}, 1))"
_RESULTS = f"""pr AS ({corpus.PAIRS_SQL}), r0 AS (SELECT *, CAST((pair_id % 7 + pair_id // 312) % 6 AS INTEGER) AS model_order FROM pr),
  r1 AS (SELECT *, {quoted_list(MODELS)}[model_order + 1] AS model, {quoted_list(FAMILIES)}[model_order // 2 + 1] AS family, model_order % 2 = 1 AS is_finetuned,
    model_order % 2 = 0 AND pair_id % 3 <> 0 AS prose FROM r0),
  r2 AS (SELECT *, CASE WHEN prose THEN 'Here is the code' ELSE pyspark_code END AS code, {_TABLES} AS tables FROM r1),
  r3 AS (SELECT *, NOT prose AND {corpus.VALID_CODE_SQL}[code_id + 1] AS syntax_valid, {_ops(fv.EVALUATION_OPERATIONS)} AS op_count,
    len(tables) = 0 OR len(list_filter(tables, lambda t: contains(lower(code), t))) / len(tables) >= 0.6 AS semantic_sim FROM r2),
  results AS (SELECT *, op_count >= 2 AS has_pyspark_ops, syntax_valid AND op_count >= 2 AND semantic_sim AS overall FROM r3)"""
_RATE = "count(*) FILTER (overall) / count(*)"


@query(
    "j61_scored_output",
    f"WITH {_RESULTS} SELECT pair_id, model, syntax_valid, op_count, has_pyspark_ops, semantic_sim, overall FROM results",
)
def j61(spark, sf):
    return results(spark, sf).select(
        "pair_id", "model", "syntax_valid", "op_count", "has_pyspark_ops", "semantic_sim", "overall"
    )


@query(
    "j61_scored_output_short_list",
    f"""WITH pr AS ({corpus.PAIRS_SQL}), s AS (SELECT pair_id, pyspark_code AS code FROM pr) SELECT pair_id, {_ops(fv.FRONTIER_OPERATIONS)} AS op_count,
        ({_ops(fv.FRONTIER_OPERATIONS)}) >= 2 AS has_pyspark_ops FROM s""",
)
def j61_short(spark, sf):
    scored = ev.with_scores(corpus.pairs(spark, sf), fv.FRONTIER_OPERATIONS)
    return scored.select("pair_id", "op_count", "has_pyspark_ops")


_LANG_RATES = ", ".join(
    f"coalesce(count(*) FILTER (overall AND source_language = '{n}') / nullif(count(*) FILTER (source_language = '{n}'), 0), 0) AS {n}"
    for n in fv.LANGUAGES
)


@query("j62_leaderboard", f"WITH {_RESULTS} SELECT model, {_LANG_RATES}, {_RATE} AS overall FROM results GROUP BY model")
def j62(spark, sf):
    return ev.leaderboard(results(spark, sf))


@query(
    "j63_best_tuned",
    f"""WITH {_RESULTS} SELECT model, {_RATE} AS pass_rate FROM results WHERE is_finetuned GROUP BY model, model_order ORDER BY pass_rate DESC, model_order LIMIT 1""",
)
def j63(spark, sf):
    return ev.best_tuned(results(spark, sf))


@query(
    "j64_tuning_gain",
    f"""WITH {_RESULTS} SELECT family, count(*) FILTER (overall AND NOT is_finetuned) / count(*) FILTER (NOT is_finetuned) AS base_rate,
        count(*) FILTER (overall AND is_finetuned) / count(*) FILTER (is_finetuned) AS tuned_rate, tuned_rate - base_rate AS delta FROM results GROUP BY 1""",
)
def j64(spark, sf):
    return ev.tuning_gain(results(spark, sf))


_METRICS = "count(*) AS scripts, " + ", ".join(
    f"count(*) FILTER ({f}) / count(*) AS {f}" for f in ("syntax_valid", "has_pyspark_ops", "semantic_sim", "overall")
)


@query("j65_language_metrics", f"WITH {_RESULTS} SELECT source_language, model, {_METRICS} FROM results GROUP BY source_language, model")
def j65(spark, sf):
    return ev.metric_breakdown(results(spark, sf), ["source_language", "model"])


@query("j66_difficulty_metrics", f"WITH {_RESULTS} SELECT model, difficulty, {_METRICS} FROM results WHERE is_finetuned GROUP BY model, difficulty")
def j66(spark, sf):
    return ev.metric_breakdown(results(spark, sf).filter("is_finetuned"), ["model", "difficulty"])


_BEST = f"""{_RESULTS}, best AS (SELECT model FROM results WHERE is_finetuned GROUP BY model, model_order ORDER BY {_RATE} DESC, model_order LIMIT 1),
  mine AS (SELECT * FROM results WHERE model = (SELECT model FROM best)),
  lab AS (SELECT source_language, unnest(CASE WHEN syntax_valid AND has_pyspark_ops AND semantic_sim THEN ['unknown'] ELSE
    list_filter([CASE WHEN NOT syntax_valid THEN 'syntax_error' END, CASE WHEN NOT has_pyspark_ops THEN 'missing_dataframe_ops' END,
      CASE WHEN NOT semantic_sim THEN 'low_semantic_alignment' END], lambda x: x IS NOT NULL) END) AS category FROM mine WHERE NOT overall),
  cat AS (SELECT source_language, category, count(*) AS n FROM lab GROUP BY ALL)"""


def best_results(spark, sf):
    scored = results(spark, sf)
    # One row; every later step reads only that model's rows.
    return scored.join(F.broadcast(ev.best_tuned(scored).select("model")), "model")


@query(
    "j67_failure_categories",
    f"WITH {_BEST} SELECT source_language, category, n, n / CAST(sum(n) OVER (PARTITION BY source_language) AS DOUBLE) AS share FROM cat",
)
def j67(spark, sf):
    return ev.failure_categories(best_results(spark, sf))


_ADVICE = "CASE category " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fv.FAILURE_ADVICE.items()) + " END"


@query(
    "j68_main_failure",
    f"""WITH {_BEST}, f AS (SELECT source_language, count(*) AS failed FROM mine WHERE NOT overall GROUP BY 1)
        SELECT c.source_language, category, n, failed, n / failed AS share, {_ADVICE} AS advice FROM cat c JOIN f ON c.source_language = f.source_language
        QUALIFY row_number() OVER (PARTITION BY c.source_language ORDER BY n DESC,
          list_position(['syntax_error', 'missing_dataframe_ops', 'low_semantic_alignment'], category)) = 1""",
)
def j68(spark, sf):
    return ev.main_failure(best_results(spark, sf))


@query(
    "j69_strongest_weakest",
    f"""WITH {_BEST}, l AS (SELECT source_language, {_RATE} AS r, list_position({quoted_list(fv.LANGUAGES)}, source_language) AS p FROM mine GROUP BY 1)
        SELECT (SELECT source_language FROM l ORDER BY r DESC, p LIMIT 1) AS strongest, (SELECT max(r) FROM l) AS best_rate,
               (SELECT source_language FROM l ORDER BY r, p LIMIT 1) AS weakest, (SELECT min(r) FROM l) AS worst_rate""",
)
def j69(spark, sf):
    return ev.strongest_weakest(best_results(spark, sf))


@query(
    "j70_rolling_rate",
    f"""WITH {_RESULTS} SELECT model, pair_id, CAST(sum(overall::INTEGER) OVER w AS DOUBLE) / count(*) OVER w AS rolling_rate FROM results
        WINDOW w AS (PARTITION BY model ORDER BY pair_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def j70(spark, sf):
    return ev.rolling_rate(results(spark, sf), "model", "pair_id")


_SMALL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in fv.SMALL_QUOTAS.items()) + ") AS q(source_language, quota)"


@query(
    "j71_small_subset",
    f"""WITH pr AS ({corpus.PAIRS_SQL}) SELECT pair_id, source_language FROM (SELECT pair_id, source_language, quota, row_number() OVER (PARTITION BY source_language
        ORDER BY md5('f42|' || pair_id), pair_id) AS rn FROM pr JOIN {_SMALL} USING (source_language)) WHERE rn <= quota""",
)
def j71(spark, sf):
    quotas = spark.createDataFrame(list(fv.SMALL_QUOTAS.items()), "source_language string, quota int")
    pairs = corpus.pairs(spark, sf).select("pair_id", "source_language")
    return sampling.quota_sample(pairs, ["source_language"], quotas, "f42", "pair_id")


@query(
    "j71_first_three",
    f"""WITH pr AS ({corpus.PAIRS_SQL}) SELECT pair_id, source_language, row_number() OVER (PARTITION BY source_language ORDER BY pair_id) AS rn FROM pr QUALIFY rn <= 3""",
)
def j71_first(spark, sf):
    pairs = corpus.pairs(spark, sf).select("pair_id", "source_language")
    return top_n_per_group(pairs, ["source_language"], [F.asc("pair_id")], 3, spread_by=["pair_id"])


@query(
    "j72_scripts_by_prefix",
    f"""WITH {_RESULTS}, k AS (SELECT substr(source_code, 1, 80) AS key, max(pair_id) AS script_id FROM pr WHERE generated_by = '{fv.ORIGINS[0]}' GROUP BY 1)
        SELECT pair_id, script_id FROM results LEFT JOIN k ON substr(source_code, 1, 80) = key""",
)
def j72(spark, sf):
    seeds = corpus.pairs(spark, sf).filter(F.col("generated_by") == fv.ORIGINS[0])
    return ev.attach_scripts(results(spark, sf), seeds, "pair_id").select("pair_id", "script_id")
