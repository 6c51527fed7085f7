"""Training-pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.operators import pairs as pr
from tidewright.operators import sampling
from tidewright.operators.shared import write_outputs
from tidewright.plans import corpus
from tidewright.plans.registry import query, quote, quoted_list
from tidewright.plans.scripts import sql_any, sql_strip
from tidewright.session import cut_lineage, spread, table
from tidewright.sources import writers

_PAIRS = f"pr AS ({corpus.PAIRS_SQL})"


def pair_lines(spark, sf):
    """Pairs as JSON lines, a share of them broken the ways real dumps are broken."""
    fields = ["source_language", "difficulty", "source_code", "pyspark_code", "features", "generated_by"]
    kind = F.col("pair_id") % 23
    rows = corpus.pairs(spark, sf)

    def line(**changed):
        picked = [changed.get(f, F.col(f)) for f in fields]
        return F.to_json(F.struct(*[c.alias(f) for c, f in zip(picked, fields) if c is not None]), {"ignoreNullFields": "false"})

    whole = line()
    value = (
        F.when(kind == 1, line(generated_by=None))
        .when(kind == 2, line(source_language=F.lit("cobol")))
        .when(kind == 3, line(features=F.lit("not a list")))
        .when(kind == 4, F.expr("substring(whole, 1, length(whole) - 5)"))
        .when(kind == 5, F.lit("   "))
        .when(kind == 6, line(source_code=F.lit(None).cast("string")))
        .when(kind == 7, line(pyspark_code=F.lit(17)))
        .when(kind == 8, line(source_code=F.lit("SELECT 1")))
        .when(kind == 9, line(difficulty=F.lit(None).cast("string")))
        .otherwise(F.col("whole"))
    )
    return rows.withColumn("whole", whole).select("pair_id", value.alias("value"))


_CUT = " OR ".join(f"ends_with({sql_strip('code')}, {quote(e)})" for e in fv.CUT_ENDINGS)
_MARKER = "coalesce(" + ", ".join(
    f"CASE WHEN contains(lower(code || ' ' || src), {quote(m.lower())}) THEN {quote(m)} END" for m in fv.PLACEHOLDERS
) + ")"
_WORDS = (
    f"list_filter(list_distinct(regexp_extract_all(lower(src), {quote(fv.IDENTIFIER)})), lambda w: NOT list_contains({quoted_list(fv.SQL_KEYWORDS)}, w))"
)
_ALIGN = f"CASE WHEN len({_WORDS}) > 0 THEN len(list_filter({_WORDS}, lambda w: contains(lower(code), w))) / len({_WORDS}) END"
_VERDICT_SQL = f"""{_PAIRS}, b AS (SELECT pair_id, pair_id % 23 AS kind, code_id, source_language, generated_by, CASE WHEN pair_id % 23 = 8 THEN 'SELECT 1' ELSE source_code END AS src,
     pyspark_code AS code FROM pr WHERE pair_id % 23 <> 5),
   j AS (SELECT *, CASE
     WHEN kind = 4 THEN ['invalid_json', 'not a JSON document'] WHEN kind = 1 THEN ['required_fields', 'Missing fields: generated_by']
     WHEN kind = 2 THEN ['field_values', 'Invalid source_language: cobol'] WHEN kind = 9 THEN ['field_values', 'Invalid difficulty: None']
     WHEN kind = 3 THEN ['field_values', 'features must be a list']
     WHEN kind = 6 THEN ['field_values', 'source_code must be a string'] WHEN kind = 7 THEN ['field_values', 'pyspark_code must be a string']
     WHEN length({sql_strip('src')}) < 15 THEN ['minimum_length', 'source_code too short (' || length({sql_strip('src')}) || ' chars)']
     WHEN length({sql_strip('code')}) < 20 THEN ['minimum_length', 'pyspark_code too short (' || length({sql_strip('code')}) || ' chars)']
     WHEN NOT {corpus.VALID_CODE_SQL}[code_id + 1] THEN ['pyspark_syntax', 'PySpark syntax error: ' || {corpus.FAULT_SQL}[code_id + 1]]
     WHEN NOT {sql_any('code', fv.DATASET_OPERATIONS, '')} THEN ['dataframe_operations', 'No DataFrame operations found in pyspark_code']
     WHEN {_MARKER} IS NOT NULL THEN ['no_placeholder_text', 'Placeholder text found: ''' || {_MARKER} || '''']
     WHEN {_CUT} THEN ['no_placeholder_text', 'PySpark code appears truncated (ends mid-expression)']
     WHEN {_ALIGN} < 0.15 THEN ['source_pyspark_alignment', 'Low alignment between source and pyspark (' || CAST(round_even({_ALIGN} * 100, 0) AS INTEGER) || '% of source tokens found in output)']
     END AS verdict FROM b)"""


def verdicts(spark, sf):
    return pr.validate_lines(pair_lines(spark, sf))


@query(
    "j36_pair_validation",
    f"WITH {_VERDICT_SQL} SELECT pair_id, verdict IS NULL AS valid, verdict[1] AS failed_check, verdict[2] AS reason FROM j",
)
def j36(spark, sf):
    return verdicts(spark, sf).select("pair_id", "valid", "failed_check", "reason")


@query(
    "w16_split_sink",
    f"""WITH {_VERDICT_SQL} SELECT 'accepted' AS sink, '' AS failed_check, count(*) AS n FROM j WHERE verdict IS NULL
        UNION ALL SELECT 'rejected', verdict[1], count(*) FROM j WHERE verdict IS NOT NULL GROUP BY 2""",
)
def w16(spark, sf):
    judged = verdicts(spark, sf).drop("features")
    accepted, rejected = writers.split_rows(judged, F.col("valid"))
    good = writers.read_sink(spark, accepted, judged.schema)
    bad = writers.read_sink(spark, rejected, judged.schema)
    n = F.count(F.lit(1)).alias("n")
    return good.agg(F.lit("accepted").alias("sink"), F.lit("").alias("failed_check"), n).unionByName(
        bad.groupBy(F.lit("rejected").alias("sink"), "failed_check").agg(n)
    )


@query(
    "w74_shared_outputs",
    f"""WITH {_VERDICT_SQL} SELECT 'accepted' AS output, count(*) AS n, CAST(sum(pair_id) AS BIGINT) AS checksum FROM j WHERE verdict IS NULL
        UNION ALL SELECT 'rejected', count(*), CAST(sum(length(verdict[2])) AS BIGINT) FROM j WHERE verdict IS NOT NULL
        UNION ALL SELECT 'summary', count(DISTINCT coalesce(verdict[1], '-')), count(*) FROM j""",
)
def w74(spark, sf):
    """Accepted rows, rejected rows and the summary of one validation, which is evaluated once and leaves nothing behind."""
    judged = verdicts(spark, sf).select("pair_id", "valid", "failed_check", "reason", "source_language", "generated_by")
    outputs = {
        "accepted": lambda df: df.filter("valid").select("pair_id"),
        "rejected": lambda df: df.filter("NOT valid").select("failed_check", "reason"),
        "summary": pr.validation_summary,
    }
    paths = write_outputs(judged, outputs)
    sizes = {
        "accepted": (F.count(F.lit(1)), F.sum("pair_id")),
        "rejected": (F.count(F.lit(1)), F.sum(F.length("reason"))),
        "summary": (F.count_if(F.col("facet") == "failed_check"), F.max(F.when(F.col("facet") == "all", F.col("total")))),
    }
    parts = [spark.read.parquet(paths[name]).agg(F.lit(name).alias("output"), n.alias("n"), total.cast("long").alias("checksum")) for name, (n, total) in sizes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "j37_minimum_length",
    f"""SELECT doc_id, length({sql_strip('text')}) >= 15 AS source_ok, length({sql_strip('text')}) >= 20 AS code_ok, length({sql_strip('text')}) AS chars FROM documents""",
)
def j37(spark, sf):
    chars = F.length(rules.strip(F.col("text")))
    return spread(table(spark, sf, "documents")).select(
        "doc_id",
        (chars >= fv.MIN_SOURCE_CHARS).alias("source_ok"),
        (chars >= fv.MIN_CODE_CHARS).alias("code_ok"),
        chars.cast("long").alias("chars"),
    )


_DOC_MARKER = "coalesce(" + ", ".join(
    f"CASE WHEN contains(lower(text), {quote(m.lower())}) THEN {quote(m)} END" for m in fv.PLACEHOLDERS
) + ")"
_DOC_CUT = " OR ".join(f"ends_with({sql_strip('text')}, {quote(e)})" for e in fv.CUT_ENDINGS)


@query("j38_placeholder_scan", f"SELECT doc_id, {_DOC_MARKER} AS marker, {_DOC_CUT} AS cut_off FROM documents")
def j38(spark, sf):
    text = F.col("text")
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", pr.placeholder_found(text, F.lit("")).alias("marker"), pr.cut_off(text).alias("cut_off"))


@query(
    "j39_token_alignment",
    f"WITH {_PAIRS}, s AS (SELECT pair_id, source_code AS src, pyspark_code AS code FROM pr) SELECT pair_id, {_ALIGN} AS share FROM s",
)
def j39(spark, sf):
    share = pr.alignment(F.col("source_code"), F.col("pyspark_code"))
    return corpus.pairs(spark, sf).select("pair_id", share.alias("share"))


# The language and origin of a rejected line are whatever its JSON says.
@query(
    "j40_validation_summary",
    f"""WITH {_VERDICT_SQL}, f AS (SELECT coalesce(verdict[1], '-') AS failed_check,
          CASE kind WHEN 4 THEN 'unknown' WHEN 2 THEN 'cobol' ELSE source_language END AS source_language,
          CASE WHEN kind IN (1, 4) THEN 'unknown' ELSE generated_by END AS generated_by, verdict IS NULL AS valid FROM j),
        u AS (SELECT 'all' AS facet, 'all' AS name, valid FROM f UNION ALL SELECT 'failed_check', failed_check, valid FROM f
              UNION ALL SELECT 'source_language', source_language, valid FROM f UNION ALL SELECT 'generated_by', generated_by, valid FROM f)
        SELECT facet, name, count(*) AS total, count(*) FILTER (valid) AS valid, round(count(*) FILTER (valid) * 100 / count(*), 2) AS pass_rate FROM u GROUP BY ALL""",
)
def j40(spark, sf):
    return pr.validation_summary(verdicts(spark, sf))


@query(
    "j41_priority_merge",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY substr({sql_strip('text')}, 1, 100)
        ORDER BY CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE 1 END, doc_id) AS rn FROM documents WHERE {sql_strip('text')} <> '') WHERE rn = 1""",
)
def j41(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    seeds_first = F.when(F.col("source").isin("src0", "src1"), 0).otherwise(1)
    return pr.merge_by_priority(docs, "text", "doc_id", seeds_first).select("doc_id", "source")


@query(
    "j42_label_counts",
    f"""WITH {_PAIRS} SELECT coalesce(source_language, 'all') AS source_language, coalesce(difficulty, 'all') AS difficulty,
        coalesce(generated_by, 'all') AS generated_by, count(*) AS pairs FROM pr
        GROUP BY GROUPING SETS ((source_language), (difficulty), (generated_by), ())""",
)
def j42(spark, sf):
    lang, diff, origin = F.col("source_language"), F.col("difficulty"), F.col("generated_by")
    counted = corpus.pairs(spark, sf).groupingSets([[lang], [diff], [origin], []], lang, diff, origin)
    return counted.agg(F.count(F.lit(1)).alias("pairs")).fillna("all")


_QUOTA_SQL = "(VALUES " + ", ".join(
    f"('{lang}', '{d}', {n})" for lang, by in fv.TEST_QUOTAS.items() for d, n in by.items()
) + ") AS q(source_language, difficulty, quota)"
_TEST_SQL = f"""test AS (SELECT * EXCLUDE (rn, quota) FROM (SELECT pr.*, quota, row_number() OVER (PARTITION BY source_language, difficulty
    ORDER BY md5('t9|' || pair_id), pair_id) AS rn FROM pr JOIN {_QUOTA_SQL} USING (source_language, difficulty)) WHERE rn <= quota)"""


@query("j43_stratified_split", f"WITH {_PAIRS}, {_TEST_SQL} SELECT pair_id, source_language, difficulty FROM test")
def j43(spark, sf):
    return pr.test_split(corpus.pairs(spark, sf), "t9").select("pair_id", "source_language", "difficulty")


@query(
    "j43_quota_report",
    f"""WITH {_PAIRS} SELECT q.source_language, q.difficulty, quota AS need, count(pair_id) AS have, CAST(least(quota, count(pair_id)) AS BIGINT) AS taken
        FROM {_QUOTA_SQL} LEFT JOIN pr ON q.source_language = pr.source_language AND q.difficulty = pr.difficulty GROUP BY q.source_language, q.difficulty, quota""",
)
def j43_report(spark, sf):
    quotas = pr.quota_table(spark, fv.TEST_QUOTAS)
    return sampling.quota_report(corpus.pairs(spark, sf), ["source_language", "difficulty"], quotas)


@query(
    "j44_train_without_test",
    f"""WITH {_PAIRS}, {_TEST_SQL} SELECT pair_id FROM pr WHERE pair_id NOT IN (SELECT pair_id FROM test)
        AND substr({sql_strip('source_code')}, 1, 100) NOT IN (SELECT substr({sql_strip('source_code')}, 1, 100) FROM test)""",
)
def j44(spark, sf):
    pairs = corpus.pairs(spark, sf).select("pair_id", "source_language", "difficulty", "source_code")
    test = cut_lineage(pr.test_split(pairs, "t9"), "test-split")
    return pr.train_without(pairs, test, "pair_id", "source_code").select("pair_id")


@query(
    "j45_train_eval",
    "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('e5|' || doc_id), 1, 15) AS BIGINT) < " + str(int(fv.EVAL_SHARE * 2**60)) + " THEN 'eval' ELSE 'train' END AS part FROM documents",
)
def j45(spark, sf):
    return pr.train_eval(table(spark, sf, "documents").select("doc_id"), "e5", "doc_id").select("doc_id", "part")


_PROMPT_SQL = r"""'### Instruction:' || chr(10) || 'Convert the following ' || upper(source_language) || ' code to PySpark.' || chr(10) || 'Difficulty: ' || difficulty
    || chr(10) || chr(10) || '### Input:' || chr(10) || source_code || chr(10) || chr(10) || '### Response:' || chr(10)"""


@query(
    "j46_prompt_text",
    f"WITH {_PAIRS} SELECT pair_id, {_PROMPT_SQL} || pyspark_code || chr(10) || '### End' AS text FROM pr",
)
def j46(spark, sf):
    text = pr.training_text(F.col("source_language"), F.col("difficulty"), F.col("source_code"), F.col("pyspark_code"))
    return corpus.pairs(spark, sf).select("pair_id", text.alias("text"))


_ANSWER_SQL = rf"""WITH {_PAIRS} SELECT pair_id, {sql_strip('source_code')} AS source_code, {sql_strip('pyspark_code')} AS pyspark_code,
    'joins|window' AS features FROM pr WHERE pair_id % 5 <> 3 AND length({sql_strip('source_code')}) >= 10 AND length({sql_strip('pyspark_code')}) >= 10"""


@query("j47_parse_answers", _ANSWER_SQL)
def j47(spark, sf):
    source, code, kind = rules.strip(F.col("source_code")), rules.strip(F.col("pyspark_code")), F.col("pair_id") % 5
    marked = F.concat(
        F.lit("===FEATURES===\njoins, window\n\n===SOURCE_CODE===\n"), source, F.lit("\n\n===PYSPARK_CODE===\n"), code, F.lit("\n\n===END===")
    )
    headed = F.concat(
        F.lit("#### Features:\n- `joins`\n* window\n## Source Code:\n```sql\n"), source,
        F.lit("\n```\n### PySpark_Code:\n```python\n"), code, F.lit("\n```\n### END"),
    )
    incomplete = F.concat(F.lit("===SOURCE_CODE===\n"), source)
    raw = F.when(kind == 3, incomplete).when(kind % 2 == 0, marked).otherwise(headed)
    answers = corpus.pairs(spark, sf).select("pair_id", raw.alias("raw"))
    parsed = pr.parse_answer(answers)
    return parsed.select("pair_id", "source_code", "pyspark_code", F.array_join("features", "|").alias("features"))


@query(
    "j48_example_choice",
    f"""WITH {_PAIRS}, pool AS (SELECT pair_id AS example_id, source_language, difficulty FROM pr WHERE generated_by = '{fv.ORIGINS[0]}'),
        fine AS (SELECT *, row_number() OVER (PARTITION BY source_language, difficulty ORDER BY example_id) AS place, count(*) OVER (PARTITION BY source_language, difficulty) AS size FROM pool),
        wide AS (SELECT *, row_number() OVER (PARTITION BY source_language ORDER BY example_id) AS place, count(*) OVER (PARTITION BY source_language) AS size FROM pool),
        req AS (SELECT pair_id, source_language, difficulty, CAST('0x' || substr(md5('x3|' || pair_id), 1, 8) AS BIGINT) AS draw FROM pr WHERE generated_by = '{fv.ORIGINS[1]}')
        SELECT pair_id, r.source_language, r.difficulty, example_id, true AS same_difficulty FROM req r JOIN fine f
          ON r.source_language = f.source_language AND r.difficulty = f.difficulty AND draw % size + 1 = place
        UNION ALL SELECT pair_id, r.source_language, r.difficulty, example_id, false FROM req r JOIN wide w
          ON r.source_language = w.source_language AND draw % size + 1 = place
          WHERE NOT EXISTS (SELECT 1 FROM fine f WHERE f.source_language = r.source_language AND f.difficulty = r.difficulty)
        UNION ALL SELECT pair_id, source_language, difficulty, NULL, NULL FROM req WHERE source_language NOT IN (SELECT source_language FROM pool)""",
)
def j48(spark, sf):
    pairs = corpus.pairs(spark, sf)
    seeds = pairs.filter(F.col("generated_by") == fv.ORIGINS[0])
    pool = seeds
    return pr.pick_examples(pairs.filter(F.col("generated_by") == fv.ORIGINS[1]), pool, "x3")


@query(
    "j49_yield_rate",
    """SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS generated,
       round(CAST(count(*) FILTER (event_type <> 'error') * 100 AS DOUBLE) / count(*), 4) AS yield_percent FROM events GROUP BY 1""",
)
def j49(spark, sf):
    made = F.count_if(F.col("event_type") != "error")
    tried = F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("user_id").agg(
        tried.alias("attempted"), made.alias("generated"), F.round(made * 100 / tried, 4).alias("yield_percent")
    )


@query(
    "j50_seed_pool",
    f"""WITH {_PAIRS} SELECT source_language, count(*) AS seeds FROM pr WHERE pair_id % 23 NOT IN (2, 4, 5) GROUP BY 1""",
)
def j50(spark, sf):
    parsed = pr.parse_lines(pair_lines(spark, sf))
    known = parsed.filter(F.col("is_json") & F.col("source_language").isin(*fv.LANGUAGES))
    return known.groupBy("source_language").agg(F.count(F.lit(1)).alias("seeds"))
