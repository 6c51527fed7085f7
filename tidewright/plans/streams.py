"""Run-metric queries over ``events``, as batch twins and as real streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.functions import fixed_values as fv
from tidewright.operators import review as rv
from tidewright.operators import scripts as sc
from tidewright.plans import corpus
from tidewright.plans.registry import ORACLES, query
from tidewright.plans.review import j35  # noqa: F401  registers the report this job continues
from tidewright.session import ROWS_PER_FILE, scratch_path, table
from tidewright.streaming import jobs
from tidewright.streaming import metrics as m
from tidewright.streaming import totals

STAGES = ("route", "analyze", "retrieve", "migrate", "validate")
FLAGS = ("cursor loop", "Trigger body", "", "temp table seen")


def run_events(events):
    """Read the event table as run events; works on static and streaming frames alike."""
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("user_id") % 5 + 1).cast("int"))
    flag = F.element_at(F.array(*[F.lit(f) for f in FLAGS]), (F.col("user_id") % 4 + 1).cast("int"))
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("source_language"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        stage.alias("stage"),
        (F.col("value") / 5).alias("duration"),
        (F.col("value") / 30).alias("risk_score"),
        (F.col("value") / 300).alias("validation_score"),
        flag.alias("flag_text"),
    )


def batch(spark, sf):
    return run_events(table(spark, sf, "events"))


def stream(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return run_events(jobs.file_stream(spark, path + "*", schema))


_EV = f"""e AS (SELECT ts, event_type AS source_language, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
    {list(STAGES)}[user_id % 5 + 1] AS stage, value / 5 AS duration, value / 30 AS risk_score, value / 300 AS validation_score,
    {list(FLAGS)}[user_id % 4 + 1] AS flag_text FROM events)"""
_MINUTE = "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M')"


def _bucket_start(minutes: int) -> str:
    return f"strftime(time_bucket(INTERVAL '{minutes} minutes', ts), '%Y-%m-%d %H:%M')"


_RATE_SQL = f"WITH {_EV} SELECT {_MINUTE} AS minute, source_language, count(*) / 60 AS per_second FROM e"


@query("j73_request_rate", f"{_RATE_SQL} GROUP BY 1, 2")
def j73(spark, sf):
    return m.request_rate(batch(spark, sf))


# Append mode gives a window out once the watermark, ten minutes behind the newest event, has passed it.
@query(
    "j73_request_rate_stream",
    f"""{_RATE_SQL} WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
)
def j73_stream(spark, sf):
    out = jobs.drain(m.request_rate(stream(spark, sf)))
    return spark.read.parquet(out)


_SUCCESS_SQL = f"""WITH {_EV}, w AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS INTEGER)) AS s, status FROM e, (SELECT unnest([0, 1, 2, 3, 4]) AS k))
    SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) FILTER (status = 'success') / count(*) * 100 AS percent, count(*) AS n FROM w"""


@query("j74_success_rate", f"{_SUCCESS_SQL} GROUP BY 1")
def j74(spark, sf):
    return m.success_rate(batch(spark, sf))


def _closed(minutes: int) -> str:
    """Windows that append mode has given out: the watermark, ten minutes behind the newest event, has passed their end."""
    end = f"time_bucket(INTERVAL '{minutes} minutes', ts) + INTERVAL '{minutes} minutes'"
    return f"{end} <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _quantile_sql(q: float, bounds, keys: str, where: str = "true") -> str:
    counts = "[" + ", ".join(f"count(*) FILTER (duration <= {b})" for b in bounds) + "]"
    uppers = "[" + ", ".join(f"{float(b)}::DOUBLE" for b in bounds) + "]"
    names = ", ".join(k.split(" AS ")[-1] for k in keys.split("; "))
    return f"""WITH {_EV}, h AS (SELECT {keys.replace('; ', ', ')}, count(*) * {q}::DOUBLE AS want, {counts} AS c, {uppers} AS u FROM e WHERE {where} GROUP BY {names}),
      p AS (SELECT *, list_position(list_transform(c, lambda x: x >= want), true) AS at_pos FROM h)
      SELECT {names}, round(CASE WHEN coalesce(at_pos, 0) = 0 THEN u[len(u)] WHEN at_pos = 1 THEN u[1] * (want / c[1])
        ELSE u[at_pos - 1] + (u[at_pos] - u[at_pos - 1]) * ((want - c[at_pos - 1]) / (c[at_pos] - c[at_pos - 1])) END, 6) AS seconds FROM p"""


@query("j75_duration_p95", _quantile_sql(0.95, fv.DURATION_BOUNDS, f"{_bucket_start(5)} AS start"))
def j75(spark, sf):
    return m.duration_quantile(batch(spark, sf))


@query("j76_stage_median", _quantile_sql(0.5, fv.STAGE_BOUNDS, f"{_bucket_start(5)} AS start; stage AS stage"))
def j76(spark, sf):
    return m.stage_median(batch(spark, sf))


# The quantile needs a whole window's counters, which append mode has when it gives the window out.
@query("j76_stage_median_stream", _quantile_sql(0.5, fv.STAGE_BOUNDS, f"{_bucket_start(5)} AS start; stage AS stage", _closed(5)))
def j76_stream(spark, sf):
    return spark.read.parquet(jobs.drain(m.stage_median(stream(spark, sf))))


def _distribution_sql(column: str, bounds, where: str = "true") -> str:
    parts = [f"SELECT {_bucket_start(15)} AS start, '{b}' AS le, count(*) FILTER ({column} <= {b}) AS hits FROM e WHERE {where} GROUP BY 1" for b in bounds]
    parts.append(f"SELECT {_bucket_start(15)}, '+Inf', count(*) FROM e WHERE {where} GROUP BY 1")
    return f"WITH {_EV} " + " UNION ALL ".join(parts)


@query("j77_risk_distribution", _distribution_sql("risk_score", fv.RISK_BOUNDS))
def j77(spark, sf):
    return m.score_distribution(batch(spark, sf), "risk_score", fv.RISK_BOUNDS)


@query("j77_risk_distribution_stream", _distribution_sql("risk_score", fv.RISK_BOUNDS, _closed(15)))
def j77_stream(spark, sf):
    return spark.read.parquet(jobs.drain(m.score_distribution(stream(spark, sf), "risk_score", fv.RISK_BOUNDS)))


@query("j78_validation_distribution_stream", _distribution_sql("validation_score", fv.VALIDATION_BOUNDS, _closed(15)))
def j78_stream(spark, sf):
    return spark.read.parquet(jobs.drain(m.score_distribution(stream(spark, sf), "validation_score", fv.VALIDATION_BOUNDS)))


@query("j78_validation_distribution", _distribution_sql("validation_score", fv.VALIDATION_BOUNDS))
def j78(spark, sf):
    return m.score_distribution(batch(spark, sf), "validation_score", fv.VALIDATION_BOUNDS)


_TOTALS_SQL = f"WITH {_EV} SELECT source_language, status, count(*) AS runs FROM e GROUP BY ALL"
_FLAGS_SQL = f"""WITH {_EV} SELECT CASE WHEN flag_text = '' THEN 'UNKNOWN' ELSE upper(string_split(flag_text, ' ')[1]) END AS flag_type, count(*) AS flags FROM e GROUP BY 1"""


@query("j79_running_totals", _TOTALS_SQL)
def j79(spark, sf):
    return m.running_totals(batch(spark, sf))


@query("j80_flag_totals", _FLAGS_SQL)
def j80(spark, sf):
    return m.flag_totals(batch(spark, sf))


def kept_totals(spark, sf, metric, keys):
    """Totals kept by a stream over events that arrive in three parts; it is stopped after each and resumed with the next."""
    arrivals, base, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "totals", "totals-state"))
    events = table(spark, sf, "events")
    found = None
    for part in range(3):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(arrivals)
        counted = metric(run_events(jobs.file_stream(spark, arrivals, events.schema)))
        totals.keep_totals(counted, keys, base, checkpoint, every=2)
        found = counted.schema
    return totals.read_totals(spark, base, keys, found)


@query("j79_running_totals_stream", _TOTALS_SQL)
def j79_stream(spark, sf):
    return kept_totals(spark, sf, m.running_totals, ["source_language", "status"])


@query("j80_flag_totals_stream", _FLAGS_SQL)
def j80_stream(spark, sf):
    return kept_totals(spark, sf, m.flag_totals, ["flag_type"])


def scored(pairs):
    """The stateless review of one frame of pairs, static or streaming."""
    rows = pairs.withColumn("raw_source", F.col("source_code"))
    report = rv.full_review(sc.with_analysis(sc.with_features(rows, "source_code")))
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


@query("j81_continuous_scoring", ORACLES["j35_review_report"])
def j81(spark, sf):
    arrivals = scratch_path(spark, "arrivals")
    incoming = corpus.pairs(spark, sf).select("pair_id", "source_code", "pyspark_code")
    incoming.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(arrivals)
    out = jobs.score_arrivals(spark, arrivals, incoming.schema, scored)
    return spark.read.parquet(out)


@query(
    "w113_insert_trigger",
    """SELECT 'base' AS kind, o_orderstatus AS note, count(*) AS n FROM orders GROUP BY ALL UNION ALL
       SELECT 'audit', 'inserted ' || o_orderstatus, count(*) FROM orders GROUP BY ALL""",
)
def w113(spark, sf):
    path = f"{sf}/orders.parquet"
    schema = StructType([f for f in spark.read.parquet(path).schema if f.name in ("o_orderkey", "o_orderstatus", "o_orderdate")])
    inserts = jobs.file_stream(spark, path + "*", schema)
    note = F.concat(F.lit("inserted "), F.col("o_orderstatus"))
    tagged = jobs.with_audit(inserts, "o_orderkey", note, F.col("o_orderdate").cast("timestamp"))
    written = spark.read.parquet(jobs.drain(tagged, partition_by=("kind",)))
    shown = F.coalesce("audit_note", "o_orderstatus").alias("note")
    return written.groupBy("kind", shown).agg(F.count(F.lit(1)).alias("n"))
