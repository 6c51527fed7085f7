"""Run metrics. Every function takes a static or a streaming frame of run events.

Events: ``ts timestamp, source_language, status, stage, duration, risk_score,
validation_score, flag_text``. Histograms are kept as one counter per bound inside a single
aggregate, so the state per window has a fixed size however many events arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv

LATENESS = "10 minutes"


def watermarked(events: DataFrame) -> DataFrame:
    """Bound the state: events later than ``LATENESS`` behind the newest one are dropped."""
    return events.withWatermark("ts", LATENESS)


def _start(window: str = "window") -> Column:
    return F.date_format(F.col(f"{window}.start"), "yyyy-MM-dd HH:mm")


def request_rate(events: DataFrame) -> DataFrame:
    """Requests per second by language, per minute."""
    counted = watermarked(events).groupBy(F.window("ts", "1 minute"), "source_language").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_start().alias("minute"), "source_language", (F.col("n") / 60).alias("per_second"))


def success_rate(events: DataFrame) -> DataFrame:
    """Percentage of successful runs over five minutes, every minute."""
    counted = (
        watermarked(events)
        .groupBy(F.window("ts", "5 minutes", "1 minute"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("good"))
    )
    return counted.select(_start().alias("start"), (F.col("good") / F.col("n") * 100).alias("percent"), "n")


def bucket_counts(value: Column, bounds) -> list[Column]:
    """Cumulative counts, one per bound."""
    return [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]


def histogram_quantile(q: float, bounds, total: str = "n") -> Column:
    """Quantile by linear interpolation inside the bucket that holds it.

    A quantile beyond the last bound is that bound; the first bucket starts at zero.
    """
    counts = F.array(*[F.col(f"le_{i}") for i in range(len(bounds))])
    uppers = F.array(*[F.lit(float(b)) for b in bounds])
    wanted = F.col(total) * F.lit(q)
    at = F.array_position(F.transform(counts, lambda c: c >= wanted), True).cast("int")
    upper, count = F.element_at(uppers, at), F.element_at(counts, at)
    lower = F.when(at > 1, F.element_at(uppers, F.greatest(at - 1, F.lit(1)))).otherwise(0.0)
    below = F.when(at > 1, F.element_at(counts, F.greatest(at - 1, F.lit(1)))).otherwise(0)
    inside = lower + (upper - lower) * ((wanted - below) / (count - below))
    return F.when(at == 0, F.lit(float(bounds[-1]))).otherwise(inside)


def duration_quantile(events: DataFrame, q: float = 0.95) -> DataFrame:
    """Run duration quantile over five minutes."""
    bounds = fv.DURATION_BOUNDS
    counted = (
        watermarked(events)
        .groupBy(F.window("ts", "5 minutes"))
        .agg(F.count(F.lit(1)).alias("n"), *bucket_counts(F.col("duration"), bounds))
    )
    return counted.select(_start().alias("start"), F.round(histogram_quantile(q, bounds), 6).alias("seconds"))


def stage_median(events: DataFrame) -> DataFrame:
    """Median stage duration over five minutes."""
    bounds = fv.STAGE_BOUNDS
    counted = (
        watermarked(events)
        .groupBy(F.window("ts", "5 minutes"), "stage")
        .agg(F.count(F.lit(1)).alias("n"), *bucket_counts(F.col("duration"), bounds))
    )
    return counted.select(_start().alias("start"), "stage", F.round(histogram_quantile(0.5, bounds), 6).alias("seconds"))


def score_distribution(events: DataFrame, column: str, bounds, width: str = "15 minutes") -> DataFrame:
    """Cumulative bucket counts of a score, one row per bound, ``+Inf`` last."""
    counted = (
        watermarked(events)
        .groupBy(F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("n"), *bucket_counts(F.col(column), bounds))
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("hits")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("hits")))
    return counted.select(_start().alias("start"), F.inline(F.array(*rows)))


def running_totals(events: DataFrame) -> DataFrame:
    """Runs so far by language and status. State is one counter per pair, so no watermark is needed."""
    return events.groupBy("source_language", "status").agg(F.count(F.lit(1)).alias("runs"))


def flag_label(text: Column) -> Column:
    """Short label of a flag: its first word in capitals."""
    return F.when(F.coalesce(text, F.lit("")) == "", "UNKNOWN").otherwise(F.upper(F.element_at(F.split(text, " "), 1)))


def flag_totals(events: DataFrame) -> DataFrame:
    return events.groupBy(flag_label(F.col("flag_text")).alias("flag_type")).agg(F.count(F.lit(1)).alias("flags"))
