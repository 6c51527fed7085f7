"""Streams against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.plans import streams as ps
from tidewright.session import fresh_name, scratch_path
from tidewright.streaming import jobs
from tidewright.streaming import metrics as m
from tidewright.streaming import totals

SCHEMA = "ts timestamp, source_language string, status string, stage string, duration double, risk_score double, validation_score double, flag_text string"


def complete(stream):
    name = fresh_name("mem")
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("metric", [m.request_rate, m.success_rate, m.duration_quantile, m.running_totals, m.flag_totals])
def test_stream_equals_batch(spark, sf, metric):
    assert rows(complete(metric(ps.stream(spark, sf)))) == rows(metric(ps.batch(spark, sf)))


def event(minute, **changed):
    base = {
        "ts": dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute), "source_language": "sql", "status": "success", "stage": "route",
        "duration": 1.0, "risk_score": 1.0, "validation_score": 0.5, "flag_text": "cursor loop",
    }
    return tuple({**base, **changed}.values())


def test_late_events_are_dropped_and_a_second_run_goes_on(spark):
    path, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))

    def arrive(*events):
        spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)
        jobs.drain(m.request_rate(stream), out, state)

    arrive(event(0), event(1), event(30))
    arrive(event(2), event(25), event(60))  # minute 2 is more than ten minutes late
    got = rows(spark.read.parquet(out).select("minute", "per_second"))
    assert got == [(f"2024-01-01 00:{x:02d}", 1 / 60) for x in (0, 1, 25, 30)]


def test_quantile_interpolates_inside_the_bucket(spark):
    events = [event(0, duration=d) for d in (0.4, 0.4, 1.5, 1.5, 100.0)]
    df = spark.createDataFrame(events, SCHEMA)
    median = m.duration_quantile(df, 0.5).first()["seconds"]
    assert median == pytest.approx(1 + (2.5 - 2) / 2)  # rank 2.5 of 5, two below 1 s, two in (1, 2]
    assert m.duration_quantile(df, 0.95).first()["seconds"] == 60.0  # beyond the last bound
    assert m.duration_quantile(df, 0.2).first()["seconds"] == pytest.approx(0.25)


def test_distribution_is_cumulative(spark):
    df = spark.createDataFrame([event(0, risk_score=r) for r in (0.0, 2.5, 11.0)], SCHEMA)
    got = {r["le"]: r["hits"] for r in m.score_distribution(df, "risk_score", (0.0, 3.0, 10.0)).collect()}
    assert got == {"0.0": 1, "3.0": 2, "10.0": 2, "+Inf": 3}


def test_flag_labels(spark):
    df = spark.createDataFrame([("Cursor loop",), ("",), (None,)], "f string")
    assert [r[0] for r in df.select(m.flag_label(F.col("f"))).collect()] == ["CURSOR", "UNKNOWN", "UNKNOWN"]


def test_audit_rows_leave_with_their_base_rows(spark):
    path = scratch_path(spark, "inserts")
    spark.range(6).withColumn("at", F.timestamp_seconds("id")).write.parquet(path)
    stream = jobs.file_stream(spark, path, spark.read.parquet(path).schema)
    out = jobs.drain(jobs.with_audit(stream, "id", F.lit("new"), F.col("at")), partition_by=("kind",))
    written = spark.read.parquet(out)
    assert rows(written.filter("kind = 'base'").select("id")) == rows(spark.range(6))
    audit = written.filter("kind = 'audit'").select(F.col("audit_key").cast("long").alias("id"))
    assert rows(audit) == rows(spark.range(6))


def counted_files(spark, arrivals):
    stream = jobs.file_stream(spark, arrivals, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    return m.running_totals(stream)


def test_totals_survive_stops_repeated_batches_and_compaction(spark):
    arrivals, base, state = (scratch_path(spark, x) for x in ("arrivals", "totals", "state"))
    keys, seen = ["source_language", "status"], []
    for part in range(4):
        new = [event(k, source_language=f"l{(k + part) % 3}", status="failed" if k % 5 == 0 else "success") for k in range(part * 10, part * 10 + 10)]
        seen += new
        spark.createDataFrame(new, SCHEMA).repartition(3).write.mode("append").parquet(arrivals)
        counted = counted_files(spark, arrivals)
        totals.keep_totals(counted, keys, base, state, every=4)
        want = rows(m.running_totals(spark.createDataFrame(seen, SCHEMA)))
        assert rows(totals.read_totals(spark, base, keys, counted.schema)) == want
    whole, changes = totals._folders(spark, f"{base}/whole", "upto"), totals._folders(spark, f"{base}/changes", "batch")
    assert max(whole) == 11 and len(whole) == 2 and min(changes) > min(whole) - 4
    # A batch that Spark runs again writes the same folder.
    last = max(changes)
    again = spark.read.parquet(changes[last])
    spark.createDataFrame(again.collect(), again.schema).write.mode("overwrite").parquet(changes[last])
    assert rows(totals.read_totals(spark, base, keys, counted.schema)) == want
    # Totals go with the checkpoint that made them.
    with pytest.raises(ValueError):
        totals.keep_totals(counted_files(spark, arrivals), keys, base, scratch_path(spark, "other"))
    assert totals.read_totals(spark, scratch_path(spark, "none"), keys, counted.schema).count() == 0


def test_a_failed_batch_counts_once(spark, monkeypatch):
    arrivals, base, state = (scratch_path(spark, x) for x in ("arrivals", "totals", "state"))
    keys = ["source_language", "status"]
    spark.createDataFrame([event(k) for k in range(6)], SCHEMA).coalesce(1).write.parquet(arrivals)

    def fails(*_):
        raise RuntimeError("lost after the write")

    with monkeypatch.context() as patched:
        patched.setattr(totals, "read_totals", fails)
        with pytest.raises(Exception, match="lost after the write"):
            totals.keep_totals(counted_files(spark, arrivals), keys, base, state, every=1)
    counted = counted_files(spark, arrivals)
    totals.keep_totals(counted, keys, base, state, every=1)
    assert rows(totals.read_totals(spark, base, keys, counted.schema)) == [("sql", "success", 6)]
