"""Exact dedup, license scan and quality classifier: edge cases, brute force and held-out accuracy."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, license_scan, quality, queries


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out.append((i, keep, len(ids), not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = True
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1024, 2])
def test_exact_dedup_edges(spark, counters):
    texts = ["A b", "a B", "é", "É", "", None, "x" * 20_000, "a b", "only"] + ["hot"] * 50 + ["Warm"] * 7
    rows = [(None if i in (3, 7) else i, t) for i, t in enumerate(texts)] + [(70, "twice"), (70, "twice"), (None, "nobody"), (None, "nobody")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, row int, digest string").repartition(4)
    assert sorted(map(tuple, exact_dedup.copy_groups(df, counters=counters).collect()), key=str) == exact(rows)
    kept = exact_dedup.drop_copies(df, counters=counters)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), lowered(r.text)) for r in kept.collect()) == sorted(
        (str(i), next(lowered(t) for _, t in rows if hashlib.sha256(lowered(t).encode()).hexdigest() == sha)) for i, _, _, stays, sha in exact(rows) if stays
    )
    assert exact_dedup.copy_groups(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_frequent_digests_bound(spark):
    df = spark.range(4000).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS BINARY) AS digest").repartition(5)
    found = {bytes(r.digest): r.low for r in exact_dedup.frequent_digests(df, 8).collect()}
    assert len(found) <= 8 and 1334 - 4000 / 8 <= found[b"hot"] <= 1334


LICENSES = [
    "", None, "no words here -- !!", "Released under the MIT License.", "x\nunder the mit\nlicense y", "CC-BY-NC cc by nc cc by nc 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under cc by sa 4 0", "Apache License, Version 2.0 é", "apache licensé version 2",
    "public general gnu the under licensed is work this license version 3", "the of and " * 2000 + "\nLicensed under the Apache License, Version 2.0.",
]


def test_license_scan_equals_sql(spark):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(LICENSES)]
    df = spark.createDataFrame([(*r, "w", 1.0) for r in rows], "doc_id long, text string, words string, score double")
    got = sorted((tuple(r) for r in license_scan.scan(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(license_scan.sql()).fetchall(), key=str)
    labels = {t: r[6] for (_, t), r in zip(rows, (license_scan.scan(df.filter(F.col("text").eqNullSafe(t))).first() for _, t in rows), strict=True)}
    assert labels[LICENSES[3]] == "mit" and labels[LICENSES[6]] == "gpl-3" and labels[LICENSES[7]] == "cc-by-sa" and labels[LICENSES[10]] == "gpl-3"
    assert license_scan.scan(df.limit(0)).count() == 0


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_license_scan_of_wrapped_notices(spark):
    around = "some words of a text\n" * 5
    rows = [(text, label, around + wrapped(text.upper(), width) + "\n" + around) for text, label in license_scan.TEMPLATES for width in (1, 3, 5)]
    part = "Licensed under the Apache\nLicense"  # too little of its template, here and with the words far apart
    apart = "this work is licensed under the gnu general\n" + "other words\n" * 40 + "public license version 3"
    inserted = "# redistribution and use in source and\n# binary forms with or extra without\r\n# modification are permitted"
    rows += [(None, "", part), (None, "", apart), (None, "bsd", inserted), (None, "", "")]
    df = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, (template, label, _) in enumerate(rows):
        assert label in got[i].labels.split(",") and got[i].score == (1.0 if label else 0.0), (template, label, got[i])


def test_quality_on_held_out_rows(spark, sf):
    found = queries.QUERIES["op3_quality"](spark, sf.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_quality_edges(spark):
    texts = ["plain words of a text", "", None, "BAD!! BAD!! BAD!! BAD!!", "a " * 50_000, "same", "same"]
    df = spark.createDataFrame([(None if i == 4 else i, t, 1, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(0, 1), (3, 0), (5, None), (None, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, buckets=1 << 12)
    scored = quality.score(df, model)
    assert scored.count() == len(texts) and scored.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.score(df.limit(0), model).count() == 0
    none = quality.fit(df, labels.limit(0), buckets=1 << 12)
    assert quality.score(df, none).select("score").distinct().collect() == [(0.5,)]
    again = quality.fit(df.repartition(3), labels, buckets=1 << 12)
    assert (again.vectors == model.vectors).all()
