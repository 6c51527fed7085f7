"""Every stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import test_exact_license_quality, test_jaccard, test_substring, test_tokens
from tidewright.llm import quality


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of each stage, written and read as ``run`` does."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, sf))
        seen.append((docs, out))
        docs = out
    return seen


def test_columns_stay(stages):
    for docs, out in stages[:-1]:
        assert out.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0


def test_quality_stage(spark, sf, stages):
    docs, out = stages[0]
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert ids(out) == ids(scored.filter("predicted = 1")) and out.count() < docs.count()


def test_exact_stage(stages):
    docs, out = stages[1]
    rows = test_exact_license_quality.exact([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(out) == sorted((i for i, _, _, kept, _ in rows if kept), key=str)


def test_near_stage(stages):
    docs, out = stages[2]
    found = test_jaccard.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(out) == sorted((d for d, _, c in found if d == c), key=str) and out.count() < docs.count()


def test_substring_stage(stages):
    docs, out = stages[3]
    wanted = {d: (n - gone, sha) for d, n, gone, sha in test_substring.brute_force([(r.doc_id, r.text) for r in docs.collect()])}
    got = out.select("doc_id", F.sha2(F.concat_ws(" ", F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")), 256).alias("sha"), "text", "n_chars")
    for r in got.collect():
        assert wanted[r.doc_id] == (len((r.text or "").encode().split()), r.sha) and r.n_chars == len(r.text)
    assert out.count() == docs.count()


def test_packing_stage(stages):
    docs, out = stages[4]
    wanted = [(r.doc_id, test_tokens.library("byte_bpe_50k.json", r.text or "") + [0]) for r in docs.collect()]
    test_tokens.check_packing(out.collect(), wanted)


def test_edges(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g", "en", None, 13), (1, "A b c d e f g", None, "s", 13), (None, None, None, None, None), (None, "a b c d e f g", "en", "s", None), (4, "", "en", "s", 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert docs.count() >= 0


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[4][1].count()
