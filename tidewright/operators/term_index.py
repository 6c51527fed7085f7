"""Keyword index in term order: blocks of postings with score bounds, in versions that any session can open.

    base/<build>/blocks/part=12   blocks of one range of (term, document), sorted: term, best, docs, tfs, lengths
    base/<build>/terms            term, documents it is in, its best block, the part a piece of it lies in
    base/manifest/v=3             one row, written last: which build version 3 is, and the numbers scoring needs

A version exists when its manifest does, so an unfinished build is never read, and an index is found by its path alone.

A search reads the parts that hold asked terms (the others are pruned as partitions, before their files are opened). ``best`` bounds what a posting of
a block can add to a score. A query's strongest term alone gives ``k`` documents and so a score that the final list reaches at least; terms whose bounds together stay below it
can't bring a document into the list, nor can a block whose bound and the bounds of the query's other terms do. Documents from the blocks that are left are scored in full. The bounds only leave out
what can't be in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv
from tidewright.functions import rules
from tidewright.operators.joins import broadcast_if_small
from tidewright.operators.ranking import top_n_per_group
from tidewright.operators.retrieval import postings, postings_top_k, tokens
from tidewright.session import cut_lineage
from tidewright.sources.writers import read_version, write_version

BLOCK = 128
#: Scores are compared after rounding; a bound may miss one by less than this.
SLACK = 1e-6
#: Parts of at most so many asked terms are named in the plan; more are found by a join.
NAMED_TERMS = 20_000


@dataclass(frozen=True)
class TermIndex:
    spark: SparkSession
    path: str
    version: int
    documents: int
    postings: int
    mean_length: float
    mean_idf: float
    kind: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(block_schema(self.kind)).parquet(f"{self.path}/blocks")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")


def saturated(tf: Column, length: Column, mean_length: float) -> Column:
    """What an occurrence count adds to a score before the term's weight."""
    norm = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * length / mean_length)
    return tf * (fv.BM25_K1 + 1) / (tf + norm)


def raw_idf(documents: Column, df: Column) -> Column:
    return F.log(documents.cast("double") - df + 0.5) - F.log(df + 0.5)


def build_index(docs: DataFrame, doc_id: str, base: str, text: str = "text", block: int = BLOCK) -> int:
    """Write the next version under ``base`` and return its number."""
    spark, path = docs.sparkSession, f"{base}/build-{uuid.uuid4().hex[:12]}"
    stored = cut_lineage(postings(docs.withColumnRenamed(doc_id, "doc"), "doc", text), "postings")
    documents = docs.count()
    words, entries = stored.agg(F.sum("tf"), F.count(F.lit(1))).first()
    mean_length = (words or 0) / max(documents, 1) or 1.0
    gains = stored.withColumn("gain", saturated(F.col("tf"), F.col("length"), mean_length))
    ordered = gains.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")
    blocked(ordered, block).write.partitionBy("part").parquet(f"{path}/blocks")
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = spark.read.schema(block_schema(kind)).parquet(f"{path}/blocks")
    # A term cut by a part's end has a row for each part; its numbers are those of the whole term.
    pieces = blocks.groupBy("term", "part").agg(F.sum(F.size("docs")).alias("own"), F.max("best").alias("best"))
    whole = pieces.groupBy("term").agg(F.sum("own").alias("df"), F.max("best").alias("best"), F.collect_list("part").alias("parts"))
    whole.sortWithinPartitions("term").write.parquet(f"{path}/terms")
    idf = spark.read.parquet(f"{path}/terms").agg(F.avg(raw_idf(F.lit(documents), F.col("df")))).first()[0]
    manifest = spark.createDataFrame([(path, documents, entries, mean_length, idf or 0.0, kind)], "path string, documents long, postings long, mean_length double, mean_idf double, kind string")
    return write_version(manifest.coalesce(1), f"{base}/manifest")


def open_index(spark: SparkSession, base: str, version: int | None = None) -> TermIndex:
    row = read_version(spark, f"{base}/manifest", version).select("*", F.input_file_name().alias("file")).first()
    number = int(row.file.split("/v=")[1].split("/")[0])
    return TermIndex(spark, row.path, number, row.documents, row.postings, row.mean_length, row.mean_idf, row.kind)


def block_schema(kind: str) -> str:
    return f"term string, best double, docs array<{kind}>, tfs array<long>, lengths array<int>, part int"


def blocked(ordered: DataFrame, size: int) -> DataFrame:
    """Postings in term order as rows of at most ``size`` postings of one term; a block ends with an Arrow batch, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            terms, docs, tfs, lengths, gains = (batch.column(c) for c in ("term", "doc", "tf", "length", "gain"))
            firsts = np.flatnonzero(np.append(True, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)))
            place = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
            starts = np.flatnonzero(place % size == 0)
            offsets = pa.array(np.append(starts, n), pa.int32())
            best = pa.array(np.maximum.reduceat(gains.to_numpy(zero_copy_only=False), starts))
            lists = [pa.ListArray.from_arrays(offsets, column) for column in (docs, tfs, lengths)]
            columns = [terms.take(pa.array(starts)), best, *lists, pa.array(np.full(len(starts), number), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "best", "docs", "tfs", "lengths", "part"])

    schema = block_schema(ordered.schema["doc"].dataType.simpleString())
    return ordered.select("term", "doc", "tf", "length", "gain").mapInArrow(run, schema)


def asked_terms(index: TermIndex, queries: DataFrame, query_id: str, text: str = "text") -> DataFrame:
    """``(query, term, weight, bound, parts)`` of the terms of each query that the index has."""
    asked = rules.unnest(queries, [query_id], tokens(F.col(text)), "term").withColumnRenamed(query_id, "query")
    asked = asked.groupBy("query", "term").agg(F.count(F.lit(1)).alias("repeats"))
    raw = raw_idf(F.lit(index.documents), F.col("df"))
    idf = F.when(raw < 0, index.mean_idf * fv.BM25_EPSILON).otherwise(raw)
    weighted = index.terms.join(broadcast_if_small(asked), "term").withColumn("weight", F.col("repeats") * idf)
    return weighted.select("query", "term", "weight", F.greatest(F.col("weight") * F.col("best"), F.lit(0.0)).alias("bound"), "parts")


def asked_blocks(index: TermIndex, asked: DataFrame) -> DataFrame:
    """The blocks of the parts in which asked terms lie. Their list has no more entries than the index has parts."""
    few = asked.select("term").distinct().limit(NAMED_TERMS + 1).count() <= NAMED_TERMS
    if not few:
        return index.blocks
    parts = [r[0] for r in asked.select(F.explode("parts").alias("part")).distinct().collect()]
    return index.blocks.filter(F.col("part").isin(parts))


def entries(blocks: DataFrame, *columns: str) -> DataFrame:
    """The single postings of blocks, and the named columns with them."""
    each = F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("e")
    return blocks.select(*columns, each).select(*columns, F.col("e.docs").alias("doc"), F.col("e.tfs").alias("tf"), F.col("e.lengths").alias("length"))


def with_reached(index: TermIndex, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """asked, and a score that the k-th document of the query reaches at least (0 without k such documents): the k-th best by its strongest term alone.

    A negative weight (of a word that most documents hold) could take from that, so its query has none.
    """
    plan = asked.groupBy("query").agg(F.max_by("term", F.struct("bound", "term")).alias("term"), F.min("weight").alias("least"), F.max_by("weight", F.struct("bound", "term")).alias("weight"))
    strongest = broadcast_if_small(plan.filter("least >= 0 AND weight > 0").select("query", "term", "weight"))
    found = entries(blocks.join(strongest, "term"), "query", "weight")
    scored = found.select("query", "doc", (F.col("weight") * saturated(F.col("tf"), F.col("length"), index.mean_length)).alias("score"))
    best = top_n_per_group(scored, ["query"], [F.desc("score"), F.asc("doc")], k, spread_by=["doc"], rank_name="_nth")
    reached = best.filter(F.col("_nth") == k).select("query", F.col("score").alias("reached"))
    return asked.join(reached, "query", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))


def indexed_top_k(index: TermIndex, doc_id: str, queries: DataFrame, query_id: str, k: int) -> DataFrame:
    """BM25 top ``k`` documents of every query, positive scores only: ``(query, doc, score, rank)``; the same as a search of all postings."""
    asked = cut_lineage(asked_terms(index, queries, query_id), "asked")
    blocks = asked_blocks(index, asked)
    bounded = with_reached(index, asked, blocks, k)
    # Terms in ascending order of their bounds: those before the sum reaches the score bring no document of their own.
    upto = Window.partitionBy("query").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    query = Window.partitionBy("query")
    bounded = bounded.withColumns({"upto": F.sum("bound").over(upto), "all": F.sum("bound").over(query)})
    plan = cut_lineage(bounded.select("query", "term", "weight", "reached", (F.col("upto") >= F.col("reached") - SLACK).alias("brings"), (F.col("all") - F.col("bound")).alias("others")), "plan")
    return scored_top_k(index, blocks, plan, doc_id, query_id, k)


def scored_top_k(index: TermIndex, blocks: DataFrame, plan: DataFrame, doc_id: str, query_id: str, k: int) -> DataFrame:
    # The least ``best`` with which a block of a term can bring a document to any query; one row per term, so a block is met once.
    gap = F.col("reached") - SLACK - F.col("others")
    least = F.when(gap <= 0, 0.0).when(F.col("weight") > 0, gap / F.col("weight") * (1 - SLACK)).otherwise(float("inf"))
    bringing = broadcast_if_small(plan.filter("brings").groupBy("term").agg(F.min(least).alias("least")))
    candidates = entries(blocks.join(bringing, "term").filter(F.col("best") >= F.col("least"))).select("doc").distinct()
    found = entries(blocks.join(broadcast_if_small(plan.select("term").distinct()), "term", "left_semi"), "term")
    part = saturated(F.col("tf"), F.col("length"), index.mean_length)
    parts = found.join(candidates, "doc", "left_semi").select(F.col("doc").alias(doc_id), "term", part.alias("part"))
    return postings_top_k(parts, doc_id, plan.select(F.col("query").alias(query_id), "term", "weight"), query_id, k)
