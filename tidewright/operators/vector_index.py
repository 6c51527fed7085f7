"""Approximate cosine search over stored bucket tables of random hyperplanes, several buckets probed in each.

Each table cuts space by ``bits`` planes through the origin; the sides a vector lies on are the bits of its bucket. Vectors at a small angle
share a bucket in some table or differ only in planes that pass close to them, so a query also asks the buckets behind the planes nearest to it.

Plane components are +1 or -1 by a digest of their place, and sides are taken of vectors in whole multiples of ``1 / SCALE``: integers, whose sums don't
depend on the order of additions, so a bucket is the same in every session, engine and partitioning.

An index is a versioned folder that any session can open. It holds a vector once per table, next to others of its bucket, so a search reads the asked
buckets (row groups are pruned by table and bucket) and shuffles no vector: the probes come to the index, broadcast while their size allows it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.joins import broadcast_if_small
from tidewright.operators.ranking import top_n_per_group
from tidewright.sources.writers import read_version, write_version

TABLES, BITS, PROBES = 8, 6, 8
SCALE = 1 << 20
#: Probe rows (a vector each) that may be broadcast.
PROBE_ROWS = 50_000


def planes(tables: int, bits: int, size: int) -> np.ndarray:
    """Components of all planes, table by table: -1 where the md5 of ``table:bit:place`` starts with 0 to 7, else 1."""
    places = (f"{t}:{b}:{i}" for t in range(tables) for b in range(bits) for i in range(size))
    sides = [-1 if hashlib.md5(p.encode()).hexdigest()[0] < "8" else 1 for p in places]
    return np.array(sides, np.int64).reshape(tables * bits, size)


def margins(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How far each vector lies on the upper side of each plane, in whole numbers."""
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64) @ cuts.T


def whole_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch without rows whose vector is null or holds a null, and its vectors as a matrix."""
    for batch in batches:
        lists = batch.column(column)
        solid = [v is not None and None not in v for v in lists.to_pylist()]
        batch = batch.filter(pa.array(solid, pa.bool_()))
        if batch.num_rows:
            values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            yield batch, values.reshape(batch.num_rows, -1)


def bucket_rows(vectors: DataFrame, key: str, vector: str, tables: int, bits: int, size: int, probes: int = 1) -> DataFrame:
    """``(key, vector, table, bucket)``: a vector's own bucket of each table and the ``probes - 1`` next ones.

    Buckets come in the order of the summed distances to the planes in between, ties by the planes' bits. Null vectors have no bucket.
    """
    masks = np.arange(1 << bits)
    turned = (masks[:, None] >> np.arange(bits)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = planes(tables, bits, size)
        for batch, values in whole_batches(batches, vector):
            for at in range(0, len(values), 1000):
                part = batch.slice(at, 1000)
                found = margins(values[at : at + 1000], cuts).reshape(-1, bits)
                own = (found >= 0) @ (1 << np.arange(bits))
                if probes > 1:
                    effort = np.abs(found) @ turned.T
                    nearest = np.argsort(effort, axis=1, kind="stable")[:, :probes]
                    buckets = own[:, None] ^ masks[nearest]
                else:
                    buckets = own[:, None]
                each = tables * buckets.shape[1]
                take = pa.array(np.repeat(np.arange(part.num_rows), each))
                table = np.tile(np.repeat(np.arange(tables), buckets.shape[1]), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(table, pa.int32()), pa.array(buckets.reshape(-1), pa.int32())], names=[key, vector, "table", "bucket"])

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in (key, vector))
    return vectors.select(key, vector).mapInArrow(run, f"{kinds}, table int, bucket int")


@dataclass(frozen=True)
class VectorIndex:
    """Rows ``(key, vector, length, table, bucket)`` and the numbers they were made with."""

    rows: DataFrame
    key: str
    vector: str
    tables: int
    bits: int
    size: int


def build_index(vectors: DataFrame, key: str, base: str, vector: str = "embedding", tables: int = TABLES, bits: int = BITS) -> int:
    """Write the next version of the index under ``base`` and return its number.

    Rows are put together by table and bucket; the key takes part in the ranges, so a bucket that holds much of the corpus is spread over files. All
    vectors must have one length.
    """
    first = vectors.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    size = first[0] if first else 0
    made = F.lit(f"{tables}:{bits}:{size}").alias("made")
    rows = bucket_rows(vectors, key, vector, tables, bits, size).withColumn("length", F.sqrt(dot(F.col(vector), F.col(vector))))
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), "length", "table", "bucket", made)
    placed = rows.repartitionByRange("table", "bucket", F.xxhash64("key")).sortWithinPartitions("table", "bucket")
    return write_version(placed, base)


def open_index(spark: SparkSession, base: str, version: int | None = None) -> VectorIndex:
    """The newest (or a given) finished version; needs nothing of the session that wrote it."""
    rows = read_version(spark, base, version)
    made = rows.select("made").first()
    tables, bits, size = map(int, made[0].split(":")) if made else (TABLES, BITS, 0)
    return VectorIndex(rows.drop("made"), "key", "vector", tables, bits, size)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def probed_top_k(index: VectorIndex, queries: DataFrame, query_id: str, k: int, vector: str = "embedding", probes: int = PROBES, doc_id: str = "doc_id") -> DataFrame:
    """Cosine top ``k`` among the documents of the asked buckets: ``(query, doc, score, rank)``.

    A document that several tables find counts once. Each table is cut to its best ``k`` by task before anything is shuffled,
    so at most ``k`` rows for each query, table and task leave a task.
    """
    asked = bucket_rows(queries, query_id, vector, index.tables, index.bits, index.size, probes)
    asked = asked.select(F.col(query_id).alias("_query"), F.col(vector).alias("_asked"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("_length"), "table", "bucket")
    met = index.rows.join(broadcast_if_small(asked, PROBE_ROWS), ["table", "bucket"])
    both = F.col("_length") * F.col("length")
    score = F.when(both == 0, 0.0).otherwise(F.round(dot(F.col("_asked"), F.col("vector")) / F.when(both != 0, both), 9))
    scored = met.select("_query", F.col("key").alias(doc_id), "table", score.alias("score"))
    order = [F.desc("score"), F.asc(doc_id)]
    by_table = top_n_per_group(scored, ["_query", "table"], order, k, rank_name="_nth").drop("_nth", "table")
    best = top_n_per_group(by_table.distinct(), ["_query"], order, k, rank_name="rank")
    return best.select(F.col("_query").alias(query_id), doc_id, F.round("score", 4).alias("score"), "rank")


def recall(found: DataFrame, exact: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """``(asked, hits, recall)``: the share of the exact hits that ``found`` has too."""
    marked = exact.select(query_id, doc_id).join(found.select(query_id, doc_id, F.lit(1).alias("_hit")), [query_id, doc_id], "left")
    counted = marked.agg(F.count(F.lit(1)).alias("asked"), F.count("_hit").alias("hits"))
    return counted.withColumn("recall", F.round(F.col("hits") / F.col("asked"), 6))
