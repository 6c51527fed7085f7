"""Exact duplicates: frequent digests are settled map-side, the others by one narrow shuffle.

A Misra-Gries summary per task finds the digests that may hold a large share of the rows. Their exact count and
winner are verified and broadcast (at most ``counters`` rows), so no row of a large group of copies is shuffled.
What is left has groups of at most about ``2 / counters`` of all rows and goes through an ordinary shuffle.

Defined results: a null text counts as empty. Texts are equal when identical after lower-casing A-Z. The row with the
largest id stays; a null id loses to any other. Of rows that repeat an id with an equal text exactly one stays.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, whole_text
from tidewright.session import cut_lineage

COUNTERS = 1024


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(ascii_lower(whole_text(text)), 256))


class Summary:
    """Misra-Gries counts of at most ``counters`` values; each is below the true count by at most rows / counters."""

    def __init__(self, counters: int):
        self.counters, self.counts = counters, Counter()

    def add(self, values) -> None:
        self.counts.update(values)
        if len(self.counts) > self.counters:
            cut = sorted(self.counts.values(), reverse=True)[self.counters]
            self.counts = Counter({v: n - cut for v, n in self.counts.items() if n > cut})


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates for a share above ``2 / counters`` of the rows: digest, low (a lower bound of its count)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in batches:
            summary.add(batch.column(0).to_pylist())
        found = summary.counts
        yield pa.RecordBatch.from_pydict({"digest": pa.array(found.keys(), pa.binary()), "low": pa.array(found.values(), pa.int64())})

    merged = digests.select("digest").mapInArrow(summarise, "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    return merged.orderBy(F.desc("low"), "digest").limit(counters)


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact count and winner of each frequent digest, at most ``counters`` rows: digest, keep_id, keep_row, group_size."""
    rows = digests.count()
    found = digests.join(F.broadcast(frequent_digests(digests, counters).select("digest")), "digest")
    counted = found.groupBy("digest").agg(
        F.max(F.struct(F.col("id"), F.col("row"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return counted.filter(F.col("group_size") * counters >= rows).select(
        "digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"
    )


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``df``: id_col, keep_id, group_size, kept, text_sha256."""
    # The written table pins the row numbers and saves hashing the texts again.
    digests = cut_lineage(
        df.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests"
    )
    heavy = cut_lineage(winners(digests, counters), "winners")
    settled = digests.join(F.broadcast(heavy), "digest").select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    same = Window.partitionBy("digest")
    others = digests.join(F.broadcast(heavy), "digest", "left_anti").select(
        "id",
        F.max("id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.desc_nulls_last("id"), F.desc("row"))) == 1).alias("kept"),
        "digest",
    )
    return settled.unionByName(others).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows of frequent digests other than the winner go before the shuffle; one shuffle of what is left decides the rest.
    """
    names = df.columns
    digests = cut_lineage(
        df.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests"
    )
    heavy = cut_lineage(winners(digests, counters).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep")), "winners")
    marked = df.withColumn("__digest", text_digest(text_col)).join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), "__digest", "left")
    left = marked.filter(F.col("__heavy").isNull() | F.col(id_col).eqNullSafe(F.col("__keep")))
    first = F.row_number().over(Window.partitionBy("__digest").orderBy(F.desc_nulls_last(id_col)))
    return left.withColumn("__nth", first).filter(F.col("__nth") == 1).select(*names)
