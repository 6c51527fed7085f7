"""Passages that repeat, by a sparse suffix array.

1. Only suffixes at minimisers are kept: every window of ``least`` words chooses a place by its content (see ``minimisers``), so two copies of a passage
   of that length keep a suffix at the same place in it. Places whose minimiser was chosen once are left out by a bit set of fixed size. A
   suffix is stored as far as a passage needs: the words to the right, and those to the left in reverse.
2. The suffixes are sorted by Spark's range partitioning, so a text that very many documents share is spread over tasks as it comes. Equal suffixes
   of a part of a task travel as one.
3. Each suffix is compared with the ``NEIGHBOURS`` different ones before it: common words to the right, then to the left. If both together reach
   ``least`` words, the passage repeats.
4. Partners further away agree on the right at least as far as all suffixes between them. So a suffix whose next one beyond its neighbours still has
   ``r`` words in common with it, or that is among the first or last of its task, hands on its windows with ``r`` or fewer words to the right, by the 128-bit
   hash of their words; those already found only as a sign that they are there. A window handed on more than once repeats.
5. What was found in a row is merged to the longest passages.

Equal windows choose the same place, so both copies of a window are either compared or handed on: none is missed.

Defined results: words are what ASCII white space separates; null and shorter texts have no passage; repeated rows repeat each other; ids may be null
or repeat (passages are found by row). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import chunked, gram_hashes, in_filter
from tidewright.llm.minimisers import documents, repeated_minimisers, window_runs
from tidewright.session import cut_lineage

LEAST = 50
GRAM = 8
NEIGHBOURS = 4
CHUNK_ROWS = 10_000
PLACES = "chunk string, ids array<{id}>, rows array<long>, starts array<int>"


def suffixes(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """right and left (reversed) words around each kept place, fewest and most words that its windows have to the left of it, and where it is."""
    bits, _ = repeated_minimisers(docs, least, gram)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for (ids, chunks, rows), words, hashes in documents(batches, ["id", "chunk", "row"]):
            runs = window_runs(hashes, least, gram)
            chosen = np.flatnonzero(in_filter(bits, runs.value))
            places: dict[tuple[str, bytes, bytes, int, int], list[tuple]] = {}
            current, grams = -1, np.empty(0, np.uint64)
            for doc, start, count, value in zip(runs.doc[chosen].tolist(), runs.start[chosen].tolist(), runs.count[chosen].tolist(), runs.value[chosen], strict=True):
                if doc != current:
                    current, grams = doc, gram_hashes(hashes[doc], gram)
                at = start + int(np.argmax(grams[start : start + least - gram + 1] == value))
                own = words[doc]
                right, left = b" ".join(own[at : at + least]), b" ".join(own[max(at - least + 1, 0) : at][::-1])
                places.setdefault((chunks[doc], right, left, at - start - count + 1, at - start), []).append((ids[doc], rows[doc], at))
            if places:
                yield pa.RecordBatch.from_pydict(
                    {
                        "right": pa.array([k[1] for k in places], pa.binary()),
                        "left": pa.array([k[2] for k in places], pa.binary()),
                        "fewest": pa.array([k[3] for k in places], pa.int32()),
                        "most": pa.array([k[4] for k in places], pa.int32()),
                        "chunk": pa.array([k[0] for k in places], pa.string()),
                        "ids": pa.array([[p[0] for p in at] for at in places.values()], pa.list_(kind(id_type))),
                        "rows": pa.array([[p[1] for p in at] for at in places.values()], pa.list_(pa.int64())),
                        "starts": pa.array([[p[2] for p in at] for at in places.values()], pa.list_(pa.int32())),
                    }
                )

    return docs.mapInArrow(run, f"right binary, left binary, fewest int, most int, {PLACES.format(id=id_type)}")


def kind(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def common(a: list[bytes], b: list[bytes]) -> int:
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


@dataclass
class Suffix:
    """A suffix while the next ones are compared with it. ``found`` has (left, right) words of its spans, ``reach`` the words to the right
    that it has in common with the nearest suffix it is not compared with."""

    right: bytes
    left: bytes
    fewest: int
    most: int
    chunk: str
    ids: list
    rows: list[int]
    starts: list[int]
    right_words: list[bytes]
    left_words: list[bytes]
    shared: int = 0
    reach: int = 0
    found: list[tuple[int, int]] = field(default_factory=list)

    def windows(self, least: int) -> Iterator[tuple[int, bool, bytes]]:
        """Words to the left, whether it is found already, and hash of the windows that may have a partner further away."""
        words = self.left_words[::-1] + self.right_words
        for n in range(max(self.fewest, least - self.reach), self.most + 1):
            at = len(self.left_words) - n
            known = any(left >= n and right >= least - n for left, right in self.found)
            yield n, known, xxhash.xxh3_128_digest(b" ".join(words[at : at + least]))


def matches(ordered: DataFrame, least: int, id_type: str) -> DataFrame:
    """Of sorted suffixes the repeated spans (key null), the windows (with key) that repeat if their key does, and only the keys (chunk null) of windows in spans."""
    names = ["chunk", "row", "id", "start", "stop", "key"]
    kinds = [pa.string(), pa.int64(), kind(id_type), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: deque[Suffix] = deque()
        out: list[tuple] = []
        seen = 0

        def span(suffix: Suffix, left: int, right: int, key: bytes | None = None) -> None:
            out.extend((suffix.chunk, r, d, s - left, s + right, key) for d, r, s in zip(suffix.ids, suffix.rows, suffix.starts, strict=True))

        def add(suffix: Suffix, left: int, right: int) -> None:
            if not any(n >= left and r >= right for n, r in suffix.found):
                span(suffix, left, right)
                suffix.found.append((left, right))

        def hand_on(suffix: Suffix) -> None:
            for n, known, key in suffix.windows(least):
                if known:
                    out.append((None, None, None, None, None, key))
                else:
                    span(suffix, n, least - n, key)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                suffix = Suffix(*values, values[0].split(), values[1].split())
                left, right = len(suffix.left_words), len(suffix.right_words)
                if before and (before[-1].right, before[-1].left) == (suffix.right, suffix.left):
                    add(before[-1], left, right)
                    add(suffix, left, right)  # the one before stands for both from now on
                    continue
                if len(suffix.rows) > 1:
                    add(suffix, left, right)
                r = suffix.shared = common(before[-1].right_words, suffix.right_words) if before else 0
                for k, other in enumerate(reversed(before)):
                    if r == 0:
                        break
                    if k == NEIGHBOURS:
                        suffix.reach, other.reach = max(suffix.reach, r), max(other.reach, r)
                        break
                    if r + left >= least and r + len(other.left_words) >= least:
                        n = left if other.left == suffix.left else common(other.left_words, suffix.left_words)
                        if n + r >= least:
                            add(other, n, r)
                            add(suffix, n, r)
                    r = min(r, other.shared)  # sorted: common with the one before that
                if seen < NEIGHBOURS:
                    suffix.reach = least
                seen += 1
                before.append(suffix)
                if len(before) > NEIGHBOURS + 1:
                    hand_on(before.popleft())
            if len(out) >= 20_000:
                yield table()
                out = []
        for k, suffix in enumerate(reversed(before)):
            if k < NEIGHBOURS:
                suffix.reach = least
            hand_on(suffix)
            if len(out) >= 20_000:
                yield table()
                out = []
        if out:
            yield table()

    schema = f"chunk string, row long, id {id_type}, start int, stop int, key binary"
    return ordered.select("right", "left", "fewest", "most", "chunk", "ids", "rows", "starts").mapInArrow(run, schema)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a row as one: id, start, stop. A row's spans are bounded by its words."""
    row = Window.partitionBy("chunk", "row").orderBy("start", "stop")
    reach = F.max("stop").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.distinct().withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = opened.withColumn("passage", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("chunk", "row", "passage").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per longest passage of at least ``least`` words that stands elsewhere too: id_col, start and stop (words), n_words."""
    docs = chunked(df, {"id": F.col(id_col), "text": F.col(text_col)}, CHUNK_ROWS)
    id_type = df.schema[id_col].dataType.simpleString()
    kept = cut_lineage(suffixes(docs, least, gram), "suffixes")
    ordered = kept.repartitionByRange("right", "left").sortWithinPartitions("right", "left")
    found = cut_lineage(matches(ordered, least, id_type), "matches")
    repeated = found.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    further = found.filter(F.col("key").isNotNull() & F.col("chunk").isNotNull()).join(repeated, "key", "left_semi")
    spans = found.filter(F.col("key").isNull()).unionByName(further.select(found.columns)).select("chunk", "row", "id", "start", "stop")
    return merged(spans).select(F.col("id").alias(id_col), F.col("start").cast("long"), F.col("stop").cast("long"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"))
