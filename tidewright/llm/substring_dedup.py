"""Repeated word windows, counted exactly by super-k-mer partitioning, and their removal.

1. Each window of ``window`` words has a minimiser (see ``minimisers``). Minimisers that one run of windows chose cannot belong to a repeated
   window; a bit set of fixed size leaves them out.
2. Consecutive windows that share a minimiser travel as one packed string to the bucket of that minimiser. Equal strings of a
   part of a task travel once, with the places they stand at, so a group of copies is small before the shuffle.
3. A bucket is sorted by its strings, and its windows are counted as word sequences, whole and exactly. Minimisers chosen more than ``HOT`` times (the
   edges of a passage that very many texts share) do not get one bucket: their windows travel one by one to buckets of their own content, where equal ones
   are neighbours and nothing is held. A bucket that turns out larger takes the same way in a second round.
4. Repeated spans go to the chunk (rows of a file) they belong to as files in the shared folder; texts are not shuffled.

Defined results: a null text has no words; words are what ASCII white space separates, unchanged; fewer words than a window are never
removed; repeated rows repeat each other's windows; ids may be null or repeat. Other columns are kept or ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import byte_texts, chunked, in_filter, in_parts, read_chunk, write_by_chunk
from tidewright.llm.minimisers import documents, repeated_minimisers, window_runs
from tidewright.session import cut_lineage

WINDOW = 35
GRAM = 5
#: Strings of one bucket that a task holds at most.
HOT = 20_000
#: Minimisers that may be called hot; the rest of a larger number is found in the buckets.
HOT_VALUES = 10_000
CHUNK_ROWS = 10_000
PACKED = "bucket long, packed binary, chunk string, docs array<long>, starts array<int>"


def as_long(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "packed", "chunk", "docs", "starts"])


def super_kmers(docs: DataFrame, window: int, gram: int, hot_count: int) -> DataFrame:
    """Packed strings of the windows that may repeat, by bucket, with the rows and word positions they start at."""
    bits, counts = repeated_minimisers(docs, window, gram)
    hot = {r.value for r in counts.filter(F.col("n") > hot_count).orderBy(F.desc("n"), "value").limit(HOT_VALUES).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for (chunks, rows), words, hashes in documents(batches, ["chunk", "row"]):
            runs = window_runs(hashes, window, gram)
            places: dict[tuple[str, int, bytes], list[tuple[int, int]]] = {}
            chosen = np.flatnonzero(in_filter(bits, runs.value))
            for doc, start, count, value in zip(*(x[chosen].tolist() for x in (runs.doc, runs.start, runs.count, runs.value.view(np.int64))), strict=True):
                own = words[doc]
                if value in hot:
                    for s in range(start, start + count):
                        packed = b" ".join(own[s : s + window])
                        places.setdefault((chunks[doc], as_long(packed), packed), []).append((rows[doc], s))
                else:
                    packed = b" ".join(own[start : start + count + window - 1])
                    places.setdefault((chunks[doc], value, packed), []).append((rows[doc], start))
            if places:
                yield packed_batch([(bucket, packed, chunk, [r for r, _ in at], [s for _, s in at]) for (chunk, bucket, packed), at in places.items()])

    return docs.select("chunk", "row", "text").mapInArrow(run, PACKED)


def repeated_windows(strings: list[tuple[bytes, int]], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each distinct packed string the spans (first window, last window) that stand more than once in the bucket.

    strings: sorted packed strings and the number of places each row has.
    """
    totals: dict[bytes, int] = {}
    for packed, n in strings:
        totals[packed] = totals.get(packed, 0) + n
    if len(totals) == 1:
        ((packed, n),) = totals.items()
        return {packed: [(0, packed.count(b" ") - window + 1)]} if n > 1 else {}
    windows = {packed: [b" ".join(w[i : i + window]) for i in range(len(w) - window + 1)] for packed in totals for w in [packed.split(b" ")]}
    counts: dict[bytes, int] = {}
    for packed, n in totals.items():
        for w in windows[packed]:
            counts[w] = counts.get(w, 0) + n
    found = {}
    for packed, own in windows.items():
        spans: list[tuple[int, int]] = []
        for i, w in enumerate(own):
            if counts[w] > 1:
                if spans and spans[-1][1] == i - 1:
                    spans[-1] = (spans[-1][0], i)
                else:
                    spans.append((i, i))
        if spans:
            found[packed] = spans
    return found


def count_buckets(kmers: DataFrame, window: int, limit: int) -> DataFrame:
    """Rows of two kinds: packed null: a repeated span, words first to stop after each of starts in docs; else windows of a bucket beyond the limit.

    The places of a string stay together in one row, so a passage of very many documents gives few rows.
    """
    names = ["chunk", "docs", "starts", "first", "stop", "bucket", "packed"]
    kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def spans(packed: bytes, at: tuple, found) -> None:
            chunk, docs, starts = at
            out.extend((chunk, docs, starts, first, last + window, None, None) for first, last in found)

        held: list[tuple[bytes, tuple]] = []
        bucket, overflow = None, False
        single: tuple[bytes, tuple, bool] | None = None  # the string before, of one window: string, places, whether it was reported

        def close() -> None:
            if held:
                found = repeated_windows([(p, len(at[1])) for p, at in held], window) if len(held) > 1 or len(held[0][1][1]) > 1 else {}
                for packed, at in held:
                    if packed in found:
                        spans(packed, at, found[packed])
                held.clear()

        def give_up(packed: bytes, at: tuple) -> None:
            words = packed.split(b" ")
            for i in range(len(words) - window + 1):
                w = b" ".join(words[i : i + window])
                out.append((at[0], at[1], [s + i for s in at[2]], 0, window, as_long(w), w))

        for batch in in_parts(batches, 1):
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for b, packed, *at in zip(*columns, strict=True):
                if b != bucket:
                    close()
                    bucket, overflow, single = b, False, None
                if packed.count(b" ") == window - 1 and as_long(packed) == b:
                    # A window in a bucket of its own content: equal ones are neighbours.
                    if single and single[0] == packed:
                        if not single[2]:
                            spans(packed, single[1], [(0, 0)])
                        spans(packed, at, [(0, 0)])
                        single = (packed, at, True)
                    else:
                        alone = len(at[1]) == 1
                        if not alone:
                            spans(packed, at, [(0, 0)])
                        single = (packed, at, not alone)
                elif overflow:
                    give_up(packed, at)
                else:
                    held.append((packed, at))
                    if len(held) > limit:
                        overflow = True
                        for own in held:
                            give_up(*own)
                        held.clear()
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ordered = kmers.repartition("bucket").sortWithinPartitions("bucket", "packed")
    return ordered.mapInArrow(run, "chunk string, docs array<long>, starts array<int>, first int, stop int, bucket long, packed binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = HOT) -> DataFrame:
    """chunk, docs, starts, first, stop: spans of words covered by repeated windows, by the places they share; they may overlap."""
    first = cut_lineage(count_buckets(super_kmers(docs, window, gram, limit), window, limit), "spans")
    names = ("chunk", "docs", "starts", "first", "stop")
    spans = first.filter(F.col("packed").isNull()).select(*names)
    again = first.filter(F.col("packed").isNotNull())
    if again.isEmpty():
        return spans
    single = again.select("bucket", "packed", "chunk", "docs", "starts")
    return spans.unionByName(count_buckets(single, window, limit).select(*names))


class Spans:
    """In a task: the repeated spans of the rows of a chunk."""

    def __init__(self, root: str):
        self.root, self.chunk, self.rows = root, None, {}

    def keep(self, chunk: str, doc: int, words: int) -> np.ndarray | None:
        """Which words stay; None if all do."""
        if chunk != self.chunk:
            self.chunk, self.rows = chunk, {}
            for table in read_chunk(self.root, chunk):
                for docs, starts, first, stop in zip(*(table.column(c).to_pylist() for c in ("docs", "starts", "first", "stop")), strict=True):
                    for d, s in zip(docs, starts, strict=True):
                        self.rows.setdefault(d, []).append((s + first, s + stop))
        if doc not in self.rows:
            return None
        stays = np.ones(words, bool)
        for start, stop in self.rows[doc]:
            stays[start:stop] = False
        return stays


def prepared(df: DataFrame, columns: dict, text: str, window: int, gram: int, limit: int) -> tuple[DataFrame, str]:
    """Rows with chunk and row, and the folder of the spans of their column ``text``."""
    docs = chunked(df, columns, CHUNK_ROWS)
    return docs, write_by_chunk(repeated_spans(docs.select("chunk", "row", F.col(text).alias("text")), window, gram, limit), "removed")


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = HOT) -> DataFrame:
    """One row per row of ``df``: id_col, n_words, n_removed, kept_sha256."""
    docs, root = prepared(df, {"id": F.col(id_col), "text": F.col(text_col)}, "text", window, gram, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(root)
        for batch in in_parts(batches):
            counts, removed, shas = [], [], []
            for chunk, row, text in zip(batch.column("chunk").to_pylist(), batch.column("row").to_pylist(), byte_texts(batch), strict=True):
                words = text.split()
                stays = spans.keep(chunk, row, len(words))
                counts.append(len(words))
                kept = words if stays is None else [words[i] for i in np.flatnonzero(stays)]
                removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": shas})

    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = HOT) -> DataFrame:
    """``df`` with the repeated windows taken out of its texts: kept words joined by one blank; texts without any are unchanged."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(text_col)]
    columns = dict(zip(names, map(F.col, df.columns), strict=True))
    docs, root = prepared(df, columns, at, window, gram, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(root)
        for batch in in_parts(batches, at):
            new = batch.column(at).to_pylist()
            for i, (chunk, row, text) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("row").to_pylist(), byte_texts(batch, at), strict=True)):
                words = text.split()
                stays = spans.keep(chunk, row, len(words))
                if stays is not None:
                    new[i] = b" ".join([words[k] for k in np.flatnonzero(stays)]).decode()
            arrays = [pa.array(new, batch.column(c).type) if c == at else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = docs.select(*names).schema
    return docs.mapInArrow(run, schema).toDF(*df.columns)
