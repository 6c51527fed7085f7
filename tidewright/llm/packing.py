"""Cost-balanced packing of documents into training sequences.

Every task packs the documents of its partition in buffers of bounded size, so nothing is shuffled and no group of rows
can be hot. A document is its token ids and ``end_id``. Pieces as long as a sequence take one each. The others are dealt in descending order,
each to the sequence of lowest cost that has room, where a piece of n tokens costs ``n + n * n / length`` (a
linear part and the attention's quadratic part). When none of the cheapest has room for all of it, the piece is cut. A buffer opens only as many
sequences as its tokens need, so it pads less than one sequence.

Defined results: a null or empty text is ``end_id`` alone; repeated rows are packed each; ids may be null or repeat, they are
only carried along; other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import in_parts, pieces_of
from tidewright.llm.tokens import encoder

LENGTH = 1024
#: Documents packed together: bounds a task's memory (their tails have less than LENGTH ids each).
BUFFER = 8192
#: Cheapest sequences that are tried before a piece is cut.
TRIED = 8


def deal(lengths: list[int], length: int) -> list[list[tuple[int, int, int, int]]]:
    """For each piece the parts (start in piece, length, sequence, offset); sequences count from 0."""
    count = -(-sum(lengths) // length)
    used = [0] * count
    heap: list[tuple[float, int]] = [(0.0, s) for s in range(count)]
    parts: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]

    def put(piece: int, start: int, n: int, cost: float, s: int) -> None:
        parts[piece].append((start, n, s, used[s]))
        used[s] += n
        if used[s] < length:
            heapq.heappush(heap, (cost + n + n * n / length, s))

    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[piece]
        while left:
            cheap = [heapq.heappop(heap) for _ in range(min(TRIED, len(heap)))]
            chosen = next((c for c in cheap if length - used[c[1]] >= left), cheap[0])
            for c in cheap:
                if c is not chosen:
                    heapq.heappush(heap, c)
            n = min(left, length - used[chosen[1]])
            put(piece, start, n, *chosen)
            start, left = start + n, left - n
    return parts


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``keep_ids`` also ids."""
    id_type = df.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        next_sequence = TaskContext.get().partitionId() << 33
        tails: list[tuple[object, int, np.ndarray]] = []  # id value, tokens before, ids

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids, start, piece, total, sequence, offset = zip(*rows, strict=True)
            columns = {
                "id": pa.array(ids, arrow_id),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(p) for p in piece], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in piece], pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()),
                "sequence_id": pa.array(sequence, pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([p.tobytes() for p in piece], pa.binary())} if keep_ids else {}))

        def packed_tails() -> list[tuple]:
            nonlocal next_sequence
            parts = deal([len(t[2]) for t in tails], length)
            rows = [
                (doc, before + start, ids[start : start + n], before + len(ids), next_sequence + s, offset)
                for (doc, before, ids), own in zip(tails, parts, strict=True)
                for start, n, s, offset in own
            ]
            next_sequence += -(-sum(len(t[2]) for t in tails) // length)
            tails.clear()
            return rows

        for batch in in_parts(batches, 1):
            arrow_id = batch.column(0).type
            docs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in pieces_of(texts, len, 2_000_000):
                rows = []
                for doc, packed in zip(docs[part], enc.encode(texts[part]), strict=True):
                    ids = np.concatenate([np.frombuffer(packed, enc.dtype), end], dtype="<u4", casting="same_kind")
                    whole = len(ids) // length * length
                    for start in range(0, whole, length):
                        rows.append((doc, start, ids[start : start + length], len(ids), next_sequence, 0))
                        next_sequence += 1
                    if whole < len(ids):
                        tails.append((doc, whole, ids[whole:].copy()))
                    if len(tails) >= BUFFER:
                        rows += packed_tails()
                if rows:
                    yield out(rows)
        if tails:
            yield out(packed_tails())

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
