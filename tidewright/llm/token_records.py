"""Token ids in length-delimited binary files with a separate offset index.

File: records one after another. A record: payload length (unsigned 64 bit), masked checksum of these eight bytes
(unsigned 32 bit), payload, masked checksum of the payload. All numbers are little-endian. Masking rotates a CRC-32 right by 15 bits and adds a
constant, so that a checksum stored inside checked data doesn't look like one. Payload: bytes per id (1 byte), whether the
document id is null (1 byte), document id (signed 64 bit), ids.

The index is a Parquet table with a row per record: file, offset, size, document id, tokens before it. Readers that shuffle take rows
of the index in any order. A file belongs to the data only if the index names it, and Spark commits the index rows of a task's
winning attempt alone, so files of lost or repeated attempts are never read.

Defined results: a null or empty text is ``end_id`` alone; records are in ascending order of the id, nulls first, equal ids by a hash
of their text; repeated rows are written each; other columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import pieces_of, slices_of
from tidewright.llm.tokens import encoder
from tidewright.session import scratch_path

#: Fixed value of the masking (public record format).
MASK_DELTA = 0xA282EAD8
FILE_BYTES = 64 << 20
DOCS_PER_PART = 5000
#: Texts turned into Python strings at a time; bytes of records that a reader holds.
ROWS_AT_ONCE, BYTES_AT_ONCE = 500, 2_000_000
HEAD, PREFIX, TAIL = "<QI", "<BBq", "<I"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack(TAIL, masked(size)), payload, struct.pack(TAIL, masked(payload))))


def unframed(frame: bytes) -> bytes:
    """The payload; ValueError when a length or checksum does not hold."""
    size, check = struct.unpack_from(HEAD, frame)
    if masked(frame[:8]) != check or len(frame) != struct.calcsize(HEAD) + size + struct.calcsize(TAIL):
        raise ValueError("damaged record length")
    payload = frame[struct.calcsize(HEAD) : -struct.calcsize(TAIL)]
    if struct.unpack(TAIL, frame[-struct.calcsize(TAIL) :])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_records(df: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> str:
    """Write ``df``'s ids in ascending id order under ``root`` (a new folder in the shared one); returns root. The index is at root/index."""
    spark = df.sparkSession
    root = root or scratch_path(spark, "records")
    system, path = file_system(root)
    system.create_dir(f"{path}/data", recursive=True)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    parts = max(1, -(-df.count() // DOCS_PER_PART))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.packed([end_id])
        context = TaskContext.get()
        part, stem = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        own_fs, own_path = file_system(root)
        out, name, rows, offset, before, files = None, "", [], 0, 0, 0

        def index() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            names = ("id", "part", "file", "offset", "size", "n_tokens", "before")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, columns, strict=True)})

        for batch in (part for whole in batches for part in slices_of(whole, ROWS_AT_ONCE)):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for piece in pieces_of(texts, len, 2_000_000):
                for doc, packed in zip(ids[piece], enc.encode(texts[piece]), strict=True):
                    if out is None:
                        name, files, offset = f"data/{stem}-{files}.rec", files + 1, 0
                        out = own_fs.open_output_stream(f"{own_path}/{name}")
                    frame = framed(struct.pack(PREFIX, enc.width, doc is None, doc or 0) + packed + end)
                    out.write(frame)
                    n = len(packed) // enc.width + 1
                    rows.append((doc, part, name, offset, len(frame), n, before))
                    offset, before = offset + len(frame), before + n
                    if offset >= FILE_BYTES:
                        out.close()
                        yield index()
                        out, rows = None, []
        if out is not None:
            out.close()
            yield index()

    ordered = docs.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = "id long, part long, file string, offset long, size long, n_tokens long, before long"
    ordered.mapInArrow(write, schema).write.parquet(f"{root}/index")
    return root


def read_records(spark, root: str) -> DataFrame:
    """One row per record, read through the index and checked: id, part, before, n_tokens, ids (binary, 4 bytes an id)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_fs, own_path = file_system(root)
        source, opened = None, None
        # The ids of a batch of index rows may be any number of bytes, so they go out in pieces.
        listed = (batch.to_pylist() for batch in batches)
        for rows in (rows[piece] for rows in listed for piece in pieces_of(rows, lambda row: row["size"], BYTES_AT_ONCE)):
            docs, parts, before, counts, sequences = [], [], [], [], []
            for row in rows:
                if row["file"] != opened:
                    source, opened = own_fs.open_input_file(f"{own_path}/{row['file']}"), row["file"]
                source.seek(row["offset"])
                payload = unframed(source.read(row["size"]))
                width, is_null, doc = struct.unpack_from(PREFIX, payload)
                ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(PREFIX)).astype("<u4")
                docs.append(None if is_null else doc)
                parts.append(row["part"])
                before.append(row["before"])
                counts.append(len(ids))
                sequences.append(ids.tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(docs, pa.int64()),
                    "part": pa.array(parts, pa.int64()),
                    "before": pa.array(before, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": pa.array(sequences, pa.binary()),
                }
            )

    return spark.read.parquet(f"{root}/index").mapInArrow(read, "id long, part long, before long, n_tokens long, ids binary")


def record_starts(spark, root: str) -> DataFrame:
    """part, base: the ids in all files before a part. One row per part, the number of tasks that wrote."""
    totals = spark.read.parquet(f"{root}/index").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def digests(records: DataFrame, starts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of records."""
    placed = records.join(F.broadcast(starts), "part")
    return placed.select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))
