"""What several training-data operators share: text normalising, word hashes, fixed-size bit filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut_lineage, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def whole_text(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text of a batch; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``limit`` words at a time."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finaliser: xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def multipliers(n: int) -> np.ndarray:
    """n fixed odd 64-bit factors."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; empty when there are fewer."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k, m in enumerate(multipliers(n)):
        total += words[k : k + size] * m
    return mix(total)


def pieces_of(texts: list, size_of, limit: int):
    """Slices of ``texts`` whose sizes add up to about ``limit``; one long text makes a slice of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = size_of(t)
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def slices_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Views of a batch of at most ``rows`` rows, so that few of its texts are Python objects at a time."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def in_parts(batches: Iterator[pa.RecordBatch], column: int | str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """All batches of a task in views whose ``column`` has about ``limit`` bytes; one long text makes a view of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for part in pieces_of(sizes, int, limit):
            yield batch.slice(part.start, part.stop - part.start)


def bit_filter(hashes: DataFrame, column: str, log2_bits: int = 26) -> np.ndarray:
    """A bit set of fixed size (8 MB for 26) with the bit of every hash in ``column`` set.

    It only ever lets too much through, so callers use it to leave work out before a shuffle and decide exactly
    afterwards. A fuller filter costs time, not rows. The rows fetched are at most ``2**log2_bits / 64`` words.
    """
    bit = f"(`{column}` & {(1 << log2_bits) - 1}L)"
    words = (
        hashes.selectExpr(f"shiftrightunsigned({bit}, 6) AS word", f"shiftleft(1L, CAST({bit} & 63L AS INT)) AS bits")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    found = words.toArrow()
    filled = np.zeros(1 << (log2_bits - 6), np.uint64)
    filled[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return filled


def in_filter(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the set."""
    bit = hashes & np.uint64(len(filled) * 64 - 1)
    return (filled[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


#: Hashes are counted in ranges, named by their highest bits, so that a range's share of a task is a row of some KB.
RANGE_BITS = 14
#: Hashes that a task holds before it counts them and passes them on; rows of a batch that it passes on.
HASHES, PASSED = 1_500_000, 100_000


def summed(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and the sums of their counts (one each without)."""
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    sums = np.diff(np.append(starts, len(hashes))) if counts is None else np.add.reduceat(counts, starts) if len(starts) else counts
    return hashes[starts], sums


def count_blocks(hashes: Iterator[np.ndarray], limit: int) -> Iterator[pa.RecordBatch]:
    """range, hashes, counts: a row for each range of the 64-bit hashes (evenly spread) that a task has in ``limit`` of them. Counts have four bytes."""

    def block(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        everything = np.concatenate(held)
        held.clear()
        found, counts = summed(everything)
        del everything
        ranges = (found >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        for at in range(0, len(starts), 1000):
            cuts = np.append(starts, len(found))[at : at + 1001]
            columns = [pa.array(ranges[cuts[:-1]])]
            for values in (found[cuts[0] : cuts[-1]].astype("<u8"), counts[cuts[0] : cuts[-1]].astype("<u4")):
                offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
            yield pa.RecordBatch.from_arrays(columns, names=["range", "hashes", "counts"])

    held, size = [], 0
    for some in hashes:
        if len(some):
            held.append(some)
            size += len(some)
        if size > limit:
            yield from block(held)
            size = 0
    if size:
        yield from block(held)


def often_hashes(df: DataFrame, hashes_of, least: int, limit: int = HASHES) -> DataFrame:
    """hash (a signed long) of the 64-bit hashes that are there ``least`` times or more. ``hashes_of`` gives those of a task's batches as arrays.

    Hashes travel as blocks of a range, a row for thousands, and the ranges are added up one after another; no task holds a table of its hashes in the JVM.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def passed(hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found, sums = summed(hashes, counts)
            found = found[sums >= least].view(np.int64)
            return (pa.RecordBatch.from_arrays([pa.array(found[i : i + PASSED])], names=["hash"]) for i in range(0, len(found), PASSED))

        for batch in (part for whole in batches for part in slices_of(whole, 2000)):
            hashes = np.concatenate([hashes, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8")])
            counts = np.concatenate([counts, np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)])
            ended = hashes >> np.uint64(64 - RANGE_BITS) < np.uint64(batch.column(0)[-1].as_py())  # the last range may go on in another batch
            yield from passed(hashes[ended], counts[ended])
            hashes, counts = hashes[~ended], counts[~ended]
        yield from passed(hashes, counts)

    blocks = df.mapInArrow(lambda batches: count_blocks(hashes_of(batches), limit), "range int, hashes binary, counts binary")
    return blocks.repartition("range").sortWithinPartitions("range").mapInArrow(add, "hash long")


def chunked(df: DataFrame, columns: dict[str, Column], rows: int) -> DataFrame:
    """``columns`` of ``df``, chunk (a name for at most ``rows`` rows of one input file) and row (the place in that file).

    Both follow from where a row is stored, so they are the same in every scan, however splits are cut. What isn't a plain scan
    of files is written first.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = cut_lineage(df.select(*[c.alias(name) for name, c in columns.items()]), "rows")
        columns = {name: F.col(name) for name in columns}
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    chunk = F.concat_ws("-", F.md5(path), F.floor(row / rows).cast("string"))
    return df.select(*[c.alias(name) for name, c in columns.items()], chunk.alias("chunk"), row.alias("row"))


def write_by_chunk(df: DataFrame, label: str) -> str:
    """Write ``df`` as a folder for each value of chunk under the shared folder; returns the root."""
    root = scratch_path(df.sparkSession, label)
    df.repartition("chunk").write.partitionBy("chunk").parquet(root)
    return root


def read_chunk(root: str, chunk: str) -> Iterator[pa.Table]:
    """In a task: the tables of one chunk, none if it has no rows."""
    system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    for info in system.get_file_info(fs.FileSelector(f"{path}/chunk={chunk}", allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                yield pq.read_table(source)
