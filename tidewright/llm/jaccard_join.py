"""Exact Jaccard join of word n-gram sets by rare-first prefix filtering, and its connected components.

1. Texts with equal words are one class; only classes go on, so a group of copies counts once.
2. The n-grams of a set are ordered rarest first, by a count of fixed size over all documents (hashed to counters) and then by hash. Any total order gives
   right results; this one keeps frequent n-grams out of the prefixes. Two sets that reach the threshold share an n-gram of
   their prefixes, the first ``n - ceil(t * n) + 1`` of each.
3. Prefix n-grams that stand in one prefix only join nothing. A bit set of those counted twice or more leaves the others out before the
   wide shuffle. The prefixes counted are longer by a tenth of the set: sets that reach the threshold share as many more n-grams there, so
   a set with fewer shared ones (that meets others by chance) is left out as a whole.
4. Candidates that meet in an n-gram pass the length filter and the positional filter; verification applies the suffix filter
   and counts the rest exactly, once per pair.
5. Pairs come in two rounds. First each document with the leader of its lists, the one with the largest share of its prefix
   in common with others (the original that a family was copied from). Then pairs of different components only. A pair inside
   a component cannot change the components, so no group emits all of its pairs.
6. Texts travel only for verification: those of the classes in a pair are read from the documents again, by a bit set of the classes.

Defined results: a null text counts as empty; a set without words is linked with nothing; fewer words than n are one shingle; ids may repeat
(rows with one id are separate documents with that id) and be null (never the smallest id of a component; null if all are). Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, bit_filter, byte_texts, gram_hashes, in_filter, mix, multipliers, often_hashes, pieces_of, slices_of, whole_text
from tidewright.llm.graph import components
from tidewright.session import cut_lineage

N = 5
#: Links need ``PERCENT`` * union <= 100 * intersection.
PERCENT = 80
LOG2_COUNTERS = 21
BLOCK = 1 << 16
#: Documents compared with one leader in a task.
SLICE = 2000
#: Bytes that are hashed at once.
HASHED = 1 << 18
#: Bits of the set of n-grams that several prefixes share (32 MB).
LOG2_SHARED = 28


@functools.cache
def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, the powers of an odd factor by place, and those of its inverse, all modulo 2**64."""
    factor = int(multipliers(1)[0])
    powers = np.cumprod(np.full(HASHED, factor, np.uint64)), np.cumprod(np.full(HASHED, pow(factor, -1, 1 << 64), np.uint64))
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), *powers


def word_hashes(line: bytes) -> np.ndarray:
    """64-bit hash of each word of a line of words one blank apart: the sum of its bytes' values, each times a power by place, from sums over the whole line."""
    of_byte, powers, inverse = hash_tables()
    out = []
    at = 0
    while at < len(line):
        end = len(line) if len(line) - at <= HASHED else line.rfind(b" ", at, at + HASHED + 1)
        if end < 0:  # one word longer than the tables
            end = line.find(b" ", at)
            end = len(line) if end < 0 else end
            out.append(np.array([xxhash.xxh3_64_intdigest(line[at:end])], np.uint64))
        else:
            block = np.frombuffer(line, np.uint8, end - at, at)
            stops = np.flatnonzero(block == 32)
            starts = np.concatenate([[0], stops + 1])
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(of_byte[block] * powers[: len(block)], out=sums[1:])
            out.append(mix((sums[np.append(stops, len(block))] - sums[starts]) * inverse[starts]))
        at = end + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(line: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct n-gram hashes of a line of words; one for all words if there are fewer than n, none without words."""
    if not line:
        return np.empty(0, np.uint64)
    words = word_hashes(line)
    return np.unique(gram_hashes(words, n) if len(words) >= n else gram_hashes(words, len(words)) + np.uint64(len(words)))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def more(size: int, percent: int = PERCENT) -> int:
    """N-grams by which the counted prefix is longer; it never shrinks with the size."""
    return max(min(size // 10, -(-percent * size // 100) - 1), 0)


def shared_needed(size: int, percent: int = PERCENT) -> int:
    """Shared n-grams in the counted prefix without which no set of any size links.

    The first ``1 + more`` common n-grams of two such sets stand in the counted prefixes of both, by the smaller ``more`` of the two sizes.
    """
    return 1 + more(-(-percent * size // 100), percent)


def lines(texts: list[bytes]) -> list[bytes]:
    """The words of each text one blank apart. bytes.lower and bytes.split know ASCII only: A-Z are lowered, blank and \\t to \\r separate."""
    return [b" ".join(t.lower().split()) for t in texts]


def class_of(line: bytes) -> bytes:
    return hashlib.md5(line).digest()


def classes(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows of two kinds: block null: id, cid (class), n_shingles of a document; else counts of a block of n-gram counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << LOG2_COUNTERS, np.uint32)
        top, kind = np.uint64(64 - LOG2_COUNTERS), pa.null()
        for batch in (part for whole in batches for part in slices_of(whole, 500)):
            kind, texts = batch.column(0).type, byte_texts(batch)
            for part in pieces_of(texts, len, 2_000_000):
                cids, sizes, grams = [], [], []
                for line in lines(texts[part]):
                    own = shingles(line, n)
                    cids.append(class_of(line))
                    sizes.append(len(own))
                    grams.append(own)
                counters += np.bincount((np.concatenate(grams) >> top).astype(np.int64), minlength=len(counters)).astype(np.uint32)
                rows = len(cids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["id", "cid", "n_shingles", "block", "counts"],
                )
        used = [b for b in range(len(counters) // BLOCK) if counters[b * BLOCK : (b + 1) * BLOCK].any()]
        for b in used:
            counts = counters[b * BLOCK : (b + 1) * BLOCK]
            width = "<u2" if counts.max() < 1 << 16 else "<u4"
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([b], pa.int32()), pa.array([counts.astype(width).tobytes()], pa.binary())],
                names=["id", "cid", "n_shingles", "block", "counts"],
            )

    schema = f"id {df.schema[id_col].dataType.simpleString()}, cid binary, n_shingles long, block int, counts binary"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def gram_counts(blocks: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: ``2**LOG2_COUNTERS`` numbers, whatever the input's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, "<u2" if len(counts) == 2 * BLOCK else "<u4")
                sums[block] = sums.get(block, np.zeros(BLOCK, np.uint64)) + own
        yield pa.RecordBatch.from_pydict({"block": pa.array(sums.keys(), pa.int32()), "counts": pa.array([np.minimum(s, 0xFFFFFFFF).astype("<u4").tobytes() for s in sums.values()], pa.binary())})

    total = np.zeros(1 << LOG2_COUNTERS, np.uint32)
    for row in blocks.select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").toArrow().to_pylist():
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], "<u4")
    return total


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """grams (sorted by hash) in the common order: by counter, then by hash. The counter is named by the highest bits, as bit sets go by the lowest."""
    return grams[np.argsort(counts[(grams >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)], kind="stable")]


def each_class(batches: Iterator[pa.RecordBatch], counts: np.ndarray, n: int, percent: int):
    """class, size and counted prefix of each text of a task, equal texts mostly once (the last 100,000 classes are remembered)."""
    seen: set[bytes] = set()
    for batch in (part for whole in batches for part in slices_of(whole, 500)):
        texts = byte_texts(batch)
        for part in pieces_of(texts, len, 2_000_000):
            for line in lines(texts[part]):
                cid = class_of(line)
                if not line or cid in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(cid)
                grams = shingles(line, n)
                yield cid, len(grams), rare_first(grams, counts)[: prefix_length(len(grams), percent) + more(len(grams), percent)]


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection of sets of these sizes that links them."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter on two entries of one n-gram."""
    na, nb, pa_, pb = (F.col(c) for c in (f"{a}.size", f"{b}.size", f"{a}.pos", f"{b}.pos"))
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & (F.least(na - pa_, nb - pb) >= overlap_needed(na, nb, percent))


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b of the pairs that link. Documents paired with one ``a`` are split into slices, each with a copy of a's text."""
    texts = texts_of(pairs, texts)
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    members = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"), "b")
    with_text = members.join(texts.withColumnRenamed("cid", "b"), "b").select("a", "slice", "b", "text")
    leaders = slices.join(texts.withColumnRenamed("cid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("binary").alias("b"), "text")
    rows = with_text.unionByName(leaders).repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in (part for whole in batches for part in slices_of(whole, 500)):
            links = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams = shingles(text, n)
                if b is None:
                    own = grams
                elif links_sets(own, grams, percent):
                    links.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return rows.mapInArrow(run, "a binary, b binary")


def starts(cids: list[bytes]) -> np.ndarray:
    """The first eight bytes of each class as a number."""
    return np.frombuffer(b"".join(c[:8] for c in cids), "<u8")


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """cid, text (its line of words) of the classes in ``pairs``, once each. Other texts are not shuffled."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(starts(batch.column(0).to_pylist()).view(np.int64))], names=["start"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).mapInArrow(numbered, "start long")
    shared_bits = pairs.sparkSession.sparkContext.broadcast(bit_filter(asked, "start"))  # of fixed size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared_bits.value, set()
        for batch in (part for whole in batches for part in slices_of(whole, 500)):
            own = {class_of(line): line for line in lines(byte_texts(batch)) if line}
            cids = list(own)
            wanted = [c for c, w in zip(cids, in_filter(bits, starts(cids)).tolist(), strict=True) if w and c not in seen]
            if len(seen) >= 100_000:
                seen.clear()
            seen.update(wanted)
            if wanted:
                yield pa.RecordBatch.from_pydict({"cid": pa.array(wanted, pa.binary()), "text": pa.array([own[c] for c in wanted], pa.binary())})

    return cut_lineage(texts.mapInArrow(found, "cid binary, text binary"), "texts").dropDuplicates(["cid"])


def links_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold. Suffix filter first: cut at three elements of one, the sets differ at least by
    the differences of their parts' sizes."""
    least = -(-percent * (len(a) + len(b)) // (100 + percent))
    if len(a) >= 16:
        cuts = a[[len(a) // 4, len(a) // 2, 3 * len(a) // 4]]
        ends_a, ends_b = (np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]) for x in (a, b))
        differ = np.abs(np.diff(ends_a) - np.diff(ends_b)).sum()
        if (len(a) + len(b) - differ) // 2 < least:
            return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked_classes(df: DataFrame, counts: np.ndarray, text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """node, component: the classes that link with another."""
    texts = df.select(F.col(text_col).alias("text"))
    shared_counts = df.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        kept, size = [], 0
        for *_, prefix in each_class(batches, shared_counts.value, n, percent):
            kept.append(prefix)
            size += len(prefix)
            if size > 200_000:
                yield np.concatenate(kept)
                kept, size = [], 0
        if kept:
            yield np.concatenate(kept)

    often = often_hashes(texts, prefixes, 2)
    shared_bits = df.sparkSession.sparkContext.broadcast(bit_filter(often, "hash", LOG2_SHARED))  # of fixed size

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared_bits.value
        names = ["cid", "size", "share", "grams", "places"]
        kinds = [pa.binary(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        rows: list[tuple] = []
        for cid, size, prefix in each_class(batches, shared_counts.value, n, percent):
            shared = np.flatnonzero(in_filter(bits, prefix))
            places = shared[shared < prefix_length(size, percent)]
            if len(shared) >= shared_needed(size, percent) and len(places):
                rows.append((cid, size, len(shared) / len(prefix), prefix[places].view(np.int64), places.astype(np.int32)))
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = cut_lineage(texts.mapInArrow(entries, "cid binary, size int, share double, grams array<long>, places array<int>"), "prefixes")
    # Equal classes of different tasks have equal entries.
    listed = found.select("cid", "size", "share", F.explode(F.arrays_zip("grams", "places")).alias("e"))
    listed = listed.select(F.col("e.grams").alias("gram"), F.struct("share", "cid", "size", F.col("e.places").alias("pos")).alias("x"))
    leaders = listed.groupBy("gram").agg(F.max("x").alias("y"), F.min("x.cid").alias("low"), F.max("x.cid").alias("high"))
    several = leaders.filter(F.col("low") != F.col("high")).select("gram", F.struct("y.cid", "y.size", "y.pos").alias("y"))
    met = cut_lineage(listed.select("gram", F.struct("x.cid", "x.size", "x.pos").alias("x")).join(several, "gram"), "met")

    first = met.filter((F.col("x.cid") != F.col("y.cid")) & may_link("x", "y", percent)).select(F.col("y.cid").alias("a"), F.col("x.cid").alias("b"))
    first = cut_lineage(first.distinct(), "pairs")
    links = cut_lineage(verified(first, texts, n, percent), "links")
    parts = cut_lineage(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")

    # Entries of lists that still hold more than one component.
    entry = met.select("gram", F.col("x.cid").alias("node"), "x")
    labelled = entry.join(parts, "node", "left").select("gram", "x", F.coalesce("component", "node").alias("c"))
    open_grams = labelled.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter(F.col("low") != F.col("high")).select("gram")
    left = cut_lineage(labelled.join(open_grams, "gram", "left_semi").distinct(), "open")
    right = left.select("gram", F.col("x").alias("y"), F.col("c").alias("d"))
    second = left.join(right, "gram").filter((F.col("c") < F.col("d")) & may_link("x", "y", percent))
    second = second.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verified(cut_lineage(second.join(done, ["a", "b"], "left_anti"), "pairs"), texts, n, percent)
    return components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))


def placed_documents(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, cid, n_shingles and low (the smallest id that links reach, or the id itself of a set without words)."""
    rows = cut_lineage(classes(df, id_col, text_col, n), "classes")
    docs = rows.filter(F.col("block").isNull()).select("id", "cid", "n_shingles")
    parts = linked_classes(df, gram_counts(rows.filter(F.col("block").isNotNull())), text_col, n, percent)
    placed = docs.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("id", "cid", "n_shingles", F.coalesce("component", "cid").alias("c"))
    placed = cut_lineage(placed, "placed")
    least = placed.filter(F.col("n_shingles") > 0).groupBy("c").agg(F.min("id").alias("low"))
    return placed.join(least, "c", "left").select("id", "cid", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("id")).alias("low"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id_col, n_shingles, component_id (smallest id that links reach)."""
    placed = placed_documents(df, id_col, text_col, n, percent)
    return placed.select(F.col("id").alias(id_col), "n_shingles", F.col("low").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component the row with the smallest id, and every text without words.

    A null id stays where no other id is in its component. Rows that repeat an id and its words share the decision.
    """
    placed = placed_documents(df, id_col, text_col, n, percent)
    gone = placed.filter(~F.col("id").eqNullSafe(F.col("low"))).select(F.col("id").alias("__id"), F.lower(F.hex("cid")).alias("__class")).distinct()
    words = F.trim(F.regexp_replace(ascii_lower(whole_text(text_col)), r"[\x20\x09-\x0D]+", " "))  # the words as ``class_of`` joins them
    same = df[id_col].eqNullSafe(F.col("__id")) & (F.md5(words) == F.col("__class"))
    return df.join(gone, same, "left_anti")
