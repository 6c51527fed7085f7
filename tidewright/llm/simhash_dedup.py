"""Near duplicates by SimHash, found with fuzzy hash keys of the binary Golay code.

Fingerprint: bit i of 64 is set where over half of a text's word shingles (repeats count) have it set in their XXH64 with seed 42.

The perfect (23, 12, 7) code puts every 23-bit word within three bits of exactly one codeword. The *keys* of a word are the 12-bit indices of the codewords that
the word itself and the words one bit away decode to: one to six of them. Two words at most two bits apart have a word between
them that is at most one bit from either, so they share a key.

A fingerprint is cut into three segments (shorter ones are filled up with zeros). Up to four differing bits lie in them in one of two ways:

* one segment has none. The other two share at most four, so one has at most two: the first segment as it is and a key of the other agree
  (six tables, one for each ordered pair of segments);
* every segment has one or two, and at most one has two. Say X may have two, Y and Z have one: then X shares a key, the index that one side's Y decodes to is
  a key of the other's Y, and the other way round for Z. So one side has the triple in X keys * Y keys * Z index, the other in X keys * Y index * Z keys
  (one table of triples; a fingerprint takes all three sets of this form).

Each table row is one 64-bit number, about 80 to a fingerprint. Numbers that only one fingerprint has join nothing and a bit set of fixed size leaves
most of them out before the wide shuffle. Rows that share a number are compared in one task and give a spanning forest of their links, never all pairs;
the members of a number that very many share are cut into slices, and each two slices meet in a task of their own.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and links like any other; fewer words than n are one shingle; ids may
repeat and be null (never the smallest id of a component; null if all are). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bit_filter, byte_texts, in_filter, pieces_of
from tidewright.llm.graph import components
from tidewright.session import cut_lineage

N = 4
SEED = 42
#: Most differing bits of linked fingerprints; the tables above are made for it.
NEAR = 4
#: Generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101
LENGTH, CHECK = 23, 11
#: Bits of the segments, lowest first.
WIDTHS = (22, 21, 21)
MOST_KEYS = 6
#: Members of a number that meet in one task; more are cut into slices of about this size.
SLICE = 8192
#: Fingerprints whose table rows one task makes and counts, some 80 to a fingerprint. A task by the bytes of a file would make millions of rows.
PRINTS = 10_000


# --- fingerprints


def shingle_hashes(words: list[bytes], n: int = N) -> np.ndarray:
    """XXH64 of each run of n words joined by a blank; of all words if there are fewer, none without words."""
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - n] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 64 bytes a hash
        block = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, n: int = N) -> int:
    """bytes.lower and bytes.split know ASCII only: A-Z are lowered, blank and \\t to \\r separate."""
    return majority(shingle_hashes(text.lower().split(), n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """id, print (64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch)
            for part in pieces_of(texts, len, 4_000_000):
                prints = np.fromiter((fingerprint(t, n) for t in texts[part]), np.uint64, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(prints.view(np.int64))], names=["id", "print"])

    schema = f"id {df.schema[id_col].dataType.simpleString()}, print long"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# --- the code


def syndrome(word: int) -> int:
    """Remainder of the word by the generator, both polynomials over two elements."""
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit; error (at most three bits) of each syndrome."""
    of_bit = np.array([syndrome(1 << b) for b in range(LENGTH)], np.int64)
    errors = np.zeros(1 << CHECK, np.int64)
    for a in range(LENGTH):
        errors[of_bit[a]] = 1 << a
        for b in range(a):
            errors[of_bit[a] ^ of_bit[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[of_bit[a] ^ of_bit[b] ^ of_bit[c]] = 1 << a | 1 << b | 1 << c
    return of_bit, errors


def indices(words: np.ndarray, syndromes: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword next to each word: its upper bits, as the code is systematic."""
    return (words ^ tables()[1][syndromes]) >> CHECK


def keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word, and its keys as rows of MOST_KEYS places, ascending, -1 where there are fewer.

    Words of ``width`` bits can differ in these only, so no other bit is turned.
    """
    of_bit, _ = tables()
    own = np.zeros(len(words), np.int64)
    for b in range(width):
        own ^= np.where(words >> b & 1, of_bit[b], 0)
    index = indices(words, own)
    around = np.stack([index, *(indices(words ^ (1 << b), own ^ of_bit[b]) for b in range(width))], axis=1)
    around.sort(axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    around.sort(axis=1)
    return index, around[:, -MOST_KEYS:]


def numbers(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``prints``, number) for each row of the tables, without repeats."""
    words, found, at = [], [], 0
    for width in WIDTHS:
        words.append((prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1))
        at += width
    index, keyed = zip(*(keys(w, width) for w, width in zip(words, WIDTHS, strict=True)), strict=True)
    table = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                found.append(np.where(keyed[y] >= 0, table << 59 | words[x][:, None] << 12 | keyed[y], -1))
                table += 1
    for single in range(3):
        parts = [index[s][:, None] if s == single else keyed[s] for s in range(3)]
        a, b, c = parts[0][:, :, None, None], parts[1][:, None, :, None], parts[2][:, None, None, :]
        triples = np.where((a >= 0) & (b >= 0) & (c >= 0), table << 59 | a << 24 | b << 12 | c, -1)
        found.append(triples.reshape(len(prints), -1))
    rows = np.sort(np.concatenate(found, axis=1), axis=1)
    fresh = rows >= 0
    fresh[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    return np.nonzero(fresh)[0], rows[fresh]


# --- search


def forest(prints: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the distinct ``prints`` as all their links would, at most len(prints) - 1."""
    left, us, vs = prints, [], []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            met = np.bitwise_count(left ^ one) <= near
            if met.any():
                found = left[met]
                us.append(np.full(len(found), one))
                vs.append(found)
                reached.extend(found)
                left = left[~met]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def spread_prints(prints: DataFrame, rows: int = PRINTS) -> DataFrame:
    """print of the distinct ``prints``, about ``rows`` to a task."""
    return prints.select("print").repartition(1 + prints.count() // rows, "print")


def table_rows(prints: DataFrame, kept=None) -> DataFrame:
    """number, print of each table row of the distinct ``prints`` that ``kept`` (a broadcast bit set) may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(everything), 2000):
                block = everything[at : at + 2000]
                places, found = numbers(block)
                if kept is not None:
                    likely = in_filter(kept.value, folded(found))
                    places, found = places[likely], found[likely]
                yield pa.RecordBatch.from_pydict({"number": pa.array(found), "print": pa.array(block[places].view(np.int64))})

    return prints.select("print").mapInArrow(run, "number long, print long")


def folded(found: np.ndarray) -> np.ndarray:
    """The bit set takes the low 26 bits, so all bits are put there."""
    return (found ^ (found >> 26) ^ (found >> 52)).view(np.uint64)


FOLDED = "number ^ shiftrightunsigned(number, 26) ^ shiftrightunsigned(number, 52)"


def links(prints: DataFrame, near: int = NEAR, slice_rows: int = SLICE) -> DataFrame:
    """u, v: a forest of links for each number that several of the distinct ``prints`` share."""
    spark, prints = prints.sparkSession, spread_prints(prints)
    often = cut_lineage(table_rows(prints).groupBy("number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "numbers")
    kept = spark.sparkContext.broadcast(bit_filter(often.selectExpr(f"{FOLDED} AS hash"), "hash"))  # of fixed size
    rows = table_rows(prints, kept)
    large = often.filter(F.col("n") > slice_rows).select("number", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    if large.isEmpty():
        dealt = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:  # not hinted: the optimizer broadcasts the list while it is small
        cut = rows.join(large, "number", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("print"), "slices"), F.lit(0)).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("other")
        cut = cut.select("number", "print", "slice", other)
        dealt = cut.select("number", "print", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"))
    dealt = dealt.repartition("number", "i", "j").sortWithinPartitions("number", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], None

        def end():
            u, v = forest(np.unique(np.concatenate(held)), near)
            return pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("number", "i", "j")]
            values = batch.column("print").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            us, vs = [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
                here = tuple(int(x[a]) for x in names) if len(values) else place
                if here != place and held:
                    yield end()
                    held = []
                place = here
                if a == 0 or b == len(values):  # may go on in another batch
                    held.append(values[a:b].copy())
                elif b - a > 1:
                    u, v = forest(np.unique(values[a:b]), near)
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us).view(np.int64)), "v": pa.array(np.concatenate(vs).view(np.int64))})
        if held:
            yield end()

    return dealt.mapInArrow(run, "u long, v long")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, near: int = NEAR, slice_rows: int = SLICE) -> DataFrame:
    """One row per row of ``df``: id_col, fingerprint (16 hexadecimal digits), component_id (smallest id that links reach)."""
    if not 0 <= near <= NEAR:
        raise ValueError(f"near must be 0 to {NEAR}: the tables find no more differing bits")
    rows = cut_lineage(fingerprints(df, id_col, text_col, n), "prints")
    prints = cut_lineage(rows.groupBy("print").agg(F.min("id").alias("low")), "distinct-prints")
    parts = components(cut_lineage(links(prints, near, slice_rows).distinct(), "links"))
    placed = prints.join(parts.withColumnRenamed("node", "print"), "print", "left").select("print", "low", F.coalesce("component", "print").alias("c"))
    placed = cut_lineage(placed, "placed")
    least = placed.groupBy("c").agg(F.min("low").alias("component_id"))
    of_print = placed.join(least, "c").select("print", "component_id")
    hexadecimal = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(of_print, "print").select(F.col("id").alias(id_col), hexadecimal, "component_id")
