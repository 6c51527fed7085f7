"""Byte-level BPE: the distinct words of the corpus are folded by Spark, texts are put together from them.

1. Words by chunk. A chunk is a run of rows of one input file, so it names the same rows in every scan. Each chunk gives its
   distinct words.
2. ``fold`` merges the bytes of each distinct word of the corpus by rank with higher-order functions: while any neighbouring pair has a rank, the
   lowest (leftmost if tied) is merged. The ranks are a literal: a table of the pairs whose concatenation has a rank, where one
   look finds a pair.
   Spark also decodes them: the binary pieces of a word's ids one after another. What that gives is kept where it is not the word itself.
3. The words' ids go back to the chunks that hold them, as files by chunk in the shared folder. A task reads the words of its chunks only,
   so what it holds is bounded by a chunk, and texts are never shuffled. A word that is missing there would be merged by the task
   itself, so results do not depend on chunks being cut alike.

A blank before a character that is no white space always starts a word, so tasks split what stands between two blanks once for a chunk. Texts with several blanks in a
row, white space at their end or unusual characters are split as a whole.

Words of more than ``LONG_WORD`` bytes (runs of blanks, encoded data) would make the fold quadratic; tasks merge them with a heap.

Defined results: a null or empty text has no ids; repeated rows are encoded each; the id is only carried along and may be null;
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import chunked, pieces_of, read_chunk, write_by_chunk
from tidewright.llm.tokens import BYTE_LEVEL, UNUSUAL

LONG_WORD = 64
CHUNK_ROWS = 10_000
#: Names of chunks in one row, about.
LISTED_CHUNKS = 50_000
#: An empty place of the table of pairs: no left << 20 is like it in all but the lowest 20 bits.
EMPTY = (1 << 60) - 1


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left, right) -> rank of their concatenation."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


def displaced_pairs(pairs: dict[tuple[int, int], int], ids: int) -> tuple[list[int], list[int]]:
    """The pairs in one table without collisions: pair (left, right) is at shift[left] + right, as left << 20 | rank; an empty place holds ``EMPTY``.

    Each left takes a random shift at which all of its rights fall on empty places, those with most rights first, while the table is
    emptiest.
    """
    rights: dict[int, list[int]] = {}
    for left, right in pairs:
        rights.setdefault(left, []).append(right)
    rng, size = np.random.default_rng(8), 4 * max(len(pairs), 1) + ids
    taken, slots, shift = np.zeros(size, bool), np.full(size, EMPTY), [0] * ids
    for left, own in sorted(rights.items(), key=lambda x: (-len(x[1]), x[0])):
        places = np.array(own)
        fits = np.empty(0, np.int64)
        while not len(fits):
            tries = rng.integers(0, size - ids, 64)
            fits = tries[~taken[tries[:, None] + places].any(axis=1)]
        shift[left] = int(fits[0])
        taken[shift[left] + places] = True
        slots[shift[left] + places] = [left << 20 | pairs[left, right] for right in own]
    return shift, slots.tolist()


def numbers(values: list[int], kind: str = "int") -> Column:
    """A literal array; as one string it is a single value for the planner."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def fold(word_bytes: Column, ranks: dict[bytes, int]) -> Column:
    """ids (array<int>) of a word given as the array of its bytes (0 to 255)."""
    edge = max(ranks.values()) + 1  # stands before the first byte and after the last, and merges with nothing
    shift, slots = displaced_pairs(rank_pairs(ranks), edge)
    tables = F.struct(numbers([*shift, 0], "bigint").alias("shift"), numbers(slots, "bigint").alias("slots"))
    of_byte = numbers([ranks[bytes([b])] for b in range(256)], "bigint")
    none, edges = F.lit(1 << 20), F.array(F.lit(edge).cast("bigint"))

    # An expression that a lambda binds is evaluated once; written twice, it is evaluated twice.
    def bound(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def merged(tables: Column, left: Column, right: Column) -> Column:
        """Rank of the pair, or ``none`` and more: what is left of a slot of ``left`` is its rank."""
        return F.get(tables["slots"], F.get(tables["shift"], left) + right).bitwiseXOR(F.shiftleft(left, 20))

    def between(tables: Column, parts: Column) -> Column:
        """Rank of each neighbouring pair; there are at least two parts."""
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: merged(tables, F.element_at(parts, i), F.element_at(parts, i + 1)))

    def merge_at(tables: Column, parts: Column, low: Column, at: Column, pairs: Column) -> Column:
        around = F.array(merged(tables, F.element_at(parts, at - 1), low), merged(tables, low, F.element_at(parts, at + 2)))
        n = F.size(parts)
        return F.struct(
            F.concat(F.slice(parts, 1, at - 1), F.array(low), F.slice(parts, at + 2, n)).alias("parts"),
            F.concat(F.slice(pairs, 1, at - 2), around, F.slice(pairs, at + 2, n)).alias("pairs"),
        )

    def step(tables: Column, state: Column) -> Column:
        parts, pairs = state["parts"], state["pairs"]
        merging = lambda low: bound(F.array_position(pairs, low).cast("int"), lambda at: merge_at(tables, parts, low, at, pairs))
        return bound(F.array_min(pairs), lambda low: F.when(low < none, merging(low)).otherwise(state))

    def word(tables: Column) -> Column:
        start = F.concat(edges, F.transform(word_bytes, lambda b: F.get(of_byte, b)), edges)
        begun = bound(start, lambda p: F.struct(p.alias("parts"), between(tables, p).alias("pairs")))
        steps = F.sequence(F.lit(2), F.size(word_bytes))
        return F.aggregate(steps, begun, lambda state, _: step(tables, state), lambda state: F.slice(state["parts"], 2, F.size(state["parts"]) - 2))

    # Bound once by a lambda, the table is in the plan once.
    many = bound(tables, word)
    return F.when(F.size(word_bytes) > 1, many).otherwise(F.transform(word_bytes, lambda b: F.get(of_byte, b))).cast("array<int>")


def bytes_of(word: Column) -> Column:
    """The bytes of a binary column as numbers."""
    return F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), F.ascii)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for long words: n log n."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def candidate(i: int):
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n):
        candidate(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop):
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        candidate(i)
        if before[i] >= 0:
            candidate(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Splitter:
    """Words of texts by the public pattern; the slower general form only where a text needs it."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)

    def words(self, text: str) -> list[str]:
        return (self.pattern if UNUSUAL.search(text) else BYTE_LEVEL).findall(text)

    @staticmethod
    def pieces(text: str) -> list[str] | None:
        """What stands between blanks; None for a text that is to be split as a whole."""
        if "  " in text or text[-1:].isspace() or UNUSUAL.search(text):
            return None
        return text.split(" ")


def word_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """chunks, word (binary), ids and decoded (null where it is the word) of the distinct words of chunks; long words are left out.

    A word that very many chunks hold comes in several rows, each with a bounded list of chunks.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen, pieces, current = Splitter(pattern), set(), set(), None

        def out() -> pa.RecordBatch:
            if pieces:
                seen.update(BYTE_LEVEL.findall(" " + " ".join(pieces)))
            words = [w for w in (w.encode() for w in seen) if len(w) <= LONG_WORD]
            return pa.RecordBatch.from_pydict({"chunk": pa.array([current] * len(words), pa.string()), "word": pa.array(words, pa.binary())})

        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk != current and (seen or pieces):
                    yield out()
                    seen, pieces = set(), set()
                current = chunk
                own = splitter.pieces(text or "")
                if own is None:
                    seen.update(splitter.words(text))
                else:
                    seen.update(BYTE_LEVEL.findall(own[0]))
                    pieces.update(own[1:])
        if seen or pieces:
            yield out()

    found = docs.select("chunk", "text").mapInArrow(distinct, "chunk string, word binary")
    blocks = -(-docs.agg(F.approx_count_distinct("chunk")).first()[0] // LISTED_CHUNKS) or 1
    listed = found.groupBy("word", F.pmod(F.xxhash64("chunk"), F.lit(blocks)).alias("block")).agg(F.collect_set("chunk").alias("chunks"))
    folded = listed.select("word", fold(bytes_of(F.col("word")), ranks).alias("ids"), "chunks")
    # A column of its own first: used twice in one expression it would be made twice.
    decoded = folded.withColumn("decoded", joined_pieces("ids", ranks))
    return decoded.select("word", "ids", F.when(F.col("decoded") != F.col("word"), F.col("decoded")).alias("decoded"), "chunks")


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``df``: id_col, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids (array) and decoded (binary)."""
    spark, ranks = df.sparkSession, rank_table(ranks_path)
    docs = chunked(df, {"id": F.col(id_col), "text": F.col(text_col)}, CHUNK_ROWS)
    # In one projection with the explode, the ids would be joined for each chunk of a word.
    spelled = word_ids(docs, ranks, pattern).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))
    root = write_by_chunk(spelled.select(F.explode("chunks").alias("chunk"), "word", "ids", "decoded"), "words")
    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep
    shared = spark.sparkContext.broadcast(ranks)  # a fixed file of 50,000 ranks

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, splitter = shared.value, Splitter(pattern)
        pieces = {rank: token for token, rank in ranks.items()}
        known, between, current = None, None, None
        for batch in batches:
            docs, chunks, texts = (batch.column(k).to_pylist() for k in ("id", "chunk", "text"))
            for part in pieces_of(docs, lambda _: 1, 2000):
                counts, shas, decoded_shas, all_ids, all_decoded = [], [], [], [], []
                for chunk, text in zip(chunks[part], texts[part], strict=True):
                    if chunk != current:
                        known = WordIds(root, chunk, ranks, pieces)
                        between, current = PieceIds(known), chunk
                    text = text or ""
                    own = splitter.pieces(text)
                    if own is None:
                        found = known.joined(splitter.words(text), text)
                    else:
                        found = between.joined(own, text)
                    decimal, decoded = found[0], text.encode() if found[1] is None else found[1]
                    counts.append(decimal.count(" ") + 1 if decimal else 0)
                    shas.append(hashlib.sha256(decimal.encode()).hexdigest())
                    decoded_shas.append(hashlib.sha256(decoded).hexdigest())
                    if keep:
                        all_ids.append(list(map(int, decimal.split())))
                        all_decoded.append(decoded)
                columns = {
                    "id": pa.array(docs[part], batch.column("id").type),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(shas, pa.string()),
                    "decoded_sha256": pa.array(decoded_shas, pa.string()),
                }
                if keep:
                    columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_decoded, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(build, schema).withColumnRenamed("id", id_col)


def joined(parts: list[tuple[str, bytes | None]], spelled, text: str) -> tuple[str, bytes | None]:
    """(ids in decimal, decoded bytes or None where they are those of ``text``) of parts one after another; ``spelled(k)`` is the k-th part's own text."""
    decimal = " ".join([ids for ids, _ in parts if ids])
    if all(decoded is None for _, decoded in parts):
        return decimal, None
    decoded = b"".join(spelled(k).encode() if own is None else own for k, (_, own) in enumerate(parts))
    return decimal, None if decoded == text.encode() else decoded


class WordIds(dict):
    """word -> its ids in decimal, one blank apart, and its decoded bytes (None: those of the word), for one chunk; other words are merged when they come."""

    def __init__(self, root: str, chunk: str, ranks: dict[bytes, int], pieces: dict[int, bytes]):
        super().__init__()
        self.ranks, self.pieces = ranks, pieces
        for table in read_chunk(root, chunk):
            decoded = table.column("decoded")
            decoded = repeat(None) if decoded.null_count == len(decoded) else decoded.to_pylist()
            self.update(zip(table.column("word").cast(pa.string()).to_pylist(), zip(table.column("ids").to_pylist(), decoded)))

    def __missing__(self, word: str) -> tuple[str, bytes | None]:
        merged = merge_long(word.encode(), self.ranks)
        decoded = b"".join(map(self.pieces.__getitem__, merged))
        return " ".join(map(str, merged)), None if decoded == word.encode() else decoded

    def joined(self, words: list[str], text: str) -> tuple[str, bytes | None]:
        return joined([self[w] for w in words], words.__getitem__, text)


class PieceIds(dict):
    """What stands between two blanks -> ids of its words in decimal, the blank in front among them. ``other`` has the decoded bytes of those that are not
    decoded to themselves."""

    def __init__(self, words: WordIds):
        super().__init__()
        self.words, self.other = words, {}

    def __missing__(self, piece: str) -> str:
        spelled = " " + piece
        # Most are one word, which is known as such.
        ids, decoded = self.words[spelled] if spelled in self.words else self.words.joined(BYTE_LEVEL.findall(spelled), spelled)
        if decoded is not None:
            self.other[piece] = decoded
        self[piece] = ids
        return ids

    def joined(self, own: list[str], text: str) -> tuple[str, bytes | None]:
        """ids and decoded bytes (None: those of the text) of a text in pieces."""
        first, decoded = self.words.joined(BYTE_LEVEL.findall(own[0]), own[0])
        after = map(self.__getitem__, own[1:])
        decimal = " ".join([first, *after] if first else after)
        if decoded is None and not self.other:
            return decimal, None
        spelled = [own[0].encode() if decoded is None else decoded, *((" " + p).encode() if (o := self.other.get(p)) is None else o for p in own[1:])]
        whole = b"".join(spelled)
        return decimal, None if whole == text.encode() else whole


def joined_pieces(ids_col: str, ranks: dict[bytes, int]) -> Column:
    """The binary pieces of an array of ids one after another."""
    pieces = F.split(F.lit(",".join(p.hex() for p, _ in sorted(ranks.items(), key=lambda x: x[1]))), ",")
    spelled = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(F.col(ids_col), lambda i: F.get(p, i)), ""))
    return F.unhex(F.element_at(spelled, 1))


def decode(ids: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``ids`` with a column decoded (binary): the pieces of its ids one after another; null ids give null, no ids empty bytes."""
    return ids.withColumn("decoded", joined_pieces(ids_col, rank_table(ranks_path)))
