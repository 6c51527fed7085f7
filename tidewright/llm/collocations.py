"""Phrase collocations from weighted acyclic automata of n-gram counts.

Texts are lowered (A-Z), split into pieces at punctuation and line ends, and pieces into words. All counts are by group (a language).

0. Texts are split into words once and stored as 32-bit word codes, a row per text, so that no batch of rows is large; a code that two words share lets more through in the next step, never less.
1. Length by length, 1 to ``MOST_WORDS``, 64-bit hashes of phrases (made of the codes) are counted. A phrase can reach ``least`` occurrences only if the phrases without its last and without its
   first word do, so only such are counted. The hashes that reach ``least`` go into a bit set of fixed size for each length (it lets too much through, never too little).
2. Then each task spells out and counts, exactly, the phrases that the bit sets let through, sorts them and adds them, in order, to acyclic automata over words (:class:`Builder`): a path is
   a phrase, the weights on it add up to its count, states with the same continuations are one. It makes an automaton for each range of phrases, from bounds that
   are the same for all tasks.
3. The automata of a range meet in one task, which adds them up and makes one automaton of the phrases that reach ``least``.
4. Each way of cutting a phrase in two asks the automata of the ranges its parts lie in for their counts. Ranges with very many questions are asked in slices.
5. The rest is columns: the score of each cut by exact integers, the lowest of a phrase, phrases that a longer one of the same count covers go, the best of
   each group stay.

The bounds of the ranges come from words of about ``SAMPLE_ROWS`` rows, as those of any range shuffle do; they decide who counts a phrase, never what is counted.

Defined results: a null text counts as empty, a null group as ``und``. Groups without a phrase that reaches ``least`` are not there. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import LOWER, UPPER, bit_filter, byte_texts, in_filter, in_parts, mix, multipliers, often_hashes
from tidewright.session import cut_lineage

MOST_WORDS = 5
LEAST = 100
TOP = 2000
NO_GROUP = "und"
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_KEYS = 2000, 8, 20_000
#: Ranges for each shuffle partition.
RANGES = 2
#: Hashes, and phrases, that a task holds before it passes them on.
HASHES, HELD = 3_000_000, 400_000
#: Questions to one range that meet in one task.
SLICE = 100_000
BREAK = b"\n"
#: A-Z to a-z, punctuation and line ends to one line end, tab to blank.
LOWERED = bytes.maketrans(UPPER.encode() + b".,;:!?\x0a\x0b\x0c\x0d\t", LOWER.encode() + BREAK * 10 + b" ")


# --- automata


class Builder:
    """A minimal acyclic automaton of keys (tuples) with weights, from keys in ascending order.

    The states of the last key's path are open. A new key closes those it doesn't share: a closed state that equals an earlier one is that one. On the
    shared path arcs keep the smaller weight and hand the rest on, so equal continuations stay equal.
    """

    def __init__(self):
        self.closed: dict[tuple, int] = {}
        self.open: list[list] = [[-1, []]]
        self.last: tuple = ()

    def add(self, key: tuple, weight: int) -> None:
        shared = 0
        for a, b in zip(key, self.last, strict=False):
            if a != b:
                break
            shared += 1
        self._close(shared)
        for depth in range(shared):
            arc = self.open[depth][1][-1]
            if arc[1] > weight:
                self._hand_on(self.open[depth + 1], arc[1] - weight)
                arc[1] = weight
            weight -= arc[1]
        for depth in range(shared, len(key)):
            self.open[depth][1].append([key[depth], weight, -1])
            self.open.append([-1, []])
            weight = 0
        self.open[-1][0] = weight
        self.last = key

    @staticmethod
    def _hand_on(state: list, weight: int) -> None:
        if state[0] >= 0:
            state[0] += weight
        for arc in state[1]:
            arc[1] += weight

    def _close(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            final, arcs = self.open.pop()
            state = (final, tuple(map(tuple, arcs)))
            self.open[-1][1][-1][2] = self.closed.setdefault(state, len(self.closed))

    def finish(self) -> bytes:
        """All states, the first one last."""
        self._close(0)
        final, arcs = self.open[0]
        states = [*self.closed, (final, tuple(map(tuple, arcs)))]
        symbols: dict = {}
        flat = [(symbols.setdefault(s, len(symbols)), w, t) for _, own in states for s, w, t in own]
        numbers = np.array(flat, np.int64).reshape(-1, 3)
        ends = np.array([(f, len(own)) for f, own in states], np.int64)
        return pickle.dumps((list(symbols), numbers[:, 0].astype(np.int32).tobytes(), numbers[:, 1].tobytes(), numbers[:, 2].astype(np.int32).tobytes(), ends.tobytes()))


class Automaton:
    def __init__(self, data: bytes):
        self.symbols, which, weights, targets, ends = pickle.loads(data)
        ends = np.frombuffer(ends, np.int64).reshape(-1, 2)
        self.which, self.weights, self.targets = np.frombuffer(which, np.int32).tolist(), np.frombuffer(weights, np.int64).tolist(), np.frombuffer(targets, np.int32).tolist()
        self.finals, self.stops = ends[:, 0].tolist(), np.cumsum(ends[:, 1]).tolist()
        self.steps: dict[int, dict] = {}

    def arcs(self, state: int) -> range:
        return range(self.stops[state - 1] if state else 0, self.stops[state])

    def paths(self) -> Iterator[tuple[tuple, int]]:
        """All keys and weights, ascending."""
        stack = [((), 0, len(self.finals) - 1)]
        while stack:
            key, weight, state = stack.pop()
            if self.finals[state] >= 0:
                yield key, weight + self.finals[state]
            for a in reversed(self.arcs(state)):
                stack.append(((*key, self.symbols[self.which[a]]), weight + self.weights[a], self.targets[a]))

    def weight(self, key: tuple) -> int | None:
        """The weight of one key, None if it isn't there."""
        total, state = 0, len(self.finals) - 1
        for symbol in key:
            if state not in self.steps:
                self.steps[state] = {self.symbols[self.which[a]]: a for a in self.arcs(state)}
            arc = self.steps[state].get(symbol)
            if arc is None:
                return None
            total, state = total + self.weights[arc], self.targets[arc]
        return total + self.finals[state] if self.finals[state] >= 0 else None


def automaton_of(weights: dict[tuple, int]) -> bytes:
    builder = Builder()
    for key in sorted(weights):
        builder.add(key, weights[key])
    return builder.finish()


def by_range(weights: dict[tuple, int], bounds: list[tuple]) -> Iterator[tuple[int, bytes]]:
    """(range, automaton) of the keys in each range: range r holds keys from bounds[r - 1] up to but without bounds[r]."""
    keys, start = sorted(weights), 0
    for r, bound in enumerate([*bounds, None]):
        end = len(keys) if bound is None else bisect_left(keys, bound, start)
        if end > start:
            builder = Builder()
            for key in keys[start:end]:
                builder.add(key, weights[key])
            yield r, builder.finish()
        start = end


# --- words


def word_code(word: bytes) -> int:
    """A 32-bit code of a word, 2 or more."""
    return max(xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF, 2)


class WordCodes(dict):
    """word -> 32-bit code: 0 for nothing, 1 for a break, else of the word's hash; remembered for up to ``limit`` words at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__({b"": 0, BREAK: 1})
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update({b"": 0, BREAK: 1})
        code = self[word] = word_code(word)
        return code


class WordNumbers(dict):
    """word -> number: 0 for nothing, 1 for a break, then as they come."""

    def __init__(self):
        super().__init__({b"": 0, BREAK: 1})
        self.names = [b"", BREAK]

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = len(self.names) - 1
        return self[word]


def split_words(text: bytes) -> list[bytes]:
    """Words, breaks and empty words of a text."""
    return text.translate(LOWERED).replace(BREAK, b" \n ").split(b" ")


def grouped_texts(batch: pa.RecordBatch, limit: int = 2_000_000, column: str = "text") -> Iterator[tuple[bytes, list[bytes]]]:
    """(group, texts) in pieces of about ``limit`` bytes; only a piece's texts are Python objects."""
    for part in in_parts(iter([batch]), column, limit):
        own: dict[bytes, list[bytes]] = {}
        for group, text in zip(byte_texts(part, "name"), byte_texts(part, column), strict=True):
            own.setdefault(group, []).append(text)
        yield from own.items()


def group_hash(group: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(group, 7))


def phrase_hashes(columns: list[np.ndarray], group: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of each row of word hashes."""
    total = np.zeros(len(columns[0]), np.uint64)
    for words, factor in zip(columns, multipliers(len(columns)), strict=True):
        total += words * factor
    return mix(total ^ group)


class Words:
    """The words of texts as numbers, remembered from piece to piece up to a limit, and their codes."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.numbers, self.of_number = WordNumbers(), np.arange(2, dtype=np.uint32)  # nothing and a break are their own codes

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, with breaks between texts, and their codes."""
        if len(self.numbers) > self.limit:
            self.numbers, self.of_number = WordNumbers(), np.arange(2, dtype=np.uint32)
        words = split_words(BREAK.join(texts))
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        found = found[found > 0]
        names = self.numbers.names
        if len(self.of_number) < len(names):
            fresh = names[len(self.of_number) :]
            self.of_number = np.concatenate([self.of_number, np.fromiter(map(word_code, fresh), np.uint32, len(fresh))])
        return found, self.of_number[found]


def runs(codes: np.ndarray, k: int, group: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """At each place: the hash of the run of k words that starts there, and whether no break lies in it."""
    size = max(len(codes) - k + 1, 0)
    whole = np.ones(size, bool)
    for j in range(k):
        whole &= codes[j : j + size] > 1
    return phrase_hashes([codes[j : j + size] for j in range(k)], group), whole


def likely_runs(codes: np.ndarray, k: int, group: np.uint64, kept) -> np.ndarray:
    """Places of the runs of k words whose first and last k - 1 words may be frequent."""
    if k == 1:
        return np.flatnonzero(codes > 1)
    found, whole = runs(codes, k - 1, group)
    likely = whole & in_filter(kept, found)
    return np.flatnonzero(likely[:-1] & likely[1:])


def counted_runs(numbers: np.ndarray, codes: np.ndarray, k: int, group: np.uint64, kept) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct runs of k words that may be frequent, as columns of word numbers, and their counts.

    Equal phrases have equal hashes; phrases are told apart by their words, so a chance meeting of hashes only splits a count.
    """
    found, whole = runs(codes, k, group)
    at = np.flatnonzero(whole & in_filter(kept, found))
    if not len(at):
        return [at] * k, at
    at = at[np.argsort(found[at])]
    columns = [numbers[at + j] for j in range(k)]
    starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return [c[starts] for c in columns], np.diff(np.append(starts, len(at)))


# --- counting


def named(df: DataFrame, text_col: str, group_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(group_col).cast("string"), F.lit(NO_GROUP)).alias("name"), F.col(text_col).alias("text"))


def range_bounds(texts: DataFrame, ranges: int) -> list[tuple]:
    """Bounds that cut the phrases of a few rows into even ranges: at most ``ranges`` - 1 keys, from at most SAMPLE_KEYS."""
    every = max(1, texts.count() // SAMPLE_ROWS)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group, text in zip(byte_texts(batch, "name"), byte_texts(batch), strict=True):
                words = [w for w in split_words(text) if w and w != BREAK]
                for at in range(0, len(words), max(1, len(words) // SAMPLE_WORDS)):
                    out.append([group, *words[at : at + MOST_WORDS]])
            yield pa.RecordBatch.from_pydict({"key": pa.array(out, pa.list_(pa.binary()))})

    rows = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(some, "key array<binary>").limit(SAMPLE_KEYS).toArrow()
    keys = sorted(map(tuple, rows.column("key").to_pylist()))
    return sorted({keys[len(keys) * r // ranges] for r in range(1, ranges)} if keys else set())


def coded(texts: DataFrame) -> DataFrame:
    """name, codes (of the words of a text of the group, with breaks, one at the end; four bytes a word) and their number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for group, own in grouped_texts(batch, 1_000_000):
                lines, sizes = [], []
                for text in own:
                    words = split_words(text + BREAK)
                    codes = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                    codes = codes[codes > 0]
                    lines.append(codes.astype("<u4").tobytes())
                    sizes.append(int((codes > 1).sum()))
                yield pa.RecordBatch.from_pydict({"name": pa.array([group] * len(own), pa.binary()), "codes": pa.array(lines, pa.binary()), "words": pa.array(sizes, pa.int64())})

    return cut_lineage(texts.mapInArrow(run, "name binary, codes binary, words long"), "words")


def often_runs(words: DataFrame, k: int, kept, least: int) -> DataFrame:
    """hash of the phrases of k words with ``least`` occurrences or more (and of any that share a hash); ``kept`` is the bit set of k - 1 words."""

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for group, own in grouped_texts(batch, 1_000_000, "codes"):
                code, codes = group_hash(group), np.frombuffer(b"".join(own), "<u4")
                at = likely_runs(codes, k, code, None if k == 1 else kept.value)
                yield phrase_hashes([codes[at + j] for j in range(k)], code)

    return cut_lineage(often_hashes(words.select("name", "codes"), hashes_of, least, HASHES), f"often-{k}")


def shard_automata(texts: DataFrame, kept: list, bounds: list[tuple]) -> DataFrame:
    """range, data (an automaton) of the phrases that each task has counted, of 1 to len(kept) words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: dict[tuple, int] = {}

        def flush():
            for r, data in by_range(held, bounds):
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "data": pa.array([data], pa.binary())})
            held.clear()

        for batch in batches:
            for group, own in grouped_texts(batch):
                numbers, codes = words.read(own)
                for k, bits in enumerate(kept, 1):
                    columns, counts = counted_runs(numbers, codes, k, group_hash(group), bits.value)
                    spelled = [[words.numbers.names[i] for i in c.tolist()] for c in columns]
                    for *phrase, n in zip(*spelled, counts.tolist(), strict=True):
                        key = (group, *phrase)
                        held[key] = held.get(key, 0) + n
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "range int, data binary")


def united(shards: DataFrame, least: int) -> DataFrame:
    """The automaton of each range (range, data) and the phrases in it (name, phrase, k, a)."""
    fields = {"range": pa.int32(), "data": pa.binary(), "name": pa.binary(), "phrase": pa.binary(), "k": pa.int32(), "a": pa.int64()}

    def rows(n: int, **known) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known[f], t) if f in known else pa.nulls(n, t) for f, t in fields.items()], names=list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        own = None

        def finish():
            often = {key: n for key, n in held.items() if n >= least}
            if often:
                yield rows(1, range=[own], data=[automaton_of(often)])
                keys = sorted(often)
                for at in range(0, len(keys), 10_000):
                    part = keys[at : at + 10_000]
                    yield rows(len(part), name=[key[0] for key in part], phrase=[b" ".join(key[1:]) for key in part], k=[len(key) - 1 for key in part], a=[often[key] for key in part])

        for batch in batches:
            for r, data in zip(batch.column("range").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if r != own:
                    yield from finish()
                    held, own = {}, r
                for key, n in Automaton(data).paths():
                    held[key] = held.get(key, 0) + n
        yield from finish()

    met = shards.repartition("range").sortWithinPartitions("range")
    return met.mapInArrow(run, "range int, data binary, name binary, phrase binary, k int, a long")


# --- scoring


def part_counts(phrases: DataFrame, automata: DataFrame, bounds: list[tuple], slice_rows: int = SLICE) -> DataFrame:
    """name, phrase, cut, l, r: counts of the first ``cut`` words and of the rest, for each way of cutting a phrase of several words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = phrase.split(b" ")
                for cut in range(1, len(words)):
                    for first, part in ((True, words[:cut]), (False, words[cut:])):
                        out.append((bisect_right(bounds, (name, *part)), name, phrase, cut, first, b" ".join(part)))
            if out:
                ranges, *rest = zip(*out, strict=True)
                kinds = [pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], names=["range", "name", "phrase", "cut", "first", "part"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "slice", "data", "name", "phrase", "cut", "first", "part")), strict=True):
                if row[:2] != own:
                    own, known = row[:2], []
                if row[2] is not None:
                    known.append(Automaton(row[2]))
                else:
                    key = (row[3], *row[7].split(b" "))
                    found = next((w for w in (a.weight(key) for a in known) if w is not None), None)
                    out.append((row[3], row[4], row[5], found if row[6] else None, None if row[6] else found))
            if out:
                kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["name", "phrase", "cut", "l", "r"])

    asked = cut_lineage(phrases.select("name", "phrase").mapInArrow(ask, "range int, name binary, phrase binary, cut int, first boolean, part binary"), "parts")
    slices = asked.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    dealt = asked.join(slices, "range").withColumn("slice", F.pmod(F.xxhash64("phrase"), "slices").cast("int")).drop("slices")
    copies = automata.join(slices, "range").select("range", "data", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    met = dealt.unionByName(copies, allowMissingColumns=True).repartition("range", "slice").sortWithinPartitions("range", "slice", F.asc_nulls_first("part"))
    found = met.select("range", "slice", "data", "name", "phrase", "cut", "first", "part").mapInArrow(answer, "name binary, phrase binary, cut int, l long, r long")
    return found.repartition("name", "phrase").groupBy("name", "phrase", "cut").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def collocations(df: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST, top: int = TOP, slice_rows: int = SLICE) -> DataFrame:
    """The first ``top`` phrases of each group by score: group_col, rank, phrase, a, l, r, n, score."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    spark, texts = df.sparkSession, named(df, text_col, group_col)
    words, kept = coded(texts), []
    for k in range(1, MOST_WORDS + 1):
        often = often_runs(words, k, kept[-1] if kept else None, least)
        if often.isEmpty():
            break
        kept.append(spark.sparkContext.broadcast(bit_filter(often, "hash")))  # of fixed size
    bounds = range_bounds(texts, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cut_lineage(united(shard_automata(texts, kept, bounds), least), "phrases")
    totals = words.groupBy("name").agg(F.sum("words").alias("n"))
    automata = found.filter(F.col("data").isNotNull()).select("range", "data")
    counted = found.filter(F.col("phrase").isNotNull()).select("name", "phrase", "k", "a")
    phrases = counted.filter(F.col("k") > 1)

    # A longer phrase that covers one with the same count does so through the phrases between them: one word more is enough.
    spelled = F.col("phrase").cast("string")
    ends = F.array(F.expr("substring_index(CAST(phrase AS STRING), ' ', k - 1)"), F.substring(spelled, F.locate(" ", spelled) + 1, F.length(spelled)))
    covers = counted.filter(F.col("k") > 2).select("name", F.explode(ends).alias("inner"), "a").groupBy("name", "inner").agg(F.max("a").alias("covered"))
    covers = covers.select("name", F.col("inner").cast("binary").alias("phrase"), "covered")
    open_phrases = phrases.join(covers, ["name", "phrase"], "left").filter(F.col("covered").isNull() | (F.col("covered") < F.col("a"))).select("name", "phrase", "a")

    parts = part_counts(open_phrases, automata, bounds, slice_rows)
    # One row for each group: a bounded side is not promised, so the optimizer decides how to join.
    scored = parts.join(open_phrases, ["name", "phrase"]).join(totals, "name")
    # Decimals of 38 places hold the products exactly; div gives the whole quotient.
    scored = scored.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), "under": exact("l") * exact("r")})
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("name", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    place = Window.partitionBy("name").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return ranked.select(
        F.col("name").cast("string").alias(group_col),
        F.col("rank").cast("long").alias("rank"),
        F.col("phrase").cast("string").alias("phrase"),
        "a",
        F.col("best.l").alias("l"),
        F.col("best.r").alias("r"),
        "n",
        F.col("best.score").cast("long").alias("score"),
    )


def sql(least: int = LEAST, top: int = TOP) -> str:
    """The same by plain counting."""
    return f"""
    WITH pieces AS (
        SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws
        FROM (SELECT coalesce(lang, '{NO_GROUP}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
    ), places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
    grams AS (
        SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM places CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws)
    ), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
    totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
    cuts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
    scored AS (
        SELECT c.*, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : cut], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1 :], ' ') JOIN totals t ON t.lang = c.lang
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
        a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM best b
    WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = b.lang AND z.k > b.k AND z.a >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' '))
    QUALIFY rank <= {top}
    """
