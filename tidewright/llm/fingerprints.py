"""Fingerprints by a randomised edit embedding: shared random walks turn edit distance into Hamming distance.

The walk stands on a character of the text, writes it, and goes on to the next character or stays, as a random bit says that all texts share for
this step and character. Texts that differ by an edit fall into step again, so their writings differ in few places. A text of n characters
is written in about 2n steps.

The fingerprint samples the writing at ``SAMPLES`` fixed random steps of each of its last four octaves (steps 0 to 63, 64 to 127, 128 to 255, ...) and at ``EARLY`` steps
of each octave before, as 4-bit symbols, 0 beyond the end. Its likeness to another weighs each sample by the steps it stands for and is the share of samples that
agree. Bands of symbols drawn at random from three octaves make candidates of a search, which the likeness verifies.

Defined results: a null text counts as empty; two empty texts have likeness 1, an empty and another 0. Rows are in descending order of
the id, nulls last, equal ids by a hash of the text; the next of the last row is the first; a single row is its own next. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import bit_filter, in_filter, pieces_of, whole_text
from tidewright.llm.graph import components
from tidewright.session import cut_lineage

SAMPLES = 64
OCTAVES = 4
#: Octave 5 is steps 0 to 63, octave k > 5 is steps 2**k to 2**(k + 1) - 1.
BASE = 5
PERIOD = 4096
#: Samples of an octave before the last four: every eighth of the others.
EARLY = 8
#: Symbols of a band, bands of a family, symbols of a band that must lie before the text's end.
BAND, BANDS, WRITTEN = 8, 20, 6
#: Rows of one range of ids, and most ranges (their bounds are literals).
RANGE_ROWS = 2000
MAX_RANGES = 1024
#: Rows of a band that are compared with as many in a task.
SLICE = 1000
#: Characters of the texts that walk at once: the last steps of a walk, which only the longest text makes, cost much the same for few texts.
WALKED = 12_000_000
#: Pairs whose likeness is taken at once.
PAIRS = 4000


@functools.cache
def walk_bits() -> np.ndarray:
    """Random bits by step (they repeat after PERIOD) and character class; class 0 is the end, where the walk stays."""
    bits = np.random.default_rng(20).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    bits[:, 0] = 0
    return bits


@functools.cache
def sampled_steps(octave: int) -> np.ndarray:
    if octave <= BASE + 1:
        return np.arange(SAMPLES) + SAMPLES * (octave - BASE)
    return np.sort(np.random.default_rng(octave).choice(1 << octave, SAMPLES, replace=False)) + (1 << octave)


def symbols(text: str) -> np.ndarray:
    """Class 1 to 255 of each code point, and the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 1, np.uint8)
    out[:-1] = 1 + ((points * np.uint32(2654435761)) >> np.uint32(8)) % 255
    return out


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """last octave, OCTAVES x SAMPLES symbols and those of the octaves before, of each text. All texts walk at once, a step at a time."""
    parts = [symbols(t) for t in texts]
    line = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    at = np.cumsum(sizes) - sizes
    alive = np.flatnonzero(sizes > 1)
    last = np.full(len(texts), BASE)
    written: dict[int, np.ndarray] = {}
    octave, bits, step = BASE, walk_bits(), 0
    at = at[alive]
    while len(alive):
        last[alive] = octave
        samples = sampled_steps(octave)
        end = 2 << octave
        rows = np.zeros((SAMPLES, len(texts)), np.uint8)
        char, move = np.empty(len(alive), np.uint8), np.empty(len(alive), np.uint8)
        taken = 0
        while step < end:
            np.take(line, at, out=char)
            if taken < SAMPLES and step == samples[taken]:
                rows[taken, alive] = char
                taken += 1
            np.take(bits[step % PERIOD], char, out=move)
            at += move
            step += 1
            if step % 64 == 0:
                going = line[at] > 0
                if not going.all():
                    alive, at = alive[going], at[going]
                    if not len(alive):
                        break
                    char, move = char[: len(alive)], move[: len(alive)]
        written[octave] = rows
        octave += 1
    out = np.zeros((len(texts), OCTAVES, SAMPLES), np.uint8)
    early = np.zeros((len(texts), max(octave - OCTAVES - BASE, 0), EARLY), np.uint8)
    for o, rows in written.items():
        kept = np.where(rows > 0, rows % 15 + 1, 0).T
        places = o - last + OCTAVES - 1
        whole = np.flatnonzero((places >= 0) & (places < OCTAVES))
        out[whole, places[whole]] = kept[whole]
        before = np.flatnonzero(places < 0)
        if len(before):
            early[before, o - BASE] = kept[before, :: SAMPLES // EARLY]
    return last, out, early


def early_octaves(last: int) -> int:
    return max(last - OCTAVES + 1 - BASE, 0)


def packed(symbols: np.ndarray) -> str:
    flat = symbols.reshape(-1)
    return (flat[0::2] << 4 | flat[1::2]).astype(np.uint8).tobytes().hex()


def as_text(last: int, samples: np.ndarray, early: np.ndarray) -> str:
    """Two hexadecimal digits of the last octave, one of each sample of the last four octaves, then those of the octaves before."""
    return f"{last:02x}" + packed(samples) + packed(early[: early_octaves(last)])


def from_text(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    flat, last = np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1), int(fingerprint[:2], 16)
    return last, flat[: OCTAVES * SAMPLES].reshape(OCTAVES, SAMPLES), flat[OCTAVES * SAMPLES :].reshape(-1, EARLY)


def octave_of(last: int, samples: np.ndarray, early: np.ndarray, octave: int, whole: bool) -> np.ndarray:
    """The symbols of an octave, of one fingerprint or of many alike in ``last`` (their first axis); all samples of it if ``whole``, else the early ones."""
    k = octave - last + OCTAVES - 1
    if k < 0:
        return early[..., octave - BASE, :]
    if k >= OCTAVES:
        return np.zeros((*samples.shape[:-2], SAMPLES if whole else EARLY), np.uint8)
    return samples[..., k, :: 1 if whole else SAMPLES // EARLY]


def likenesses(a: tuple, b: tuple) -> np.ndarray:
    """Share of agreeing samples, 0 to 1, weighed by the steps they stand for, of the fingerprints of ``a`` and ``b``, place by place.

    Both are (last octaves, samples, early samples), one row for each.
    """
    out = np.ones(len(a[0]))
    kinds, which = np.unique(np.stack([a[0], b[0]], axis=1), axis=0, return_inverse=True)
    for kind, (last, other) in enumerate(kinds.tolist()):
        mine = np.flatnonzero(which.reshape(-1) == kind)
        x_of, y_of = (a[1][mine], a[2][mine]), (b[1][mine], b[2][mine])
        agree, total = np.zeros(len(mine)), np.zeros(len(mine))
        for octave in range(BASE, max(last, other) + 1):
            whole = octave > max(last, other) - OCTAVES
            x, y = octave_of(last, *x_of, octave, whole), octave_of(other, *y_of, octave, whole)
            weight = float(1 << max(octave - BASE - 1, 0)) * (1 if whole else SAMPLES // EARLY)
            agree += weight * np.count_nonzero((x == y) & (x > 0), axis=1)
            total += weight * np.count_nonzero((x > 0) | (y > 0), axis=1)
        out[mine] = np.where(total > 0, agree / np.maximum(total, 1), 1.0)
    return out


def likeness_to(last: int, samples: np.ndarray, early: np.ndarray, lasts: np.ndarray, others: np.ndarray, earlies: np.ndarray) -> np.ndarray:
    """``likenesses`` of one fingerprint to each of many."""
    n = len(lasts)
    return likenesses((np.full(n, last), np.broadcast_to(samples, (n, *samples.shape)), np.broadcast_to(early, (n, *early.shape))), (lasts, others, earlies))


def likeness(a: tuple, b: tuple) -> float:
    last, samples, early = b
    return float(likeness_to(*a, np.array([last]), samples[None], early[None])[0])


def padded(earlies: list[np.ndarray]) -> np.ndarray:
    """Early symbols of many fingerprints in one array."""
    out = np.zeros((len(earlies), max(map(len, earlies)), EARLY), np.uint8)
    for row, early in zip(out, earlies, strict=True):
        row[: len(early)] = early
    return out


def many(prints: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints as arrays, one row for each."""
    lasts, samples, earlies = zip(*prints, strict=True)
    return np.array(lasts, np.int64), np.stack(samples), padded(list(earlies))


@functools.cache
def band_places(top: int) -> np.ndarray:
    """Octave and sample of each symbol of the family's bands: drawn from the octaves top - 2 to top."""
    rng, first = np.random.default_rng([5, top]), max(BASE, top - 2)
    drawn = np.array([rng.choice((top - first + 1) * SAMPLES, BAND, replace=False) for _ in range(BANDS)])
    return np.stack([first + drawn // SAMPLES, drawn % SAMPLES])


def bands(last: int, samples: np.ndarray) -> list[str]:
    """Keys of the bands: of the family of the last octave and of the one before, so that texts on either side of an octave's border share one.

    A band mostly beyond the text's end says nothing and is left out; texts of the first octave have their start for a band, whatever its length.
    """
    keys = [f"start-{samples[OCTAVES - 1, :BAND].tobytes().hex()}"] if last == BASE else []
    for top in range(max(BASE, last - 1), last + 1):
        octaves, places = band_places(top)
        found = samples[octaves - last + OCTAVES - 1, places]
        for i in np.flatnonzero(np.count_nonzero(found, axis=1) >= WRITTEN).tolist():
            keys.append(f"{top}-{i}-{found[i].tobytes().hex()}")
    return keys


def ranges(df: DataFrame, column: str, count: int) -> tuple[list[int], DataFrame]:
    """Bounds that cut ``column`` into about equal parts, and df with range: 0 for nulls, then ascending."""
    cuts = df.agg(F.percentile_approx(column, [i / count for i in range(1, count)], 10_000)).first()[0] if count > 1 else None
    bounds = sorted(set(cuts or []))
    per = 32  # looked up in two steps: every 32nd bound, then those between
    coarse = F.array(*[F.lit(b) for b in bounds[::per]]).cast("array<bigint>")
    every = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda b: b <= F.col(column)))
    fine = F.size(F.filter(F.slice(every, F.greatest(block - 1, F.lit(0)) * per + 1, per), lambda b: b <= F.col(column)))
    place = F.greatest(block - 1, F.lit(0)) * per + fine + 1
    return bounds, df.withColumn("range", F.when(F.col(column).isNull(), F.lit(0)).otherwise(place).cast("int"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one: its last third replaced by the start of the next text, in descending order of the id.

    One row per row of ``df``: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shared_bands.
    Each range of ids is a bucket; the first row of a range also goes to the range before it, whose last row it follows.
    """
    docs = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    count = min(MAX_RANGES, max(1, docs.count() // RANGE_ROWS))
    _, docs = ranges(docs, "id", count)
    firsts = sorted(docs.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("x")).collect())  # a row per range
    following = [(r["range"], r["x"]["id"], r["x"]["tie"], firsts[(i + 1) % len(firsts)]["range"]) for i, r in enumerate(firsts)]
    tails = df.sparkSession.createDataFrame(following, "r int, i long, t long, target int")
    joined = docs.join(F.broadcast(tails), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")
    # As the first of its range, a row is the one that follows the last row of the range above.
    places = F.when(F.col("target").isNull(), F.array("range")).otherwise(F.array("range", "target"))
    dealt = joined.select(F.posexplode(places).alias("tail", "range"), "id", "tie", "text")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "tail", F.desc_nulls_last("id"), F.desc("tie")).select("range", "tail", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple | None = None
        for batch in batches:
            kind = batch.column("id").type
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "tail", "id", "text")), strict=True))
            for part in pieces_of(rows, lambda r: len(r[3]), WALKED):
                own = ([pending] if pending else []) + rows[part]
                pairs = [(a, b) for a, b in zip(own[:-1], own[1:], strict=True) if a[0] == b[0] and not a[1]]
                pending = own[-1]
                if pairs:
                    yield compared(pairs, kind)

    schema = (
        f"id {df.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, shared_bands int"
    )
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def compared(pairs: list[tuple[tuple, tuple]], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of the result for (row, next row) pairs of (range, tail, id, text)."""
    texts = [a[3] for a, _ in pairs]
    nexts = [b[3] for _, b in pairs]
    thirds = [len(t) // 3 for t in texts]
    edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, nexts, thirds, strict=True)]
    # The next text is mostly the next row, so each text walks once.
    distinct = {t: i for i, t in enumerate(dict.fromkeys(texts + nexts + edited))}
    order = sorted(distinct, key=len)
    last, samples, early = fingerprints(order)
    place = {t: i for i, t in enumerate(order)}
    of = lambda ts: [(int(last[place[t]]), samples[place[t]], early[place[t]]) for t in ts]
    mine, theirs, changed = of(texts), of(nexts), of(edited)
    own = many(mine)
    keys = {t: frozenset(bands(int(last[i]), samples[i])) for t, i in place.items()}
    columns = {
        "id": pa.array([a[2] for a, _ in pairs], kind),
        "n_chars": pa.array(list(map(len, texts)), pa.int64()),
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "fingerprint": [as_text(*m) for m in mine],
        "edited_fingerprint": [as_text(*c) for c in changed],
        "near_edited": likenesses(own, many(changed)),
        "near_next": likenesses(own, many(theirs)),
        "shared_bands": pa.array([len(keys[t] & keys[e]) for t, e in zip(texts, edited, strict=True)], pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns)


def links_across(nodes: list[bytes], prints: list[bytes], parts: list[bytes], least: float, sizes: list[int] | None = None) -> list[tuple[bytes, bytes]]:
    """Links of likeness ``least`` or more that join the parts as all such links would: one fewer than parts at most.

    With ``sizes`` the members are those of several groups, one after another, and links stay inside a group; the pairs of many groups are compared together.
    """
    kinds: dict[bytes, int] = {}
    which = np.array([kinds.setdefault(p, len(kinds)) for p in prints])
    lasts, samples, early = many([from_text(p.hex()) for p in kinds])
    sizes = np.array(sizes or [len(nodes)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    part = np.unique(np.array([f"{g}-".encode() + p for g, p in zip(group.tolist(), parts, strict=True)], object), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(sizes)[group]
    links = []

    def compared(rows: list[int], others: list[np.ndarray]) -> None:
        x, y = which[np.repeat(rows, [len(o) for o in others])], which[np.concatenate(others)]
        near = likenesses((lasts[x], samples[x], early[x]), (lasts[y], samples[y], early[y])) >= least
        at = 0
        for i, own in zip(rows, others, strict=True):
            for j in own[near[at : at + len(own)]].tolist():
                if part[j] != part[i]:
                    low, high = ends[i] - sizes[group[i]], ends[i]
                    part[low:high][part[low:high] == part[j]] = part[i]
                    links.append((nodes[i], nodes[j]))
            at += len(own)

    rows, others, waiting = [], [], 0
    for i in range(len(nodes)):
        later = i + 1 + np.flatnonzero(part[i + 1 : ends[i]] != part[i])
        if len(later):
            rows.append(i)
            others.append(later)
            waiting += len(later)
        if waiting >= PAIRS:
            compared(rows, others)
            rows, others, waiting = [], [], 0
    if rows:
        compared(rows, others)
    return links


def linked_prints(prints: DataFrame, least: float) -> DataFrame:
    """node (md5 of a fingerprint), component of the fingerprints that are near another, of stored rows (fingerprint).

    Pairs come in two rounds: all of a band with its smallest node, so a band of n rows gives n - 1 pairs; then, in bands that still hold several
    components and more than the two nodes that the first round compared, a forest of the links between different ones. Of the links of a node to several smallest ones its own smallest is kept, and these are linked
    with each other instead. A band of more than ``SLICE`` rows is split, and each two of its slices meet in a task. A pair
    inside a component cannot change the classes. A bit set of the bands held twice leaves the others out before the shuffle.
    """

    def keys(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {p: np.array([xxhash.xxh3_64_intdigest(b) for b in bands(*from_text(p)[:2])], np.uint64) for p in set(batch.column(0).to_pylist())}
            if bits is not None:
                own = {p: b[in_filter(bits, b)] for p, b in own.items()}
            nodes = [hashlib.md5(p.encode()).digest() for p, b in own.items() for _ in range(len(b))]
            held = np.concatenate([*own.values(), np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "band": pa.array(held.view(np.int64))})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, y = (many([from_text(p.hex()) for p in part.column(c).to_pylist()]) for c in ("x", "y"))
                yield part.select(["u", "v"]).filter(pa.array(likenesses(x, y) >= least))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            found = links_across(*map(list, zip(*members, strict=True)), least, sizes)
            return pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

        group, members, sizes = None, [], []
        for batch in batches:
            for band, i, j, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != group:
                    if len(members) >= 2 * SLICE:
                        yield links()
                        members, sizes = [], []
                    group = (band, i, j)
                    sizes.append(0)
                members.append(member)
                sizes[-1] += 1
        if members:
            yield links()

    texts = prints.select("fingerprint")
    often = texts.mapInArrow(lambda batches: keys(batches, None), "node binary, band long").groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    bits = prints.sparkSession.sparkContext.broadcast(bit_filter(often, "band"))  # of fixed size
    held = cut_lineage(texts.mapInArrow(lambda batches: keys(batches, bits.value), "node binary, band long").distinct(), "held")
    shared = held.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("high")).filter(F.col("leader") != F.col("high")).select("band", "leader")
    entries = cut_lineage(held.join(shared, "band"), "entries")
    print_of = texts.select(node_of().alias("node"), F.unhex("fingerprint").alias("print")).dropDuplicates(["node"])

    pairs = entries.filter(F.col("node") != F.col("leader")).select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = pairs.join(print_of.select(F.col("node").alias("u"), F.col("print").alias("x")), "u").join(print_of.select(F.col("node").alias("v"), F.col("print").alias("y")), "v")
    own_least = F.min("v").over(Window.partitionBy("u"))  # a node has some forty bands at most
    kept = pairs.mapInArrow(verify, "u binary, v binary").withColumn("own", own_least)
    first = cut_lineage(kept.select(F.when(F.col("v") == F.col("own"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("own").alias("v")).distinct(), "links")
    labelled = entries.select("band", "node").join(components(first), "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    labelled = cut_lineage(labelled, "labelled")
    members = labelled.join(open_bands(labelled), "band").join(print_of, "node")
    mine = F.pmod(F.xxhash64("node"), "slices").cast("int")
    met = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = met.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "print", "c")
    second = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(across, "u binary, v binary").distinct()
    return components(first.unionByName(second))


def open_bands(labelled: DataFrame) -> DataFrame:
    """band, slices of the bands of ``labelled`` (band, node, c) that may hold a link between components that the first round didn't look at: it compared
    both nodes of a band of two."""
    counted = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("low") != F.col("high")) & (F.col("n") > 2)).select("band", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))


def node_of() -> Column:
    return F.unhex(F.md5("fingerprint"))


def with_class(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """The stored rows of ``prints`` and class_id, the smallest id of the fingerprints that links reach: bands make candidates, likeness of at least
    ``least`` verifies them. Equal fingerprints are one class; a null id is the smallest of none."""
    parts = linked_prints(prints, least)
    named = prints.select(F.col(id_col).alias("i"), node_of().alias("node")).groupBy("node").agg(F.min("i").alias("i"))
    named = cut_lineage(named.join(parts, "node", "left").select("node", "i", F.coalesce("component", "node").alias("c")), "classes")
    classes = named.select("node", "c").join(named.groupBy("c").agg(F.min("i").alias("class_id")), "c").select("node", "class_id")
    return prints.withColumn("node", node_of()).join(classes, "node").drop("node")


def near_classes(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """id_col and class_id of rows with a fingerprint column (see ``with_class``)."""
    return with_class(cut_lineage(prints.select(id_col, "fingerprint"), "prints"), least, id_col).select(id_col, "class_id")


def classed_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``edited_fingerprints`` and class_id of each text."""
    return with_class(cut_lineage(edited_fingerprints(df, id_col, text_col), "prints"), least, id_col)
