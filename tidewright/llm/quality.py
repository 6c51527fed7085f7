"""Quality classifier: supervised subword embeddings, as in fastText.

A text is its words (what white space separates, with case and marks) and the character 3- to 5-grams of each word, hashed to
``buckets`` vectors. A word that repeats the one before it adds a bigram mark, and ``PRIOR`` end marks hold short texts near the average. The
mean of the vectors goes through a linear layer and softmax; vectors and layer are learned by numpy
stochastic gradient descent, a document a step. Learning uses at most ``sample`` labelled rows, chosen by a hash of the id; their
features are counted by Spark and fetched, so the driver's memory is bounded by ``sample * buckets`` and not by text.

Scoring covers every whole text. As the mean is linear, each word's share of the score is a number that a task works out once per word.

Defined results: a null text counts as empty; an empty text has the score of the end marks alone; a label is used if all rows of its id
agree on it; without a labelled row of both kinds every score is the share of good rows (0.5 without any). Rows are independent:
ids may be null or repeat, other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import in_parts, pieces_of

BUCKETS = 1 << 17
DIM = 8
#: Documents that learning steps through, however many are labelled: few are gone through more often.
STEPS = 15_000
RATE = 0.5
#: Most labelled rows that are learned from.
SAMPLE = 3000
GRAMS = (3, 4, 5)
#: Marks that no word can be, as words hold no blank: a word after itself, the end of a text.
SAME, END = "same as before", "end of text"
#: End marks of each text.
PRIOR = 20


def features(word: str, buckets: int) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks for its start and end."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in (word, *grams)]


def bucket(mark: str, buckets: int) -> int:
    return zlib.crc32(mark.encode()) % buckets


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, islice(words, 1, None)))


def counted(text: str, buckets: int) -> Counter:
    """Features of a whole text and their counts."""
    words, found = text.split(), Counter()
    for word, n in Counter(words).items():
        for f in features(word, buckets):
            found[f] += n
    found[bucket(SAME, buckets)] += repeats(words)
    found[bucket(END, buckets)] += PRIOR
    return found


@dataclass
class Model:
    """contributions: each bucket's share in (good - bad), before the mean; bias: what the layer adds."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def contributions(self) -> np.ndarray:
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(documents: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 1) -> Model:
    """documents: distinct buckets, their counts and the label of each."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    labels = [label for *_, label in documents]
    if len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels), 1e-6), 1 - 1e-6) if labels else 0.5
        return Model(np.zeros_like(vectors), layer, np.array([0, math.log(share / (1 - share))], np.float32))
    order = np.empty(0, np.int64)
    for done in range(steps):
        if not len(order):
            order = rng.permutation(len(documents))
        ids, counts, label = documents[order[0]]
        order = order[1:]
        step = rate * (1 - done / steps)
        weights = (counts / max(counts.sum(), 1)).astype(np.float32)
        mean = weights @ vectors[ids]
        logits = mean @ layer + bias
        chance = np.exp(logits - logits.max())
        wrong = chance / chance.sum()
        wrong[label] -= 1
        back = layer @ wrong
        layer -= step * np.outer(mean, wrong)
        bias -= step * wrong
        vectors[ids] -= step * len(ids) ** 0.5 * np.outer(weights, back)
    return Model(vectors, layer, bias)


def labelled_rows(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows to learn from, at most ``sample``: id_col, label. Rows whose crc32(id) mod 3 is 1 are held out."""
    agreed = labels.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("high"))
    usable = agreed.filter((F.col("label") == F.col("high")) & F.col("label").isin(0, 1))
    return usable.select(id_col, F.col("label").cast("int")).orderBy(F.xxhash64(id_col), id_col).limit(sample)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS, **options) -> Model:
    chosen = F.broadcast(labelled_rows(labels, sample, id_col))  # at most ``sample`` rows
    texts = df.select(F.col(id_col), F.col(text_col).alias("text")).join(chosen, id_col).select(F.col(id_col).cast("string").alias("id"), "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for text in batch.column("text").to_pylist():
                found = counted(text or "", buckets)
                ids.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                counts.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "label": batch.column("label"), "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())}
            )

    # The order of steps must not depend on the order of tasks.
    rows = sorted(texts.mapInArrow(count, "id string, label int, ids binary, counts binary").toArrow().to_pylist(), key=lambda r: (r["id"], r["ids"]))
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32), r["label"]) for r in rows if r["ids"]], buckets, **options)


class WordShares(dict):
    """word -> (sum of its features' contributions, their number) as one complex number, so that a text is one sum."""

    def __init__(self, contributions: np.ndarray, limit: int = 300_000):
        super().__init__()
        self.contributions, self.limit = contributions, limit

    def __missing__(self, word: str) -> complex:
        if len(self) >= self.limit:
            self.clear()
        ids = features(word, len(self.contributions))
        share = self[word] = complex(float(self.contributions[ids].sum()), len(ids))
        return share


def text_scores(model: Model):
    """A function for tasks: scores of a list of texts."""
    contributions, offset = model.contributions.astype(np.float32), model.offset
    same, end = (complex(float(contributions[bucket(mark, len(contributions))]), 1) for mark in (SAME, END))

    def start():
        shares = WordShares(contributions)

        def score(texts: list[str | None]) -> list[float]:
            totals = []
            for part in pieces_of(texts, lambda t: len(t or ""), 2_000_000):
                words = [(t or "").split() for t in texts[part]]
                totals += [sum(map(shares.__getitem__, w), repeats(w) * same + PRIOR * end) for w in words]
            return [1 / (1 + math.exp(-min(max(z.real / z.imag + offset, -700), 700))) for z in totals]

        return score

    return start


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id_col, held_out, score, predicted."""
    start = text_scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in in_parts(batches, 1):
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(of(batch.column(1).to_pylist()), pa.float64())})

    scored = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text scores at least ``least``."""
    start, at = text_scores(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in in_parts(batches, at):
            yield batch.filter(pa.array([s >= least for s in of(batch.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)
