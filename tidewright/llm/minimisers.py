"""Minimisers of word windows: the positions that windows choose by content alone.

A window of ``window`` words chooses its run of ``gram`` words with the smallest hash, the leftmost if equal. Equal windows choose the same
place wherever they stand, and neighbours mostly share their choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import WordHashes, bit_filter, byte_texts, gram_hashes, in_parts
from tidewright.session import cut_lineage


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, in log(width) passes."""
    size, done = len(x) - width + 1, 1
    if size <= 0:
        return x[:0]
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:size], x[width - done : width - done + size])


@dataclass
class Runs:
    """Runs of windows that share a minimiser: document, first window and number of windows in its words, hash."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    value: np.ndarray


def window_runs(hashes: list[np.ndarray], window: int, gram: int) -> Runs:
    """The runs of all windows of some documents, given the hashes of their words."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    grams = gram_hashes(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), gram)
    low = sliding_min(grams, window - gram + 1)
    valid = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), valid)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(valid) - valid, valid)
    place = begins[doc] + within
    value = low[place]
    # A run ends with its document, when a smaller gram comes in, or when the chosen one drops out on the left.
    same = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1]) & (grams[place[:-1]] != value[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(doc) else np.empty(0, np.int64)
    return Runs(doc[first], within[first], np.diff(np.append(first, len(doc))), value[first])


def documents(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Of each small part of a task's rows: the values of ``keys``, the words of the texts, their hashes; texts as bytes split at ASCII white space."""
    hashes = WordHashes()
    for batch in in_parts(batches):
        words = [t.split() for t in byte_texts(batch)]
        yield [batch.column(k).to_pylist() for k in keys], words, [hashes.of(w) for w in words]


def repeated_minimisers(docs: DataFrame, window: int, gram: int) -> tuple[np.ndarray, DataFrame]:
    """Bit set of the minimisers that several runs chose, and value, n of those. Nothing is decided here: windows whose minimiser is chosen once
    cannot repeat, so they need not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes in documents(batches, []):
            yield pa.RecordBatch.from_pydict({"value": pa.array(window_runs(hashes, window, gram).value.view(np.int64))})

    counts = docs.select("text").mapInArrow(run, "value long").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    counts = cut_lineage(counts, "minimisers")
    return bit_filter(counts, "value"), counts
