"""A Bloom filter of ids with a fixed size, to leave rows out of a shuffle that no join will keep.

It only ever saves work: an id that was put in always passes, and whatever passes wrongly is dropped by the join
that follows. ``BITS`` bounds what is collected and broadcast (4 MB) however many ids there are; the fuller it
gets, the less it saves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.llm import textkit as tk

BITS = 1 << 25
_U = np.uint64


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = tk.mix(ids.astype(np.int64).view(_U))
    return (h & _U(BITS - 1)).astype(np.int64), ((h >> _U(32)) & _U(BITS - 1)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_places(np.asarray(batch.column(0)))))
        word, first = np.unique(at >> 6, return_index=True)
        bits = np.left_shift(_U(1), (at & 63).astype(_U))
        joined = np.bitwise_or.reduceat(bits, first) if len(first) else np.zeros(0, _U)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(tk.signed(joined))], names=["word", "bits"])


def build(ids: DataFrame) -> np.ndarray:
    """The filter of the first column (long, no nulls) of ``ids``; repeats are fine."""
    got = ids.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, _U)
    out[np.asarray(got["word"])] = np.asarray(got["bits"]).view(_U)
    return out


def passes(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = _places(ids)
    hit = lambda at: (table[at >> 6] >> (at & 63).astype(_U)) & _U(1)
    return (hit(a) & hit(b)).astype(bool)


def only(docs: DataFrame, table: np.ndarray, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` (doc_id first, then text) that pass, or with ``keep`` false those that certainly aren't in it."""
    box = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = passes(box.value, np.asarray(batch.column(0)))
            yield batch.filter(pa.array(mask if keep else ~mask))

    return docs.mapInArrow(run, docs.schema)
