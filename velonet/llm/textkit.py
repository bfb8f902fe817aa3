"""Vectorised word splitting and hashing shared by the corpus operators.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text, so no multi-byte character is ever cut. All functions work on a
whole group of documents at once; a group is closed at ``GROUP_BYTES`` unless
one document alone is longer, which bounds a worker's memory by the longest
text rather than by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 17
SLICE = 256
_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 256 if have is None else 2 * len(have)), _U(base))
        step[0] = _U(1)
        have = _tables[base] = np.multiply.accumulate(step)
    return have[:n]


def powers(n: int) -> np.ndarray:
    """_BASE to the power 0..n-1, modulo 2**64."""
    return _table(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _table(pow(_BASE, -1, 1 << 64), n)


class Words:
    """The words of a group of documents: byte spans, 64-bit hashes and the document of each."""

    def __init__(self, texts: list[bytes]):
        self.blob = b"\n".join(texts)
        raw = np.frombuffer(self.blob, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.raw = raw
        word = ~_SEP[raw]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))  # first word of each document
        self.count = np.searchsorted(self.doc, np.arange(len(texts)), "right") - self.first
        self.is_word = word

    def hashes(self, lower: bool = False, limit: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``limit`` bytes; ``lower`` folds A-Z only."""
        if not len(self.start):
            return np.zeros(0, _U)
        raw = self.raw
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        size = self.end - self.start
        at = np.arange(len(raw), dtype=np.int64)
        begin = np.zeros(len(raw), np.int64)
        begin[self.start] = self.start
        at -= np.maximum.accumulate(begin)
        at[~self.is_word] = 0
        skip = ~self.is_word
        if limit is not None:
            skip |= at >= limit
            at[skip] = 0
            size = np.minimum(size, limit)
        part = _BYTE[raw] * powers(int(size.max()) + 1)[at]
        part[skip] = 0
        return mix(np.add.reduceat(part, self.start) ^ (size.astype(_U) * _U(0x9E3779B97F4A7C15)))

    def grams(self, word_hash: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one document, and the index of the first word of each."""
        if len(word_hash) < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        m = len(word_hash) - n + 1
        total = np.zeros(m, _U)
        for j in range(n):
            total *= _U(_BASE)
            total += word_hash[j : j + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(total[at] ^ _U(n)), at


_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words and their hashes without case and outer punctuation; a word of punctuation alone stays."""
    w = Words(texts)
    if len(w.start):
        begin, end = w.start.copy(), w.end.copy()
        # from the first to the last place that is no mark; of punctuation alone the middle byte stays
        place = np.arange(len(w.raw))
        inner = w.is_word & ~_EDGE[w.raw]
        first = np.minimum.accumulate(np.where(inner, place, len(place))[::-1])[::-1][begin]
        last = np.maximum.accumulate(np.where(inner, place, -1))[end - 1]
        alone = first >= end
        begin, end = np.where(alone, (begin + end) // 2, first), np.where(alone, (begin + end) // 2, last) + 1
        w.start, w.end = begin, end
        inner = np.zeros(len(w.raw) + 1, np.int8)
        inner[begin] += 1
        inner[end] -= 1
        w.is_word = np.cumsum(inner[:-1]).astype(bool)
    return w, w.hashes(lower=True)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, each with at most GROUP_BYTES of text or one document."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):  # the texts of a batch become Python objects by slices
            batch = whole.slice(at, SLICE)
            texts = byte_texts(batch.column(text))
            begin, size = 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t) > GROUP_BYTES:
                    yield batch.slice(begin, i - begin), texts[begin:i]
                    begin, size = i, 0
                size += len(t) + 1
            if begin < len(texts):
                yield batch.slice(begin), texts[begin:]
    _tables.clear()
    pa.default_memory_pool().release_unused()  # a worker lives on for the next stages


def packed_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == _U else x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
