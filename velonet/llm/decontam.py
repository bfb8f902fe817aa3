"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds are the word pairs of the test items (single words for items too short to promise a pair). One scan finds, for
   each document, the items with which it shares seeds, and where.
2. A copy that scores ``least`` can have lost only so many of its item's pairs (an edit costs at least as many points as it
   breaks pairs), and is only so long. A stretch of a document with fewer of an item's seeds is no candidate, so frequent
   pairs alone lead nowhere; nor is one with too few of the item's words.
3. The other stretches are aligned with the whole item by Smith-Waterman over words
   (match +2, mismatch -1, gap -1). The score is the alignment's share of the
   item's own (2 a word): 1 for a verbatim copy, and falling with each edit.

Both bounds are exact, so the result is that of aligning every document with every item.

The seeds are broadcast while they are at most ``MAX_SEEDS`` (16 bytes each, and 24 for each word of an item);
beyond that the benchmark is scanned in blocks of items, one pass over the documents each. Nothing is shuffled.

Words are lower-cased (in any script) and split at ASCII white space; ASCII punctuation at either end
of a word is dropped before hashing. Edge cases: null or empty texts and items match
nothing; rows with a null id go. Repeated items and repeated documents
are each reported. Empty tables give an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.llm import textkit as tk

MAX_SEEDS, LEAST = 1 << 20, 0.55
#: Bytes of passages whose alignments a task remembers.
MEMO = 1 << 24
_U = np.uint64

def folded_words(texts: list[bytes]) -> tuple[tk.Words, np.ndarray]:
    """Words and hashes without case (of any script) and outer punctuation."""
    return tk.plain_words([t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts])


def promised(words: int, least: float) -> tuple[int, int, int]:
    """(n, seeds, span): a copy of an item of ``words`` words that scores ``least`` keeps ``seeds`` of its n-word seeds, within ``span`` words.

    Of the 2 points a word, 2 words (1 - least) may be lost. A changed or missing word costs 3 (2 at the ends) and breaks two pairs,
    an inserted one costs 1 and breaks one, so no point breaks more than one pair.
    """
    lost = int(2 * words * (1 - least) + 1e-9)
    pairs = words - 1 - lost
    return (2, pairs, words + lost) if pairs >= 1 else (1, max(1, math.ceil(words * least - 1e-9)), words + lost)


@dataclass
class Items:
    """Items by number: ids, word hashes, their seeds, and how often each holds each of its words."""

    ids: np.ndarray
    words: list[np.ndarray]
    need: np.ndarray
    span: np.ndarray
    seeds: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    lengths: list[int]
    vocabulary: np.ndarray
    held: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], least: float) -> Items:
        w, h = folded_words([t for _, t in items])
        words = [h[f : f + n] for f, n in zip(w.first, w.count)]
        rule = np.array([promised(len(x), least) for x in words], np.int64).reshape(-1, 3)
        gram, own = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for n in (1, 2):
            g, at = w.grams(h, n)
            mine = rule[w.doc[at], 0] == n
            gram.append(g[mine])
            own.append(w.doc[at[mine]])
        pairs = np.unique(np.stack([np.concatenate(gram), np.concatenate(own).astype(_U)]), axis=1)  # by seed, then item
        seeds, first = np.unique(pairs[0], return_index=True)
        vocabulary, number = np.unique(h, return_inverse=True)
        held, times = np.unique(w.doc * len(vocabulary) + number, return_counts=True)
        return cls(np.array([i for i, _ in items], np.int64), words, rule[:, 1], rule[:, 2], seeds, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64), sorted({*rule[w.count > 0, 0].tolist()}), vocabulary, held, times)

    def __len__(self) -> int:
        return len(self.seeds)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (+2, -1, -1): (score, begin, end) in the passage."""
    m = len(passage)
    best, gap = (0, 0, 0), np.arange(m + 1)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for v in item:
        same = np.where(passage == v, 2, -1)
        diag = row[:-1] + same
        up = row[1:] - 1
        top, came = np.zeros(m + 1, np.int64), np.arange(m + 1)
        take = diag >= up
        top[1:] = np.where(take, diag, up)
        came[1:] = np.where(take, origin[:-1], origin[1:])
        low = top <= 0
        top[low], came[low] = 0, np.arange(m + 1)[low]
        # gaps in the item: the best of top[j'] - (j - j') over j' <= j
        lifted = top + gap
        peak = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == peak, gap, 0))
        row, origin = peak - gap, came[at]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(origin[j]), j)
    return best


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _places(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def candidates(x: Items, w: tk.Words, h: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(document, item, begin, end) of the stretches that neither bound rules out, in order; words counted from the document's first."""
    none = (np.zeros(0, np.int64),) * 4
    item, at = [], []
    for n in x.lengths:
        gram, place = w.grams(h, n)
        if len(gram):
            spot = np.minimum(np.searchsorted(x.seeds, gram), len(x.seeds) - 1)
            hit = np.flatnonzero(x.seeds[spot] == gram)
            begin, size = x.first[spot[hit]], x.first[spot[hit] + 1] - x.first[spot[hit]]
            item.append(x.owner[_places(begin, size)])
            at.append(np.repeat(place[hit], size))
    if not item or not sum(map(len, item)):
        return none
    item, at = np.concatenate(item), np.concatenate(at)
    doc = w.doc[at]
    at -= w.first[doc]
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    # the promised number of seeds, from this one on, within a copy's greatest length
    last = np.minimum(np.arange(len(at)) + x.need[item] - 1, len(at) - 1)
    near = (np.arange(len(at)) + x.need[item] <= len(at)) & (doc[last] == doc) & (item[last] == item) & (at[last] - at < x.span[item])
    doc, item, at, last = doc[near], item[near], at[near], at[last[near]]
    if not len(doc):
        return none
    begin, end = np.maximum(last + 1 - x.span[item], 0), np.minimum(at + x.span[item], w.count[doc])
    # those that begin close to each other are one stretch
    first = _runs(doc, item, at // x.span[item])
    doc, item, begin, end = doc[first], item[first], begin[first], end[np.append(first[1:], len(doc)) - 1]
    # words of the item that occur in the stretch
    size = end - begin
    word = h[_places(w.first[doc] + begin, size)]
    spot = np.minimum(np.searchsorted(x.vocabulary, word), len(x.vocabulary) - 1)
    known = x.vocabulary[spot] == word
    seen = np.unique(np.repeat(np.arange(len(doc)), size)[known] * len(x.vocabulary) + spot[known])
    which, number = seen // len(x.vocabulary), seen % len(x.vocabulary)
    key = item[which] * len(x.vocabulary) + number
    spot = np.minimum(np.searchsorted(x.held, key), len(x.held) - 1)
    own = np.bincount(which, np.where(x.held[spot] == key, x.times[spot], 0), len(doc))
    keep = own >= least * np.array([len(v) for v in x.words])[item] - 1e-9
    doc, item, begin, end = doc[keep], item[keep], begin[keep], end[keep]
    if not len(doc):
        return none
    # stretches that overlap are one
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], item[first], begin[first], end[np.append(first[1:], len(doc)) - 1]


def _aligned(box, least: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Items = box.value
        known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        size = 0

        def best_of(k: int, passage: np.ndarray) -> tuple[int, int, int]:
            nonlocal size
            item, best = x.words[k], (0, 0, 0)
            for p in range(0, len(passage), 1 << 14):  # long stretches in pieces that overlap by a copy's greatest length
                q = min(len(passage), p + (1 << 14) + int(x.span[k]))
                key = (k, passage[p:q].tobytes())
                if key not in known:
                    if size > MEMO:
                        known.clear()
                        size = 0
                    size += len(key[1]) + 200
                    known[key] = align(item, passage[p:q])
                s, a, b = known[key]
                if s > best[0]:
                    best = (s, p + a, p + b)
                if q == len(passage):
                    break
            return best

        for batch, texts in tk.groups(batches):
            w, h = folded_words(texts)
            ids, found = np.asarray(batch.column("doc_id")), {}
            for d, k, a, b in zip(*(c.tolist() for c in candidates(x, w, h, least))):
                s, p, q = best_of(k, h[w.first[d] + a : w.first[d] + b])
                score = s / (2 * len(x.words[k]))
                if score >= least and score > found.get((d, k), (0,))[0]:
                    found[d, k] = (score, a + p, a + q)
            rows = [(ids[d], x.ids[k], round(s, 6), p, q) for (d, k), (s, p, q) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, begin, end): aligned word spans of items in documents, with score of ``least`` or more; of several the first of the best."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and length(trim(text)) > 0")
    words = rows.select(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-int(words) // MAX_SEEDS))
    out = None
    for k in range(blocks):
        own = [(r.item_id, r.text.encode()) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").toLocalIterator()]
        part = _block(spark, docs, Items.of(own, least), least)
        out = part if out is None else out.unionByName(part)
    return out


def _block(spark, docs: DataFrame, items: Items, least: float) -> DataFrame:
    kind = "doc_id long, item_id long, score double, begin long, end long"
    if not len(items):
        return spark.createDataFrame([], kind)
    return docs.mapInArrow(_aligned(spark.sparkContext.broadcast(items), least), kind)
