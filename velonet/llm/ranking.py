"""Ranked lexical search with integer impacts, by sort-based accumulation.

1. One pass over the texts keeps, of each document, its length and (term, occurrences) of the items' terms.
2. N, L and document frequencies are summed over all documents; they make the terms' weights.
3. Documents are dealt out by ranges of doc_id. A task joins its postings with the items that hold each term into
   arrays (item, document, impact), sorts the packed keys by radix (documents come in order, so a stable sort by the item's
   16-bit digits is enough), sums equal keys with ``reduceat``, and keeps the ``k`` best of each item in heaps.
4. The tasks' heaps are merged by rank.

Bounds: items go in blocks of about ``MAX_WORDS`` words, each a pass of its own; an array has at most ``ENTRIES`` rows
or those of one document. No posting leaves its document, so a frequent term is in no task's way.

Edge cases: a null text has no terms. Documents with a null id count in N, L and frequencies and are never ranked. Each
row is a document or an item of its own where ids repeat. Items with a null id, or without terms, have no rows. Equal scores go by doc_id. Empty tables
give an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velonet.llm import textkit as tk
from velonet.llm.store import materialise

MAX_WORDS, ENTRIES = 1 << 20, 1 << 21
#: Terms are runs of ASCII letters and digits and all beyond ASCII; A-Z lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """A block of items: the terms' numbers, and for each term the items that hold it (repeats included)."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        term, item = [], []
        for k, (_, text) in enumerate(rows):
            for t in terms(text):
                term.append(self.number.setdefault(t, len(self.number)))
                item.append(k)
        term, item = np.array(term, np.int64), np.array(item, np.int64)
        order = np.argsort(term, kind="stable")
        self.item = item[order]
        self.begin = np.searchsorted(term[order], np.arange(len(self.number) + 1))


def _matched(box):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = box.value.number
        for batch, texts in tk.groups(batches):
            size, found, often, counts = [], [], [], []
            for text in texts:
                own = terms(text)
                size.append(len(own))
                term, tf = np.unique(np.array([x for x in map(number.get, own) if x is not None], np.int64), return_counts=True)
                found.append(term)
                often.append(tf)
                counts.append(len(term))
            flat = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), tk.packed_lists(flat(found), np.array(counts), pa.int32()), tk.packed_lists(flat(often), np.array(counts), pa.int32())], schema=schema)
            yield out.filter(pa.array(np.array(size) > 0))

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents by term; under -1 documents, under -2 all terms."""
    docs, words, df = 0, 0, np.zeros(0, np.int64)
    for batch in batches:
        docs += batch.num_rows
        words += int(np.asarray(batch.column("n")).sum())
        new = np.bincount(np.asarray(batch.column("terms").flatten()), minlength=len(df))
        new[: len(df)] += df
        df = new
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[docs, words], df[at]]))], names=["term", "n"])


def radix_order(key: np.ndarray, top: int) -> np.ndarray:
    """Stable order of keys below ``top``: numpy sorts 16-bit digits by radix, the lowest first."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        order = order[np.argsort((key[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(items: Items, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) from postings (doc, term, tf) in order of documents; ``m`` is the length norm of each posting's document."""
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
    many = items.begin[term + 1] - items.begin[term]
    begin = np.cumsum(many) - many
    item = items.item[np.arange(many.sum()) + np.repeat(items.begin[term] - begin, many)]
    doc, impact = np.repeat(doc, many), np.repeat(impact, many)
    order = radix_order(item, max(len(items.ids) - 1, 0))
    item, doc, impact = item[order], doc[order], impact[order]
    first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])) if len(item) else np.zeros(0, np.int64)
    return item[first], doc[first], np.add.reduceat(impact, first) if len(first) else impact


class Heaps:
    """The ``k`` best (score, then smaller id) of each item."""

    def __init__(self, items: int, k: int):
        self.k, self.heap, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        """Rows sorted by item."""
        ok = score >= self.least[item]
        item, doc_id, score = item[ok], doc_id[ok], score[ok]
        cut = np.flatnonzero(np.diff(item, prepend=-1)) if len(item) else []
        for a, b in zip(cut, [*cut[1:], len(item)]):
            own, heap, s, d = int(item[a]), self.heap[int(item[a])], score[a:b], doc_id[a:b]
            if b - a > self.k:
                best = s >= np.partition(s, b - a - self.k)[b - a - self.k]
                s, d = s[best], d[best]
            for x in zip(s.tolist(), (-d).tolist()):
                if len(heap) < self.k:
                    heapq.heappush(heap, x)
                elif x > heap[0]:
                    heapq.heapreplace(heap, x)
            if len(heap) == self.k:
                self.least[own] = heap[0][0]


def _ranked(box, weight: np.ndarray, docs: int, words: int, k: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = box.value
        heaps = Heaps(len(items.ids), k)
        for batch in batches:
            ids, n = np.asarray(batch.column("doc_id")), np.asarray(batch.column("n"))
            norm = 25 + 75 * n * docs // max(words, 1)
            size = np.diff(np.asarray(batch.column("terms").offsets))
            term, tf = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(ids)), size)
            many = np.cumsum(items.begin[term + 1] - items.begin[term])
            end = np.cumsum(size)
            done = np.concatenate([[0], many])[end]  # array rows up to each document
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + ENTRIES, "right")))
                p, q = (end[a - 1] if a else 0), end[b - 1]
                item, at, score = accumulate(items, weight, doc[p:q], term[p:q], tf[p:q], norm[doc[p:q]])
                heaps.add(item, ids[at], score)
                a = b
        rows = [(i, -d, s) for i, heap in enumerate(heaps.heap) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    return run


def _block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    box = spark.sparkContext.broadcast(items)
    matched = materialise(docs.mapInArrow(_matched(box), "doc_id long, n long, terms array<int>, tfs array<int>"), "ranked")
    stats = {r.term: r.n for r in matched.mapInArrow(_statistics, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # as many as the block has terms
    n, words = stats.get(-1, 0), stats.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * stats.get(t, 0) + 1))) for t in range(len(items.number))], np.int64)
    ranges = matched.filter("doc_id is not null and size(terms) > 0").repartitionByRange("doc_id")
    best = ranges.mapInArrow(_ranked(box, weight, n, words, k), "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    words = rows.select(F.coalesce(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-int(words) // MAX_WORDS))
    out = None
    for b in range(blocks):
        own = [(r.item_id, r.text.encode()) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toLocalIterator()]
        block = Items(own)
        part = _block(docs, block, k) if block.number else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        out = part if out is None else out.unionByName(part)
    return out


SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from documents),
c as (select doc_id, term, count(*) as tf from t group by doc_id, term),
z as (select doc_id, cast(sum(tf) as bigint) as n from c group by doc_id),
g as (select count(*) as docs, cast(sum(n) as bigint) as words from z),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from benchmark),
q as (select item_id, term, count(*) as many from i group by item_id, term),
df as (select term, count(*) as df from c where term in (select term from q) group by term),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from df, g),
m as (select doc_id, 100 - 75 + ((75 * n * docs) // words) as m from z, g),
s as (select item_id, c.doc_id, cast(sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
      from c join w on c.term = w.term join q on c.term = q.term join m on c.doc_id = m.doc_id group by item_id, c.doc_id),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
"""
