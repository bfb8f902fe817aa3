"""Filter interaction audit: what each filter removes in every order of five filters.

A document's failures are five bits. ``FIRST`` (32 masks by 120 orders) holds the step at which a document with
these failures leaves, so one look-up a document and order replaces running the filters 120 times.

1. One pass over the texts gives (doc_id, part, digest, four bits); the least doc_id of each repeated digest gives
   the fifth.
2. ``mapInArrow`` indexes the table with the masks of a batch, and ``np.bincount`` accumulates removals by part,
   order and step, once for all, good and toxic documents. Each task hands on one array a part.
3. The arrays are summed by place; a part's sums (``CELLS`` numbers) become its 600 rows.

Hot groups: equal texts are counted before they move and joined as a table written first, so that a hot digest can be
split; a part is an array of fixed size for each task, however many documents it has.

Edge cases: a null text is the empty text, a null lang the part ''. Rows with a null doc_id count, have no labels and are
copies of nothing and no one's original. Rows of one doc_id are documents of their own, none of them the other's copy.
Of repeated label rows the highest value counts; null labels are 0. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.llm import textkit as tk
from velonet.llm.store import materialise

LETTERS = "ABCDE"
ORDERS = list(permutations(range(5)))
#: Where a document with these failures leaves: 0 to 4, 5 if it stays.
FIRST = np.array([[next((s for s, f in enumerate(o) if m >> f & 1), 5) for o in ORDERS] for m in range(32)], np.int64)
#: Numbers a part: removals by order and step, of all, good and toxic documents; failures and sole failures by filter; documents.
STEPS = len(ORDERS) * 6
CELLS = 3 * STEPS + 2 * 5 + 1
#: Parts held by a task at a time, and rows looked up at once.
PARTS, ROWS = 64, 4096

_CONTINUATION, _UPPER = bytes(range(0x80, 0xC0)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The bits of A to D: few words, few distinct words, many capitals, a mark."""
    words = text.split()  # of bytes: at \x20 and \x09-\x0D
    n, capitals, points = len(words), len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _CONTINUATION))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (_MARKS.search(text) is not None) << 3


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tk.groups(batches):
        digests = np.frombuffer(b"".join(hashlib.sha256(t).digest()[:16] for t in texts), "<i8").reshape(-1, 2)
        masks = pa.array([failures(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), masks], names=["doc_id", "part", "d1", "d2", "mask"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("cells", pa.list_(pa.int64()))])
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tolist() for x in held.values()], schema[1].type)], schema=schema)
        held.clear()
        return batch

    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            parts = batch.column("part").dictionary_encode()
            code, mask = np.asarray(parts.indices).astype(np.int64), np.asarray(batch.column("mask")).astype(np.int64)
            good, toxic = np.asarray(batch.column("good")), np.asarray(batch.column("toxic"))
            n = len(parts.dictionary)
            cell = code[:, None] * STEPS + np.arange(len(ORDERS)) * 6 + FIRST[mask]
            removed = [np.bincount(cell[rows].ravel(), minlength=n * STEPS).reshape(n, STEPS) for rows in (slice(None), good == 1, toxic == 1)]
            by_mask = np.bincount(code * 32 + mask, minlength=n * 32).reshape(n, 32)
            bit = np.arange(32)[:, None] >> np.arange(5) & 1
            sums = np.concatenate([*removed, by_mask @ bit, by_mask[:, 1 << np.arange(5)], by_mask.sum(1, keepdims=True)], 1)
            for name, row in zip(parts.dictionary.to_pylist(), sums):
                held[name] = held[name] + row if name in held else row
                if len(held) >= PARTS:
                    yield out()
    if held:
        yield out()


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = np.array(ORDERS)
    names = np.repeat(["".join(LETTERS[f] for f in o) for o in ORDERS], 5)
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            v = np.zeros(CELLS, np.int64)
            for x in cells:
                v[x["pos"]] = x["n"]
            removed, good, toxic = (v[i * STEPS : (i + 1) * STEPS].reshape(-1, 6)[:, :5] for i in range(3))
            fails, unique, total = v[3 * STEPS : 3 * STEPS + 5][order], v[3 * STEPS + 5 : -1][order], v[-1]
            shapley = np.bincount(order.ravel(), weights=removed.ravel(), minlength=5).astype(np.int64)[order]
            columns = [total - np.cumsum(removed, 1), removed, fails - removed, unique, good, toxic, shapley]
            head = [pa.array([part] * len(names), pa.string()), pa.array(names.tolist()), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(np.ascontiguousarray(c).ravel()) for c in columns)], names=[f.split()[0] for f in _RESULT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = materialise(own.mapInArrow(_scan, "doc_id long, part string, d1 long, d2 long, mask int"), "audit")
    # both written first: joins of plain exchanges can be split where a text or an id is hot
    first = materialise(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "audit-copies")
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    marked = materialise(marked.filter("good = 1 or toxic = 1"), "audit-labels")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    bits = rows.join(first, ["d1", "d2"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    known = bits.join(marked, "doc_id", "left").select("part", "mask", flag("good"), flag("toxic"))
    partial = known.mapInArrow(_counted, "part string, cells array<long>")
    sums = partial.select("part", F.posexplode("cells").alias("pos", "n")).filter("n <> 0").groupBy("part", "pos").agg(F.sum("n").alias("n"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("pos", "n")).alias("cells")).mapInArrow(_rows, _RESULT)


SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') as ws, coalesce(doc_id > min(doc_id) over (partition by t), false) as copied from d),
f as (select doc_id, part,
        (case when len(ws) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end)
        || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end)
        || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when copied then 'E' else '' end) as fails from w),
l as (select doc_id, max(quality) as q, max(toxic) as x from labels group by doc_id),
g as (select part, fails, count(*) as n, count(*) filter (where q = 1) as good, count(*) filter (where x = 1) as toxic
      from f left join l on f.doc_id = l.doc_id group by part, fails),
v as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from v a, v b, v c, v d, v e
      where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
s as (select filter_order, step, filter_order[step] as letter, left(filter_order, step - 1) as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, letter,
        sum(case when translate(fails, before || letter, '') = fails then n else 0 end) as kept,
        sum(case when contains(fails, letter) and translate(fails, before, '') = fails then n else 0 end) as removed,
        sum(case when contains(fails, letter) and translate(fails, before, '') <> fails then n else 0 end) as redundant,
        sum(case when fails = letter then n else 0 end) as unique_fails,
        sum(case when contains(fails, letter) and translate(fails, before, '') = fails then good else 0 end) as good_lost,
        sum(case when contains(fails, letter) and translate(fails, before, '') = fails then toxic else 0 end) as toxic_lost
      from g, s group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from r
"""
