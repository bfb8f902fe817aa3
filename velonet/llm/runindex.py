"""Byte-level dedup with a run-length index: remove bytes of strings that also start earlier.

A window is ``k`` bytes of one document; it goes if an equal one starts earlier (smaller doc_id, or same document,
earlier start). Equal windows have the same minimiser (the least hash of the ``gram``-byte strings in them, leftmost on
ties), so consecutive windows that share one travel as one string and equal windows meet under it.

1. Minimisers are counted; only strings of minimisers that occur again are looked at.
2. Of equal strings the first stays, with the number of different strings of its minimiser; all others go whole.
3. Different strings of one minimiser are packed from their texts and meet in a bucket. ``RunIndex`` makes the
   run-compressed Burrows-Wheeler transform of a bucket's strings in contexts of ``k`` bytes, equal contexts in order of
   (doc_id, start), and samples the place where each run of equal contexts begins: their earliest one. Then every string is
   streamed backwards through the index, a byte a step: its matching statistic reaches ``k`` at an earlier place or not.
4. The marks of a document meet its text, which is cut once.

Hot groups: equal strings are counted before they move and joins have sides written first, so a hot one can be split. A minimiser
with over ``HOT`` different strings deals out their windows one by one under their own hash, counted before they
move: a bucket is never larger than ``BUCKET`` and ``HOT`` strings.

Strings are compared byte by byte in buckets, under 128 bits of two hashes before. Edge cases: null texts are empty;
texts shorter than ``k`` bytes have no window and stay whole; very long texts are taken in pieces of ``PIECE`` bytes. Rows with a null id go.
Where ids repeat each row is a document, in order of (doc_id, SHA-256 of the text). An empty table gives an empty table.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.llm import idfilter, store
from velonet.llm import textkit as tk
from velonet.llm.store import materialise, settled
from velonet.operators.network import number_rows

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
PIECE = 1 << 20
#: Bytes after which a bucket is closed, different strings of a minimiser up to which it is one bucket, bits of a place in it.
BUCKET, HOT, BITS = 1 << 19, 2048, 20


class Grams:
    """Hashes of a group of texts: of all strings of one length, and of any string by its ends."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\0".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.cumsum(self.size + 1) - self.size - 1
        self.byte = tk._BYTE[self.raw]
        self._sums = None

    def rolling(self, length: int) -> np.ndarray:
        """A hash of each ``length`` consecutive bytes, ``length`` a power of two."""
        now, have, step = self.byte, 1, _BASE
        while have < length:
            now = now[:-have] * _U(step) + now[have:] if len(now) > have else now[:0]
            have, step = 2 * have, step * step & 0xFFFFFFFFFFFFFFFF
        return tk.mix(now)

    def strings(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the string at each place, wherever it stands."""
        if self._sums is None:
            self._sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.byte * tk.powers(len(self.byte)), dtype=_U)])
        raw = (self._sums[begin + length] - self._sums[begin]) * tk.inverse_powers(len(self.byte) + 1)[begin]
        return tk.mix(raw ^ length.astype(_U) * _U(0x9E3779B97F4A7C15))


def super_strings(g: Grams, k: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimiser, first place, windows, text) of each longest run of windows that share a minimiser's place."""
    none = np.zeros(0, np.int64)
    inside = [np.arange(b, b + n - k + 1) for b, n in zip(g.base.tolist(), g.size.tolist()) if n >= k]
    if not inside:
        return none.view(_U), none, none, none
    at = np.concatenate(inside)
    hashes = g.rolling(gram)
    # upper half: the hash; lower half: the place, so that the leftmost of equal ones is the least
    keyed = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=_U)
    place = (tk.sliding_min(keyed, k - gram + 1)[at] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])]))
    return hashes[place[first]], at[first], np.diff(np.append(first, len(at))), np.searchsorted(g.base, at[first], "right") - 1


def _pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, Grams]]:
    """(doc_id, start in the document, Grams) of texts and pieces; pieces overlap so that each window is in one."""
    for batch, texts in tk.groups(batches):
        ids = np.asarray(batch.column("doc_id"))
        if len(texts) > 1 or len(texts[0]) <= PIECE:
            yield ids, np.zeros(len(ids), np.int64), Grams(texts)
            continue
        for at in range(0, len(texts[0]) - k + 1, PIECE):
            yield ids, np.array([at]), Grams([texts[0][at : at + PIECE + k - 1]])


def _minimisers(k: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, g in _pieces(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(super_strings(g, k, gram)[0]))], names=["h"])

    return run


_NARROW = "h long, pid long, doc_id long, start long, n int"


def _alive(k: int, gram: int, box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offset, g in _pieces(batches, k):
            h, at, n, text = super_strings(g, k, gram)
            ok = idfilter.passes(box.value, tk.signed(h)) if len(h) else np.zeros(0, bool)
            h, at, n, text = h[ok], at[ok], n[ok], text[ok]
            pid = g.strings(at, n + k - 1) if len(at) else h
            columns = (tk.signed(h), tk.signed(pid), ids[text], at - g.base[text] + offset[text], n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "pid", "doc_id", "start", "n"])

    return run


def _packed(k: int, hot: int):
    schema = pa.schema([("h", pa.int64()), ("pid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tk.groups(batches):
            rows: list[tuple] = []
            for doc_id, text, cuts in zip(batch.column("doc_id").to_pylist(), texts, batch.column("cuts").to_pylist()):
                for x in cuts:
                    string = text[x["start"] : x["start"] + x["n"] + k - 1]
                    if x["strings"] <= hot:
                        rows.append((x["h"], 0, doc_id, x["start"], x["n"], string))
                        continue
                    windows = np.arange(x["n"])
                    for i, pid in enumerate(tk.signed(Grams([string]).strings(windows, np.full(len(windows), k))).tolist()):
                        rows.append((x["h"], pid, doc_id, x["start"] + i, 1, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return run


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, in contexts of ``k`` symbols, of equal contexts the earliest first.

    Kept: the transform's runs in order of (symbol, place) with where each leads, the bounds of contexts of ``k`` - 1 symbols that
    occur again, where the first place of each context of ``k`` that occurs again is, and each string's last place.
    """

    def __init__(self, strings: list[bytes], k: int):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[np.cumsum(size + 1) - 1] = 0  # ends
        self.k, self.symbols, self.begin, self.windows = k, symbols, np.cumsum(size + 1) - size - 1, size - k + 1
        n = len(symbols)
        if n >= 1 << BITS or k < 5:
            raise ValueError("too many bytes for one index, or too short a context")

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([x[by:], np.zeros(min(by, n), np.int64)])

        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places in order of ``key`` (then of place), where a new key begins, and each place's rank from 1."""
            both = key << BITS | np.arange(n)
            both.sort()
            place, key = both & ((1 << BITS) - 1), both >> BITS
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank = np.empty(n, np.int64)
            rank[place] = np.cumsum(new)
            return place, new, rank

        rank = ranked(symbols << 27 | shifted(symbols, 1) << 18 | shifted(symbols, 2) << 9 | shifted(symbols, 3))[2]
        have = 4
        while 2 * have < k:
            rank, have = ranked(rank << BITS | shifted(rank, have))[2], 2 * have
        place, new, _ = ranked(rank << BITS | shifted(rank, k - have))
        tail = shifted(rank, k - 1 - have)[place]
        head = rank[place]
        wide = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])  # a new context of k - 1

        before = symbols[place - 1]
        run = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        order = np.argsort(before[run], kind="stable")
        length = np.diff(np.append(run, n))[order]
        self.key, self.length = (before[run] << BITS | run)[order], length
        self.leads = np.cumsum(length) - length
        self.low, self.high = self._again(wide)
        self.first = self._again(new)[0]
        self.earliest = place[self.first]
        spot = np.empty(n, np.int64)
        spot[place] = np.arange(n)
        self.last = spot[self.begin + self.windows]  # the last k - 1 symbols of each string

    @staticmethod
    def _again(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the stretches of two or more."""
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(new))
        many = end - at > 1
        return at[many], end[many]

    def leading(self, symbol: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """Where the contexts that begin with ``symbol`` and go on like those before ``spot`` end."""
        key = symbol << BITS | spot
        run = np.searchsorted(self.key, key) - 1
        return np.where(run < 0, 0, self.leads[run] + np.minimum(key - self.key[run], self.length[run]))

    def context(self, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch that shares the first ``k`` - 1 symbols of ``spot``."""
        if not len(self.low):
            return spot, spot + 1
        at = np.searchsorted(self.low, spot, "right") - 1
        inside = (at >= 0) & (spot < self.high[at])
        return np.where(inside, self.low[at], spot), np.where(inside, self.high[at], spot + 1)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, window) of every window that starts at an earlier place of the strings, too."""
        order = np.argsort(-self.windows, kind="stable")
        left = self.windows[order]
        low, high = self.context(self.last[order])
        strings, windows = [], []
        for step in range(1, int(left[0]) + 1 if len(left) else 1):
            n = int(np.searchsorted(-left, -step, "right"))  # strings with so many windows
            place = self.begin[order[:n]] + left[:n] - step
            symbol = self.symbols[place]
            spot, end = self.leading(symbol, low[:n]), self.leading(symbol, high[:n])
            many = np.flatnonzero(end - spot > 1)
            hit = many[self.earliest[np.searchsorted(self.first, spot[many])] < place[many]]
            strings.append(order[hit])
            windows.append(left[hit] - step)
            low, high = self.context(spot)
        return (np.concatenate(strings), np.concatenate(windows)) if strings else (order[:0], order[:0])


def runs(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, length) of the longest runs of consecutive numbers in each group."""
    order = np.lexsort((at, group))
    group, at = group[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
    return group[new], at[new], np.diff(np.append(new, len(at)))


_MARKS = "doc_id long, start long, n int"


def _indexed(k: int):
    def bucket(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (doc_id, start, packed) of whole minimisers, in order."""
        string, first, n = runs(*RunIndex([r[2] for r in rows], k).stream())
        ids, start = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids[string]), pa.array(start[string] + first), pa.array(n.astype(np.int32))], names=["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "start", "packed"))):
                if size >= BUCKET and h != last:
                    yield bucket(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[2]) + 1, h
        if held:
            yield bucket(held)

    return run


def _kept(k: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tk.groups(batches):
            removed, spans, kept, sha = [], [], [], []
            marks = batch.column("marks")
            for text, own in zip(texts, (marks.slice(i, 1) for i in range(len(texts)))):
                gone, n, left = 0, 0, text
                if own[0].is_valid:
                    flat = own.flatten()
                    start, many = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "n"))
                    step = np.zeros(len(text) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + many + k - 1, -1)
                    out = np.cumsum(step)[:-1] > 0
                    gone, n = int(out.sum()), int((np.diff(out.astype(np.int8), prepend=0) == 1).sum())
                    left = np.frombuffer(text, np.uint8)[~out].tobytes()
                removed.append(gone)
                spans.append(n)
                kept.append(left if with_text else None)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, k: int = 100, gram: int = 16, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): ``kept`` is what is left (null without ``with_text``).

    ``gram`` is a power of two, at most ``k``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    spark: SparkSession = docs.sparkSession
    if store.ids_repeat(docs):
        own = number_rows(docs.withColumn("own_id", F.col("doc_id")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), ["own_id", "digest"], "n")
        own = materialise(own.select(F.col("n").alias("doc_id"), "own_id", "text"), "runindex-numbered")
        cut = remove_repeats(own, k, gram, with_text, hot)
        return cut.join(own.select("doc_id", "own_id"), "doc_id").select(F.col("own_id").alias("doc_id"), *cut.columns[1:])
    mark = store.made()
    often = docs.mapInArrow(_minimisers(k, gram), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    box = spark.sparkContext.broadcast(idfilter.build(settled(often, "runindex-often")))
    alive = materialise(docs.mapInArrow(_alive(k, gram, box), _NARROW), "runindex-alive")
    strings = alive.groupBy("h", "pid").agg(F.min(F.struct("doc_id", "start", "n")).alias("first"), F.count(F.lit(1)).alias("c"))
    strings = settled(strings.select("h", "pid", "first.*", "c"), "runindex-strings")
    again = materialise(strings.filter("c > 1").select("h", "pid", F.col("doc_id").alias("first_id"), F.col("start").alias("first_start")), "runindex-again")
    many = settled(strings.groupBy("h").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1"), "runindex-many")
    whole = alive.join(again, ["h", "pid"]).filter("doc_id <> first_id or start <> first_start").select("doc_id", "start", "n")
    cuts = strings.join(many, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "strings")).alias("cuts"))
    packed = settled(docs.join(cuts, "doc_id").mapInArrow(_packed(k, hot), "h long, pid long, doc_id long, start long, n int, packed binary"), "runindex-packed")
    met = packed.filter("packed is not null").repartition("h").sortWithinPartitions("h", "doc_id", "start").mapInArrow(_indexed(k), _MARKS)
    single = packed.filter("packed is null").drop("packed")
    first = materialise(single.groupBy("h", "pid").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "pid", F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start")), "runindex-windows")
    windows = single.join(first, ["h", "pid"]).filter("doc_id <> first_id or start <> first_start").select("doc_id", "start", "n")
    marks = settled(whole.unionByName(met).unionByName(windows), "runindex-marks")
    store.clear(spark, mark)
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return docs.join(marks, "doc_id", "left").mapInArrow(_kept(k, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select doc_id, c, substring(x, 2 * c + 1, 2 * 599) as y from (select doc_id, x, unnest(generate_series(0, len(x) // 2 - 100, 500)) as c from d where len(x) >= 200)),
o as (select doc_id, c, y, unnest(generate_series(0, least(499, len(y) // 2 - 100))) as i from p),
k as (select doc_id, c + i as start, substring(y, 2 * i + 1, 200) as w from o),
r as (select doc_id, start, row_number() over (partition by w order by doc_id, start) as n from k),
m as (select doc_id, start, start - lag(start) over (partition by doc_id order by start) as gap from r where n > 1),
b as (select doc_id, start, sum(case when gap <= 100 then 0 else 1 end) over (partition by doc_id order by start) as span from m),
s as (select doc_id, span, min(start) as a, max(start) + 100 as e from b group by doc_id, span),
t as (select d.doc_id, x, coalesce(sum(e - a), 0) as gone, count(a) as spans, list(a order by a) filter (where a is not null) as begins, list(e order by a) filter (where a is not null) as ends
      from d left join s on d.doc_id = s.doc_id group by d.doc_id, x),
c as (select *, case when spans = 0 then x else list_aggregate(list_transform(generate_series(0, spans),
        lambda i: substring(x, 2 * (case when i = 0 then 0 else ends[i] end) + 1, 2 * ((case when i = spans then len(x) // 2 else begins[i + 1] end) - (case when i = 0 then 0 else ends[i] end)))), 'string_agg', '') end as rest from t)
select doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(gone as bigint) as n_removed, cast(spans as bigint) as n_spans, sha256(unhex(rest)) as kept_sha256
from c
"""
