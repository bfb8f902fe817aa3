"""Substring dedup by super-k-mers: remove words covered by a window that starts anywhere else too.

A window is ``k`` consecutive words of one document. Windows that share their
minimiser (the least hash of an ``m``-word gram in them, leftmost on ties)
form one super-k-mer.

1. One pass writes (minimiser, fingerprint, doc_id, start, windows) per super-k-mer.
2. A window that also starts elsewhere has its minimiser there as well, so
   super-k-mers whose minimiser occurs once go.
3. Of equal super-k-mers one exemplar, with their number, is cut from its text
   as a packed string and travels to its minimiser's bucket; there windows are
   sorted and counted.
4. The repeated windows go back to all occurrences, and each document is cut once.

Hot groups: occurrences of equal strings are counted before they move, so a bucket
gets one string however many copies there are; a minimiser with over ``HOT`` super-k-mers
deals out the windows of its different strings one by one under their own hash, counted before they move, so no
bucket has more strings; joins back to the occurrences have a unique side, written first, which adaptive execution splits.

Edge cases: null, empty and short texts (under ``k`` words) have no window and keep
all their words. An empty table gives an empty table. Extra columns are ignored.
Rows with a null id go. Where ids repeat each row is a document of its own: equal texts repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.llm import textkit as tk
from velonet.llm.store import ids_repeat, materialise, renumbered, settled

_U = np.uint64
#: Super-k-mers of a minimiser up to which its strings are one bucket.
HOT = 4096


def super_kmers(w: tk.Words, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(minimiser hash, fingerprint, first word, number of windows, document) of each super-k-mer."""
    h = w.hashes()
    none = np.zeros(0, np.int64)
    if len(h) < k:
        return none.view(_U), none.view(_U), none, none, none
    n = len(h) - k + 1
    total = np.zeros(len(h) - m + 1, _U)
    for j in range(m):
        total = total * _U(0xD6E8FEB86659FD93) + h[j : j + len(total)]
    gram = tk.mix(total)
    span = k - m + 1
    # upper half: the hash; lower half: the place, so that the leftmost of equal ones is the least
    keyed = (gram & _U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=_U)
    place = (tk.sliding_min(keyed, span)[:n] & _U(0xFFFFFFFF)).astype(np.int64)
    ok = w.doc[:n] == w.doc[k - 1 :]
    at = np.flatnonzero(ok)
    if not len(at):
        return none.view(_U), none.view(_U), none, none, none
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])
    first = np.flatnonzero(cut)
    size = np.diff(np.concatenate([first, [len(at)]]))
    begin = at[first]
    # fingerprint of words begin .. begin + size + k - 2
    grow = np.concatenate([[_U(0)], np.cumsum(h * tk.powers(len(h)), dtype=_U)])
    raw = (grow[begin + size + k - 1] - grow[begin]) * tk.inverse_powers(len(h))[begin]  # the same wherever it starts
    return gram[place[begin]], tk.mix(raw ^ size.astype(_U) * _U(0x9E3779B97F4A7C15)), begin, size, w.doc[begin]


def _narrow(k: int, m: int):
    schema = pa.schema([("h", pa.int64()), ("pid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tk.groups(batches):
            w = tk.Words(texts)
            h, pid, begin, size, doc = super_kmers(w, k, m)
            ids = np.asarray(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h)), pa.array(tk.signed(pid)), pa.array(ids[doc]), pa.array((begin - w.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32))], schema=schema)

    return run


def _packed(k: int):
    schema = pa.schema([("h", pa.int64()), ("pid", pa.int64()), ("c", pa.int64()), ("packed", pa.binary()), ("window", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tk.groups(batches):
            w, hashes = tk.Words(texts), None
            rows: list[tuple] = []
            for d, cuts in enumerate(batch.column("cuts").to_pylist()):
                for x in cuts:
                    i = w.first[d] + x["start"]
                    if not x["hot"]:
                        rows.append((x["h"], x["pid"], x["c"], w.blob[w.start[i] : w.end[i + x["n"] + k - 2]], None, None))
                        continue
                    if hashes is None:
                        gram, at = w.grams(w.hashes(), k)
                        hashes = np.zeros(len(w.start), np.int64)
                        hashes[at] = tk.signed(gram)
                    rows += [(x["h"], x["pid"], x["c"], None, v, j) for j, v in enumerate(hashes[i : i + x["n"]].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return run


def _counted(k: int):
    schema = pa.schema([("h", pa.int64()), ("pid", pa.int64()), ("hits", pa.list_(pa.int32()))])

    def bucket(rows: list[tuple]) -> pa.RecordBatch | None:
        """Rows (h, pid, c, packed) of whole minimisers."""
        if not rows:
            return None
        w = tk.Words([r[3] for r in rows])
        gram, at = w.grams(w.hashes(), k)
        doc = w.doc[at]
        key, c = np.array([r[0] for r in rows], np.int64)[doc], np.array([r[2] for r in rows], np.int64)[doc]
        order = np.lexsort((gram, key))
        g, kk = gram[order], key[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (kk[1:] != kk[:-1])
        run = np.cumsum(new) - 1
        total = np.bincount(run, weights=c[order]).astype(np.int64)
        again = np.zeros(len(g), bool)
        again[order] = total[run] > 1
        hit = np.flatnonzero(again)
        some, counts = np.unique(doc[hit], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), tk.packed_lists((at[hit] - w.first[doc[hit]]).astype(np.int32), counts, pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= tk.GROUP_BYTES and row[0] != held[-1][0]:
                    yield bucket(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield bucket(held)

    return run


def _kept(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def runner(with_text: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in tk.groups(batches):
                w = tk.Words(texts)
                removed, kept, sha = [], [], []
                for d, marks in enumerate(batch.column("marks").to_pylist()):
                    first, n = w.first[d], w.count[d]
                    keep = np.ones(n, bool)
                    if marks:
                        step = np.zeros(n + 1, np.int64)
                        begin = np.concatenate([x["start"] + np.array(x["hits"], np.int64) for x in marks])
                        np.add.at(step, begin, 1)
                        np.add.at(step, begin + k, -1)
                        keep = np.cumsum(step)[:n] == 0
                    at = first + np.flatnonzero(keep)
                    out = b" ".join([w.blob[b:e] for b, e in zip(w.start[at].tolist(), w.end[at].tolist())])
                    removed.append(int(n - len(at)))
                    kept.append(out if with_text else None)
                    sha.append(hashlib.sha256(out).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], schema=schema)

        return run

    return runner


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 3, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): ``kept`` is what is left, words joined by one space (null without ``with_text``)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    if ids_repeat(docs):
        own = renumbered(docs)
        cut = remove_repeats(own, k, m, with_text, hot)
        return cut.join(own.select("doc_id", "own_id"), "doc_id").select(F.col("own_id").alias("doc_id"), *cut.columns[1:])
    narrow = materialise(docs.mapInArrow(_narrow(k, m), "h long, pid long, doc_id long, start int, n int"), "superkmers")
    # written first: a join of two plain exchanges can be split where a minimiser is hot
    often = settled(narrow.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", (F.col("c") > hot).alias("hot")), "superkmers-often")
    alive = settled(narrow.join(often, "h"), "superkmers-alive")
    exemplars = alive.groupBy("h", "pid", "hot").agg(F.min(F.struct("doc_id", "start", "n")).alias("x"), F.count(F.lit(1)).alias("c"))
    cuts = exemplars.groupBy("x.doc_id").agg(F.collect_list(F.struct("x.start", "x.n", "h", "pid", "c", "hot")).alias("cuts"))
    packed = settled(docs.join(cuts, "doc_id").mapInArrow(_packed(k), "h long, pid long, c long, packed binary, window long, at int"), "superkmers-packed")
    met = packed.filter("packed is not null").select("h", "pid", "c", "packed").repartition("h").sortWithinPartitions("h").mapInArrow(_counted(k), "h long, pid long, hits array<int>")
    single = packed.filter("packed is null")
    again = materialise(single.groupBy("h", "window").agg(F.sum("c").alias("s")).filter("s > 1").select("h", "window"), "superkmers-windows")
    apart = single.join(again, ["h", "window"]).groupBy("h", "pid").agg(F.collect_list("at").alias("hits"))
    hits = settled(met.unionByName(apart), "superkmers-hits")
    marks = alive.join(hits, ["h", "pid"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "hits")).alias("marks"))
    return docs.join(marks, "doc_id", "left").mapInArrow(_kept(k)(with_text), "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
