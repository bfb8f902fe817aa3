"""Byte windows against brute force: the index alone, the operator with and without hot minimisers, edges."""

import hashlib
import random

import numpy as np
import pytest
from test_operators import corpus, docs

from velonet.llm import runindex


def brute(texts, k):
    """texts in order of documents; (bytes, removed, spans, kept) of each."""
    seen, out = set(), []
    for t in texts:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if t[i : i + k] in seen:
                gone[i : i + k] = True
            seen.add(t[i : i + k])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("k", [5, 8, 9, 16, 33])
def test_index_names_every_window_that_starts_earlier(k):
    rng = random.Random(k)
    for letters in ("ab", "abcdefgh\0", "a"):
        strings = ["".join(rng.choices(letters, k=rng.randrange(k, 3 * k))).encode() for _ in range(60)]
        strings += rng.sample(strings, 5) + [strings[0] + strings[1]]
        seen, want = set(), set()
        for i, s in enumerate(strings):
            for j in range(len(s) - k + 1):
                if s[j : j + k] in seen:
                    want.add((i, j))
                seen.add(s[j : j + k])
        got = runindex.RunIndex(strings, k).stream()
        assert set(zip(*(x.tolist() for x in got))) == want and len(got[0]) == len(want)


def test_runs_are_few_where_strings_repeat():
    rng = random.Random(0)
    one = "".join(rng.choices("abcdefgh", k=300)).encode()
    few, many = (runindex.RunIndex([one] * n, 100) for n in (2, 50))
    assert len(many.key) < 1.2 * len(few.key)


@pytest.mark.parametrize(("k", "gram", "hot"), [(100, 16, runindex.HOT), (100, 16, 2), (24, 8, 1), (8, 8, 3)])
def test_operator(spark, k, gram, hot):
    texts = [*corpus(5), "a" * 400, "ab" * 150, "a" * 130, "ü" * 90, "x\0y" * 60]
    got = {r.doc_id: r for r in runindex.remove_repeats(docs(spark, texts), k, gram, hot=hot).collect()}
    assert len(got) == len(texts)
    for d, want in enumerate(brute(texts, k)):
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, bytes(got[d].kept)) == want
        assert got[d].kept_sha256 == hashlib.sha256(want[3]).hexdigest()


def test_pieces_and_closed_buckets(spark, monkeypatch):
    """Long texts in pieces, and several buckets a task: rules of the driver's process, so functions are called directly."""
    import pyarrow as pa

    monkeypatch.setattr(runindex, "PIECE", 700)
    rng = random.Random(1)
    text = "".join(rng.choices("abcd ", k=5000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], names=["doc_id", "text"])
    covered = set()
    for ids, offset, g in runindex._pieces(iter([batch]), 100):
        _, at, n, doc = runindex.super_strings(g, 100, 16)
        for a, m in zip((at - g.base[doc] + offset[doc]).tolist(), n.tolist()):
            assert not covered & set(range(a, a + m))
            covered |= set(range(a, a + m))
    assert covered == set(range(4901))
    monkeypatch.setattr(runindex, "BUCKET", 500)
    strings = [(h, d, 10 * d, ("%d" % h).encode() * 60) for h in range(1, 6) for d in range(3)]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*strings)], names=["h", "doc_id", "start", "packed"])
    found = [r for b in runindex._indexed(50)(iter([rows])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted({d for d, _, _ in found}) == [0, 1, 2] and sum(n for d, _, n in found if d == 1) == 5 * 11 == sum(n for d, _, n in found if d == 2)


def test_null_and_repeated_ids_and_empty(spark):
    a, b = ("".join(random.Random(i).choices("abcdefgh ", k=150)) for i in (1, 2))
    df = spark.createDataFrame([(5, a), (5, a), (3, a + b), (None, b), (9, None), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in runindex.remove_repeats(df).collect())
    assert got == [(3, 300, 0, 0), (5, 150, 150, 1), (5, 150, 150, 1), (9, 0, 0, 0), (9, 0, 0, 0)]
    assert runindex.remove_repeats(df.filter("doc_id is null")).count() == 0
