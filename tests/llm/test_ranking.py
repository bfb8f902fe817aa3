"""Ranked search against plain loops over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
from test_operators import corpus, docs

from velonet.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(rows, items, k=10):
    """rows and items as lists of (id, text); sorted (item, rank, doc_id, score)."""
    own = [(d, Counter(terms(t))) for d, t in rows]
    own = [(d, c) for d, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in own:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def asked(rng, texts):
    some = [t for t in texts if t and len(terms(t)) > 3]
    out = [" ".join(rng.choices(terms(rng.choice(some)), k=8)) for _ in range(25)]
    return list(enumerate(out + [None, "", "...", "NOTHING-like_this", "ÜBER über Über", some[0].upper(), out[0]]))


def test_ranks(spark):
    rng = random.Random(6)
    texts = [*corpus(6), "über ÜBER Straße", "a1b2-c3", "\x80é ñ", *["same words here"] * 30]
    items = asked(rng, texts)
    rows = list(enumerate(texts)) + [(None, texts[10]), (3, texts[9])]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, n int, item int, score int")
    got = sorted(map(tuple, ranking.search(df.repartition(7), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == brute(rows, items) and len(got) > 200


def test_blocks_and_small_arrays(spark, monkeypatch):
    """Several blocks of items; arrays of a few rows at a time."""
    rng = random.Random(7)
    texts = corpus(7)
    items = asked(rng, texts)
    monkeypatch.setattr(ranking, "MAX_WORDS", 40)
    got = sorted(map(tuple, ranking.search(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), k=3).collect()))
    assert got == brute(list(enumerate(texts)), items, 3)


def test_radix_order_and_heaps():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 16, 1 << 20, 1 << 40):
        key = rng.integers(0, top, 5000)
        assert (ranking.radix_order(key, top) == np.argsort(key, kind="stable")).all()
    heaps, rows = ranking.Heaps(3, 4), []
    for _ in range(6):
        item = np.sort(rng.integers(0, 3, 40))
        doc, score = rng.integers(0, 1000, 40), rng.integers(-1, 6, 40)
        heaps.add(item, doc, score)
        rows += zip(item.tolist(), doc.tolist(), score.tolist())
    for i in range(3):
        assert sorted(heaps.heap[i], reverse=True) == sorted(((s, -d) for j, d, s in rows if j == i and s > 0), reverse=True)[:4]


def test_no_documents_no_items(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([(1, "word"), (None, "word")], "item_id long, text string")
    assert ranking.search(none, items).count() == 0
    assert ranking.search(docs(spark, ["word", None]), items).count() == 1
    assert ranking.search(docs(spark, ["word"]), items.filter("item_id is null")).count() == 0
