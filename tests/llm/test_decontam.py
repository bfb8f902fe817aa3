"""Leaks that no seed may be too frequent or too far away to find."""

import random
import string

import pyarrow as pa
import pytest
from test_operators import docs

from velonet.llm import decontam


def _item(seed, k=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(k)]


def _found(spark, texts, *items):
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(spark, texts), table).collect()}


def test_a_crowd_of_edited_copies_beside_one_verbatim(spark):
    item, other = _item(1), _item(2)
    edited = item[:20] + ["changed"] + item[21:]
    texts = [" ".join(_item(100 + i, 30) + edited + _item(200 + i, 30)) for i in range(100)] + [" ".join(item)]
    texts.append(" ".join(_item(3, 100) + item[18:22] + _item(4, 100)))  # one gram across the changed word
    texts.append(" ".join(item[18:22] + _item(5, 300) + edited))  # a rare gram far from the copy
    got = _found(spark, texts, item, other)
    assert set(got) == {(d, 0) for d in (*range(101), 102)}
    assert all(got[d, 0].score == pytest.approx((39 * 2 - 1) / 80) and got[d, 0].begin == 30 for d in range(100)) and got[100, 0].score == 1
    assert (got[102, 0].begin, got[102, 0].end) == (304, 344)


def test_a_gram_that_many_items_share(spark):
    head = _item(6, 8)
    items = [head + _item(300 + i, 20) for i in range(30)]
    texts = [" ".join(x) for x in items] + [" ".join(head + _item(7, 50))]
    got = _found(spark, texts, *items)
    assert set(got) == {(i, i) for i in range(30)} and all(r.score == 1 for r in got.values())


def _edit(rng, words, rate):
    out = []
    for w in words:
        what = rng.random()
        if what < rate / 3:
            continue
        out.append("".join(rng.choices(string.ascii_lowercase, k=5)) if what < 2 * rate / 3 else w)
        if what > 1 - rate / 3:
            out.append("put")
    return out


def test_equals_aligning_every_document_with_every_item():
    """Edits of 5 to 60 % of the words, regular ones too, in items that share many words."""
    rng = random.Random(12)
    vocab = ["the", "of", "and", "a", "to"] * 12 + ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(120)]
    items = [rng.choices(vocab, k=k) for k in (1, 2, 3, 5, 8, 11, 12, 15, 20, 25, 30, 40, 40, 40, 59)]
    texts = []
    for x in items:
        for rate in (0.05, 0.15, 0.3, 0.45, 0.6):
            texts.append(rng.choices(vocab, k=rng.randrange(60)) + _edit(rng, x, rate) + rng.choices(vocab, k=rng.randrange(60)))
        texts.append([w if i % 4 else "changed" for i, w in enumerate(x)])
        texts.append([w for i, x_ in enumerate(x) for w in ([x_] if i % 3 else [x_, "put"])])
    coded = decontam.Items.of([(i, " ".join(x).encode()) for i, x in enumerate(items)], 0.55)
    w, h = decontam.folded_words([" ".join(t).encode() for t in texts])
    want = {}
    for d in range(len(texts)):
        for k, x in enumerate(coded.words):
            score = decontam.align(x, h[w.first[d] : w.first[d] + w.count[d]])[0] / (2 * len(x))
            if score >= 0.55:
                want[d, k] = round(score, 6)

    class Box:
        value = coded

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([" ".join(t) for t in texts])], names=["doc_id", "text"])
    got = {(r["doc_id"], r["item_id"]): r["score"] for out in decontam._aligned(Box, 0.55)(iter([batch])) for r in out.to_pylist()}
    assert got == want and len({k for _, k in want}) == len(items) and 0.6 < min(s for s in want.values() if s > 0.6) < 0.7
