"""Repeated and null ids, very long texts and empty tables; the classifier against plain loops."""

import hashlib
import os
import random
import string
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import docs, pages

from velonet.llm import bm25, bpe, jaccard, linededup, secrets, store, substrings, toxicity, warc
from velonet.llm import textkit as tk


def _text(rng, k):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(k))


def _repeated(spark):
    """Ids 0, 1, 1, 2, 2, 3, null: copies under one id, other texts under one id, and a copy without an id."""
    rng = random.Random(2)
    a, b, c = _text(rng, 90), _text(rng, 80), _text(rng, 70)
    rows = [(0, a), (1, b), (1, b), (2, c), (2, a), (3, None), (None, a)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_repeated_and_null_ids(spark):
    df, rows = _repeated(spark)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == [(0, 86, 0), (1, 76, 1), (1, 76, 1), (2, 66, 2), (2, 86, 0), (3, 0, 3)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [(0, 90, 90), (1, 80, 80), (1, 80, 80), (2, 70, 0), (2, 90, 90), (3, 0, 0)]
    # without ids a row is kept; the copy of document 0's line under id 2 goes, rows of one id and text are one document
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).collect())
    assert got == [(-1, 1, 0), (0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 1), (3, 0, 0)]
    got = {(r.query_id, r.doc_id) for r in bm25.search(df, df.filter("doc_id = 2")).collect()}
    assert got == {(2, 0)}
    keyed = df.withColumn("text", F.concat_ws(" ", "text", F.lit("token=abcdef password=x12345")))
    found = secrets.scan_secrets(keyed, F.lit("r"), F.lit("o")).collect()
    assert len(found) == 6 and all([s.kind for s in r.secrets] == ["assign", "assign"] for r in found)


def test_repeated_pages(spark):
    html = "<p>" + "x" * 1200
    rows = spark.createDataFrame([(1, "http://a/", html), (1, "http://a/", html), (2, "http://b/", html), (2, "http://c/", "small"), (None, "http://d/", html)], "page_id long, url string, html string")
    path = store.new_path(spark, "w")
    warc.write_captures(rows, path)
    got = warc.resolve_revisits(warc.assemble(warc.read_records(spark, path))).collect()
    assert sorted((bytes(r.metadata[0].payload), r.type, r.payload_bytes) for r in got) == [(b"page-id: 1\r\n", "revisit", 1203), (b"page-id: 1\r\n", "revisit", 1203), (b"page-id: 2\r\n", "response", 5), (b"page-id: 2\r\n", "response", 1203)]
    assert all(r.request is not None and len(r.metadata) == 1 for r in got)


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = _text(rng, 16_000)  # 95,999 characters
    cjk = "".join(rng.choices("中文字符测试数据", k=40_000)) + "，" + "".join(rng.choices("中文字符", k=40_000))
    texts = [long, long[:-6] + " other", cjk, "x" * 70_000, None]
    df = docs(spark, texts)
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), digest=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {0: (15_996, 0), 1: (15_996, 0), 2: (1, 2), 3: (1, 3), 4: (0, 4)}
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {0: 15_999, 1: 15_999, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(df).collect()} == dict.fromkeys(range(5), 0)
    page = spark.createDataFrame([(1, "http://a/", long * 12), (2, "http://b/", long * 12)], "page_id long, url string, html string")
    path = store.new_path(spark, "w")
    warc.write_captures(page, path)
    full = warc.resolve_revisits(warc.assemble(warc.read_records(spark, path, with_payload=False))).collect()
    assert [r.payload_bytes for r in full] == [95_999 * 12] * 2 and sorted(r.type for r in full) == ["response", "revisit"]


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    sf = str(tmp_path)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df, rows = _repeated(spark)
    df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    some, none = spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([], kind)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        left[name] = sorted(-1 if r.doc_id is None else r.doc_id for r in stage(spark, some, sf).collect())
    everything = [-1, 0, 1, 1, 2, 2, 3]
    assert left == {"toxicity": everything, "line dedup": [-1, 0, 1, 1, 2, 3], "n-gram Jaccard join": everything, "benchmark decontamination": everything, "byte-level BPE": everything}


def test_gzip_members_are_read_in_one_pass():
    import gzip
    import time

    one = gzip.compress(b"WARC/1.0\r\nContent-Length: 20000\r\n\r\n" + random.Random(1).randbytes(20_000) + b"\r\n\r\n")
    took = []
    for n in (200, 1600):
        began = time.perf_counter()
        assert sum(1 for _ in warc.parse(one * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1


def test_maxima_equal_a_plain_convolution():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), {w: rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}, rng.normal(size=24), 0.3)
    count = np.array([0, 1, 2, 5, 0, 30])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    token = rng.integers(0, toxicity.BUCKETS, (count.sum(), 3)).astype("<u2")
    got = toxicity.maxima(model, token, first, count)
    for d in range(len(count)):
        x = np.array([sum(model.embed[t] for t in token[i]) for i in range(first[d], first[d] + count[d])])
        for k, (w, f) in enumerate(model.filters.items()):
            for c in range(toxicity.FILTERS):
                best = max([0.0] + [sum(float(x[i + o] @ f[o][:, c]) for o in range(w)) for i in range(count[d] - w + 1)])
                assert abs(got[d, k * toxicity.FILTERS + c] - best) < 1e-4


def test_best_cut_equals_trying_every_cut():
    rng = np.random.default_rng(5)
    for _ in range(30):
        y = rng.integers(0, 2, 40)
        s = np.round(rng.normal(size=40) + y, 1)
        f1 = lambda cut: 2 * (y * (s >= cut)).sum() / max(1, (s >= cut).sum() + y.sum())  # noqa: E731, B023
        if y.any() and not y.all():
            assert f1(toxicity.best_cut(s, y)) >= max(f1(c) for c in s) - 1e-9


def test_training_is_bounded_by_characters(spark):
    df = docs(spark, ["vile " * 50 if i % 2 else "fine " * 50 for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels, train_chars=0).weight.tolist() == [0.0] * 24
    few = toxicity.fit(df, labels, train_chars=12_000)
    got = {r.doc_id: r.score for r in toxicity.scores(df, few).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200))


def test_groups_hold_every_text():
    import pyarrow as pa

    texts = ["a" * n for n in (1, 300_000, 5, 0, 130_000, 2)] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [t for _, part in tk.groups(iter([batch])) for t in part] == [t.encode() for t in texts]
    assert all(sum(map(len, part)) <= tk.GROUP_BYTES or len(part) == 1 for _, part in tk.groups(iter([batch])))
    assert pages is not None


def test_training_passes_over_what_does_not_fit():
    """A text over the bound doesn't take those after it along."""
    assert toxicity.fitting(np.array([50, 10, 20, 5, 9]), 40).tolist() == [False, True, True, True, False]
    assert toxicity.fitting(np.array([], np.int64), 40).tolist() == []


def test_thresholds_of_small_languages_lean_on_their_own_rows(spark):
    """Few toxic rows of a language move its threshold, and none leave it at that of all."""
    rng = random.Random(9)
    words = {"en": ["the", "of", "and", "to", "in", "is"], "de": ["der", "die", "und", "das", "ist", "nicht"]}
    rows, marks = [], []
    for i in range(900):
        own, toxic = words["de" if i % 9 == 0 else "en"], i % 6 == 0
        text = rng.choices(own, k=12) + ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(12)] + (["vileword", "hatefulstuff"] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert len(set(model.cut.tolist())) > 1
    held = {r.doc_id: r.score for r in toxicity.scores(df, model).collect()}
    assert sum((held[i] >= 0.5) == bool(t) for i, t in marks) >= 0.97 * len(marks)


def test_all_labels_are_learnt_from(spark):
    """What one shard never sees is learnt all the same: bad words that only a few labels show, spread over many shards; and thresholds count all rows."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        bad = [f"vile{i // 4 % 8}"] * 3 if i % 4 == 0 else []
        rows.append((i, " ".join(["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(12)] + bad), i % 4 == 0))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(t)) for i, _, t in rows], "doc_id long, toxic int")
    models = [toxicity.fit(df.repartition(n), marks, shard_rows=100) for n in (2, 5)]
    assert np.array_equal(models[0].embed, models[1].embed) and np.array_equal(models[0].cut, models[1].cut)
    got = {r.doc_id: r.score for r in toxicity.scores(df, models[0]).collect()}
    assert sum((got[i] >= 0.5) == t for i, _, t in rows) >= 0.97 * len(rows)


def test_toxicity_leaves_no_text_on_the_disks(spark):
    """What training shuffles is small beside the texts, and is given back: neither texts nor the epochs' rows stay."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(60)) + (" vile" if i % 4 == 0 else "")) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 4000, 4)] + [(i, 0) for i in range(1, 2000, 4)], "doc_id long, toxic int")
    files = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before, most = files(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # labels of any size
    try:
        toxicity.fit(df, marks, shard_rows=200)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    left = [f for f in files() - before if "shuffle" in f and os.path.exists(f)]
    assert sum(os.path.getsize(f) for f in left) < sum(len(t) for _, t in rows) / 10


@pytest.mark.parametrize("hot", [0, 1, 5, 10**6])
def test_windows_of_hot_minimisers(spark, hot):
    """Whatever counts as hot, the same words go: many texts around one passage, copies, and runs of one word."""
    rng = random.Random(4)
    word = lambda n: ["".join(rng.choices("abcdef", k=2)) for _ in range(n)]
    passage = word(12)
    texts = [" ".join(word(rng.randrange(0, 9)) + passage[rng.randrange(3) : rng.randrange(9, 13)] + word(rng.randrange(0, 9))) for _ in range(80)]
    texts += texts[:7] + ["la " * 30, "la " * 9, " ".join(passage)]
    k, w = 6, [t.split() for t in texts]
    seen = Counter(tuple(x[i : i + k]) for x in w for i in range(len(x) - k + 1))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs(spark, texts), k, 2, hot=hot).collect()}
    assert got == {d: (len(x), len({j for i in range(len(x) - k + 1) if seen[tuple(x[i : i + k])] > 1 for j in range(i, i + k)})) for d, x in enumerate(w)}
