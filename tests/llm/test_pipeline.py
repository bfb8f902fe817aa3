"""The pipeline's stages against brute force, each on what the one before it kept."""

import hashlib
import random
import string

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from test_operators import jaccard_truth, line_windows

from velonet.llm import bpe, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    vocab = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    item = text(40)
    rows = []
    for i in range(500):
        t = text(rng.choice([8, 60, 150]))
        if rng.random() < 0.15:
            t = t.replace(" ", " vilestum ", 1)
        rows.append(t)
    clean = [t for t in rows if "vilest" not in t and len(t) > 700]
    block = "\n".join(text(9) for _ in range(4))
    near = clean[0].split(" ")
    near[50] = "changed"
    rows += [clean[0], " ".join(near), text(30) + "\n" + block, block + "\n" + text(25), text(30) + " " + item + " " + text(30), item.replace(" ", " , ", 3), None, "", block]
    docs = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("vilest" in (t or ""))) for i, t in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        assert k == 4 or out.columns == now.columns
        out.write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        kept.append({r.doc_id: r for r in now.collect()})

    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.scores(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    assert set(kept[0]) == {d for d, s in score.items() if s < 0.5}
    toxic = {i for i, t in enumerate(rows) if "vilest" in (t or "")}
    assert len(set(kept[0]) & toxic) <= 0.05 * len(toxic) and len(set(range(len(rows))) - toxic - set(kept[0])) <= 5

    seen, want = set(), {}
    for d in sorted(kept[0]):
        t = kept[0][d].text
        lines = (t or "").split("\n")
        gone = line_windows(lines, seen) if t is not None else set()
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            want[d] = None if t is None else left
    assert {d: r.text for d, r in kept[1].items()} == want and len(rows) - 1 not in want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept[1].values())

    ids = sorted(kept[1])
    truth = jaccard_truth([kept[1][d].text for d in ids], 5, 80)
    assert set(kept[2]) == {ids[i] for i, (_, root) in truth.items() if root == i}
    assert 500 not in kept[2] and 501 not in kept[2]
    assert set(kept[2]) - set(kept[3]) == {504, 505}

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoder(path, P.PATTERN)
    assert set(kept[4]) == set(kept[3])
    for d, r in kept[4].items():
        t = kept[3][d].text or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()}
    assert whole == {d: r.ids_sha256 for d, r in kept[4].items()}
