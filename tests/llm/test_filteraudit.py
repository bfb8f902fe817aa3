"""The audit against running every order of the filters, document by document."""

import random
from collections import Counter
from itertools import permutations

from test_operators import corpus

from velonet.llm import filteraudit

SCHEMA = "doc_id long, lang string, text string, part string, mask int, first long, good int"


def brute(rows, labels):
    """rows (doc_id, lang, text); {(part, order, step): counts}."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    judged = {}
    for d, lang, t in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        judged.setdefault(lang or "", []).append((d, {f for f, x in fails.items() if x}))
    out = {}
    for part, docs in judged.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in x for _, x in docs)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x == {f} for _, x in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def case(seed):
    rng = random.Random(seed)
    texts = corpus(seed) + ["WORD " * 250, "a b # c", "Ä É", "$" + "word " * 199, "é" * 50 + "AA", "x " * 400]
    texts += [" ".join(str(rng.random()) for _ in range(300)) for _ in range(5)]
    texts += rng.sample(texts, 30)
    rows = [(rng.choice([i, i, i, i // 2]), rng.choice(["en", "de", "", None, "x|y"]), t) for i, t in enumerate(texts)] + [(None, "en", texts[8]), (None, "en", None)]
    labels = [(rng.randrange(len(texts)), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    return rows, labels


def test_all_orders(spark):
    rows, labels = case(4)
    df = spark.createDataFrame([(d, lang, t, "p", 1, 2, 3) for d, lang, t in rows], SCHEMA).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(df, marks).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert list(r)[3:] == want[r.part, r.filter_order, r.step], r
    seen = {tuple(x) for x in want.values()}
    assert all(any(x[i] for x in seen) for i in range(7))


def test_more_parts_than_a_task_holds(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(filteraudit, "PARTS", 3)
    n = 40
    batch = pa.RecordBatch.from_arrays([pa.array([str(i % 7) for i in range(n)]), pa.array([i % 32 for i in range(n)], pa.int32()), pa.array([i % 2 for i in range(n)], pa.int32()), pa.array([0] * n, pa.int32())], names=["part", "mask", "good", "toxic"])
    total = Counter()
    for out in filteraudit._counted(iter([batch, batch])):
        assert out.num_rows <= 3
        for part, cells in zip(*(c.to_pylist() for c in out.columns)):
            total[part] += cells[-1]
    assert total == Counter({str(j): 2 * len(range(j, n, 7)) for j in range(7)})


def test_empty(spark):
    assert filteraudit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert filteraudit.audit(spark.createDataFrame([(1, None, None, "", 0, 0, 0)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 600
