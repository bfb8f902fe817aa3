"""Toxicity: a convolutional text classifier trained in numpy.

Words (A-Z lower-cased, outer ASCII punctuation dropped) are embedded as the sum of three hashed
units: the word, its first 4 and its first 6 bytes, so inflected forms share what they learn;
filters of widths 1, 2 and 3 slide over the whole text, each keeps its maximum, and a
logistic layer reads the maxima. All labelled rows are trained on, by the tasks: in each epoch they are dealt anew into shards
of about ``SHARD_ROWS``, each shard goes on from the same parameters, and what the shards make of them is averaged (an embedding over
those that met its bucket). Only parameters and counts reach the driver. Texts of labelled rows, which a filter of their ids picks, travel as two-byte
bucket numbers, three a word; texts themselves never do, and what an epoch shuffles is given back when it ends. Embeddings start small and random but for one component, the unit's log-odds
z-score between toxic and other training documents, which breaks the symmetry.

Thresholds are calibrated by language on all labelled rows of the fold not trained on, from counts by thousandths of a logit. The language is guessed from the
text itself (function words), so labels, lang, source and doc_id never enter a score; the
threshold is subtracted before the logistic function, so 0.5 is the cut in every language.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out from both.

Edge cases: null and empty texts and texts without words get the score of no evidence (all
maxima 0). Without labels of both kinds the score is the share of toxic labels (0 without
labels). Null labels are ignored; of repeated labels of a document the largest counts. Repeated rows are scored each.
Empty tables give an empty table. Extra columns are kept by ``reject`` and ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velonet.llm import idfilter, store
from velonet.llm import textkit as tk

#: Labelled rows, and bytes of their bucket numbers, of a shard.
SHARD_ROWS, SHARD_BYTES = 12_000, 64_000_000
#: Parameters are averaged as whole numbers of this part, so that the order of adding them up makes no difference.
PART = 2.0**-36
#: Toxic calibration rows that the common threshold counts as, beside those of a language.
SHRINK = 2
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIXES, EPOCHS, BATCH, SEED = (4, 6), 5, 64, 7
#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "that", "with"],
    "de": ["der", "die", "und", "das", "zu", "den"],
    "fr": ["le", "la", "et", "les", "des", "du"],
    "es": ["el", "los", "que", "del", "y", "las"],
}
_U = np.uint64


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS x DIM
    filters: dict[int, np.ndarray]  # width -> width x DIM x FILTERS
    weight: np.ndarray
    bias: float
    cut: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))  # by language, the last for none

    def stacked(self) -> np.ndarray:
        """All filters' weights at all offsets side by side: one product scores every word."""
        return np.concatenate([f[o] for f in self.filters.values() for o in range(len(f))], 1)


def units(w: tk.Words, h: np.ndarray) -> np.ndarray:
    """Bucket numbers, words x 3."""
    salted = [h, *(w.hashes(lower=True, limit=n) ^ _U(n) for n in PREFIXES)]
    return np.stack([(tk.mix(x) & _U(BUCKETS - 1)).astype("<u2") for x in salted], 1)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    flat = [(w.encode(), i) for i, words in enumerate(FUNCTION_WORDS.values()) for w in words]
    h = tk.plain_words([b" ".join(w for w, _ in flat)])[1]
    order = np.argsort(h)
    return h[order], np.array([i for _, i in flat])[order]


def languages(w: tk.Words, h: np.ndarray) -> np.ndarray:
    """The language with most function words of each document, the last number for none."""
    known, lang = _language_table()
    n = len(FUNCTION_WORDS)
    if not len(h):
        return np.full(len(w.count), n)
    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[spot] == h)
    votes = np.bincount(w.doc[hit] * n + lang[spot[hit]], minlength=len(w.count) * n).reshape(-1, n)
    return np.where(votes.max(1) > 0, votes.argmax(1), n)


def maxima(model: Model, token: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Documents x (widths x filters): each filter's largest response, at least 0; 0 where a text is shorter than the filter."""
    x = model.embed[token[:, 0]]
    for c in range(1, token.shape[1]):
        x = x + model.embed[token[:, c]]
    response, at, out = x @ model.stacked(), 0, []
    for w in model.filters:
        best = np.zeros((len(count), FILTERS), np.float32)
        inside = np.flatnonzero(count >= w)
        if len(inside):
            n = len(token) - w + 1
            total = response[:n, at * FILTERS : (at + 1) * FILTERS].copy()
            for o in range(1, w):
                total += response[o : o + n, (at + o) * FILTERS : (at + o + 1) * FILTERS]
            # windows of a document: from its first word to the last that leaves room for the filter
            edges = np.stack([first[inside], first[inside] + count[inside] - w + 1], 1).ravel()
            total = np.vstack([total, np.zeros((1, FILTERS), np.float32)])
            best[inside] = np.maximum(np.maximum.reduceat(total, edges, axis=0)[::2], 0)
        out.append(best)
        at += w
    return np.concatenate(out, 1)


@dataclass
class State:
    """Parameters in training, and the squared gradients that they have seen."""

    embed: np.ndarray  # BUCKETS x (DIM + 1), the last is the bucket's squares
    rest: np.ndarray  # filters, weight and bias
    squares: np.ndarray  # of the rest

    def parts(self, flat: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Views of the filters, weights and bias of ``rest`` or ``squares``."""
        filters, at = {}, 0
        for w in WIDTHS:
            n = w * DIM * FILTERS
            filters[w], at = flat[at : at + n].reshape(w, DIM, FILTERS), at + n
        return filters, flat[at:-1], flat[-1:]

    def packed(self) -> np.ndarray:
        """Everything in rows of DIM + 1, the embeddings first."""
        more = np.concatenate([self.rest, self.squares])
        return np.vstack([self.embed, np.append(more, np.zeros(-len(more) % (DIM + 1))).reshape(-1, DIM + 1)])

    def unpacked(self, table: np.ndarray) -> State:
        more, n = table[BUCKETS:].ravel(), len(self.rest)
        return State(table[:BUCKETS].copy(), more[:n].copy(), more[n : 2 * n].copy())


def begin(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> State:
    """Parameters before training. pos, neg: in how many toxic and other documents each bucket occurs."""
    a, b, rng = toxic + 1, clean + 1, np.random.default_rng(SEED)
    delta = np.log((pos + 0.5 * a / (a + b)) / (a + 1 - pos)) - np.log((neg + 0.5 * b / (a + b)) / (b + 1 - neg))
    z = delta / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    embed = rng.normal(0, 0.05, (BUCKETS, DIM))
    embed[:, 0] = np.clip(z, -6, 6) / 3
    n = sum(WIDTHS) * DIM * FILTERS + FILTERS * len(WIDTHS) + 1
    state = State(np.hstack([embed, np.full((BUCKETS, 1), 1e-6)]), np.zeros(n), np.full(n, 1e-6))
    filters, weight, bias = state.parts(state.rest)
    for f in filters.values():
        f[:] = rng.normal(0, 0.3, f.shape)
        f[:, 0, 0] = 1.0
        f[:, 0, 1] = -0.5
    weight[:] = rng.normal(0, 0.1, len(weight))
    weight[0] = 1.0
    bias[0] = np.log(toxic / clean)
    return state


def epoch(state: State, docs: list[np.ndarray], y: np.ndarray, seed: int) -> None:
    """One pass over docs (bucket numbers, words x units), which changes ``state``."""
    embed, g_embed, rate = state.embed[:, :DIM], state.embed[:, DIM:], 0.05
    (filters, weight, bias), (g_filters, g_weight, g_bias) = state.parts(state.rest), state.parts(state.squares)
    order = np.random.default_rng([SEED, seed]).permutation(len(docs))
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        feats = np.zeros((len(batch), len(weight)))
        spots = np.full((len(batch), len(weight)), -1)
        for i, d in enumerate(batch):
            x = embed[docs[d]].sum(1)
            for k, (w, f) in enumerate(filters.items()):
                if len(x) < w:
                    continue
                r = x[: len(x) - w + 1] @ f[0]
                for o in range(1, w):
                    r = r + x[o : len(x) - w + 1 + o] @ f[o]
                p = r.argmax(0)
                v = r[p, np.arange(FILTERS)]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                feats[i, cols] = np.maximum(v, 0)
                spots[i, cols] = np.where(v > 0, p, -1)
        err = (1 / (1 + np.exp(-(feats @ weight + bias[0]))) - y[batch]) / len(batch)
        d_feat = err[:, None] * weight
        d_weight, d_bias = feats.T @ err + 1e-4 * weight, err.sum()
        for k, (w, f) in enumerate(filters.items()):
            i, c = np.nonzero(spots[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            if not len(i):
                continue
            g, p = d_feat[i, k * FILTERS + c], spots[i, k * FILTERS + c]
            d_f = np.zeros_like(f)
            for o in range(w):
                token = np.array([docs[batch[a]][b + o] for a, b in zip(i, p)])
                np.add.at(d_f[o].T, c, g[:, None] * embed[token].sum(1))
                row, inverse = np.unique(token, return_inverse=True)
                d_e = np.zeros((len(row), DIM))
                np.add.at(d_e, inverse.ravel(), np.repeat(g[:, None] * f[o][:, c].T, token.shape[1], 0))
                g_embed[row] += (d_e**2).mean(1, keepdims=True)
                embed[row] -= 0.2 * rate * d_e / np.sqrt(g_embed[row])
            g_filters[w] += d_f**2
            f -= rate * d_f / np.sqrt(g_filters[w])
        g_weight += d_weight**2
        weight -= rate * d_weight / np.sqrt(g_weight)
        g_bias += d_bias**2
        bias -= rate * d_bias / np.sqrt(g_bias)


def _decoded(column) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u2").reshape(-1, 1 + len(PREFIXES)) for t in column.to_pylist()]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, pos, neg): in how many toxic and other documents of the task each bucket occurs."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for d, label in zip(_decoded(batch.column("tokens")), batch.column("toxic").to_pylist()):
            seen[int(label != 0)][np.unique(d)] += 1
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["bucket", "pos", "neg"])


_TABLE = "key int, " + ", ".join(f"p{i} long" for i in range(DIM + 1))


def _pass(box, turn: int):
    def run(shard: pa.Table) -> pa.Table:
        before: State = box.value
        shard = shard.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        state = before.unpacked(before.packed())
        epoch(state, _decoded(shard["tokens"]), np.asarray(shard["toxic"]), turn)
        old, new = before.packed(), state.packed()
        changed = (old != new).any(1)
        changed[BUCKETS:] = True
        at = np.flatnonzero(changed)
        whole = np.rint(new[at] / PART).astype(np.int64)
        return pa.table([pa.array(at.astype(np.int32)), *(pa.array(whole[:, i].copy()) for i in range(DIM + 1))], names=["key", *(f"p{i}" for i in range(DIM + 1))])

    return run


def train(rows: DataFrame, toxic: int, clean: int, shards: int) -> Model:
    """rows: doc_id, toxic, tokens; both kinds are present."""
    spark = rows.sparkSession
    met = rows.select("toxic", "tokens").mapInArrow(_met, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    pos[np.asarray(met["bucket"])], neg[np.asarray(met["bucket"])] = np.asarray(met["pos"]), np.asarray(met["neg"])
    state = begin(pos, neg, toxic, clean)
    for turn in range(EPOCHS):
        box = spark.sparkContext.broadcast(state)
        dealt = rows.select("doc_id", F.least("toxic", F.lit(1)).alias("toxic"), "tokens", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(shards)).alias("shard"))
        made = dealt.groupBy("shard").applyInArrow(_pass(box, turn), _TABLE)
        with store.giving_back(spark):
            mean = made.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(DIM + 1))).toArrow()
        table = state.packed()
        table[np.asarray(mean["key"])] = np.stack([np.asarray(mean[f"p{i}"]) for i in range(DIM + 1)], 1) * PART / np.asarray(mean["n"])[:, None]
        state = state.unpacked(table)
        box.unpersist()
    filters, weight, bias = state.parts(state.rest)
    return Model(state.embed[:, :DIM].astype(np.float32), {w: f.astype(np.float32) for w, f in filters.items()}, weight, float(bias[0]))


def best_cut(logit: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The middle of the widest gap that gives the best F1. y: 0 or 1, or how many of the ``n`` rows of a logit are 1."""
    order = np.argsort(-logit, kind="stable")
    s, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / ((np.arange(1, len(s) + 1) if n is None else np.cumsum(n[order])) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    below = np.append(s[1:], s[-1] - 1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax((s - below)[top])]
    return float((s[k] + below[k]) / 2)


def _bucketed(box):
    """(doc_id, lang, tokens) of the rows whose id passes the filter."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(idfilter.passes(box.value, np.asarray(b.column("doc_id"))))) for b in batches)
        for batch, texts in tk.groups(some):
            w, h = tk.plain_words(texts)
            b = units(w, h)
            tokens = [b[f : f + n].tobytes() for f, n in zip(w.first, w.count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages(w, h).astype(np.int32)), pa.array(tokens, pa.binary())], schema=schema)

    return run


def fold(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5


def fitting(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which of ``sizes`` in order stay within ``most`` in sum: one that doesn't fit is passed over, those after it are not."""
    took, total = np.zeros(len(sizes), bool), 0
    for i, n in enumerate(sizes.tolist()):
        if total + n <= most:
            took[i], total = True, total + n
    return took


def _bounded(own: DataFrame, learn: DataFrame, train_rows: int, train_chars: int) -> DataFrame:
    """Of ``learn`` at most so many rows, the least by a hash of their id, with at most so many characters of text together."""
    some = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sizes = own.join(F.broadcast(some), "doc_id").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.xxhash64("doc_id").alias("h")).groupBy("doc_id", "h").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sizes = sizes.sort_values(["h", "doc_id"])
    taken = sizes["doc_id"][fitting(sizes["n"].to_numpy(), train_chars)]
    return some.join(F.broadcast(own.sparkSession.createDataFrame(taken.to_frame(), "doc_id long")), "doc_id")


def _judged(box):
    schema = pa.schema([("lang", pa.int32()), ("toxic", pa.int32()), ("logit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = box.value
        for batch in batches:
            logit = [logits(model, t, np.zeros(1, np.int64), np.array([len(t)]))[0] for t in _decoded(batch.column("tokens"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(np.rint(np.array(logit) * 1000).astype(np.int64))], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, train_rows: int | None = None, train_chars: int | None = None, shard_rows: int = SHARD_ROWS) -> Model:
    """A calibrated model from all labels (doc_id, toxic) of documents that aren't held out; only where a bound is given from no more rows or characters."""
    learn = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("part", fold()).filter("part <> 0")
    own = docs.select(F.col("doc_id").cast("long"), "text")
    if train_rows is not None or train_chars is not None:
        learn = _bounded(own, learn, (1 << 31) - 1 if train_rows is None else train_rows, 1 << 62 if train_chars is None else train_chars)
    known = docs.sparkSession.sparkContext.broadcast(idfilter.build(learn.select("doc_id")))
    tokens = own.filter("doc_id is not null").mapInArrow(_bucketed(known), "doc_id long, lang int, tokens binary")
    # labels grow with the documents: they are merged at any size rather than sent to all
    rows = store.settled(tokens.join(learn.hint("merge"), "doc_id"), "toxicity")
    counts = rows.groupBy((F.col("part") == 4).alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("toxic", F.lit(1))).alias("y"), F.sum(F.length("tokens")).alias("bytes")).collect()
    own_n, own_y, size = ([sum(r[c] for r in counts if not r["held"]) for c in ("n", "y", "bytes")]) if counts else (0, 0, 0)
    if own_y in (0, own_n):
        n, y = sum(r["n"] for r in counts), sum(r["y"] for r in counts)
        share = float(np.clip(y / n if n else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros((BUCKETS, DIM), np.float32), {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS)), float(np.log(share / (1 - share))))
    model = train(rows.filter("part <> 4"), own_y, own_n - own_y, max(-(-own_n // shard_rows), -(-size // SHARD_BYTES)))
    box = docs.sparkSession.sparkContext.broadcast(model)
    held = rows.filter("part = 4").select("lang", F.least("toxic", F.lit(1)).alias("toxic"), "tokens").mapInArrow(_judged(box), "lang int, toxic int, logit long")
    held = held.groupBy("lang", "logit").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y")).toArrow()
    logit, n, y, lang = np.asarray(held["logit"]) / 1000, np.asarray(held["n"]), np.asarray(held["y"]), np.asarray(held["lang"])
    overall = best_cut(logit, y, n) if 0 < y.sum() < n.sum() else 0.0
    for k in range(len(model.cut)):
        at = lang == k
        # the fewer toxic calibration rows a language has, the nearer its threshold stays to that of all
        toxic = int(y[at].sum())
        model.cut[k] = (toxic * best_cut(logit[at], y[at], n[at]) + SHRINK * overall) / (toxic + SHRINK) if 0 < toxic < n[at].sum() else overall
    return model


def logits(model: Model, token: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return maxima(model, token, first, count) @ model.weight + model.bias


def _scored(box):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = box.value
        for batch, texts in tk.groups(batches):
            w, h = tk.plain_words(texts)
            raw = logits(model, units(w, h), w.first, w.count) - model.cut[languages(w, h)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))))], schema=schema)

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(box), "doc_id long, score double")


def _clean(box, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = box.value
        for batch, texts in tk.groups(batches):
            w, h = tk.plain_words(texts)
            raw = logits(model, units(w, h), w.first, w.count) - model.cut[languages(w, h)]
            kept = batch.filter(pa.array(raw < 0))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in names], schema=schema)

    return run


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns are kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    box = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(box, docs.columns, to_arrow_schema(docs.schema)), docs.schema)
