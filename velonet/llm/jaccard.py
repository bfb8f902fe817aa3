"""N-gram Jaccard join: exact links between documents whose shingle sets overlap enough.

1. One pass over the texts gives each document its set size, a 128-bit
   fingerprint of the set, four bottom hashes, and the locally frequent
   shingles. Documents of one fingerprint form a class with one representative.
2. Star links: representatives sharing a bottom hash are verified against one
   hub of that hash, which joins groups of near copies without emitting pairs.
3. Tiles: a linked pair must share a shingle among the rarest
   ``n - ceil(t n) + 1`` of either set. Representatives sharing such a shingle
   but still in different groups meet in a tile of (shingle, size band). Crowded tiles first link their rows to a hub of each,
   as in 2, for as long as that joins a fair share of them. Tiles of up to ``SMALL`` rows name their
   pairs, larger ones are compared in blocks, where a row
   brings the earlier ones of its tiles, so that a pair is named in the first tile that it shares only; parity bitmaps, as wide as the band's sets ask for, bound the overlap
   from above: ``|A & B| <= (|A| + |B| - popcount(a ^ b)) / 2``.
4. What survives is settled by intersecting the sorted hash arrays, and the
   links of 2 and 4 make the components.

The frequent-shingle list (at most ``FREQUENT`` entries) only orders shingles; any order gives the same links.
Besides it only a Bloom filter of fixed size is broadcast, which keeps texts without a candidate out of the shuffle.

Edge cases: null or empty text and texts without words have an empty set
(``n_shingles`` 0), link with nothing and are their own component. Equal texts are
one class. An empty table gives an empty table. Extra columns are ignored, so
their names cannot clash. Rows with a null id go. Where ids repeat each row is a document of its own, numbered anew;
a component's id is the least ``doc_id`` of its rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.llm import idfilter
from velonet.llm import textkit as tk
from velonet.llm.components import connected_components
from velonet.llm.store import ids_repeat, materialise, renumbered

FREQUENT = 1 << 16
STAR_KEYS = 4
BLOCK, SMALL = 1024, 16
#: Rows from which a tile is a crowd, and how many rounds of hubs crowds get before their pairs are compared.
CROWD, ROUNDS = 64, 3
#: Another round follows while the last one linked at least one in so many of the crowds' rows; its cost is that of all tiles.
CROWD_SHARE = 10
_U = np.uint64


def shingle_sets(texts: list[bytes], width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each has."""
    w = tk.Words(texts)
    h = w.hashes(lower)
    gram, at = w.grams(h, width)
    doc = w.doc[at]
    few = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(few):
        short = np.empty(len(few), _U)
        for k, d in enumerate(few):
            own = tk.mix(h[w.first[d] : w.first[d] + w.count[d]] + np.arange(1, w.count[d] + 1, dtype=_U))
            short[k] = np.bitwise_xor.reduce(own) ^ _U(0xA5A5A5A500000000 | int(w.count[d]))
        gram, doc = np.concatenate([gram, tk.mix(short)]), np.concatenate([doc, few])
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[keep], doc[keep]
    return gram, np.bincount(doc, minlength=len(texts))


def _runs(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _signatures(width: int, lower: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), ("hot_n", pa.list_(pa.int64()))])

    def frequent(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        return tk.signed(value[count > 2]), count[count > 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        none = lambda n: tk.packed_lists(np.zeros(0, np.int64), np.zeros(n, np.int64), pa.int64())
        for batch, texts in tk.groups(batches):
            gram, counts = shingle_sets(texts, width, lower)
            at = _runs(counts)
            prints = np.zeros((len(texts), 2), np.int64)
            for i in np.flatnonzero(counts):
                prints[i] = np.frombuffer(hashlib.blake2b(gram[at[i] : at[i + 1]].tobytes(), digest_size=16).digest(), np.int64)
            few = np.minimum(counts, STAR_KEYS)
            pick = np.repeat(at[:-1], few) + (np.arange(few.sum()) - np.repeat(_runs(few)[:-1], few))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(prints[:, 0]), pa.array(prints[:, 1]), tk.packed_lists(tk.signed(gram[pick]), few, pa.int64()), none(len(texts)), none(len(texts))], schema=schema)
            parts.append(gram)
            size += len(gram)
            if size >= 4_000_000:
                value, count = frequent(parts)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.array([0])] * 3, none(1), tk.packed_lists(value, [len(value)], pa.int64()), tk.packed_lists(count, [len(count)], pa.int64())], schema=schema)
                parts, size = [], 0
        if parts:
            value, count = frequent(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.array([0])] * 3, none(1), tk.packed_lists(value, [len(value)], pa.int64()), tk.packed_lists(count, [len(count)], pa.int64())], schema=schema)

    return run


def bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of n: the power of two from 2n, at least 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def parity_bitmap(values: np.ndarray) -> np.ndarray:
    """One bit per slot: whether an odd number of the hashes falls into it."""
    bits = bitmap_bits(len(values))
    odd = np.bincount((values & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The parity bitmap of the same set at a smaller width."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def _prefixes(width: int, lower: bool, percent: int, frequent):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int64())), ("bitmap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = frequent.value
        for batch, texts in tk.groups(batches):
            gram, counts = shingle_sets(texts, width, lower)
            at = _runs(counts)
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
                order = np.where(hot[spot] == gram, rank[spot], 0)
            else:
                order = np.zeros(len(gram), np.int64)
            gram_doc = np.repeat(np.arange(len(texts)), counts)
            by = np.lexsort((gram, order, gram_doc))
            need = np.where(counts > 0, counts - (counts * percent + 99) // 100 + 1, 0)
            pick = np.repeat(at[:-1], need) + (np.arange(need.sum()) - np.repeat(_runs(need)[:-1], need))
            maps = [parity_bitmap(gram[at[i] : at[i + 1]]).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tk.packed_lists(tk.signed(gram[by][pick]), need, pa.int64()), pa.array(maps, pa.binary())], schema=schema)

    return run


def _unmet(own: np.ndarray, seen: list[np.ndarray], j: np.ndarray) -> np.ndarray:
    """The rows of j whose earlier tiles are none of ``own`` (both sorted)."""
    if not len(own):
        return j
    theirs = [seen[k] for k in j]
    flat = np.concatenate(theirs)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    row = np.repeat(np.arange(len(j)), [len(x) for x in theirs])
    return j[np.bincount(row[hit], minlength=len(j)) == 0]


def tile_pairs(n: np.ndarray, label: np.ndarray, visitor: np.ndarray, maps: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile that sizes and bitmaps can't rule out; each is of different labels.

    With ``seen``, the sorted earlier tiles of each row, a pair that meets in one of them is left to the first.
    """
    size = min(map(len, maps))
    bits = np.stack([fold(x, size) for x in maps])
    words = bits.view(np.uint64) if size % 8 == 0 else bits
    out_a, out_b = [], []
    for i in np.flatnonzero(left):
        ok = right & (label != label[i]) & ~(visitor & visitor[i])
        ok &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        j = np.flatnonzero(ok)
        if not len(j):
            continue
        apart = np.bitwise_count(words[j] ^ words[i]).sum(1, dtype=np.int64)
        most = (n[j] + n[i] - apart) // 2
        j = j[100 * most >= percent * (n[j] + n[i] - most)]
        if seen is not None and len(j):
            j = _unmet(seen[i], seen, j)
        out_a.append(np.full(len(j), i))
        out_b.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _keyed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted rows that may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for b, e in zip(cuts, cuts[1:]):
            key = tuple(c[b] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(b, e - b))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _tiles(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _keyed_groups(batches, ["token", "band", "bi", "bj"]):
            ids, block = np.asarray(t["id"]), np.asarray(t["block"])
            bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
            maps = [np.frombuffer(x, np.uint8) for x in t["bitmap"].to_pylist()]
            lists = t["seen"].combine_chunks()
            seen = np.split(np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))[:-1])
            a, b = tile_pairs(np.asarray(t["n"]), np.asarray(t["label"]), np.asarray(t["visitor"]).astype(bool), maps, block == bi, block == bj, percent, seen)
            a, b = ids[a], ids[b]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    return run


def _bounded(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            for i, (x, y) in enumerate(zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, size).view(np.uint64) ^ fold(y, size).view(np.uint64)).sum())
                most = (na[i] + nb[i] - apart) // 2
                keep[i] = 100 * most >= percent * (na[i] + nb[i] - most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], schema=schema)

    return run


def _verified(width: int, lower: bool, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_key, hub_set = None, None
        for batch, texts in tk.groups(batches):
            gram, counts = shingle_sets(texts, width, lower)
            at = _runs(counts)
            hub, salt, ids, is_hub = (batch.column(k).to_pylist() for k in ("hub", "salt", "id", "is_hub"))
            a, b = [], []
            for i in range(len(texts)):
                own = gram[at[i] : at[i + 1]]
                if is_hub[i]:
                    hub_key, hub_set = (hub[i], salt[i]), own
                    continue
                if hub_key != (hub[i], salt[i]):
                    raise RuntimeError(f"the text of document {hub[i]} is missing")
                both = len(np.intersect1d(own, hub_set, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(hub_set) - both):
                    a.append(hub[i])
                    b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def verify(pairs: DataFrame, docs: DataFrame, width: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are close enough; each hub's partners are dealt out over salts of 500."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 500).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(0).alias("is_hub"))
    hubs = salts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(1).alias("is_hub"))
    rows = members.unionByName(hubs)
    own = idfilter.only(docs, idfilter.build(rows.select("id")))
    rows = rows.join(own.select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub")).mapInArrow(_verified(width, lower, percent), "a long, b long")


def _with_maps(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with both bitmaps."""
    own = lambda k: maps.select(F.col("id").alias(k), F.col("bitmap").alias(f"m{k}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "ma", "mb")


def _live(prefixes: DataFrame, near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (token, id, n, label, own, band, visitor) of shingles that more than one group has, and the tiles (token, band, c) where groups meet."""
    labelled = prefixes.select("id", "n", "tokens").join(near.select("id", "component"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    own_band = lambda n: F.floor(F.log(n) / math.log(100 / percent)).cast("int")
    # a set meets its partners of at least its size in their band: its own or the next (one more should rounding want it)
    reach = F.sequence(own_band(F.col("n") * 1.0), own_band(F.col("n") * (100.0 / percent) * (1 + 1e-9)))
    postings = labelled.select(F.explode("tokens").alias("token"), "id", F.col("n").cast("int").alias("n"), "label")
    # written first, so that the join can be split where a shingle is hot
    shared = materialise(postings.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token"), "jaccard-shared")
    live = postings.join(shared, "token")
    rows = live.select("*", own_band(F.col("n") * 1.0).alias("own"), F.explode(reach).alias("band")).withColumn("visitor", (F.col("own") < F.col("band")).cast("int"))
    rows = materialise(rows, "jaccard-live")
    tile = rows.groupBy("token", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("visitor").alias("v"), F.count(F.lit(1)).alias("c")).filter("lo < hi and v = 0").select("token", "band", "c")
    return rows, materialise(tile, "jaccard-tiles")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id): sets of ``width``-word shingles, links from ``percent``/100 Jaccard on."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    if not ids_repeat(docs):
        return _components(docs, width, percent, lower)
    own = renumbered(docs)
    found = materialise(_components(own.select("doc_id", "text"), width, percent, lower).join(own.select("doc_id", "own_id"), "doc_id"), "jaccard-rows")
    least = found.groupBy(F.col("component_id").alias("_c")).agg(F.min("own_id").alias("_least"))
    return found.join(least, found["component_id"] == least["_c"]).select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"))


def _components(docs: DataFrame, width: int, percent: int, lower: bool) -> DataFrame:
    spark = docs.sparkSession
    found = materialise(docs.mapInArrow(_signatures(width, lower), "doc_id long, n long, f1 long, f2 long, keys array<long>, hot array<long>, hot_n array<long>"), "jaccard-sets")
    hot = found.filter("size(hot) > 0").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_n").alias("c")).orderBy(F.desc("c"), "hot").limit(FREQUENT).toArrow()
    value, rank = np.array(hot["hot"], np.int64).view(_U), np.arange(len(hot), 0, -1)
    order = np.argsort(value)
    frequent = spark.sparkContext.broadcast((value[order], rank[order]))

    sets = found.filter("doc_id is not null").select("doc_id", "n", "f1", "f2")
    classes = found.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    classes = materialise(classes, "jaccard-classes")

    keyed = classes.select("rep", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.col("hub.rep").alias("a"), F.col("hub.n").alias("na"))
    hubs = materialise(hubs, "jaccard-hubs")  # so that a join on a hot key can be split
    stars = keyed.join(hubs, "key").filter(f"rep <> a and 100 * least(n, na) >= {percent} * greatest(n, na)").select("a", F.col("rep").alias("b")).distinct()
    stars = materialise(stars, "jaccard-stars")
    links = materialise(verify(stars, docs, width, lower, percent), "jaccard-links")
    prefixes = docs.mapInArrow(_prefixes(width, lower, percent, frequent), "id long, tokens array<long>, bitmap binary")
    prefixes = materialise(prefixes.join(classes.select("rep", "n"), prefixes.id == F.col("rep")).drop("rep"), "jaccard-prefixes")
    maps = prefixes.select("id", "bitmap")
    bounded = lambda pairs: _with_maps(pairs, maps).mapInArrow(_bounded(percent), "a long, b long")
    near_size = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    for turn in range(1, ROUNDS + 2):
        near = connected_components(links)
        rows, tile = _live(prefixes, near, percent)
        crowded = tile.filter(F.col("c") > CROWD).agg(F.sum("c")).first()[0] or 0
        if turn > ROUNDS or not crowded:
            break
        # crowds first: one hub a tile, another in each round, so that a crowd of near copies becomes a group without its pairs
        crowd = rows.join(tile.filter(F.col("c") > CROWD), ["token", "band"])
        hub = crowd.filter("visitor = 0").groupBy("token", "band").agg(F.min_by(F.struct("id", "n", "label"), F.xxhash64(F.lit(turn), "id")).alias("hub"))
        hub = materialise(hub, "jaccard-crowds")
        asked = crowd.join(hub, ["token", "band"]).filter("label <> hub.label and " + near_size.format("n", "hub.n"))
        asked = asked.select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct()
        more = materialise(verify(materialise(bounded(asked), "jaccard-asked"), docs, width, lower, percent), "jaccard-more")
        if more.count() * CROWD_SHARE < crowded:
            break  # these pairs meet again in the tiles below
        links = links.unionByName(more)

    few = rows.join(tile.filter(F.col("c") <= SMALL), ["token", "band"]).groupBy("token", "band").agg(F.collect_list(F.struct("id", "n", "label", "visitor")).alias("x"))
    met = few.select(F.explode("x").alias("p"), "x").select("p", F.explode("x").alias("q")).filter(f"p.id < q.id and p.label <> q.label and p.visitor + q.visitor < 2 and 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n)")
    met = met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()
    met = bounded(met)

    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    large = rows.join(tile.filter(F.col("c") > SMALL), ["token", "band"]).groupBy("id", "band").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.first("visitor").alias("visitor"), F.sort_array(F.collect_list(F.struct("token", "c"))).alias("own"))
    large = large.join(maps, "id").select("*", F.posexplode("own").alias("before", "tile")).select("id", "band", "n", "label", "visitor", "bitmap", "tile.token", "tile.c", F.expr("slice(own.token, 1, before)").alias("seen"))
    large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    large = large.select("token", "band", "bi", "bj", "block", "id", F.col("n").cast("long").alias("n"), "label", "visitor", "bitmap", "seen")
    crowd = large.repartition("token", "band", "bi", "bj").sortWithinPartitions("token", "band", "bi", "bj").mapInArrow(_tiles(percent), "a long, b long")
    met = met.unionByName(crowd).distinct()
    met = materialise(met, "jaccard-met")
    if not met.isEmpty():
        far = materialise(verify(met, docs, width, lower, percent), "jaccard-far")
        if not far.isEmpty():
            near = connected_components(links.unionByName(far))
    reps = classes.select("f1", "f2", "n", "rep").join(near.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    return sets.join(reps, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
