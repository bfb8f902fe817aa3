"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``CHUNK`` characters are encoded as they are. Longer ones are dealt out
as chunks that overlap by ``OVERLAP`` characters:

* each chunk is pre-tokenised by itself and reports the pre-token boundaries in its
  two overlaps, and its first certain boundary;
* a boundary where white space follows anything else, or where a run of letters or of numbers ends, holds whatever
  came before (no alternative of the pattern runs from a non-space into a space, nor from a letter or number into
  another kind), so neighbours are stitched at their first common boundary of that kind; if their overlap has none (one very long word),
  the right one's first certain boundary is taken, and a chunk without any joins its left
  neighbour;
* the pieces between the stitches are encoded in parallel, and each document's pieces are
  put in order again.

Decoding concatenates the raw bytes of the tokens, so any cut of an id sequence decodes.

Edge cases: null and empty texts give no ids. An empty table gives an empty table.
``doc_id`` may repeat or be null for short texts; long texts are told apart by an
internal row key, so ties stay separate. Extra columns are ignored unless asked for with ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.llm import textkit as tk
from velonet.llm.store import materialise

CHUNK, OVERLAP = 1 << 16, 1 << 10
_SPACE = " \n\t\r"


@lru_cache(2)
def encoder(path: str, pattern: str):
    """A tiktoken encoding by the rank file at ``path``, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _decimals(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoder(path, pattern).n_vocab)]


def certain(text: str, p: int) -> bool:
    """Whether a pre-token must end at p: white space follows something else, or a letter or number is followed by another kind."""
    if not 0 < p < len(text):
        return False
    if text[p] in _SPACE:
        return not text[p - 1].isspace()
    before, after = category(text[p - 1])[0], category(text[p])[0]
    # characters that this Unicode version doesn't know are left out: another may take them for letters
    return before in "LN" and after in "LNPSZ" and before != after


def boundaries(text: str, begin: int, end: int, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    """Certain pre-token boundaries of ``text``, tokenised from its start, within [begin, end)."""
    import regex

    out = []
    for m in regex.finditer(pattern, text):
        if m.end() >= end:
            break
        if m.end() >= begin and certain(text, m.end()):
            out.append(m.end())
    return out


def first_certain(text: str) -> int:
    return next((p for p in range(1, len(text)) if certain(text, p)), -1)


def stitch(chunks: list[dict]) -> list[tuple[int, int]]:
    """Piece spans of one text. chunks, in order: begin, head and tail (boundaries in its overlaps), first (certain, or -1), end."""
    cuts = [0]
    for left, right in zip(chunks, chunks[1:]):
        common = sorted({*left["tail"]} & {*right["head"]})
        p = common[0] if common else right["first"]
        if p > cuts[-1]:
            cuts.append(p)
    cuts.append(chunks[-1]["end"])
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _scan(pattern: str):
    schema = pa.schema([("row", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail, first, end = [], [], [], []
            for begin, text in zip(batch.column("begin").to_pylist(), batch.column("chunk").to_pylist()):
                inner = boundaries(text, 1, len(text), pattern)
                head.append([begin + p for p in inner if begin and p < OVERLAP])
                tail.append([begin + p for p in inner if p >= CHUNK])
                f = first_certain(text)
                first.append(begin + f if f >= 0 else -1)
                end.append(begin + len(text))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("begin"), pa.array(end, pa.int32()), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32())), pa.array(first, pa.int32())], schema=schema)

    return run


def _pieces(batches):
    for t in batches:
        rows = t.to_pylist()
        by: dict[str, list] = {}
        for r in rows:
            by[r["row"]] = sorted(r["chunks"], key=lambda c: c["begin"])
        out = [(k, n, a, b) for k, c in by.items() for n, (a, b) in enumerate(stitch(c))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), *(pa.array([x[i] for x in out], pa.int32()) for i in (1, 2, 3))], names=["row", "piece", "begin", "end"])


def _digests(enc, decimal: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of id arrays."""
    n, a, b = [], [], []
    for own in ids:
        own = own.tolist()
        n.append(len(own))
        a.append(hashlib.sha256(",".join([decimal[i] for i in own]).encode()).hexdigest())
        b.append(hashlib.sha256(enc.decode_bytes(own)).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _kinds(df: DataFrame, keep: list[str], more: str):
    """The Spark schema of some columns and further ones, and the same for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(more).fields])
    return kinds, to_arrow_schema(kinds)


def _encoded(path: str, pattern: str, names: list[str], schema: pa.Schema, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        decimal = _decimals(path, pattern) if digest else []
        for batch, texts in tk.groups(batches):
            ids = [enc.encode_to_numpy(x.decode("utf-8", "replace"), disallowed_special=()).astype("<u4") for x in texts]
            columns = [*(batch.column(k) for k in names), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + (_digests(enc, decimal, ids) if digest else []), schema=schema)

    return run


def _mapped(df: DataFrame, keep: list[str], path: str, pattern: str, digest: bool) -> DataFrame:
    kinds, arrow = _kinds(df, keep, "ids binary" + (f", {_DIGESTS}" if digest else ""))
    return df.mapInArrow(_encoded(path, pattern, keep, arrow, digest), kinds)


def _joined(path: str, pattern: str, digest: bool):
    def run(batches):
        enc, decimal = (encoder(path, pattern), _decimals(path, pattern)) if digest else (None, [])
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                t = whole.slice(at, 16)
                ids = [b"".join(p["ids"] for p in sorted(x, key=lambda p: p["piece"])) for x in t.column("pieces").to_pylist()]
                columns = [t.column("row"), pa.array(ids, pa.binary())]
                if digest:
                    columns += _digests(enc, decimal, [np.frombuffer(x, "<u4") for x in ids])
                yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "n_tokens", "ids_sha256", "decoded_sha256"][: len(columns)])

    return run


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """``keep`` and ``ids`` (binary, little-endian 32-bit ids in order) for each row of ``docs``.

    With ``digest`` also n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the bytes they
    decode to), worked out in the same pass: a worker holds one encoder.
    """
    keep = list(keep)
    docs = docs.select(*keep, "text")
    more = ["ids"] + (["n_tokens", "ids_sha256", "decoded_sha256"] if digest else [])
    long = F.length("text") > CHUNK
    short = _mapped(docs.filter(~F.coalesce(long, F.lit(False))), keep, path, pattern, digest)

    # equal rows have equal ids, so a key of the row's content is enough; repeated rows are counted
    rows = docs.filter(long).withColumn("_row", F.sha2(F.to_json(F.struct(*keep, "text"), {"ignoreNullFields": "false"}), 256))
    rows = materialise(rows.groupBy("_row").agg(F.first(F.struct(*keep, "text")).alias("_x"), F.count(F.lit(1)).alias("_copies")), "bpe-long")
    starts = F.sequence(F.lit(0), F.length("_x.text") - 1, F.lit(CHUNK))
    chunks = rows.select(F.col("_row").alias("row"), F.explode(starts).alias("begin"), F.col("_x.text").alias("t")).select("row", "begin", F.substring("t", F.col("begin") + 1, F.lit(CHUNK + OVERLAP)).alias("chunk"))
    seen = chunks.repartition("row", "begin").mapInArrow(_scan(pattern), "row string, begin int, end int, head array<int>, tail array<int>, first int")
    seen = seen.groupBy("row").agg(F.collect_list(F.struct("begin", "end", "head", "tail", "first")).alias("chunks"))
    spans = seen.mapInArrow(_pieces, "row string, piece int, begin int, end int")
    cut = rows.join(spans, rows["_row"] == spans["row"]).select("row", "piece", F.substring("_x.text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("text"))
    pieces = _mapped(cut.repartition("row", "piece"), ["row", "piece"], path, pattern, False)
    whole = pieces.groupBy("row").agg(F.collect_list(F.struct("piece", "ids")).alias("pieces"))
    whole = whole.mapInArrow(_joined(path, pattern, digest), "row string, ids binary" + (f", {_DIGESTS}" if digest else ""))
    meta = rows.select("_row", *(F.col("_x")[k].alias(k) for k in keep), "_copies")
    joined = meta.join(whole, meta["_row"] == whole["row"]).select(*keep, *more, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n"))
    return short.unionByName(joined.select(*keep, *more))


def _digested(path: str, pattern: str, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, decimal = encoder(path, pattern), _decimals(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, tk.SLICE):
                batch = whole.slice(at, tk.SLICE)
                ids = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *_digests(enc, decimal, ids)], schema=schema)

    return run


def digests(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """The digests of ``encode`` for a table that is already encoded, in place of ``ids`` or beside it."""
    keep = [c for c in encoded.columns if keep_ids or c != "ids"]
    kinds, arrow = _kinds(encoded, keep, _DIGESTS)
    return encoded.mapInArrow(_digested(path, pattern, keep, arrow), kinds)


def _decoded(path: str, pattern: str, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(out, pa.binary())], schema=schema)

    return run


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``bytes`` in place of ``ids``: the tokens' raw bytes, one after the other; null ids give none."""
    keep = [c for c in encoded.columns if c != "ids"]
    kinds, arrow = _kinds(encoded, keep, "bytes binary")
    return encoded.mapInArrow(_decoded(path, pattern, keep, arrow), kinds)
