"""Secret scans: candidate spans, and how widely each candidate value is owned.

One pass over the texts finds spans of the base kinds (assign, access, hex) and further
candidates: ``key`` (blocks of private keys), ``jwt`` (signed tokens of three parts), ``url`` (addresses that carry a
password) and ``token`` (unbroken runs of 20 or more key characters that mix digits and letters
and are random enough). Of candidates that overlap the kind named first stays. The values (of addresses the password, of
key blocks what they hold without its line breaks), as 128-bit hashes, are then counted over the whole corpus by distinct
repositories and owners. A value of at most ``MAX_OWNERS`` owners and ``MAX_REPOS`` repositories is ``live`` (owner-specific,
live-looking), others are ``example`` (widely copied). Base spans stay whatever their class; a
further candidate is reported only if it is live and overlaps no base span.

The counts are partial aggregates of (hash, owner) pairs, so a key copied into a third of all
documents is a few rows per task. Values never leave the executors in clear.

Edge cases: null text is empty and has no spans; null repositories and owners count as one
unnamed each. Repeated rows count once by owner, and each has its own row in the result (rows of one id and different texts too).
An empty table gives an empty table. Extra columns are ignored; rows with a null ``doc_id`` go.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velonet.llm.store import materialise

KINDS = ("assign", "access", "hex")
#: Further kinds, in the order of their precedence.
MORE = ("key", "jwt", "url", "token")
MAX_OWNERS, MAX_REPOS, MIN_ENTROPY = 2, 8, 3.5
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run is maximal, so asking for its length at once drops the same matches as dropping short ones later
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# what comes before a match holds none of its first characters, so no run is scanned once from each of its places
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----")
_END = re.compile(r"-----END (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_URL = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,19}://[^\s/:@?#"'<>]{0,64}:([^\s/:@?#"'<>]{6,256})@[A-Za-z0-9\[]""")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, by start, then kind as in KINDS."""
    found = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda x: (x[0], x[2]))]


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in map(value.count, set(value)))


def key_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Blocks of private keys, from their first line to their last; of blocks that begin in another the outer one."""
    out, at = [], 0
    while (begin := _BEGIN.search(text, at)) and (end := _END.search(text, begin.end())):
        value = "".join(text[begin.end() : end.start()].split())
        if len(value) >= 64:
            out.append((begin.start(), end.end(), "key", value))
        at = end.end()
    return out


def free_of(found: list[tuple[int, int, str, str]], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Those of ``found`` that overlap none of ``taken``; both by start."""
    # the farthest end of all that start so far: a span is free if nothing that starts before its end reaches beyond its start
    starts, reach, far = [a for a, *_ in taken], [], -1
    for _, b, *_ in taken:
        far = max(far, b)
        reach.append(far)
    return [x for x in found if (n := bisect_left(starts, x[1])) == 0 or reach[n - 1] <= x[0]]


def token_spans(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Runs of key characters that overlap nothing taken."""
    found = [(m.start(), m.end(), "token", m[0]) for m in _TOKEN.finditer(text)]
    return [x for x in free_of(found, taken) if any(c.isdigit() for c in x[3]) and any(c.isalpha() for c in x[3]) and entropy(x[3]) >= MIN_ENTROPY]


def more_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Candidates of the further kinds that overlap no base span, nor each other; by start."""
    taken = list(base)
    for found in (key_spans(text), [(m.start(), m.end(), "jwt", m[0]) for m in _JWT.finditer(text)], [(m.start(), m.end(), "url", m[1]) for m in _URL.finditer(text)]):
        taken = sorted(taken + free_of(found, taken))
    more = [x for x in taken if x[2] in MORE]
    return sorted(more + token_spans(text, taken))


def _scan():
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("found", pa.list_(span)), ("base_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, sha = [], []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text or "")
                    sha.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in base).encode()).hexdigest())
                    rows.append([{"start": a, "end": b, "kind": k, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for a, b, k, v in base + more_spans(text or "", base)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("repo"), batch.column("owner"), pa.array(rows, pa.list_(span)), pa.array(sha, pa.string())], schema=schema)

    return run


def ownership(spans: DataFrame) -> DataFrame:
    """(value, repos, owners) of spans (value, repo, owner)."""
    pairs = spans.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("value").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("places"))


def scan_secrets(docs: DataFrame, repo: Column, owner: Column, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, base_sha256, secrets): secrets is an array of (start, end, kind, class, repos, owners), by start and kind."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), "text").filter("doc_id is not null")
    found = materialise(rows.mapInArrow(_scan(), "doc_id long, repo string, owner string, found array<struct<start: long, end: long, kind: string, value: string>>, base_sha256 string"), "secrets")
    # rows of one id are told apart by what was found in them; equal ones share their answer
    found = found.withColumn("_row", F.xxhash64("found", "base_sha256"))
    spans = found.select("doc_id", "_row", "repo", "owner", F.explode("found").alias("x")).select("doc_id", "_row", "repo", "owner", "x.*")
    # written first: a join of two plain exchanges can be split where a value is hot
    owned = materialise(ownership(spans), "secrets-owned")
    kind = F.when((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos), "live").otherwise("example")
    judged = spans.join(owned, "value").withColumn("class", kind).filter(F.col("kind").isin(*KINDS) | (F.col("class") == "live"))
    order = F.array_position(F.array(*map(F.lit, (*KINDS, *MORE))), F.col("kind"))
    by_doc = judged.groupBy("doc_id", "_row").agg(F.array_sort(F.collect_set(F.struct("start", order.alias("rank"), "end", "kind", "class", "repos", "owners"))).alias("s"))
    lean = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["class"].alias("class"), x["repos"].alias("repos"), x["owners"].alias("owners")))
    none = F.array().cast("array<struct<start: long, end: long, kind: string, class: string, repos: long, owners: long>>")
    return found.select("doc_id", "_row", "base_sha256").join(by_doc, ["doc_id", "_row"], "left").select("doc_id", "base_sha256", F.coalesce(lean, none).alias("secrets"))
