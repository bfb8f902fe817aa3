"""WARC archives: writing captures, reading records back, and assembling transactions.

``write_captures`` writes a request, a response (or revisit) and a metadata record per
capture through Spark's own text writer, so any store that Spark reaches will do. A
record ends in two CR LF, which serve as the line separator; Content-Length alone
decides where a payload ends when reading. Captures are written by classes of size (``SIZES``), each of which closes a file
after so many that it holds ``FILE_BYTES`` of payload at most, or a single capture.

``read_records`` takes plain files, files of gzip members and whole-file gzip, as a stream
through each file's bytes. ``assemble`` joins requests and metadata to their response,
revisit or resource by WARC-Concurrent-To, named by either side and directly or through one other
record of the capture, and gives one nested row per capture.

Edge cases: null html is an empty payload; null urls give an empty target. Payloads shorter than
``MIN_REVISIT`` bytes are always responses. Of equal payloads the largest page_id is the
response. Records that name no capture are left out of ``assemble`` (``orphans`` lists them).
Rows with a null page_id are not written; an empty table gives an archive without records. Where page ids repeat each row is a capture of its own, of equal payloads
one of those with the largest page_id is the response. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.llm.store import ids_repeat, materialise

MIN_REVISIT = 1000
FILE_BYTES = 192 << 20
#: Payload bytes at which the next class of captures begins.
SIZES = (0, 1 << 16, 1 << 22)
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, type string, target string, concurrent array<string>, refers_to string, digest_header string, payload_bytes long, payload_digest string, payload binary"
_CRLF = "\r\n"


def _uid(kind: str, page: Column) -> Column:
    """A name-based UUID: the same capture has the same record ids in each run."""
    h = F.md5(F.concat(F.lit(kind + ":"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[Column | str], block: Column) -> Column:
    """A record without the final two CR LF, which the writer adds."""
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    lines = [F.lit("WARC/1.1"), *(h if isinstance(h, Column) else F.lit(h) for h in headers), size]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def revisits(pages: DataFrame) -> DataFrame:
    """(_key, refers_to): pages (_key, page_id, html) whose payload is that of a page with a larger id, and that page's key."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", "_key", F.octet_length(payload).alias("n"), F.sha1(payload.cast("binary")).alias("sha")).filter(f"n >= {MIN_REVISIT}")
    kept = slim.groupBy("n", "sha").agg(F.max(F.struct("page_id", "_key")).alias("last"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    # written first: a join of two plain exchanges can be split where a payload is hot
    kept = materialise(kept.select("n", "sha", F.col("last._key").alias("refers_to")), "warc-kept")
    return slim.join(kept, ["n", "sha"]).filter("_key <> refers_to").select("_key", "refers_to")


def file_records(size: int) -> int:
    """How many captures of the class that begins at ``size`` bytes make a file; of the last class one alone."""
    after = [s for s in SIZES if s > size]
    return max(1, FILE_BYTES // after[0]) if after else 1


def write_captures(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, html) at ``path``."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).filter("page_id is not null")
    if ids_repeat(pages, "page_id"):
        pages = materialise(pages.withColumn("_key", F.concat_ws(":", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string"))), "warc-pages")
    else:
        pages = pages.withColumn("_key", F.col("page_id").cast("string"))
    rows = pages.join(revisits(pages), "_key", "left")
    page, again = F.col("_key"), F.col("refers_to").isNotNull()
    # line breaks would end a header; they are percent-encoded as a URI needs anyway
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"))
    digest = F.sha1(F.col("html").cast("binary"))
    common = [F.lit(f"WARC-Date: {_DATE}"), target]
    main = _uid("response", page)
    linked = F.concat(F.lit("WARC-Concurrent-To: "), main)
    name = lambda kind: F.concat(F.lit("WARC-Record-ID: "), _uid(kind, page))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_CRLF * 2))
    payload_digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)
    http = "Content-Type: application/http; msgtype="
    response = _record(["WARC-Type: response", name("response"), *common, payload_digest, http + "response"], F.concat(head, F.col("html")))
    revisit = _record(["WARC-Type: revisit", name("response"), *common, payload_digest, F.concat(F.lit("WARC-Refers-To: "), _uid("response", F.col("refers_to"))), f"WARC-Profile: {_REVISIT}", http + "response"], head)
    request = _record(["WARC-Type: request", name("request"), *common, linked, http + "request"], F.concat(F.lit("GET "), F.regexp_replace("url", r"[\r\n ]", ""), F.lit(" HTTP/1.1\r\nAccept: */*\r\n\r\n")))
    metadata = _record(["WARC-Type: metadata", name("metadata"), *common, linked, "Content-Type: application/warc-fields"], F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_CRLF)))
    one = F.concat_ws(_CRLF * 2, request, F.when(again, revisit).otherwise(response), metadata)
    n = F.octet_length("html")
    bounds = [(low, n >= low if high is None else (n >= low) & (n < high)) for low, high in zip(SIZES, (*SIZES[1:], None))]
    many = pages.agg(*(F.count_if(within) for _, within in bounds)).first()
    present = [b for b, c in zip(bounds, many) if c] or bounds[:1]
    for low, within in present:
        # the only class needs no filter
        of_size = rows.filter(within) if len(present) > 1 else rows
        of_size.select(one.alias("value")).write.mode("append").option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records(low)).text(path)


class _Inflated:
    """Bytes of a plain or gzip (one member or many) buffer, inflated as they are asked for; the buffer itself is never copied."""

    def __init__(self, raw: bytes):
        self.raw, self.spot, self.gz = memoryview(raw), 0, raw[:2] == b"\x1f\x8b"
        self.coder, self.held = None, bytearray()

    def _more(self) -> bool:
        if not self.gz:
            took = self.raw[self.spot : self.spot + (1 << 20)]
            self.spot += len(took)
            self.held += took
            return bool(len(took))
        while self.spot < len(self.raw):
            self.coder = self.coder or zlib.decompressobj(31)
            took = self.raw[self.spot : self.spot + (1 << 16)]
            out = self.coder.decompress(took)
            self.spot += len(took) - len(self.coder.unused_data)
            if self.coder.eof:
                self.coder = None
            if out:
                self.held += out
                return True
        return False

    def line(self) -> bytes | None:
        begin = 0
        while (at := self.held.find(b"\r\n", begin)) < 0:
            begin = max(0, len(self.held) - 1)
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"a record ends {n - len(self.held)} bytes early")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record of a file."""
    data = _Inflated(raw)
    while (line := data.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        last = ""
        while line := data.line():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and last:
                headers[last][-1] += " " + text.strip()
                continue
            last, _, value = text.partition(":")
            last = last.strip().lower()
            headers.setdefault(last, []).append(value.strip())
        yield headers, data.take(int(headers.get("content-length", ["0"])[0]))


def _payload(headers: dict[str, list[str]], block: bytes) -> bytes:
    if headers.get("content-type", [""])[0].startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _records(with_payload: bool):
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("concurrent", pa.list_(pa.string())), ("refers_to", pa.string()), ("digest_header", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, size = [], 0
                for h, block in parse(raw.as_py()):
                    body, one = _payload(h, block), lambda k: h.get(k, [None])[0]  # noqa: B023
                    kind = one("warc-type")
                    kept = with_payload or kind == "metadata"
                    rows.append((one("warc-record-id"), kind, one("warc-target-uri"), h.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-payload-digest"), len(body), hashlib.sha1(body).hexdigest(), body if kept else None))
                    size += 200 + len(body) * kept
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives at ``path``; without ``with_payload`` only metadata keep theirs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_records(with_payload), _RECORD)


_MAIN = "type in ('response', 'revisit', 'resource')"


def _attached(records: DataFrame) -> DataFrame:
    """(capture, record_id) of each request and metadata record."""
    side = records.filter(f"not {_MAIN}").select("record_id", "concurrent")
    main = records.filter(_MAIN).select(F.col("record_id").alias("capture"), "concurrent")
    named = side.select("record_id", F.explode("concurrent").alias("to"))
    ids = main.select(F.col("capture").alias("to"), F.col("capture"))
    direct = named.join(ids, "to").select("capture", "record_id")
    back = main.filter("size(concurrent) > 0").select("capture", F.explode("concurrent").alias("record_id")).join(side.select("record_id"), "record_id").select("capture", "record_id")
    one = direct.unionByName(back).distinct()
    # those that name another request or metadata record of the capture
    rest = named.join(ids, "to", "left_anti")
    via = rest.join(one.select(F.col("record_id").alias("to"), "capture"), "to").select("capture", "record_id")
    return one.unionByName(via).distinct()


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture, type, target, payload fields of its own, ``refers_to``, ``request`` (struct, of several the least record id) and ``metadata`` (array)."""
    linked = _attached(records)
    body = F.struct("record_id", "target", "payload_bytes", "payload_digest", "payload")
    request = linked.join(records.filter("type = 'request'"), "record_id").groupBy("capture").agg(F.min(body).alias("request"))
    metadata = linked.join(records.filter("type = 'metadata'"), "record_id").groupBy("capture").agg(F.array_sort(F.collect_list(body)).alias("metadata"))
    main = records.filter(_MAIN).withColumnRenamed("record_id", "capture").drop("concurrent")
    return main.join(request, "capture", "left").join(metadata, "capture", "left")


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata that belong to no capture."""
    return records.filter(f"not {_MAIN}").join(_attached(records).select("record_id"), "record_id", "left_anti")


def resolve_revisits(captures: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``captures`` with payload_bytes and payload_digest of the full payload: a revisit's are those of the record it refers to.

    Columns named in ``carry`` come along as ``refers_<name>``. A revisit whose record is in no archive has a null
    payload_bytes and the digest of its own header.
    """
    carry = carry or []
    full = captures.filter("type <> 'revisit'").select(F.col("capture").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), *(F.col(c).alias(f"refers_{c}") for c in carry))
    again = captures.filter("type = 'revisit'").join(full, "refers_to", "left")
    declared = F.regexp_extract("digest_header", "(?i)^sha1:([0-9a-f]{40})$", 1)
    again = again.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.coalesce("_digest", F.nullif(F.lower(declared), F.lit("")))}).drop("_bytes", "_digest")
    plain = captures.filter("type <> 'revisit'").withColumns({f"refers_{c}": F.lit(None).cast(captures.schema[c].dataType) for c in carry})
    return plain.unionByName(again)
