"""Map extracts in protocol buffers (``.osm.pbf``) as a data source: one partition for each few blobs, decoded in arrays.

    spark.dataSource.register(PbfSource)
    spark.read.format("osm_pbf").option("kind", "node").load("hdfs://.../region.osm.pbf")

or ``osm_pbf(spark, path)``, which gives the tables of ``readers.osm_xml``. The driver reads blob headers only, skipping the data; tasks
read their own blobs at their offsets, so a file may be of any size and a lost task repeats its blobs alone. Files are opened with
pyarrow's file systems: local paths, file:, hdfs: and s3: addresses, which all machines must reach.

The format's blobs hold up to 8,000 entities each; of a blob only groups of the wanted kind are decoded. Extracts with features
that the format marks as required and this reader doesn't know (such as histories) are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from velonet.sources.shared import open_file

#: Fixed values of the format: member types by number, and what a reader must understand.
MEMBERS = ("node", "way", "relation")
KNOWN = {"OsmSchema-V0.6", "DenseNodes"}
#: Bytes of blobs that one partition takes.
PARTITION_BYTES = 32 << 20

SCHEMAS = {
    "node": "node long, lon double, lat double, tags map<string,string>",
    "way": "way long, refs array<long>, tags map<string,string>",
    "relation": "relation long, members array<struct<type:string,ref:long>>, tags map<string,string>",
}
_TAGS = pa.map_(pa.string(), pa.string())
_ARROW = {
    "node": pa.schema([("node", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", _TAGS)]),
    "way": pa.schema([("way", pa.int64()), ("refs", pa.list_(pa.int64())), ("tags", _TAGS)]),
    "relation": pa.schema([("relation", pa.int64()), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64())]))), ("tags", _TAGS)]),
}


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: numbers for varints, views for what has a length."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            if at + size > end:
                raise ValueError("a field is longer than its message")
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")


def message(data: memoryview) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def varints(data: memoryview | None) -> np.ndarray:
    """Packed varints, all at once."""
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.bitwise_or.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag undone."""
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64)


def deltas(data: memoryview | None) -> np.ndarray:
    return np.cumsum(signed(varints(data)))


def _int(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def blob(data: memoryview) -> memoryview:
    """A blob's content: stored, or packed by zlib."""
    m = message(data)
    if 1 in m:
        return m[1][0]
    if 3 in m:
        return memoryview(zlib.decompress(m[3][0]))
    raise ValueError("blobs packed otherwise than by zlib are not read")


class Block:
    """The entities of a data blob."""

    def __init__(self, data: memoryview):
        m = message(data)
        self.strings = [bytes(s).decode("utf-8", "replace") for s in message(m[1][0]).get(1, [])]
        self.groups = [message(g) for g in m.get(2, [])]
        self.step, self.lat0, self.lon0 = m.get(17, [100])[0], _int(m.get(19, [0])[0]), _int(m.get(20, [0])[0])

    def degrees(self, units, offset: int):
        return (offset + self.step * units) / 1e9

    def _tags(self, m: dict[int, list]) -> list[tuple[str, str]]:
        keys, values = (varints(m[n][0]).tolist() if n in m else [] for n in (2, 3))
        return [(self.strings[k], self.strings[v]) for k, v in zip(keys, values)]

    def node(self) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            for dense in map(message, g.get(2, [])):
                ids = deltas(dense[1][0])
                lat, lon = (self.degrees(deltas(dense[n][0]), o) for n, o in ((8, self.lat0), (9, self.lon0)))
                tags: list[list] = [[] for _ in ids]
                words, at, i = varints(dense[10][0]).tolist() if 10 in dense else [], 0, 0
                while at < len(words):  # key, value, ..., 0 for each node
                    if words[at] == 0:
                        at, i = at + 1, i + 1
                    else:
                        tags[i].append((self.strings[words[at]], self.strings[words[at + 1]]))
                        at += 2
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lon), pa.array(lat), pa.array(tags, _TAGS)], schema=_ARROW["node"])
            if plain := [message(n) for n in g.get(1, [])]:
                ids, lat, lon = (signed(np.array([n[k][0] for n in plain], np.uint64)) for k in (1, 8, 9))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.degrees(lon, self.lon0)), pa.array(self.degrees(lat, self.lat0)), pa.array([self._tags(n) for n in plain], _TAGS)], schema=_ARROW["node"])

    def way(self) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            if ways := [message(w) for w in g.get(3, [])]:
                refs = [deltas(w[8][0] if 8 in w else None).tolist() for w in ways]
                yield pa.RecordBatch.from_arrays([pa.array([_int(w[1][0]) for w in ways], pa.int64()), pa.array(refs, pa.list_(pa.int64())), pa.array([self._tags(w) for w in ways], _TAGS)], schema=_ARROW["way"])

    def relation(self) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            if rows := [message(r) for r in g.get(4, [])]:
                members = [[{"type": MEMBERS[t], "ref": i} for i, t in zip(deltas(r[9][0]).tolist(), varints(r[10][0]).tolist())] if 9 in r else [] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([_int(r[1][0]) for r in rows], pa.int64()), pa.array(members, _ARROW["relation"].field("members").type), pa.array([self._tags(r) for r in rows], _TAGS)], schema=_ARROW["relation"])


@dataclass
class Blobs(InputPartition):
    """Data blobs of a file: (offset, bytes) of each."""

    path: str
    spans: list[tuple[int, int]]


def index(path: str, most: int = PARTITION_BYTES) -> list[Blobs]:
    """Where the data blobs lie; only headers are read."""
    parts, held, size = [], [], 0
    with open_file(path) as f:
        end, at = f.size(), 0
        while at < end:
            f.seek(at)
            (n,) = struct.unpack(">i", f.read(4))
            header = message(memoryview(f.read(n)))
            kind, length = bytes(header[1][0]), header[3][0]
            at += 4 + n
            if kind == b"OSMHeader":
                f.seek(at)
                needs = {bytes(x).decode() for x in message(blob(memoryview(f.read(length)))).get(4, [])}
                if needs - KNOWN:
                    raise ValueError(f"{path} needs {sorted(needs - KNOWN)}")
            elif kind == b"OSMData":
                if held and size + length > most:
                    parts.append(Blobs(path, held))
                    held, size = [], 0
                held, size = [*held, (at, length)], size + length
            at += length
    return [*parts, Blobs(path, held)] if held else parts


class PbfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.most = options["path"], options.get("kind", "node"), int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Blobs]:
        return index(self.path, self.most)

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Blobs):  # a file without data
            return
        with open_file(partition.path) as f:
            for at, size in partition.spans:
                f.seek(at)
                yield from getattr(Block(blob(memoryview(f.read(size)))), self.kind)()


class PbfSource(DataSource):
    """Options: path, kind (node, way or relation), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "node")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)


def osm_pbf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """node, way and relation tables, as ``readers.osm_xml`` gives them."""
    spark.dataSource.register(PbfSource)
    return {kind: spark.read.format("osm_pbf").option("kind", kind).load(path) for kind in SCHEMAS}
