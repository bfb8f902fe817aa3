"""An extract written here in protocol buffers gives the tables of the same extract in XML."""

import struct
import zlib

import numpy as np
import pytest
from test_sources import OSM

from velonet.operators import network
from velonet.sources import pbf, readers


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(n):
    return varint((n << 1) ^ (n >> 63))


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def delta(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values))


class Writer:
    def __init__(self):
        self.out, self.words = b"", [""]

    def word(self, s):
        if s not in self.words:
            self.words.append(s)
        return self.words.index(s)

    def blob(self, kind, data, packed=True):
        body = field(2, len(data)) + field(3, zlib.compress(data)) if packed else field(1, data)
        header = field(1, kind) + field(3, len(body))
        self.out += struct.pack(">i", len(header)) + header + body

    def block(self, *groups, packed=True, more=b""):
        table = b"".join(field(1, w.encode()) for w in self.words)
        self.blob(b"OSMData", field(1, table) + b"".join(field(2, g) for g in groups) + more, packed)
        self.words = [""]

    def tags(self, tags):
        pairs = [(self.word(k), self.word(v)) for k, v in tags.items()]
        return field(2, b"".join(varint(k) for k, _ in pairs)) + field(3, b"".join(varint(v) for _, v in pairs)) if pairs else b""

    def dense(self, nodes, step=100, lat0=0, lon0=0):
        unit = lambda x, o: round((x * 1e9 - o) / step)
        kv = b"".join(b"".join(varint(self.word(k)) + varint(self.word(v)) for k, v in t.items()) + varint(0) for *_, t in nodes)
        return field(2, field(1, delta([n for n, *_ in nodes])) + field(8, delta([unit(x[2], lat0) for x in nodes])) + field(9, delta([unit(x[1], lon0) for x in nodes])) + (field(10, kv) if any(x[3] for x in nodes) else b""))

    def way(self, i, refs, tags):
        return field(3, field(1, i) + self.tags(tags) + field(8, delta(refs)))

    def relation(self, i, members, tags):
        return field(4, field(1, i) + self.tags(tags) + field(8, b"".join(varint(0) for _ in members)) + field(9, delta([r for _, r in members])) + field(10, b"".join(varint(pbf.MEMBERS.index(t)) for t, _ in members)))


def test_equals_the_xml_reader(spark, tmp_path):
    (tmp_path / "x.osm").write_text(OSM)
    w = Writer()
    w.blob(b"OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes") + field(5, b"Sort.Type_then_ID"))
    w.block(w.dense([(1, 24.94, 60.17, {}), (2, 24.942, 60.17, {"highway": "crossing"})]))
    w.block(w.dense([(3, 24.944, 60.17, {})], 1000, 7_000, -5_000), packed=False, more=field(17, 1000) + field(19, 7_000) + varint(20 << 3) + varint(-5_000))
    w.block(w.way(10, [1, 2, 3], {"highway": "residential", "name": "Katu"}) + w.way(11, [1, 3], {"highway": "motorway"}))
    w.block(w.relation(5, [("way", 10)], {"type": "route", "route": "bicycle"}))
    (tmp_path / "x.osm.pbf").write_bytes(w.out)
    xml, own = readers.osm_xml(spark, str(tmp_path / "x.osm")), pbf.osm_pbf(spark, str(tmp_path / "x.osm.pbf"))
    for kind in ("node", "way", "relation"):
        rows = lambda t: sorted(map(repr, (r.asDict(True) for r in t[kind].collect())))
        assert own[kind].columns == xml[kind].columns and rows(own) == rows(xml)
    raw = readers.way_segments(own["way"], own["node"], readers.bicycle_route_ways(own["relation"]))
    assert sorted((r.a, r.b, r.name) for r in network.dedupe_segments(raw).collect()) == [(1, 2, "Katu"), (2, 3, "Katu")]


def test_many_blobs_partitions_and_plain_nodes(spark, tmp_path):
    rng, w, want = np.random.default_rng(0), Writer(), []
    for b in range(20):
        nodes = [(int(i), float(x), float(y), {"k": f"ö{b}"} if i % 3 else {}) for i, x, y in zip(rng.integers(-(1 << 40), 1 << 40, 50), rng.integers(-1800000000, 1800000000, 50) / 1e7, rng.integers(-900000000, 900000000, 50) / 1e7)]
        want += nodes
        if b % 4 == 3:
            plain = b"".join(field(1, varint(1 << 3) + zigzag(i) + w.tags(t) + varint(8 << 3) + zigzag(round(y * 1e7)) + varint(9 << 3) + zigzag(round(x * 1e7))) for i, x, y, t in nodes)
            w.block(plain)
        else:
            w.block(w.dense(nodes[:30]), w.dense(nodes[30:]))
    (tmp_path / "n.pbf").write_bytes(w.out)
    spark.dataSource.register(pbf.PbfSource)
    df = spark.read.format("osm_pbf").option("partitionBytes", 3000).load(str(tmp_path / "n.pbf"))
    assert df.rdd.getNumPartitions() > 3
    got = sorted((r.node, round(r.lon, 7), round(r.lat, 7), r.tags) for r in df.collect())
    assert got == sorted((i, round(x, 7), round(y, 7), t) for i, x, y, t in want)
    assert spark.read.format("osm_pbf").option("kind", "way").load(str(tmp_path / "n.pbf")).count() == 0


def test_refusals_and_empty_files(spark, tmp_path):
    w = Writer()
    w.blob(b"OSMHeader", field(4, b"HistoricalInformation"))
    (tmp_path / "h.pbf").write_bytes(w.out)
    with pytest.raises(ValueError, match="HistoricalInformation"):
        pbf.index(str(tmp_path / "h.pbf"))
    (tmp_path / "e.pbf").write_bytes(b"")
    assert pbf.osm_pbf(spark, str(tmp_path / "e.pbf"))["node"].count() == 0
    with pytest.raises(ValueError):
        list(pbf.fields(memoryview(field(1, b"abc")[:-1])))


def test_varints():
    values = [0, 1, 127, 128, 300, (1 << 63) - 1, (1 << 64) - 1]
    assert pbf.varints(memoryview(b"".join(map(varint, values)))).tolist() == values
    back = [0, -1, 1, -(1 << 63), (1 << 63) - 1, 12345, -98765]
    assert pbf.signed(pbf.varints(memoryview(b"".join(map(zigzag, back))))).tolist() == back
