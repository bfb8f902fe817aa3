import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from velonet.operators import network
from velonet.sources import readers, sinks
from velonet.streaming import usage

OSM = """<osm><node id="1" lon="24.940" lat="60.170"/><node id="2" lon="24.942" lat="60.170"><tag k="highway" v="crossing"/></node><node id="3" lon="24.944" lat="60.170"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="name" v="Katu"/></way>
<way id="11"><nd ref="1"/><nd ref="3"/><tag k="highway" v="motorway"/></way>
<relation id="5"><member type="way" ref="10"/><tag k="type" v="route"/><tag k="route" v="bicycle"/></relation></osm>"""


def test_map_extract_to_segments(spark, tmp_path):
    (tmp_path / "x.osm").write_text(OSM)
    t = readers.osm_xml(spark, str(tmp_path / "x.osm"))
    assert t["node"].filter("node = 2").first().tags == {"highway": "crossing"}
    raw = readers.way_segments(t["way"], t["node"], readers.bicycle_route_ways(t["relation"]))
    got = sorted((r.a, r.b, r.name, r["class"]) for r in network.dedupe_segments(raw).collect())
    assert got == [(1, 2, "Katu", 4), (2, 3, "Katu", 4)]
    assert readers.way_segments(t["way"], t["node"], readers.bicycle_route_ways(t["relation"]), (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_registers(spark, tmp_path):
    f = {"features": [{"geometry": {"type": "Point", "coordinates": [24.9, 60.2]}, "properties": {"tyyppi": "Liikennevalot", "nimi": "A"}}, {"geometry": {"type": "Point", "coordinates": [24.8, 60.2]}, "properties": {"tyyppi": "Suunniteltu"}}, {"geometry": {"type": "Point", "coordinates": [24.7, 60.2]}, "properties": {"name": "B"}}]}
    (tmp_path / "a.json").write_text(json.dumps(f))
    got = [(r.lon, r.city, r.name) for r in readers.geojson_points(spark, str(tmp_path / "a.json"), "x", ["nimi", "name"], "tyyppi").orderBy("seq").collect()]
    assert got == [(24.9, "x", "A"), (24.7, "x", "B")]
    (tmp_path / "a.gml").write_text("<c><gml:pos>60.2 24.9</gml:pos><gml:pos srs='q'> 24.8  60.1 </gml:pos></c>")
    assert [(r.lon, r.lat) for r in readers.gml_points(spark, str(tmp_path / "a.gml"), "x").orderBy("seq").collect()] == [(24.9, 60.2), (24.8, 60.1)]


def test_counters(spark):
    df = spark.createDataFrame([("a", "2020", "10.5", [[24.0, 60.0], [25.0, 61.0]]), ("b", "x", "0", [[1.0, 1.0]]), ("c", "2020", "n/a", [[1.0, 1.0]]), ("d", "2020", "3", [])], "p string, y string, d string, l array<array<double>>")
    assert [(r.place, r.year, r.daily, r.lon, r.lat) for r in readers.counters(df, "p", "y", "d", "l").collect()] == [("a", 2020, 10.5, 24.5, 60.5)]


def test_packed_sections(spark, tmp_path):
    blob = struct.pack("<2i", -5, 7) + struct.pack("<3H", 1, 2, 65535)
    (tmp_path / "g.bin").write_bytes(gzip.compress(blob))
    m = {"sections": [{"name": "x", "offset": 0, "count": 2, "type": "int32"}, {"name": "y", "offset": 8, "count": 3, "type": "uint16"}]}
    got = [(r.section, r.i, r.value) for r in readers.sections(spark, str(tmp_path / "g.bin"), m).orderBy("section", "i").collect()]
    assert got == [("x", 0, -5.0), ("x", 1, 7.0), ("y", 0, 1.0), ("y", 1, 2.0), ("y", 2, 65535.0)]
    with pytest.raises(KeyError):
        readers.sections(spark, str(tmp_path / "g.bin"), {"sections": [{"name": "x", "offset": 0, "count": 2, "type": "int64"}]})


def test_map_sheets(spark):
    box = spark.createDataFrame([(-75_000.0, 6_571_000.0, -74_000.0, 6_572_000.0)], "west double, south double, east double, north double")
    assert {r.sheet for r in readers.map_sheets(box).collect()} == {"K2111"}
    box = spark.createDataFrame([(-52_200.0, 6_571_000.0, -51_800.0, 6_581_900.0)], "west double, south double, east double, north double")
    assert {r.sheet for r in readers.map_sheets(box).collect()} == {"K2111", "K2112", "K2113", "K2114"}


EDGE = "edge_id long, length double, grade int"


def test_sink_round_trip_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 0), (0, 20.0, 3)], EDGE)
    sinks.write({"edge": df}, str(tmp_path / "g"), "graph", {"edge": ["edge_id"]}, note="x")
    tables, manifest = sinks.read(spark, str(tmp_path / "g"), "graph")
    assert sorted(map(tuple, tables["edge"].collect())) == [(0, 20.0, 3), (1, 10.0, 0)] and manifest["note"] == "x"
    with pytest.raises(ValueError):
        sinks.read(spark, str(tmp_path / "g"), "climb")
    with pytest.raises(Exception, match="grade out of"):
        sinks.checked(spark.createDataFrame([(1, 10.0, 9)], EDGE)).collect()
    with pytest.raises(Exception, match="length out of"):
        sinks.checked(spark.createDataFrame([(1, None, 1)], EDGE)).collect()
    with pytest.raises(ValueError):
        sinks.same_rows(df.limit(1), df)
    with pytest.raises(Exception, match="lon out of"):
        sinks.inside(spark.createDataFrame([(0.0, 60.2)], "lon double, lat double")).collect()


def test_usage_stream(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", [1, 2]), ("2024-01-01 10:50:00", [2]), ("2024-01-01 20:00:00", [3])]
    df = spark.createDataFrame(rows, "ts string, edges array<long>").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    usage.start(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.edge, r.trips) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1), (2, 2)]  # the last window is still open


def test_digests_know_rows_not_partitions(spark, tmp_path):
    rows = [(i, f"n{i % 3}", {"k": str(i)}, [float(i)]) for i in range(50)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "edge_id long, name string, tags map<string,string>, xs array<double>")
    again = df.orderBy("name", "edge_id").repartition(7).select("xs", "tags", "name", "edge_id")
    assert sinks.digest(df) == sinks.digest(again) != sinks.digest(df.filter("edge_id > 0")) and sinks.digest(df) != sinks.digest(df.unionByName(df.limit(1)))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write({"edges": df.repartition(2)}, a, "graph", {"edges": ["edge_id"]})
    sinks.write({"edges": df.repartition(9)}, b, "graph", {"edges": ["edge_id"]})
    assert sinks.read(spark, a, "graph")[1]["digests"] == sinks.read(spark, b, "graph")[1]["digests"]
    df.withColumn("name", F.lit("x")).write.mode("overwrite").parquet(f"{b}/edges")
    with pytest.raises(ValueError, match="other rows"):
        sinks.read(spark, b, "graph")
