"""Readers of map extracts, registers and counters; all through Spark's own sources, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo, tags

_TAG = "array<struct<_k:string,_v:string>>"


def _tag_map(c: str) -> Column:
    return F.map_from_entries(F.transform(F.coalesce(F.col(c), F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"])))


def osm_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes (node, lon, lat, tags), ways (way, refs, tags) and relations (relation, tags, members) of an XML extract."""

    def read(row: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)

    node = read("node", f"_id long, _lon double, _lat double, tag {_TAG}")
    way = read("way", f"_id long, nd array<struct<_ref:long>>, tag {_TAG}")
    relation = read("relation", f"_id long, member array<struct<_type:string,_ref:long>>, tag {_TAG}")
    return {
        "node": node.select(F.col("_id").alias("node"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tag_map("tag").alias("tags")),
        "way": way.select(F.col("_id").alias("way"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tag_map("tag").alias("tags")),
        "relation": relation.select(F.col("_id").alias("relation"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"))).alias("members"), _tag_map("tag").alias("tags")),
    }


def bicycle_route_ways(relation: DataFrame) -> DataFrame:
    """(way): members of bicycle routes."""
    routes = relation.filter("coalesce(tags['type'], '') = 'route' and coalesce(tags['route'], '') = 'bicycle'")
    return routes.select(F.explode("members").alias("m")).filter("m.type in ('way', 'w')").select(F.col("m.ref").alias("way")).distinct()


def way_segments(way: DataFrame, node: DataFrame, route_ways: DataFrame, bounds=C.BOUNDS, margin: float = C.BOUNDS_MARGIN) -> DataFrame:
    """Raw segments (as ``network.dedupe_segments`` takes them) of rideable ways with any node in the widened box.

    Nodes without a position break no way: neighbours that have one are joined, as the reader drops the others.
    """
    rows = way.filter(tags.rideable(F.col("tags"))).select("way", "tags", F.posexplode("refs").alias("pos", "node"))
    rows = rows.join(node.select("node", "lon", "lat").filter("lon is not null and lat is not null"), "node")
    from pyspark.sql import Window

    w = Window.partitionBy("way").orderBy("pos")
    any_in = F.max(geo.within("lon", "lat", bounds, margin).cast("int")).over(Window.partitionBy("way"))
    rows = rows.withColumn("_in", any_in).filter("_in = 1")
    nxt = {f"_{c}": F.lead(c).over(w) for c in ("node", "lon", "lat")}
    rows = rows.withColumns(nxt).filter("_node is not null and _node <> node")
    flagged = rows.join(route_ways.withColumn("_net", F.lit(True)), "way", "left")
    t, direction = F.col("tags"), tags.bicycle_direction(F.col("tags"))
    return flagged.select(
        F.col("node").alias("a"), F.col("_node").alias("b"), (F.col("way") * 100_000 + F.col("pos")).alias("seq"), geo.distance_m("lon", "lat", "_lon", "_lat").alias("length"),
        tags.surface_kind(t).alias("surface"), tags.surface_grade(t).alias("grade"), tags.traffic_class(t).alias("traffic"), F.coalesce(t["lit"] == "yes", F.lit(False)).alias("lit"),
        F.coalesce(t["name"], F.lit("")).alias("name"), (direction >= 0).alias("forward"), (direction <= 0).alias("backward"), tags.way_class(t, F.coalesce("_net", F.lit(False))).alias("class"),
    )


def geojson_points(spark: SparkSession, path: str, city: str, name_keys: list[str], live_key: str | None = None, live: tuple[str, ...] = ("Liikennevalot", "")) -> DataFrame:
    """(lon, lat, city, name, seq) of the live points of a feature collection; the first name key that is filled."""
    props = "map<string,string>"
    schema = f"features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:{props}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("seq", "f"))
    rows = rows.filter("f.geometry.type = 'Point'")
    if live_key:
        rows = rows.filter(F.coalesce(F.col("f.properties")[live_key], F.lit("")).isin(*live))
    name = F.coalesce(*(F.col("f.properties")[k] for k in name_keys))
    return rows.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), F.lit(city).alias("city"), name.alias("name"), F.col("seq").cast("long").alias("seq"))


def gml_points(spark: SparkSession, path: str, city: str) -> DataFrame:
    """(lon, lat, city, name, seq) of the gml:pos elements; in this region the smaller number is the longitude, whatever the axis order."""
    rows = spark.read.text(path, wholetext=True)
    pos = F.regexp_extract_all("value", F.lit(r"<(?:\w+:)?pos[^>]*>\s*([-0-9.eE]+\s+[-0-9.eE]+)\s*<"), F.lit(1))
    rows = rows.select(F.posexplode(pos).alias("seq", "p")).withColumn("xy", F.split("p", r"\s+"))
    x, y = F.col("xy")[0].cast("double"), F.col("xy")[1].cast("double")
    return rows.select(F.least(x, y).alias("lon"), F.greatest(x, y).alias("lat"), F.lit(city).alias("city"), F.lit(None).cast("string").alias("name"), F.col("seq").cast("long").alias("seq"))


def counters(rows: DataFrame, place: str, year: str, daily: str, line: str) -> DataFrame:
    """(place, year, daily, lon, lat): readings that are numbers above zero, at the mean of their line's points (array of lon, lat)."""
    n = F.size(line)
    mean = lambda i: F.aggregate(line, F.lit(0.0), lambda a, p: a + p[i]) / n
    out = rows.select(F.col(place).alias("place"), F.expr(f"try_cast(`{year}` as int)").alias("year"), F.expr(f"try_cast(`{daily}` as double)").alias("daily"), F.when(n > 0, mean(0)).alias("lon"), F.when(n > 0, mean(1)).alias("lat"))
    return out.filter("daily > 0 and lon is not null")


def sections(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """(section, i, value) of a packed file: typed sections at the offsets of its manifest; a name or type that is off is refused.

    manifest: {"sections": [{"name", "offset", "count", "type"}]}, types int32, uint16, uint8, float32. gzip is told by its first bytes.
    """
    import gzip

    import numpy as np

    kinds = {"int32": "<i4", "uint16": "<u2", "uint8": "u1", "float32": "<f4"}
    wanted = [(s["name"], s["offset"], s["count"], kinds[s["type"]]) for s in manifest["sections"]]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                for name, offset, count, kind in wanted:
                    v = np.frombuffer(data, kind, count, offset)
                    yield pd.DataFrame({"section": name, "i": np.arange(count), "value": v.astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "section string, i long, value double")


def missing_sheets(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(sheet) of those wanted that are not there yet."""
    return wanted.select("sheet").exceptAll(present.select("sheet").distinct()).distinct()


def map_sheets(bounds: DataFrame, slack: float = 500.0) -> DataFrame:
    """(sheet): names of the 24 x 12 km sheets that boxes (west, south, east, north, metres of the national grid) touch, widened by ``slack``.

    Sheets of 192 x 96 km are lettered northwards and numbered eastwards, then quartered three times: 1 south-west,
    2 north-west, 3 south-east, 4 north-east.
    """
    # Corner and size of sheet K2, and the letters.
    west0, south0, width, height, letters = -76_000.0, 6_570_000.0, 192_000.0, 96_000.0, "KLMNPQRSTUVWX"
    cells = lambda low, high, zero, step: F.explode(F.sequence(F.floor((F.col(low) - slack - zero) / step), F.floor((F.col(high) + slack - zero) / step)))
    grid = bounds.select(cells("west", "east", west0, width / 8).alias("cx"), "south", "north").select("cx", cells("south", "north", south0, height / 8).alias("cy")).distinct()
    quarter = lambda n: (F.floor(F.col("cx") / n) % 2 * 2 + F.floor(F.col("cy") / n) % 2 + 1).cast("string")
    letter = F.substring(F.lit(letters), (F.floor(F.col("cy") / 8) + 1).cast("int"), F.lit(1))
    return grid.select(F.concat(letter, (F.floor(F.col("cx") / 8) + 2).cast("string"), quarter(4), quarter(2), quarter(1)).alias("sheet")).distinct()
