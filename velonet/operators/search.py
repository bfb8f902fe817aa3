"""Ranked search-as-you-type over streets, doors and places; index building; reverse geocoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo, tags, text
from velonet.operators.spatial import grid_join, nearest
from velonet.sources import sinks
from velonet.sources.shared import Parts, Rounds, cut_lineage


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def addresses(doors: DataFrame) -> DataFrame:
    """First door per (street, number), by ``seq``; entry order is (street, number as text)."""
    return first_of(doors, ["street", "number"], ["seq"]).select("street", "number", "lon", "lat")


def streets(address: DataFrame, roads: DataFrame) -> DataFrame:
    """(street, lon, lat, doors): every street with doors or a named road; its point is its first door's, else the road's."""
    door = address.groupBy("street").agg(F.min_by(F.struct("lon", "lat"), "number").alias("p"), F.count(F.lit(1)).alias("doors"))
    road = roads.groupBy("street").agg(F.min_by(F.struct("lon", "lat"), "seq").alias("r"))
    both = door.join(road, "street", "full")
    return both.select("street", F.coalesce("p", "r").alias("p"), F.coalesce("doors", F.lit(0)).alias("doors")).select("street", "p.lon", "p.lat", "doors")


def cap_names(places: DataFrame, most: int = C.POINTS_PER_NAME) -> DataFrame:
    """At most ``most`` points per (name, kind): notable first, then by (lon, lat)."""
    w = Window.partitionBy("name", "kind").orderBy(F.desc("notability"), "lon", "lat")
    return places.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def merge_points(places: DataFrame, apart: float = 1e-4) -> DataFrame:
    """(name, kind, seq, lon, lat, notability): places of one (name, kind) within ``apart`` degrees on both axes of a kept one merge into it, in order of ``seq``.

    A merged place goes to the first kept one in its reach, which takes the highest notability. Cells are a little wider than ``apart``, so what is
    near lies in the same cell or one beside it. A round keeps every cell's first open place that comes before those of the cells around, and closes
    what lies near it: no list of a name's places is ever gathered, so one name may be as frequent as it likes. Equal ``seq`` go by coordinates;
    places without coordinates stay as they are.
    """
    known = F.coalesce((F.abs("lon") < 1e9) & (F.abs("lat") < 1e9), F.lit(False))
    text_of = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), c))
    at = lambda c: F.floor(F.col(c) / F.lit(apart * 1.01)).cast("long")
    columns = ["name", "kind", "seq", "lon", "lat", "notability"]
    key = ["_key", "_cx", "_cy"]
    points = places.filter(known).select(*columns, F.concat_ws("\0", text_of("name"), text_of("kind")).alias("_key"), at("lon").alias("_cx"), at("lat").alias("_cy"))
    points = cut_lineage(points.withColumn("_o", F.struct("seq", "lon", "lat", "notability")), "points")
    step = F.sequence(F.lit(-1), F.lit(1))
    around = lambda df: df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")
    near = (F.abs(F.col("lon") - F.col("_k.lon")) < apart) & (F.abs(F.col("lat") - F.col("_k.lat")) < apart)

    open_, kept, left = points, Parts("kept", lambda t: t), Rounds("open")
    while True:
        first = open_.groupBy(*key).agg(F.min("_o").alias("_k")).withColumns({"_x": F.col("_cx"), "_y": F.col("_cy")})
        own = F.when((F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), F.col("_k"))
        reached = around(first).groupBy(*key).agg(F.max(own).alias("_k"), F.min("_k").alias("_b"))
        new = kept.add(reached.filter(F.col("_k") == F.col("_b")).select(*key, "_k"))
        if new.isEmpty():
            break
        reach = around(new).select(*(F.col(c).alias(f"{c}2") for c in key), "_k")
        open_ = left.write(open_.join(reach, (F.col("_key") == F.col("_key2")) & (F.col("_cx") == F.col("_cx2")) & (F.col("_cy") == F.col("_cy2")) & near, "left_anti"))
    mine = points.join(around(kept.table().select(*key, "_k")), key).filter(near).groupBy("name", "kind", "_o").agg(F.min("_k").alias("_k"))
    merged = mine.groupBy("name", "kind", "_k").agg(F.max("_o.notability").alias("notability"))
    return merged.select("name", "kind", "_k.seq", "_k.lon", "_k.lat", "notability").unionByName(places.filter(~known).select(*columns))


def place_context(places: DataFrame, address: DataFrame, radius: float = C.PLACE_CONTEXT) -> DataFrame:
    """places (place, lon, lat, ...) with ``street``: that of the nearest door nearer than ``radius``, else null."""
    doors = address.select(F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), "street", "number")
    near = grid_join(places.select("place", "lon", "lat"), doors, radius, 0.01).filter(F.col("metres") < radius)
    best = near.groupBy("place").agg(F.min(F.struct("metres", "street", "number")).alias("b"))
    return places.join(best.select("place", F.col("b.street").alias("street")), "place", "left")


def _pieces(c, n: int):
    """All strings of ``n`` characters in a column, none if it is shorter."""
    last = F.length(c) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_index(texts: DataFrame) -> DataFrame:
    """(f, gram) of every folded text ``f``, once: its strings of one, two and three characters."""
    f = F.col("f")
    return texts.select("f").distinct().select("f", F.explode(F.array_distinct(F.concat(*(_pieces(f, n) for n in (1, 2, 3))))).alias("gram"))


def containing(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, f): the texts (f) that contain what each query asks (query, part).

    Whatever contains a part contains its rarest string of three characters, so that is joined and the rest verified; a part of fewer characters is a gram
    itself. A query meets as many texts as hold its rarest gram, not all.
    """
    index = cut_lineage(gram_index(texts), "grams")
    part = F.col("part")
    grams = asked.filter(part != "").select("query", "part", F.explode(F.array_distinct(F.when(F.length(part) >= 3, _pieces(part, 3)).otherwise(F.array(part)))).alias("gram"))
    often = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = grams.join(often, "gram", "left").groupBy("query", "part").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").filter(F.col("f").contains(part)).select("query", "f")


def search(queries: DataFrame, places: DataFrame, streets_: DataFrame, doors: DataFrame, limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """(query, rank, label, detail, lon, lat) of up to ``limit`` hits of each query (query, text).

    places: place, name, kind, rank (of the kind), lon, lat, street. streets: street, lon, lat, doors. doors: street, number, lon,
    lat. Classes in order: place equal, street prefix, place prefix, street inside, place inside. With a house number only streets
    count and doors must begin with it. Names are matched through an index of their grams (``containing``).
    """
    number, street = F.col("_number"), F.col("_street")
    q = queries.filter(F.length(F.trim("text")) >= C.SEARCH_LEAST).withColumns(dict(zip(("_s", "_n"), text.query_parts(F.col("text")))))
    q = q.select("query", text.fold(F.col("_s")).alias("_street"), text.fold(F.col("_n")).alias("_number")).filter(street != "")

    p, s = places.withColumn("_f", text.fold(F.col("name"))), streets_.withColumn("_f", text.fold(F.col("street")))
    names = p.select(F.col("_f").alias("f")).unionByName(s.select(F.col("_f").alias("f")))
    met = q.join(cut_lineage(containing(q.select("query", street.alias("part")), names), "met").withColumnRenamed("f", "_f"), "query")
    cls = F.when(F.col("_f") == street, 0).when(F.col("_f").startswith(street), 2).otherwise(4)
    hits = met.filter(number == "").join(p, "_f")
    place_hits = hits.select("query", cls.alias("cls"), F.col("rank").alias("k1"), F.length("_f").alias("k2"), F.col("place").cast("long").alias("k3"), F.lit(0).alias("k4"), F.col("name").alias("label"), text.place_detail(F.col("kind"), F.col("street")).alias("detail"), "lon", "lat")

    hits = met.join(s, "_f").withColumn("_prefix", F.col("_f").startswith(street))
    # the scan runs in street order and ends with the 200th prefix hit
    before = Window.partitionBy("query").orderBy("street").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("_hits", F.coalesce(F.sum(F.col("_prefix").cast("int")).over(before), F.lit(0))).filter(F.col("_hits") < C.PREFIX_HITS)
    hits = hits.select("query", "_number", "street", F.when(F.col("_prefix"), 1).otherwise(3).alias("cls"), F.length("_f").alias("k2"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), "doors")
    d = doors.select(F.col("street").alias("d_street"), "number", F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"))
    met = hits.join(d, (F.col("street") == F.col("d_street")) & ((number == "") | text.fold(F.col("number")).startswith(number)), "left")
    nth = F.row_number().over(Window.partitionBy("query", "street").orderBy("number"))
    met = met.withColumn("k4", nth).filter(F.col("k4") <= F.when(number == "", 1).otherwise(limit))
    door = F.col("number").isNotNull()
    plain = F.when(F.col("doors") > 0, C.STREET_LABEL).otherwise(C.ROAD_LABEL)
    # one door per street without a number; where no door fits, the street itself
    label = F.when(door & (F.col("number") != ""), text.door_label(F.col("street"), F.col("number"))).otherwise(F.col("street"))
    street_hits = met.select("query", "cls", F.lit(0).alias("k1"), "k2", F.lit(0).cast("long").alias("k3"), "k4", label.alias("label"), F.when(door, C.DOOR_LABEL).otherwise(plain).alias("detail"), F.coalesce("d_lon", "s_lon").alias("lon"), F.coalesce("d_lat", "s_lat").alias("lat"), F.col("street").alias("k5"))
    both = place_hits.withColumn("k5", F.lit("")).unionByName(street_hits)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("cls", "k1", "k2", "k5", "k3", "k4"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "rank", "cls", "label", "detail", "lon", "lat")


def reverse_geocode(points: DataFrame, address: DataFrame) -> DataFrame:
    """(point, metres, label) of the nearest door of each point (point, lon, lat)."""
    doors = address.select(F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), "street", "number")
    best = nearest(points, doors, "point", ["street", "number"])
    return best.select("point", "metres", text.door_label(F.col("street"), F.col("number")).alias("label"))


def recall(truth: DataFrame, hits: DataFrame, within_m: float = 250.0) -> DataFrame:
    """top1, top3 and in_list shares: rank of the first hit of each truth row (query, lon, lat) within tolerance."""
    h = hits.select("query", "rank", F.col("lon").alias("h_lon"), F.col("lat").alias("h_lat"))
    best = truth.join(h, "query", "left").withColumn("_ok", geo.distance_m("lon", "lat", "h_lon", "h_lat") <= within_m)
    best = best.groupBy("query").agg(F.min(F.when(F.col("_ok"), F.col("rank"))).alias("rank"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return best.agg(F.count(F.lit(1)).alias("queries"), share(F.col("rank") <= 1).alias("top1"), share(F.col("rank") <= 3).alias("top3"), share(F.col("rank").isNotNull()).alias("in_list"))


def index_order(places: DataFrame) -> DataFrame:
    """``places`` with ``position``, from 0: by rank of the kind, the most notable first, then by name."""
    from velonet.operators.network import number_rows

    rows = places.withColumn("_less", -F.col("notability"))
    return number_rows(rows, ["rank", "_less", "name", "place"], "position").drop("_less")


def index_tables(nodes: DataFrame, ways: DataFrame, areas: DataFrame, bounds=C.BOUNDS) -> dict[str, DataFrame]:
    """``door`` (seq, street, number, lon, lat), ``road`` (seq, street, lon, lat), ``district`` and ``poi`` (seq, name, kind, lon, lat, notability) of an extract.

    nodes: id, lon, lat, tags. ways: id, points (array of lon, lat), tags; a named rideable way lies at its middle point. areas: id, ring
    (array of lon, lat), tags; an area lies at the mean of its ring. Doors and places come from nodes, then areas; everything outside the
    bounds goes. ``seq`` is the order in which the first of several wins.
    """
    n, t = F.size("points"), F.col("tags")
    mean = lambda i: F.try_divide(F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[i]), F.size("ring"))  # noqa: E731  the filter on size may come later
    at_node = nodes.select(F.lit(0).alias("_k"), "id", "lon", "lat", "tags")
    at_area = areas.filter(F.size("ring") > 0).select(F.lit(1).alias("_k"), "id", mean("lon").alias("lon"), mean("lat").alias("lat"), "tags")
    spots = at_node.unionByName(at_area).filter(geo.within("lon", "lat", bounds)).withColumn("seq", F.struct("_k", "id"))
    # three tables and many conditions read the tags: written once and dealt out, they are neither worked out for each of them nor by the few tasks of a small file
    spots = cut_lineage(spots.repartition("seq"), "spots")
    filled = lambda k: F.coalesce(t[k], F.lit("")) != ""
    door = spots.filter(filled("addr:street")).select("seq", t["addr:street"].alias("street"), F.coalesce(t["addr:housenumber"], F.lit("")).alias("number"), "lon", "lat")
    middle = F.floor(n / 2).cast("int")
    inside = F.exists(F.slice("points", middle + 1, 1), lambda p: geo.within(p["lon"], p["lat"], bounds))  # names the point once, however its way was made
    road = ways.filter(filled("name") & tags.rideable(t) & (n > 0) & inside).withColumn("_m", F.get("points", middle))
    road = road.select(F.col("id").alias("seq"), t["name"].alias("street"), F.col("_m.lon").alias("lon"), F.col("_m.lat").alias("lat"))
    district = spots.filter((F.col("_k") == 0) & t["place"].isin(*C.DISTRICTS) & filled("name")).select("seq", t["name"].alias("name"), t["place"].alias("kind"), "lon", "lat", F.lit(0).alias("notability"))
    poi = spots.withColumn("kind", tags.poi_kind(t)).filter("kind is not null")
    poi = poi.select("seq", F.explode(tags.names_of(t)).alias("name"), "kind", "lon", "lat", tags.notability(t).alias("notability"))
    return {"door": door, "road": first_of(road, ["street"], ["seq"]), "district": first_of(district, ["name"], ["seq"]), "poi": poi}


def build_index(nodes: DataFrame, ways: DataFrame, areas: DataFrame, bounds=C.BOUNDS) -> dict[str, DataFrame]:
    """From an extract, as ``index_tables`` takes it, to the three tables that ``search`` reads.

    ``street`` (street_id, street, lon, lat, doors), numbered by name; ``door`` (street_id, street, number, lon, lat); ``place`` (place, name,
    kind, rank, notability, lon, lat, street), numbered by rank of the kind, notability, name and place on the map: districts, and merged and
    capped points of interest of other names, each with the street it stands on.
    """
    from velonet.operators.network import number_rows

    found = index_tables(nodes, ways, areas, bounds)
    address = cut_lineage(addresses(found["door"]), "address")
    district = cut_lineage(found["district"], "district")
    street = cut_lineage(number_rows(streets(address, found["road"]), ["street"], "street_id"), "street")
    door = address.join(street.select("street", "street_id"), "street").select("street_id", "street", "number", "lon", "lat")
    poi = cap_names(merge_points(found["poi"]).join(district.select("name"), "name", "left_anti"))
    columns = ["name", "kind", "lon", "lat"]
    entries = district.select(*columns, F.lit(2).alias("notability")).unionByName(poi.select(*columns, "notability"))
    rank = F.array_position(F.array(*map(F.lit, C.PLACE_KINDS)), F.col("kind")) - 1
    entries = entries.withColumns({"rank": rank.cast("int"), "_less": -F.col("notability")})
    place = cut_lineage(number_rows(cut_lineage(entries, "entries"), ["rank", "_less", "name", "lon", "lat"], "place").drop("_less"), "place")
    return {"street": street.select("street_id", "street", "lon", "lat", "doors"), "door": door, "place": place_context(place, address).select("place", "name", "kind", "rank", "notability", "lon", "lat", "street")}


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """The tables of ``build_index`` as checked Parquet; the manifest counts streets with doors, districts, and places of each kind."""
    kinds = {r["kind"]: r["n"] for r in index["place"].groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most as many as PLACE_KINDS
    sinks.write(
        index, path, "search", {"street": ["street_id"], "door": ["street_id", "number"], "place": ["place"]},
        addressed_streets=index["street"].filter("doors > 0").count(), districts=sum(kinds.get(k, 0) for k in C.DISTRICTS), kinds={k: kinds[k] for k in C.PLACE_KINDS if k in kinds},
    )
