"""Further queries: classifiers in all their branches, codes, counts, projections, tastes, and the built network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velonet.functions import cost as K
from velonet.functions import geo, tags, text
from velonet.operators import evaluate, network, routing, search, signals, winter
from velonet.operators import profile as lines
from velonet.plans.derived import _bearing, _distance
from velonet.plans.queries import _CHAIN_SQL, _TURN_SQL, query, r
from velonet.sources import readers


def _tag_map(values: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def _cycle(by: Column, values: tuple) -> Column:
    """The value at ``by`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _cycle_sql(by: str, values: tuple) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + f"][{by} % {len(values)} + 1]"


# -- tags

_NODE_TAGS = {
    "highway": (1, ("traffic_signals", "crossing", None, "crossing")), "crossing": (3, ("traffic_signals", "zebra", None)), "crossing:signals": (5, ("yes", "no", None)),
    "crossing:island": (7, ("yes", None)), "barrier": (2, ("gate", "bollard", "kerb", None, "stile")), "kerb": (11, ("raised", "lowered", "flush", None)),
}


@query(f"""
with t as (select p_partkey as id, {", ".join(f'{_cycle_sql(f"(p_partkey // {n})", v)} as "{k}"' for k, (n, v) in _NODE_TAGS.items())} from part),
s as (select *, highway = 'traffic_signals' or (highway = 'crossing' and (coalesce(crossing, '') = 'traffic_signals' or coalesce("crossing:signals", '') = 'yes')) as lit from t)
select id, coalesce(lit, false) as signal, case when lit then case when "crossing:island" = 'yes' then 3 else 2 end when highway = 'crossing' then 1 else 0 end as kind,
  case when barrier in ('gate', 'stile') then 2 when barrier = 'bollard' or kerb = 'raised' or (barrier = 'kerb' and coalesce(kerb, '') not in ('lowered', 'flush')) then 1 else 0 end as barrier from s""", derived=False)
def node_classes(d):
    p = F.col("p_partkey")
    t = F.col("t")
    rows = d.table("part").select(p.alias("id"), _tag_map({k: _cycle(F.floor(p / n), v) for k, (n, v) in _NODE_TAGS.items()}).alias("t"))
    return rows.select("id", tags.is_signal(t).alias("signal"), tags.node_kind(t).alias("kind"), tags.barrier_kind(t).alias("barrier"))


_WAY_TAGS = {
    "highway": (1, ("residential", "footway", "path", "motorway", "cycleway", "pedestrian", "steps")), "bicycle": (3, ("no", "yes", "designated", None, "use_sidepath")), "oneway": (2, ("yes", "-1", None, "no", "reverse", "1")),
    "oneway:bicycle": (5, ("no", None, "yes", None, "-1", None)), "cycleway": (7, ("opposite_lane", "track", None, None)), "cycleway:left": (11, ("separate", "opposite", None, None, None)), "junction": (4, ("roundabout", None)),
    "bridge": (13, ("yes", None, "")), "layer": (6, ("0", "1", None)), "segregated": (9, ("no", None, "yes")), "foot": (8, ("no", None)),
}


@query(f"""
with t as (select p_partkey as id, {", ".join(f'{_cycle_sql(f"(p_partkey // {n})", v)} as "{k}"' for k, (n, v) in _WAY_TAGS.items())} from part)
select id, (highway in ('residential', 'path', 'cycleway') and coalesce(bicycle, '') <> 'no') or (highway in ('footway', 'pedestrian') and coalesce(bicycle, '') in ('yes', 'designated')) as rideable,
  case when "oneway:bicycle" = 'yes' then 1 when "oneway:bicycle" = '-1' then -1 when "oneway:bicycle" = 'no' or contains(coalesce(cycleway, ''), 'opposite') or contains(coalesce("cycleway:left", ''), 'opposite') then 0
       when oneway in ('yes', '1') then 1 when oneway in ('-1', 'reverse') then -1 when oneway is null and junction = 'roundabout' then 1 else 0 end as direction,
  coalesce(bicycle, '') = 'use_sidepath' or coalesce(cycleway, '') = 'track' or coalesce("cycleway:left", '') = 'separate' as sidepath,
  highway = 'cycleway' or (highway = 'path' and coalesce(bicycle, '') = 'designated') as dedicated,
  coalesce(bridge, '') <> '' or coalesce(layer, '0') <> '0' as elevated,
  case when highway in ('footway', 'pedestrian') or coalesce(segregated, '') = 'no' or (highway = 'path' and segregated is null and coalesce(foot, '') <> 'no') then 2 else 0 end as surface from t""", derived=False)
def way_classes(d):
    p, t = F.col("p_partkey"), F.col("t")
    rows = d.table("part").select(p.alias("id"), _tag_map({k: _cycle(F.floor(p / n), v) for k, (n, v) in _WAY_TAGS.items()}).alias("t"))
    return rows.select("id", tags.rideable(t).alias("rideable"), tags.bicycle_direction(t).alias("direction"), tags.has_sidepath(t).alias("sidepath"), tags.is_dedicated(t).alias("dedicated"), tags.is_elevated(t).alias("elevated"), tags.surface_kind(t).alias("surface"))


@query("""
, ent as (select node, lon, lat, case when node % 3 = 0 then 'Katu ' || (node % 50) end as street, case when node % 5 > 0 then cast(node % 9 as varchar) end as number,
    case when node % 4 = 0 then 'museum' end as tourism, case when node % 7 = 0 then 'suburb' end as place, case when node % 6 > 0 then 'Nimi ' || (node % 40) end as name from node),
inside as (select * from ent where lon between 24.905e0 and 24.92e0 and lat between 60e0 and 60.16e0),
door_i as (select 'door' as what, street || ' ' || coalesce(number, '') as label, arg_min(lon, node) as lon from inside where street is not null group by street, number),
road_i as (select 'road', name, arg_min(lon, node) from inside where name is not null group by name),
district_i as (select 'district', name, arg_min(lon, node) from inside where place is not null and name is not null group by name),
poi_i as (select 'poi', name || '/attraction', lon from inside where tourism is not null and name is not null)
select what, label, cast(round(lon * 1e6) as bigint) as lon_e6 from (select * from door_i union all select * from road_i union all select * from district_i union all select * from poi_i)""")
def index_scan(d):
    """Doors, roads, districts and places of an extract of nodes, ways and areas (here each node is also a way of three points around it)."""
    i = F.col("node")
    t = {"addr:street": F.when(i % 3 == 0, F.concat(F.lit("Katu "), (i % 50).cast("string"))), "addr:housenumber": F.when(i % 5 > 0, (i % 9).cast("string")), "tourism": F.when(i % 4 == 0, "museum"), "place": F.when(i % 7 == 0, "suburb"), "name": F.when(i % 6 > 0, F.concat(F.lit("Nimi "), (i % 40).cast("string")))}
    rows = d.node
    nodes = rows.select(i.alias("id"), "lon", "lat", _tag_map(t).alias("tags"))
    point = lambda dx: F.struct((F.col("lon") + dx).alias("lon"), F.col("lat"))
    ways = rows.select(i.alias("id"), F.array(point(-1e-5), point(0.0), point(1e-5)).alias("points"), _tag_map({"highway": F.lit("residential"), "name": t["name"]}).alias("tags"))
    areas = rows.limit(0).select(i.alias("id"), F.array(point(0.0)).alias("ring"), _tag_map(t).alias("tags"))
    found = search.index_tables(nodes, ways, areas, (24.905, 60.0, 24.92, 60.16))
    first = search.first_of(found["door"], ["street", "number"], ["seq"])
    parts = [(first, "door", F.concat_ws(" ", "street", "number")), (found["road"], "road", F.col("street")), (found["district"], "district", F.col("name")), (found["poi"], "poi", F.concat_ws("/", "name", "kind"))]
    return reduce(DataFrame.unionByName, (df.select(F.lit(what).alias("what"), label.alias("label"), F.round(F.col("lon") * 1e6).cast("long").alias("lon_e6")) for df, what, label in parts))


@query("""
, ring as (select node // 30 as area, lon, lat, node % 30 as pos from node), closed as (select * from ring union all select area, lon, lat, 30 from ring where pos = 0)
select area, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from closed group by area""")
def area_centres(d):
    """The plain mean of a ring's vertices, the closing one included."""
    ring = d.node.select(F.floor(F.col("node") / 30).alias("area"), (F.col("node") % 30).alias("pos"), "lon", "lat")
    ring = ring.unionByName(ring.filter("pos = 0").withColumn("pos", F.lit(30).cast("long")))
    areas = ring.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))
    areas = areas.select(F.col("area").alias("id"), "ring", F.create_map(F.lit("addr:street"), F.lit("Katu")).alias("tags"))
    none = d.node.limit(0)
    points = F.array(F.struct("lon", "lat"))
    tables = search.index_tables(none.select(F.col("node").alias("id"), "lon", "lat", F.create_map(F.lit("a"), F.lit("b")).alias("tags")), none.select(F.col("node").alias("id"), points.alias("points"), F.create_map(F.lit("a"), F.lit("b")).alias("tags")), areas, (-180, -90, 180, 90))
    return tables["door"].select(F.col("seq.id").alias("area"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


# -- codes and labels


@query("""
, v as (select line, seq, cast(round(height * 10) as bigint) as v, 100 + line as anchor from height), x as (select *, v - coalesce(lag(v) over (partition by line order by seq), anchor) as delta from v)
select line, seq, delta, case when delta >= 0 then 2 * delta else -2 * delta - 1 end as code, anchor + sum(delta) over (partition by line order by seq) as value from x""")
def delta_codes(d):
    """Heights in tenths as differences, as unsigned codes, and back."""
    rows = d.height.select("line", "seq", F.round(F.col("height") * 10).cast("long").alias("v"), (F.col("line") + 100).alias("anchor"))
    coded = lines.deltas(rows, "line", "seq", "v", "anchor").withColumn("code", geo.zigzag("delta"))
    back = lines.undo_deltas(coded.withColumn("_d", geo.unzigzag("code")), "line", "seq", "_d", "anchor")
    return back.select("line", "seq", "delta", "code", "value")


@query("""
, m as (select node, node * 10 + 3 as m from node)
select m.node, printf('%.5f, %.5f', n.lat, n.lon) as label, cast(floor(m / 4.0 / 60 + 0.5) as int) as minutes, replace(printf('%.1f', m / 1000.0), '.', ',') as km,
  cast(floor(m / 9000.0 * 100 + 0.5) as bigint) as percent, case when m < 1000 then cast(cast(floor(m / 10.0 + 0.5) * 10 as bigint) as varchar) || ' m' else replace(printf('%.1f', m / 1000.0), '.', ',') || ' km' end as distance
from m join node n using (node)""")
def labels(d):
    m = F.col("node") * 10 + 3
    return d.node.select("node", geo.coordinate_label("lon", "lat").alias("label"), text.minutes(m / 4).alias("minutes"), text.km_comma(m).alias("km"), text.percent(m, F.lit(9000)).alias("percent"), text.distance_label(m).alias("distance"))


@query("""
with a as (select l_orderkey as pair, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as rank, l_quantity * 37e0 as seconds from lineitem),
f as (select *, first_value(seconds) over (partition by pair order by rank) as first, min(seconds) over (partition by pair) as quickest from a)
select pair, rank, round(seconds - first, 3) as longer, round(seconds - quickest, 3) as slower, case when rank = 1 then case when first = quickest then 'nopein' else 'paras asetuksillasi' end
  when floor((seconds - first) / 60 + 0.5) = 0 then 'sama aika' when seconds > first then '+' || cast(floor((seconds - first) / 60 + 0.5) as bigint) || ' min' else '−' || cast(-floor((seconds - first) / 60 + 0.5) as bigint) || ' min' end as label from f""", derived=False)
def alternative_labels(d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")).cast("long")
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("pair"), rank.alias("rank"), (F.col("l_quantity") * 37.0).cast("double").alias("seconds"))
    return evaluate.beside_first(rows).select("pair", "rank", r("longer").alias("longer"), r("slower").alias("slower"), "label")


# -- geometry


def _grid_sql(crs: int) -> str:
    """East and north of node's lon and lat, as ``geo.to_grid`` says them."""
    meridian, scale, false = geo.GRIDS[crs]
    radius, there, _ = geo._series()
    f = geo.ELLIPSOID[1]
    e = (f * (2 - f)) ** 0.5
    x = " + ".join(f"{c!r} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, c in enumerate(there, 1))
    y = " + ".join(f"{c!r} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, c in enumerate(there, 1))
    return f"""(select node, round({false}e0 + {scale * radius!r} * (eta + {y}), 3) as east, round({scale * radius!r} * (xi + {x}), 3) as north from
  (select node, atan2(t, cos(l)) as xi, ln((1 + q) / (1 - q)) / 2 as eta from (select *, sin(l) / sqrt(1 + t * t) as q from
  (select node, radians(lon - {meridian}e0) as l, (exp(u) - exp(-u)) / 2 as t from (select node, lon, ln((1 + s) / (1 - s)) / 2 - {e!r} * ln((1 + {e!r} * s) / (1 - {e!r} * s)) / 2 as u from (select node, lon, sin(radians(lat)) as s from node))))))"""


@query(f" select g.node, g.east, g.north, h.east as east_city, h.north as north_city, round(n.lon, 8) as lon, round(n.lat, 8) as lat from {_grid_sql(3067)} g join {_grid_sql(3879)} h using (node) join node n using (node)")
def project_points(d):
    """Both national grids, and back from the first."""
    (east, north), (east2, north2) = geo.to_grid("lon", "lat", 3067), geo.to_grid("lon", "lat", 3879)
    rows = d.node.select("node", east.alias("e"), north.alias("n"), east2.alias("e2"), north2.alias("n2"))
    lon, lat = geo.from_grid("e", "n", 3067)
    return rows.select("node", r("e").alias("east"), r("n").alias("north"), r("e2").alias("east_city"), r("n2").alias("north_city"), r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query("select node, cast(floor((lon - 24.915e0) / 2e-3) as bigint) as floored, cast(trunc((lon - 24.915e0) / 2e-3) as bigint) as truncated from node")
def grid_cells(d):
    x = F.col("lon") - 24.915
    return d.node.select("node", geo.cell(x, 2e-3).alias("floored"), geo.cell_truncated(x, 2e-3).alias("truncated"))


@query(f"""
, p as (select node // 30 as line, node % 30 as pos, lon, lat, lead(lon) over w as lon2, lead(lat) over w as lat2, count(*) over (partition by node // 30) as n from node window w as (partition by node // 30 order by node)),
len as (select line, sum(coalesce({_distance("lon", "lat", "lon2", "lat2")}, 0)) as length from p group by line),
s as (select p.*, greatest(1, floor(n / greatest(1e0, round_even(length / 250e0, 0)))) as step from p join len using (line))
select line, pos as k, round((lon + lon2) / 2, 6) as lon, round((lat + lat2) / 2, 6) as lat, round({_bearing("lon", "lat", "lon2", "lat2")}, 6) as heading from s where lon2 is not null and pos % step = 0""")
def parallel_sampling(d):
    from pyspark.sql import Window

    p = d.node.select(F.floor(F.col("node") / 30).alias("line"), (F.col("node") % 30).alias("pos"), "lon", "lat")
    w = Window.partitionBy("line").orderBy("pos")
    step = F.coalesce(geo.distance_m("lon", "lat", F.lead("lon").over(w), F.lead("lat").over(w)), F.lit(0.0))
    p = p.withColumn("_m", step).withColumn("length", F.sum("_m").over(Window.partitionBy("line")))
    return winter.parallel_samples(p, "line", "pos", 250.0).select("line", "k", *(F.round(c, 6).alias(c) for c in ("lon", "lat", "heading")))


_SHEET_SQL = """
, box as (select s_suppkey as s, 300000e0 + s_suppkey % 61 * 2500 as west, 6600000e0 + s_suppkey % 61 * 1700 as south from supplier),
cell as (select distinct s, x, y from box, generate_series(0, 40) gx(x), generate_series(0, 60) gy(y) where x between floor((west - 500 + 76000) / 24000) and floor((west + 9000 + 500 + 76000) / 24000) and y between floor((south - 500 - 6570000) / 12000) and floor((south + 9000 + 500 - 6570000) / 12000)),
sheet as (select s, substr('KLMNPQRSTUVWX', y // 8 + 1, 1) || (x // 8 + 2) || ((x // 4) % 2 * 2 + (y // 4) % 2 + 1) || ((x // 2) % 2 * 2 + (y // 2) % 2 + 1) || (x % 2 * 2 + y % 2 + 1) as sheet from cell)"""


@query(_SHEET_SQL + " select distinct sheet from sheet except select sheet from sheet where s % 61 % 4 = 0")
def sheets_missing(d):
    """Sheets that all boxes touch but for those already there."""
    s = F.col("s_suppkey") % 61  # boxes all over the map, many of them equal
    box = d.table("supplier").select(s.alias("s"), (s * 2500.0 + 300_000.0).alias("west"), (s * 1700.0 + 6_600_000.0).alias("south")).withColumns({"east": F.col("west") + 9000, "north": F.col("south") + 9000})
    return readers.missing_sheets(readers.map_sheets(box), readers.map_sheets(box.filter("s % 4 = 0")))


# -- counts


@query("select place, row_number() over (order by rank, notability desc, name, place) - 1 as position from place")
def index_order(d):
    return search.index_order(d.place).select("place", "position")


@query("select kind, count(*) as places from place group by kind")
def place_kind_counts(d):
    return d.place.groupBy("kind").agg(F.count(F.lit(1)).alias("places"))


@query(f"""
, pair as (select p.point, n.node, {_distance("p.lon", "p.lat", "n.lon", "n.lat")} as m from register p, node n),
best as (select *, row_number() over (partition by point order by case when m <= 40 then 0 else 1 end, m, node) as k from pair where m <= 80)
select case when m <= 40 then 'near' else 'far' end as source, count(*) as points from best where k = 1 group by 1""")
def evidence_counts(d):
    nodes = d.node.select("node", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    return signals.match_register(d.register, nodes).groupBy("source").agg(F.count(F.lit(1)).alias("points"))


@query("""
, v as (select count(*) as nodes, count_if(barrier > 0) as barrier_nodes, count_if(kind = 3) as two_stage, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from node),
e as (select count(*) as edges, count_if(not (forward and backward)) as oneway, count_if(class & 1 <> 0) as dedicated, count_if(class & 2 <> 0) as sidepath, count_if(class & 4 <> 0) as network, cast(0 as bigint) as inside_barriers, count(distinct name) filter (where name <> '') as names from edge)
select edges, oneway, dedicated, sidepath, network, inside_barriers, names, nodes, barrier_nodes, two_stage, round(west, 6) as west, round(south, 6) as south, round(east, 6) as east, round(north, 6) as north from e, v""")
def manifest_counts(d):
    rows = evaluate.manifest_counts(d.edge, d.node)
    return rows.select(*(c for c in rows.columns if c not in ("west", "south", "east", "north")), *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


@query("select case when edge_id % 3 = 0 then 0 else edge_id % 3 end as tier, count(*) as edges, round(sum(length) / 1000, 6) as km from edge group by 1")
def winter_lengths(d):
    tiers = d.edge.filter("edge_id % 3 > 0").select("edge_id", (F.col("edge_id") % 3).cast("int").alias("tier"))
    return evaluate.tier_lengths(d.edge, tiers).select(F.col("tier").cast("long").alias("tier"), "edges", F.round("km", 6).alias("km"))


@query("select round(sum(case when edge_id % 4 > 0 then (edge_id % 7) * 1.5e0 else 0 end) / 1000, 6) as km, round(avg(case when edge_id % 4 > 0 and edge_id % 7 > 0 then 1e0 else 0e0 end), 6) as rising from edge")
def climb_totals(d):
    edges = routing.with_sides(d.edge, _climb(d))
    return evaluate.climb_totals(edges).select(F.round("km", 6).alias("km"), F.round("rising", 6).alias("rising"))


# -- tastes, climb and winter


def _climb(d) -> DataFrame:
    i = F.col("edge_id")
    return d.edge.filter("edge_id % 4 > 0").select("edge_id", ((i % 7) * 1.5).alias("ascent"), ((i % 5) * 0.5).alias("descent"))


TASTED = K.Taste({"unpaved": 1.3, "shared": 0.9, "traffic": 1.5, "sidepath": 4, "network": 0.9, "hill": 2, "barrier": 1.5, "lit": 0.8, "winter": 0.7, "signal": 1.5, "turn": 2})


def _tasted(d) -> DataFrame:
    """States of edges with delays, climb and winter tiers, priced with tastes."""
    i = F.col("edge_id")
    edges = d.edge.withColumns({c: F.when(i % n == 0, 1).otherwise(0) for c, n in (("signals", 11), ("crossings", 7), ("barriers", 13))})
    tiers = d.edge.filter("edge_id % 3 > 0").select("edge_id", (i % 3).cast("int").alias("tier"))
    return routing.priced(routing.with_sides(edges, _climb(d), tiers), d.node, K.CostModel(), TASTED)


_TASTED_SQL = """
, side as (select e.*, case when edge_id % 11 = 0 then 1 else 0 end as sig, case when edge_id % 7 = 0 then 1 else 0 end as cro, case when edge_id % 13 = 0 then 1 else 0 end as bar,
    case when edge_id % 4 > 0 then (edge_id % 7) * 1.5e0 else 0e0 end as asc_, case when edge_id % 4 > 0 then (edge_id % 5) * 0.5e0 else 0e0 end as des_, edge_id % 3 as tier from edge e),
way2 as (select edge_id * 2 as state, asc_ as up, des_ as down, * from side where forward union all select edge_id * 2 + 1, des_, asc_, * from side where backward),
part2 as (select *, (length - unpaved - shared) / 5e0 as fast, unpaved / ([1e0, 0.8e0, 0.65e0, 0.55e0][grade + 1] * case when grade > 0 then 1e0 else 0.65e0 end * 5e0) as rough, shared / (0.65e0 * 5e0) as walk, greatest(0e0, up * 2 - down * 0.4e0) as climb, [0e0, 0.25e0, 0.6e0, 1e0, 1.4e0][traffic + 1] as exposure from way2),
cost2 as (select state, fast + rough + walk + climb + sig * 30 + cro * 2 + bar * 4 as true_s, greatest(1e-9, (fast + rough * 1.3e0 + walk * 0.9e0 + climb * 2 + sig * 45 + cro * 2 + bar * 6 - least(lit, length) / 5e0 * 0.2e0)
    * case when exposure > 0 then 1 + 0.5e0 * exposure else 1e0 end * case when class & 2 <> 0 then 4e0 else 1e0 end * case when tier > 0 then 1 - 0.3e0 * [0e0, 0.6e0, 1e0][tier + 1] else 1e0 end * case when class & 4 <> 0 then 0.9e0 else 1e0 end) as search_s from part2),
tasted as (select s.state, s.tail, s.head, c.true_s, c.search_s, case n.kind when 3 then 90e0 when 2 then 45e0 when 1 then 2e0 else 0e0 end + n.barrier * 6e0 as node_s from state s join cost2 c using (state) join node n on n.node = s.tail)"""


@query(_TASTED_SQL + " select state, round(true_s + 1e-9, 5) as true_s, round(search_s + 1e-9, 5) as search_s, round(node_s, 5) as node_s from tasted")
def tasted_costs(d):
    # halves at the last digit would depend on the order of the sums
    return _tasted(d).select("state", *(F.round(F.col(c) + 1e-9, 5).alias(n) for c, n in (("true_s", "true_s"), ("search_s", "search_s"), ("node_search", "node_s"))))


@query(_TURN_SQL + _TASTED_SQL + """
, least(state, cost) using key (state) as (
  select state, search_s from tasted where tail = 0 union
  select t.to_state, min(s.cost + p.search_s + p.node_s + 2 * t.turn_s) from least s join turned t on t.from_state = s.state join tasted p on p.state = t.to_state left join recurring.least r on r.state = t.to_state
  where r.cost is null or s.cost + p.search_s + p.node_s + 2 * t.turn_s < r.cost group by t.to_state)
select head as node, round(min(cost), 3) as seconds from least join state using (state) where head <> 0 group by head union all select 0, 0e0""")
def route_search_cost(d):
    """Least cost of the search from junction 0, with tastes, climb, winter tiers and turns."""
    source = d.node.filter("node = 0").select(F.col("node").alias("source"))
    return routing.costs(_tasted(d), d.node, source, K.CostModel(), TASTED, true=False).select("node", r("seconds").alias("seconds"))


# -- the built network


@query(_CHAIN_SQL + """
, sums as (select st as a, last as b, sh as first, sum(length) as length, count(*) as segments, bool_and(f) as f, bool_and(g) as g,
             sum(case coalesce(i.kind, 0) when 3 then 2 when 2 then 1 else 0 end) as signals, sum(coalesce(i.barrier, 0)) as barriers
           from chain left join inner_ i on i.node = chain.head group by st, sh, last),
built as (select * from sums where f or g),
arc as (select a as tail, b as head from built where f union select b, a from built where g),
hub as (select node from (select tail as node from arc union all select head from arc) group by node order by count(*) desc, node limit 1),
fw(node, x) using key (node) as (select (select node from hub), 0 union select s.head, 0 from fw join arc s on s.tail = fw.node left join recurring.fw r on r.node = s.head where r.node is null),
bw(node, x) using key (node) as (select (select node from hub), 0 union select s.tail, 0 from bw join arc s on s.head = bw.node left join recurring.bw r on r.node = s.tail where r.node is null),
inside as (select node from fw intersect select node from bw)
select row_number() over (order by a, b, first) - 1 as edge_id, a, b, round(length, 3) as length, segments, cast(signals as bigint) as signals, cast(barriers as bigint) as barriers, (case when f then 1 else 0 end) + (case when g then 2 else 0 end) as access
from built where a in (select node from inside) and b in (select node from inside)""")
def build_edges(d):
    """Contracted, cut to the largest component, and numbered from 0 in order of (a, b, first)."""
    edges, _ = network.build_network(d.segment, d.node)
    return edges.select("edge_id", "a", "b", r("length").alias("length"), "segments", F.col("signals").cast("long").alias("signals"), F.col("barriers").cast("long").alias("barriers"), "access")


@query()
def built_routes(d):
    """Routes of all orders over the built network, with climb and winter tiers: ends off the network have none."""
    edges, nodes = network.build_network(d.segment, d.node)
    i = F.col("edge_id")
    climb = edges.select("edge_id", ((i % 7) * 1.5).alias("ascent"), ((i % 5) * 0.5).alias("descent"))
    edges = routing.with_sides(edges, climb, edges.select("edge_id", (i % 3).cast("int").alias("tier")))
    model = K.CostModel()
    states = routing.cut_lineage(routing.priced(edges, nodes, model, TASTED), "priced")
    leads, members = routing.shared_ends(d.trip)
    paths = routing.cut_lineage(routing.routed(states, nodes, leads, model, TASTED), "paths")
    rolled = routing.for_all(routing.roll_up(paths, states, model, nodes), members)
    return rolled.select("pair", "edges", r("metres").alias("metres"), r("seconds").alias("seconds"), "turns", "lefts", "signals")

