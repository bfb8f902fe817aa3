"""A road network, addresses, places and profiles derived from the TPC-H-like tables.

The same tables are said twice: as DataFrames, and in SQL for the comparison. All keys are contiguous
from 0, so every table is a projection or one equi-join of its source.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo, tags

HIGHWAYS = ("cycleway", "residential", "tertiary", "path", "secondary", "service", "primary", "living_street", "unclassified", "track")
SURFACES = ("gravel", "asphalt", "compacted", None, "dirt", "asphalt")
ENDINGS = ("Väylä", "Katu", "Tie", "Polku", "Raitti", "Kuja", "Rinne")
TITLES = ("Kämp", "Töölö", "Hähti", "Park", "Zoo")


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _div(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n)


class Derived:
    """The derived tables over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def size(self) -> int:
        return self.table("customer").count()

    @cached_property
    def node(self) -> DataFrame:
        i, m = F.col("c_custkey"), F.col("c_mktsegment")
        kind = F.when((m == "HOUSEHOLD") & (i % 11 == 0), 3).when((m == "AUTOMOBILE") & (i % 3 == 0), 2).when((m == "MACHINERY") & (i % 2 == 0), 1).otherwise(0)
        lon = F.lit(24.9) + (i % 30) * F.lit(1e-3) + ((i * 7919) % 100) * F.lit(4e-6)
        lat = F.lit(60.15) + _div("c_custkey", 30) * F.lit(5e-4) + ((i * 104729) % 100) * F.lit(2e-6)
        barrier = F.when(i % 17 == 0, 2).when(i % 13 == 0, 1).otherwise(0)
        return self.table("customer").select(i.alias("node"), lon.alias("lon"), lat.alias("lat"), kind.alias("kind"), barrier.alias("barrier"))

    @cached_property
    def tagged_way(self) -> DataFrame:
        """One way of two nodes per chosen order: seq, a, b, tags."""
        k, a = F.col("o_orderkey"), F.col("o_custkey")
        b = F.when((k % 2 == 0) & (a % 30 != 29), a + 1).otherwise(a + 30)
        bicycle = F.when(_div("o_orderkey", 19) % 7 == 0, "use_sidepath").when(_div("o_orderkey", 19) % 7 == 1, "designated")
        name = F.when(_div("o_orderkey", 17) % 5 == 0, "").otherwise(F.concat(F.lit("Street "), (_div("o_orderkey", 17) % 97).cast("string")))
        kv = {"highway": _pick(HIGHWAYS, _div("o_orderkey", 5) % 10), "surface": _pick(SURFACES, _div("o_orderkey", 7) % 6), "oneway": F.when(_div("o_orderkey", 3) % 11 == 0, "yes"), "bicycle": bicycle, "lit": F.when(_div("o_orderkey", 11) % 3 == 0, "yes"), "name": name}
        entries = F.map_filter(F.create_map(*(x for k_, v in kv.items() for x in (F.lit(k_), v))), lambda _, v: v.isNotNull())
        network = _div("o_orderkey", 13) % 6 == 0
        rows = self.table("orders").filter(k % 5 < 2).select(k.alias("seq"), a.alias("a"), b.alias("b"), entries.alias("tags"), network.alias("network"))
        return rows.filter(F.col("b") < self.size)

    @cached_property
    def way(self) -> DataFrame:
        """Raw segments with the classes of their tags, and their length."""
        t, t_b = F.col("tags"), self.node.select(F.col("node").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
        t_a = self.node.select(F.col("node").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
        direction = tags.bicycle_direction(t)
        rows = self.tagged_way.filter(tags.rideable(t)).join(t_a, "a").join(t_b, "b")
        return rows.select(
            "seq", "a", "b", F.round(geo.distance_m("lon_a", "lat_a", "lon_b", "lat_b"), 3).alias("length"),
            tags.surface_kind(t).alias("surface"), tags.surface_grade(t).alias("grade"), tags.traffic_class(t).alias("traffic"),
            F.coalesce(t["lit"] == "yes", F.lit(False)).alias("lit"), F.coalesce(t["name"], F.lit("")).alias("name"),
            (direction >= 0).alias("forward"), (direction <= 0).alias("backward"), tags.way_class(t, F.col("network")).alias("class"),
        )

    @cached_property
    def segment(self) -> DataFrame:
        from velonet.operators.network import dedupe_segments

        ends = lambda s: self.node.select(F.col("node").alias(s), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"))
        rows = dedupe_segments(self.way).join(ends("a"), "a").join(ends("b"), "b")
        heading = F.round(geo.bearing("lon_a", "lat_a", "lon_b", "lat_b"), 6)
        return rows.withColumn("bearing_a", heading).withColumn("bearing_b", heading)

    @cached_property
    def edge(self) -> DataFrame:
        """Each segment as an edge of its own; its id is its key."""
        part = lambda c: F.when(c, F.col("length")).otherwise(0.0)
        zero = F.lit(0)
        return self.segment.select(
            (F.col("a") * 2 + F.when(F.col("b") - F.col("a") == 1, 0).otherwise(1)).alias("edge_id"), "a", "b", "length",
            part(F.col("surface") == C.UNPAVED).alias("unpaved"), part(F.col("surface") == C.SHARED).alias("shared"), part(F.col("lit")).alias("lit"),
            "grade", "traffic", "class", "name", (F.col("forward").cast("int") + 2 * F.col("backward").cast("int")).alias("access"),
            zero.alias("signals"), zero.alias("crossings"), zero.alias("barriers"), "bearing_a", "bearing_b",
        )

    @cached_property
    def register(self) -> DataFrame:
        """Points beside junctions, by city."""
        s = F.col("s_suppkey")
        near = self.table("supplier").select(s.alias("point"), ((s * 37) % self.size).alias("node"), F.concat(F.lit("city"), (F.col("s_nationkey") % 3).cast("string")).alias("city"), F.col("s_nationkey").alias("nation"))
        lon = F.col("lon") + ((F.col("point") * 13) % 7 - 3) * F.lit(1e-4)
        lat = F.col("lat") + ((F.col("point") * 11) % 5 - 2) * F.lit(1e-4)
        return near.join(self.node.select("node", "lon", "lat"), "node").select("point", "city", "nation", lon.alias("lon"), lat.alias("lat"))

    @cached_property
    def door(self) -> DataFrame:
        """seq, street, number, lon, lat: a door beside each node; (street, number) repeats."""
        i = F.col("c_custkey")
        rows = self.table("customer").join(self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
        rows = rows.select(i.alias("seq"), F.concat("n_name", F.lit(" "), _pick(ENDINGS, i % 7)).alias("street"), (_div("c_custkey", 7) % 40 + 1).cast("string").alias("number"))
        return rows.join(self.node.select(F.col("node").alias("seq"), F.col("lon"), F.col("lat")), "seq").withColumn("lat", F.col("lat") + F.lit(1e-4))

    @cached_property
    def place(self) -> DataFrame:
        s = F.col("point")
        rows = self.register.join(self.table("nation").select(F.col("n_nationkey").alias("nation"), "n_name"), "nation")
        kind = s % len(C.PLACE_KINDS)
        return rows.select(s.alias("place"), F.concat("n_name", F.lit(" "), _pick(TITLES, s % 5)).alias("name"), _pick(C.PLACE_KINDS, kind).alias("kind"), kind.cast("int").alias("rank"), (s % 3).cast("int").alias("notability"), "lon", "lat")

    @cached_property
    def height(self) -> DataFrame:
        """Profiles by user: seq orders them, dist runs by 7 m, height is the event's value."""
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        rows = self.table("events").withColumn("seq", F.row_number().over(w) - 1)
        return rows.select(F.col("user_id").alias("line"), "seq", (F.col("seq") * F.lit(7.0)).alias("dist"), F.round(F.col("value"), 2).alias("height"))

    @cached_property
    def counter(self) -> DataFrame:
        """place, seq, year, daily, lon, lat: several readings of each site."""
        p = F.col("p_partkey")
        rows = self.table("part").select((p % 40).alias("site"), p.alias("seq"), (F.lit(2015) + F.col("p_size") % 8).cast("int").alias("year"), F.round(F.col("p_retailprice"), 2).alias("daily"))
        return rows.withColumn("place", F.concat(F.lit("site "), F.col("site").cast("string")))

    @cached_property
    def trip(self) -> DataFrame:
        """pair, start, goal: one of each order."""
        return self.table("orders").select(F.col("o_orderkey").alias("pair"), F.col("o_custkey").alias("start"), ((F.col("o_custkey") * 31 + 7) % self.size).alias("goal"))


def _case(table: dict, key: str, default) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _distance(lon1, lat1, lon2, lat2) -> str:
    return f"sqrt(pow(({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)) * 111320e0, 2) + pow(({lat2} - {lat1}) * 110540e0, 2))"


def _bearing(lon1, lat1, lon2, lat2) -> str:
    x = f"degrees(atan2(({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)), {lat2} - {lat1}))"
    return f"(case when {x} < 0 then {x} + 360e0 else {x} end)"


_SLOW = ", ".join(f"'{s}'" for s in C.SLOW_SURFACES)
#: Common table expressions of the derived tables; each query starts with "with recursive" and these.
SQL = f"""
with recursive node as (
  select c_custkey as node, 24.9e0 + (c_custkey % 30) * 1e-3 + ((c_custkey * 7919) % 100) * 4e-6 as lon,
         60.15e0 + (c_custkey // 30) * 5e-4 + ((c_custkey * 104729) % 100) * 2e-6 as lat,
         case when c_mktsegment = 'HOUSEHOLD' and c_custkey % 11 = 0 then 3 when c_mktsegment = 'AUTOMOBILE' and c_custkey % 3 = 0 then 2
              when c_mktsegment = 'MACHINERY' and c_custkey % 2 = 0 then 1 else 0 end as kind,
         case when c_custkey % 17 = 0 then 2 when c_custkey % 13 = 0 then 1 else 0 end as barrier
  from customer),
tagged as (
  select o_orderkey as seq, o_custkey as a, case when o_orderkey % 2 = 0 and o_custkey % 30 <> 29 then o_custkey + 1 else o_custkey + 30 end as b,
         {_list(HIGHWAYS)}[(o_orderkey // 5) % 10 + 1] as highway, {_list(SURFACES)}[(o_orderkey // 7) % 6 + 1] as surf,
         case when (o_orderkey // 3) % 11 = 0 then 'yes' end as oneway,
         case when (o_orderkey // 19) % 7 = 0 then 'use_sidepath' when (o_orderkey // 19) % 7 = 1 then 'designated' end as bicycle,
         (o_orderkey // 11) % 3 = 0 as lit, (o_orderkey // 13) % 6 = 0 as network,
         case when (o_orderkey // 17) % 5 = 0 then '' else 'Street ' || ((o_orderkey // 17) % 97) end as name
  from orders where o_orderkey % 5 < 2),
way as (
  select t.seq, t.a, t.b, round({_distance("p.lon", "p.lat", "q.lon", "q.lat")}, 3) as length,
         case when surf in ({_SLOW}) then 1 when highway = 'path' then 2 else 0 end as surface,
         {_case(C.GRADE, "surf", 0)} as grade, {_case(C.TRAFFIC_CLASS, "highway", C.TRAFFIC_UNKNOWN)} as traffic, t.lit, t.name,
         true as forward, oneway is null as backward,
         case when highway = 'cycleway' or (highway = 'path' and coalesce(bicycle, '') = 'designated') then 1 when coalesce(bicycle, '') = 'use_sidepath' then 2 else 0 end
           + case when network then 4 else 0 end as class
  from tagged t join node p on p.node = t.a join node q on q.node = t.b where t.b < (select count(*) from customer)),
seg as (
  select a, b, min(length) as length, case when bool_or(surface = 1) then 1 when bool_or(surface = 2) then 2 else 0 end as surface,
         max(grade) as grade, max(traffic) as traffic, bool_or(lit) as lit, coalesce(arg_min(name, seq) filter (where name <> ''), '') as name,
         bool_or(forward) as forward, bool_or(backward) as backward,
         case when bit_or(class) & 1 <> 0 then bit_or(class) & 5 else bit_or(class) end as class, count(*) as ways
  from way group by a, b),
segment as (
  select s.*, p.lon as lon_a, p.lat as lat_a, q.lon as lon_b, q.lat as lat_b, round({_bearing("p.lon", "p.lat", "q.lon", "q.lat")}, 6) as bearing
  from seg s join node p on p.node = s.a join node q on q.node = s.b),
degree as (select node, count(*) as degree from (select a as node from seg union all select b from seg) group by node),
edge as (
  select a * 2 + case when b - a = 1 then 0 else 1 end as edge_id, a, b, length, case when surface = 1 then length else 0 end as unpaved,
         case when surface = 2 then length else 0 end as shared, case when lit then length else 0 end as lit, grade, traffic, class, name,
         forward, backward, bearing from segment),
state as (
  select edge_id * 2 as state, edge_id, a as tail, b as head, length, unpaved, shared, grade, traffic, class, bearing from edge where forward
  union all
  select edge_id * 2 + 1, edge_id, b, a, length, unpaved, shared, grade, traffic, class, case when bearing >= 180 then bearing - 180 else bearing + 180 end from edge where backward),
priced as (
  select s.*, (length - unpaved - shared) / 5e0 + unpaved / ([1e0, 0.8e0, 0.65e0, 0.55e0][grade + 1] * case when grade > 0 then 1e0 else 0.65e0 end * 5e0) + shared / (0.65e0 * 5e0) as true_s,
         case n.kind when 3 then 60e0 when 2 then 30e0 when 1 then 2e0 else 0e0 end + n.barrier * 4e0 as node_s, d.degree
  from state s join node n on n.node = s.tail join degree d on d.node = s.tail),
register as (
  select s_suppkey as point, 'city' || (s_nationkey % 3) as city, s_nationkey as nation, n.lon + ((s_suppkey * 13) % 7 - 3) * 1e-4 as lon, n.lat + ((s_suppkey * 11) % 5 - 2) * 1e-4 as lat
  from supplier join node n on n.node = (s_suppkey * 37) % (select count(*) from customer)),
door as (
  select c_custkey as seq, n_name || ' ' || {_list(ENDINGS)}[c_custkey % 7 + 1] as street, cast((c_custkey // 7) % 40 + 1 as varchar) as number, n.lon, n.lat + 1e-4 as lat
  from customer join nation on n_nationkey = c_nationkey join node n on n.node = c_custkey),
place as (
  select point as place, n_name || ' ' || {_list(TITLES)}[point % 5 + 1] as name, {_list(C.PLACE_KINDS)}[point % 20 + 1] as kind, point % 20 as rank, point % 3 as notability, lon, lat
  from register join nation on n_nationkey = nation),
height as (
  select user_id as line, seq, seq * 7e0 as dist, h as height from
    (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, round(value, 2) as h from events)),
counter as (
  select 'site ' || (p_partkey % 40) as place, p_partkey as seq, 2015 + p_size % 8 as year, round(p_retailprice, 2) as daily from part)
"""
