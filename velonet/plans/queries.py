"""Queries over the derived network, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import cost as K
from velonet.functions import geo, profile, tags, text
from velonet.operators import evaluate, network, routing, search, signals, spatial, winter
from velonet.operators import profile as lines
from velonet.plans.derived import SQL, Derived, _bearing, _case, _distance
from velonet.sources.shared import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODEL, TASTE = K.CostModel(), K.Taste()


def query(sql: str | None = None, derived: bool = True):
    def add(f: Callable[[Derived], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLES[f.__name__] = (SQL + (body if body.startswith(",") else "\n" + body)) if derived else body
        return f

    return add


def r(c, digits: int = 3):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- building the network


@query("select a, b, length, surface, grade, traffic, lit, name, forward, backward, class, ways from seg")
def seg_dedupe(d):
    return d.segment.select("a", "b", "length", "surface", "grade", "traffic", "lit", "name", "forward", "backward", "class", "ways")


@query("select node, degree from degree")
def node_degree(d):
    return network.degrees(d.segment)


@query("select a, b, length, bearing, floor(bearing / 1.40625e0 + 0.5e0) % 256 * 1.40625e0 as quantised, case when length > 56 then 'long' else 'short' end as size from segment")
def edge_geometry(d):
    # halves never occur at six decimals of a bearing, so half-even and half-up agree
    return d.segment.select("a", "b", "length", F.col("bearing_a").alias("bearing"), geo.quantised("bearing_a").alias("quantised"), F.when(F.col("length") > 56, "long").otherwise("short").alias("size"))


@query("select seq, surface, grade, traffic, forward, backward, class & 3 as class from way")
def tag_classes(d):
    return d.way.select("seq", "surface", "grade", "traffic", "forward", "backward", F.col("class").bitwiseAND(3).alias("class"))


@query("select node, lon between 24.905e0 and 24.92e0 and lat between 60.155e0 and 60.17e0 as inside from node")
def bbox_filter(d):
    return d.node.select("node", geo.within("lon", "lat", (24.905, 60.155, 24.92, 60.17)).alias("inside"))


@query("select seq, network from tagged where b < (select count(*) from customer)")
def network_flag(d):
    """The route relations' members flag their ways: a semi-join as a left join."""
    members = d.tagged_way.filter("network").select("seq").distinct().withColumn("network", F.lit(True))
    return d.tagged_way.drop("network").join(members, "seq", "left").select("seq", F.coalesce("network", F.lit(False)).alias("network"))


@query("""
, met as (select distinct x.node, w.seq from way w, (values (0), (1)) v(i), node x where x.node = case when i = 0 then w.a else w.b end and x.kind > 0 and w.class & 1 = 0)
select node, count(*) as n, string_agg(cast(seq as varchar), ',' order by seq) as ways from met group by node""")
def carriageways_at_node(d):
    ends = d.way.filter(F.col("class").bitwiseAND(1) == 0).select(F.explode(F.array("a", "b")).alias("node"), "seq")
    sets = ends.join(d.node.filter("kind > 0").select("node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("seq")).alias("ways"))
    return sets.select("node", F.size("ways").cast("long").alias("n"), F.array_join(F.transform("ways", lambda x: x.cast("string")), ",").alias("ways"))


def _headings(d) -> DataFrame:
    halves = network.both_ways(d.segment, ["bearing_a", "class"])
    away = F.when(F.col("along"), F.col("bearing_a")).otherwise(F.pmod(F.col("bearing_a") + 180.0, F.lit(360.0)))
    return halves.select(F.col("tail").alias("node"), away.alias("b"), (F.col("class").bitwiseAND(1) != 0).alias("cycle"))


_HEADINGS_SQL = """
, heading as (select a as node, bearing as b, class & 1 <> 0 as cycle from segment
              union all select b, case when bearing >= 180 then bearing - 180 else bearing + 180 end, class & 1 <> 0 from segment)"""


@query(_HEADINGS_SQL + """
select node, count(*) filter (where cycle) as cycle_n, round(sum(b) filter (where cycle), 3) as cycle_sum, count(*) filter (where not cycle) as road_n, round(max(b) filter (where not cycle), 6) as road_max
from heading group by node""")
def bearings_at_node(d):
    by = _headings(d).groupBy("node").agg(F.array_sort(F.collect_list(F.when(F.col("cycle"), F.col("b")))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("cycle"), F.col("b")))).alias("o"))
    total = F.when(F.size("c") > 0, F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 3))
    return by.select("node", F.size("c").cast("long").alias("cycle_n"), total.alias("cycle_sum"), F.size("o").cast("long").alias("road_n"), F.round(F.array_max("o"), 6).alias("road_max"))


_CHAIN_SQL = """
, half as (select a as tail, b as head, length, surface, traffic, name, grade, forward as f, backward as g from seg
           union all select b, a, length, surface, traffic, name, grade, backward, forward from seg),
inner_ as (select node, kind, barrier from degree join node using (node) where degree = 2),
walk as (
  select h.tail as st, h.head as sh, h.tail, h.head, 0 as pos, h.length, h.surface, h.traffic, h.name, h.grade, h.f, h.g from half h where h.tail not in (select node from inner_)
  union all
  select w.st, w.sh, h.tail, h.head, w.pos + 1, h.length, h.surface, h.traffic, h.name, h.grade, h.f, h.g
  from walk w join inner_ i on i.node = w.head join half h on h.tail = w.head and h.head <> w.tail),
ends as (select st, sh, arg_max(head, pos) as last, arg_max(tail, pos) as prev from walk group by st, sh),
kept as (select * from ends where st < last or (st = last and sh <= prev)),
chain as (select w.*, k.last from walk w join kept k using (st, sh))"""


@query(_CHAIN_SQL + """
, sums as (select st, sh, last, sum(length) as length, sum(case when surface = 1 then length else 0 end) as unpaved, count(*) as segments, bool_and(f) as f, bool_and(g) as g,
             sum(case coalesce(i.kind, 0) when 3 then 2 when 2 then 1 else 0 end) as signals, sum(case when i.kind = 1 then 1 else 0 end) as crossings, sum(coalesce(i.barrier, 0)) as barriers
           from chain left join inner_ i on i.node = chain.head group by st, sh, last)
select st as a, last as b, sh as first, round(length, 3) as length, round(unpaved, 3) as unpaved, segments, signals, crossings, barriers, (case when f then 1 else 0 end) + (case when g then 2 else 0 end) as access
from sums where f or g""")
def contract_edges(d):
    e = network.contract(d.segment, d.node)
    return e.select("a", "b", "first", r("length").alias("length"), r("unpaved").alias("unpaved"), "segments", F.col("signals").cast("long").alias("signals"), F.col("crossings").cast("long").alias("crossings"), F.col("barriers").cast("long").alias("barriers"), "access")


@query(_CHAIN_SQL + """
, t as (select st, sh, traffic as v, sum(length) as w, min(pos) as p from chain group by all),
n as (select st, sh, name as v, sum(length) as w, min(pos) as p from chain where name <> '' group by all),
tm as (select st, sh, v, row_number() over (partition by st, sh order by w desc, p) as k from t),
nm as (select st, sh, v, row_number() over (partition by st, sh order by w desc, p) as k from n)
select c.st as a, c.sh as first, tm.v as traffic, coalesce(nm.v, '') as name from (select distinct st, sh from chain group by st, sh having bool_and(f) or bool_and(g)) c
join tm on tm.st = c.st and tm.sh = c.sh and tm.k = 1 left join nm on nm.st = c.st and nm.sh = c.sh and nm.k = 1""")
def chain_majority(d):
    return network.contract(d.segment, d.node).select("a", "first", "traffic", "name")


_TURN_SQL = """
, pair as (select s.state as from_state, t.state as to_state, s.head as node, g.degree,
             (round(t.bearing - s.bearing + 540, 9) % 360) - 180 as swing
           from state s join state t on t.tail = s.head join degree g on g.node = s.head),
turned as (select *, case when degree >= 3 and abs(swing) >= 40 then case when swing < 0 then 15e0 else 10e0 end else 0e0 end as turn_s from pair)"""


@query(_TURN_SQL + """
select from_state, to_state, round(swing, 6) as swing, turn_s, case when abs(swing) < 40 then 'straight' when abs(swing) >= 115 then 'sharp_' || case when swing < 0 then 'left' else 'right' end when swing < 0 then 'left' else 'right' end as manoeuvre from turned""")
def turn_table(d):
    t = network.turn_table(network.directed_states(d.edge), network.degrees(d.edge))
    return t.select("from_state", "to_state", F.round("swing", 6).alias("swing"), K.turn_seconds(MODEL, F.col("swing"), F.col("degree")).alias("turn_s"), geo.manoeuvre("swing").alias("manoeuvre"))


@query("""
, fw(node, x) using key (node) as (
  select (select node from degree order by degree desc, node limit 1), 0 union
  select s.head, 0 from fw join state s on s.tail = fw.node left join recurring.fw r on r.node = s.head where r.node is null),
bw(node, x) using key (node) as (
  select (select node from degree order by degree desc, node limit 1), 0 union
  select s.tail, 0 from bw join state s on s.head = bw.node left join recurring.bw r on r.node = s.tail where r.node is null)
select node from fw intersect select node from bw""")
def largest_scc(d):
    return network.largest_scc(network.directed_states(d.edge).select("tail", "head"))


@query(f"""
, heading as (select a as node, bearing as b, class & 1 <> 0 as cycle from segment
              union all select b, case when bearing >= 180 then bearing - 180 else bearing + 180 end, class & 1 <> 0 from segment)
select distinct c.node from node c join node l on l.kind >= 2 and c.kind = 1 and {_distance("c.lon", "c.lat", "l.lon", "l.lat")} <= 60
where exists (select 1 from heading x join heading y on x.node = c.node and y.node = l.node and x.cycle and not y.cycle
              and least(abs(x.b - y.b) % 180, 180 - abs(x.b - y.b) % 180) >= 45)""")
def crossing_signals(d):
    own = _headings(d)
    cycle = own.filter("cycle").groupBy("node").agg(F.collect_list("b").alias("bearings"))
    road = own.filter("not cycle").groupBy("node").agg(F.collect_list("b").alias("road_bearings"))
    left = d.node.filter("kind = 1").join(cycle, "node").select("node", "lon", "lat", "bearings")
    right = d.node.filter("kind >= 2").join(road, "node").select(F.col("node").alias("light"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), "road_bearings")
    return signals.crossing_signals(left, right, 60.0)


@query(f"""
, pair as (select p.point, n.node, {_distance("p.lon", "p.lat", "n.lon", "n.lat")} as m from register p, node n),
best as (select *, row_number() over (partition by point order by case when m <= 40 then 0 else 1 end, m, node) as k from pair where m <= 80)
select point, node, round(m, 3) as metres, case when m <= 40 then 'near' else 'far' end as source from best where k = 1""")
def register_anchor(d):
    nodes = d.node.select("node", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    return signals.match_register(d.register, nodes).select("point", "node", r("metres").alias("metres"), "source")


@query(f"""
, reach(start, node, m) using key (start, node) as (
  select node, node, 0e0 from node union
  select s.start, h.head, min(s.m + h.length) from reach s join (select a as tail, b as head, length from seg union all select b, a, length from seg) h on h.tail = s.node
  left join recurring.reach r on r.start = s.start and r.node = h.head where s.m + h.length <= 240 and (r.m is null or s.m + h.length < r.m) group by s.start, h.head)
select start, node, round(m, 3) as metres from reach""")
def bounded_walk(d):
    arcs = network.both_ways(d.segment, ["length"]).select("tail", "head", "length")
    starts = d.node.select(F.col("node").alias("start"))
    return signals.walk(arcs, starts).select("start", "node", r("metres").alias("metres"))


@query("""
, light as (select node, lon, lat from node where kind = 1)
select node from light l where not exists (select 1 from light o where o.node < l.node and """ + _distance("o.lon", "o.lat", "l.lon", "l.lat") + """ < 30)""")
def suppress_lights(d):
    """On this grid no rival has a rival of its own, so one round decides and SQL can say it."""
    rows = d.node.filter("kind = 1").withColumn("roads", F.array().cast("array<long>"))
    return signals.suppress_near(rows)


@query(f"""
, sample as (select a, b, t.k, lon_a + (lon_b - lon_a) * t.f as lon, lat_a + (lat_b - lat_a) * t.f as lat, bearing from segment, (values (0, 0.1e0), (1, 0.5e0), (2, 0.9e0)) t(k, f) where class & 1 = 0),
cyc as (select lon_a, lat_a, lon_b, lat_b, bearing from segment where class & 1 <> 0),
near as (select s.a, s.b, s.k, s.bearing, c.bearing as cb, (c.lon_a - s.lon) * cos(radians(s.lat)) * 111320e0 as x1, (c.lat_a - s.lat) * 110540e0 as y1, (c.lon_b - s.lon) * cos(radians(s.lat)) * 111320e0 as x2, (c.lat_b - s.lat) * 110540e0 as y2
         from sample s join cyc c on abs(c.lat_a - s.lat) < 2e-3 and abs(c.lon_a - s.lon) < 4e-3),
foot as (select *, greatest(0e0, least(1e0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from near),
hit as (select distinct a, b, k from foot where sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) <= 20 and least(abs(bearing - cb) % 180, 180 - abs(bearing - cb) % 180) <= 30)
select s.a * 2 + case when s.b - s.a = 1 then 0 else 1 end as edge, round(avg(case when h.k is null then 0e0 else 1e0 end), 6) as share from sample s left join hit h on h.a = s.a and h.b = s.b and h.k = s.k group by s.a, s.b""")
def parallel_share(d):
    rows = d.segment.withColumn("edge", F.col("a") * 2 + F.when(F.col("b") - F.col("a") == 1, 0).otherwise(1))
    t = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in enumerate((0.1, 0.5, 0.9))))
    s = rows.filter(F.col("class").bitwiseAND(1) == 0).withColumn("t", F.explode(t))
    s = s.select("edge", F.col("t.k").alias("k"), (F.col("lon_a") + (F.col("lon_b") - F.col("lon_a")) * F.col("t.f")).alias("lon"), (F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * F.col("t.f")).alias("lat"), F.col("bearing_a").alias("heading"))
    c = rows.filter(F.col("class").bitwiseAND(1) != 0).select(*(F.col(f"{x}_{e}").alias(f"{x}{i}") for i, e in ((1, "a"), (2, "b")) for x in ("lon", "lat")), F.col("bearing_a").alias("bearing"))
    return winter.parallel_share(s, c, folded=True).select("edge", F.round("share", 6).alias("share"))


# -- routes


@query("""
, least(node, cost) using key (node) as (
  select cast(0 as bigint), 0e0 union
  select p.head, min(s.cost + p.true_s + case when p.tail = 0 then 0e0 else p.node_s end) from least s join priced p on p.tail = s.node left join recurring.least r on r.node = p.head
  where r.cost is null or s.cost + p.true_s + case when p.tail = 0 then 0e0 else p.node_s end < r.cost group by p.head)
select node, round(cost, 3) as seconds from least""")
def sssp_true_cost(d):
    """Least true seconds from junction 0 to every junction, without turns."""
    states = routing.priced(d.edge, d.node, MODEL, TASTE)
    return routing.costs(states, d.node, d.node.filter("node = 0").select(F.col("node").alias("source")), MODEL, TASTE, turns=False).select("node", r("seconds").alias("seconds"))


@query(_TURN_SQL + """
, least(state, cost) using key (state) as (
  select state, true_s from priced where tail = 0 union
  select t.to_state, min(s.cost + p.true_s + p.node_s + t.turn_s) from least s join turned t on t.from_state = s.state join priced p on p.state = t.to_state left join recurring.least r on r.state = t.to_state
  where r.cost is null or s.cost + p.true_s + p.node_s + t.turn_s < r.cost group by t.to_state)
select head as node, round(min(cost), 3) as seconds from least join state using (state) where head <> 0 group by head union all select 0, 0e0""")
def sssp_turn_aware(d):
    states = routing.priced(d.edge, d.node, MODEL, TASTE)
    return routing.costs(states, d.node, d.node.filter("node = 0").select(F.col("node").alias("source")), MODEL, TASTE).select("node", r("seconds").alias("seconds"))


def _led(d, limit: int):
    """Routes of one trip of each two ends, their states, and which trip stands for which."""
    states = cut_lineage(routing.priced(d.edge, d.node, MODEL, TASTE), "priced")
    leads, members = routing.shared_ends(d.trip)
    return cut_lineage(routing.routed(states, d.node, leads, MODEL, TASTE, limit), "paths"), states, members


def _routed(d, limit: int):
    """Routes of all trips, and their states."""
    paths, states, members = _led(d, limit)
    return routing.for_all(paths.hint("merge"), members), states


@query()
def route_rollup(d):
    paths, states, members = _led(d, 1)
    rolled = routing.for_all(routing.roll_up(paths, states, MODEL, d.node), members)
    return rolled.select("pair", "edges", r("metres").alias("metres"), r("seconds").alias("seconds"), "turns", "lefts", "signals", r("dedicated").alias("dedicated"), r("sidepath").alias("sidepath"), r("network").alias("network"), F.transform("traffic", lambda x: F.round(x, 3)).alias("traffic"))


@query()
def route_alternatives(d):
    paths, states, members = _led(d, C.ALTERNATIVES)
    rolled = routing.roll_up(paths, states, MODEL, d.node)
    rows = routing.for_all(evaluate.beside_first(rolled.select("pair", "rank", "metres", "seconds")), members)
    return rows.select("pair", "rank", *(r(c).alias(c) for c in ("metres", "seconds", "longer", "slower")), "label")


@query()
def route_steps(d):
    paths, states, members = _led(d, 1)
    return routing.for_all(routing.steps(paths, states), members).select("pair", "step", "manoeuvre", "name", r("metres").alias("metres"))


def _trip_edges(d) -> DataFrame:
    """Each trip's own first hop and the rung below: a path SQL can name."""
    return d.trip.join(d.edge, d.trip["start"] == d.edge["a"]).select("pair", F.col("edge_id").alias("edge"), "length", "traffic", "class", "unpaved", "shared", "grade")


_HOPS = ", hop as (select o_orderkey as pair, edge_id as edge, length, traffic, class, unpaved, shared, grade from orders join edge on edge.a = o_custkey)"


@query(_HOPS + " select edge, count(*) as trips from hop group by edge order by trips desc, edge limit 12")
def edge_usage_topk(d):
    return evaluate.usage(_trip_edges(d), 12)


@query(_HOPS + " select count(distinct edge) as edges, count(distinct pair) as trips from hop")
def distinct_usage(d):
    return _trip_edges(d).agg(F.count_distinct("edge").alias("edges"), F.count_distinct("pair").alias("trips"))


@query(_HOPS + """
, by_class as (select pair, traffic, sum(length) as m from hop group by all), share as (select *, m / sum(m) over (partition by pair) as s from by_class)
select pair, traffic, round(s * 100, 3) as percent from share where s * 100 >= 0.5""")
def traffic_bands(d):
    from pyspark.sql import Window

    by = _trip_edges(d).groupBy("pair", "traffic").agg(F.sum("length").alias("m"))
    share = F.col("m") / F.sum("m").over(Window.partitionBy("pair")) * 100
    return by.withColumn("p", share).filter("p >= 0.5").select("pair", "traffic", r("p").alias("percent"))


@query(_HOPS + """
, setting as (select * from (values (10e0), (15e0), (18e0), (25e0)) v(kmh))
select kmh, count(*) as hops, round(sum(length), 3) as metres,
  round(sum((length - unpaved - shared) / (kmh / 3.6) + unpaved / ([1e0, 0.8e0, 0.65e0, 0.55e0][grade + 1] * case when grade > 0 then 1e0 else 0.65e0 end * kmh / 3.6) + shared / (0.65e0 * kmh / 3.6)) / 60, 3) as minutes
from hop, setting group by kmh""")
def sweep_reprice(d):
    """One sum per setting over the same hops: the settings are a few columns, so nothing is multiplied out."""
    hops = _trip_edges(d)
    rides = {kmh: K.ride_seconds(K.CostModel(kmh=kmh), set(hops.columns)) for kmh in (10.0, 15.0, 18.0, 25.0)}
    one = hops.agg(F.count(F.lit(1)).alias("hops"), F.round(F.sum("length"), 3).alias("metres"), *(F.sum(s).alias(f"s{int(k)}") for k, s in rides.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("kmh"), F.round(F.col(f"s{int(k)}") / 60, 3).alias("minutes")) for k in rides))
    return one.select("hops", "metres", F.explode(rows).alias("x")).select("x.kmh", "hops", "metres", "x.minutes")


@query()
def trip_usage(d):
    """Usage of edges by the routes of all trips."""
    paths, _, members = _led(d, 1)
    trips = members.groupBy("lead").agg(F.count(F.lit(1)).alias("trips"))
    rows = paths.filter("pos >= 0").join(trips.withColumnRenamed("lead", "pair"), "pair")
    return rows.groupBy(F.floor(F.col("state") / 2).alias("edge")).agg(F.sum("trips").alias("trips"))


@query(f"""
, pair as (select p.point, n.node, n.lon, n.lat, {_distance("p.lon", "p.lat", "n.lon", "n.lat")} as m from register p, node n),
near as (select * from (select *, row_number() over (partition by point order by m, node) as k from pair) where k = 1),
inc as (select n.point, e.edge_id, least(n.m, {_distance("p.lon", "p.lat", "o.lon", "o.lat")}) as m from near n join edge e on n.node in (e.a, e.b) join node o on o.node = case when e.a = n.node then e.b else e.a end join register p on p.point = n.point),
best as (select *, row_number() over (partition by point order by m, edge_id) as k from inc where m < 40)
select point, edge_id, round(m, 3) as metres from best where k = 1""")
def counter_edges(d):
    found = evaluate.counter_edges(d.register.select(F.col("point").alias("counter"), "lon", "lat"), d.node, d.edge)
    return found.select(F.col("counter").alias("point"), "edge_id", r("metres").alias("metres"))


# -- places


@query(f"""
, pair as (select p.point, n.node, {_distance("p.lon", "p.lat", "n.lon", "n.lat")} as m from register p, node n), best as (select *, row_number() over (partition by point order by m, node) as k from pair)
select point, node, round(m, 3) as metres from best where k = 1""")
def snap_nodes(d):
    nodes = d.node.select("node", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    return spatial.nearest(d.register, nodes, "point", ["node"], cell=0.002, start_m=100.0).select("point", "node", r("metres").alias("metres"))


_ADDRESS_SQL = ", address as (select street, number, arg_min(lon, seq) as lon, arg_min(lat, seq) as lat from door group by all)"


@query(_ADDRESS_SQL + f"""
, pair as (select p.point, a.street, a.number, {_distance("p.lon", "p.lat", "a.lon", "a.lat")} as m from register p, address a), best as (select *, row_number() over (partition by point order by m, street, number) as k from pair)
select point, street || ' ' || number as label, round(m, 3) as metres from best where k = 1""")
def nearest_address(d):
    return search.reverse_geocode(d.register, search.addresses(d.door)).select("point", "label", r("metres").alias("metres"))


@query(_ADDRESS_SQL + f"""
, pair as (select p.place, a.street, a.number, {_distance("p.lon", "p.lat", "a.lon", "a.lat")} as m from place p, address a), best as (select *, row_number() over (partition by place order by m, street, number) as k from pair where m < 250)
select p.place, b.street from place p left join best b on b.place = p.place and b.k = 1""")
def place_context(d):
    return search.place_context(d.place, search.addresses(d.door)).select("place", "street")


@query(_ADDRESS_SQL + " select street, number, round(lon, 6) as lon, round(lat, 6) as lat from address")
def addr_first_wins(d):
    return search.addresses(d.door).select("street", "number", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""
, capped as (select *, row_number() over (partition by name, kind order by notability desc, lon, lat) as k from place)
select place, name, kind, notability from capped where k <= 5""")
def poi_cap(d):
    return search.cap_names(d.place).select("place", "name", "kind", "notability")


@query("select distinct street from door where street not in (select name from place where rank < 6)")
def address_except_places(d):
    return d.door.select("street").distinct().join(d.place.filter(F.col("rank") < 6).select(F.col("name").alias("street")), "street", "left_anti")


@query("select street from door union select name from seg where name <> ''")
def street_union(d):
    return d.door.select("street").union(d.segment.filter("name <> ''").select("name")).distinct()


_POI = """case
  when aeroway in ('aerodrome', 'terminal') then 'airport' when shop in ('mall', 'department_store') then 'mall' when tourism in ('museum', 'gallery', 'attraction', 'zoo', 'theme_park', 'viewpoint') then 'attraction'
  when leisure in ('park', 'garden', 'nature_reserve', 'playground', 'pitch', 'marina') then 'park' when amenity in ('university', 'college', 'school') then 'school' when shop <> '' then 'shop' when amenity <> '' then 'service' end"""
_POI_TAGS = """
with t as (select p_partkey as id, case p_partkey % 5 when 0 then 'aerodrome' when 1 then 'hangar' end as aeroway, case p_partkey % 3 when 0 then 'bakery' when 1 then 'mall' end as shop,
  case p_partkey % 7 when 0 then 'museum' when 1 then 'hotel_bar' end as tourism, case p_partkey % 4 when 0 then 'park' when 1 then 'bench' end as leisure, case p_partkey % 6 when 0 then 'school' when 1 then 'bench' end as amenity,
  p_name as name, case when p_partkey % 2 = 0 then p_brand || '; ' || p_name || ';' end as alt_name, case p_partkey % 3 when 0 then 'en:' || p_name when 1 then 'en:Else' end as wikipedia, case when p_partkey % 4 = 0 then 'Q1' end as wikidata from part)"""


@query(_POI_TAGS + f"""
select id, {_POI} as kind, case when split_part(wikipedia, ':', 2) = name then 2 when wikipedia is not null or wikidata is not null then 1 else 0 end as notability,
  name || case when alt_name is not null then '|' || split_part(alt_name, ';', 1) else '' end as names from t""", derived=False)
def poi_kind(d):
    p = F.col("p_partkey")
    by = lambda n, a, b: F.when(p % n == 0, a).when(p % n == 1, b)
    kv = {
        "aeroway": by(5, "aerodrome", "hangar"), "shop": by(3, "bakery", "mall"), "tourism": by(7, "museum", "hotel_bar"), "leisure": by(4, "park", "bench"), "amenity": by(6, "school", "bench"),
        "name": F.col("p_name"), "alt_name": F.when(p % 2 == 0, F.concat("p_brand", F.lit("; "), "p_name", F.lit(";"))), "wikipedia": F.when(p % 3 == 0, F.concat(F.lit("en:"), "p_name")).when(p % 3 == 1, "en:Else"), "wikidata": F.when(p % 4 == 0, "Q1"),
    }
    t = F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    rows = d.table("part").select(p.alias("id"), t.alias("t"))
    return rows.select("id", tags.poi_kind(F.col("t")).alias("kind"), tags.notability(F.col("t")).alias("notability"), F.array_join(tags.names_of(F.col("t")), "|").alias("names"))


def _asked(d) -> DataFrame:
    n, name = F.col("n_nationkey"), F.lower("n_name")
    words = F.when(n % 4 == 0, F.substring(name, 1, 3)).when(n % 4 == 1, F.concat(name, F.lit(" vay 1"))).when(n % 4 == 2, F.concat(name, F.lit("  TOOLO "))).when(n % 8 == 7, "Stree").otherwise("katu")
    return d.table("nation").select(n.cast("long").alias("query"), words.alias("text"))


def _roads(d) -> DataFrame:
    """Named segments, each at its first end; ``seq`` is the edge."""
    seq = F.col("a") * 2 + F.when(F.col("b") - F.col("a") == 1, 0).otherwise(1)
    return d.segment.filter("name <> ''").select(F.col("name").alias("street"), F.col("lon_a").alias("lon"), F.col("lat_a").alias("lat"), seq.alias("seq"))


_SEARCH_SQL = _ADDRESS_SQL + """
, asked as (select n_nationkey as query, case n_nationkey % 4 when 0 then substr(lower(n_name), 1, 3) when 1 then lower(n_name) || ' vay' when 2 then lower(n_name) || ' toolo' else case when n_nationkey % 8 = 7 then 'stree' else 'katu' end end as q, case when n_nationkey % 4 = 1 then '1' else '' end as num from nation),
f_place as (select place.*, translate(lower(name), 'äåöéè', 'aaoee') as f, b.street as beside from place left join
  (select * from (select p.place, a.street, row_number() over (partition by p.place order by """ + _distance("p.lon", "p.lat", "a.lon", "a.lat") + """, a.street, a.number) as k from place p, address a where """ + _distance("p.lon", "p.lat", "a.lon", "a.lat") + """ < 250) where k = 1) b using (place)),
doored as (select street, arg_min(lon, number) as lon, arg_min(lat, number) as lat, count(*) as doors from address group by street),
road as (select name as street, arg_min(lon_a, a * 2 + case when b - a = 1 then 0 else 1 end) as lon, arg_min(lat_a, a * 2 + case when b - a = 1 then 0 else 1 end) as lat from segment where name <> '' group by name),
street as (select street, coalesce(o.lon, r.lon) as lon, coalesce(o.lat, r.lat) as lat, coalesce(doors, 0) as doors, translate(lower(street), 'äåöéè', 'aaoee') as f from doored o full join road r using (street)),
ph as (select query, case when f = q then 0 when starts_with(f, q) then 2 else 4 end as cls, rank as k1, length(f) as k2, '' as k5, place as k3, 0 as k4, name as label, """ + _case({k: f"'{v}'" for k, v in C.KIND_LABELS.items()}, 'kind', f"'{C.DEFAULT_LABEL}'") + """ || case when coalesce(beside, '') <> '' then ' · ' || beside else '' end as detail, lon, lat from asked join f_place on contains(f, q) where num = ''),
sh as (select query, num, street, f, lon, lat, doors, starts_with(f, q) as pre, coalesce(sum(case when starts_with(f, q) then 1 else 0 end) over (partition by query order by street rows between unbounded preceding and 1 preceding), 0) as hits from asked join street on contains(f, q)),
dh as (select s.query, s.num, s.street, s.f, s.pre, s.doors, s.lon as slon, s.lat as slat, a.number, a.lon, a.lat, row_number() over (partition by s.query, s.street order by a.number) as k4
       from sh s left join address a on a.street = s.street and (s.num = '' or starts_with(a.number, s.num)) where s.hits < 200),
st as (select query, case when pre then 1 else 3 end as cls, 0 as k1, length(f) as k2, street as k5, 0 as k3, k4, case when number is not null then street || ' ' || number else street end as label, case when number is not null then 'Osoite' when doors > 0 then 'Katu' else 'Tie' end as detail, coalesce(lon, slon) as lon, coalesce(lat, slat) as lat from dh where k4 <= case when num = '' then 1 else 7 end),
hit as (select *, row_number() over (partition by query order by cls, k1, k2, k5, k3, k4) as rank from (select * from ph union all select * from st))"""


@query(_SEARCH_SQL + " select query, rank, cls, label, detail, round(lon, 6) as lon, round(lat, 6) as lat from hit where rank <= 7")
def search_rank(d):
    address = search.addresses(d.door)
    hits = search.search(_asked(d), search.place_context(d.place, address), search.streets(address, _roads(d)), address)
    return hits.select("query", F.col("rank").cast("long").alias("rank"), "cls", "label", "detail", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(_SEARCH_SQL + """
, truth as (select n_nationkey as query, min(p.lon) as lon, min(p.lat) as lat from nation join place p on p.name like n_name || '%' group by n_nationkey),
best as (select t.query, min(case when """ + _distance("t.lon", "t.lat", "h.lon", "h.lat") + """ <= 250 then h.rank end) as rank from truth t left join hit h on h.query = t.query and h.rank <= 7 group by t.query)
select count(*) as queries, round(avg(case when rank <= 1 then 1e0 else 0e0 end), 6) as top1, round(avg(case when rank <= 3 then 1e0 else 0e0 end), 6) as top3, round(avg(case when rank is not null then 1e0 else 0e0 end), 6) as in_list from best""")
def search_recall(d):
    address = search.addresses(d.door)
    hits = search.search(_asked(d), d.place.withColumn("street", F.lit("")), search.streets(address, _roads(d)), address)
    nation = d.table("nation").select(F.col("n_nationkey").cast("long").alias("query"), "n_name")
    truth = d.place.join(F.broadcast(nation), F.col("name").startswith(F.col("n_name"))).groupBy("query").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    return search.recall(truth, hits).select("queries", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "in_list")))


@query("select n_nationkey as id, translate(lower(n_name), 'äåöéè', 'aaoee') as folded, case when n_nationkey % 2 = 0 then n_name else n_name || ' tie' end as street, case when n_nationkey % 2 = 0 then '12 b' else '' end as number from nation", derived=False)
def query_split(d):
    n = F.col("n_nationkey")
    q = F.when(n % 2 == 0, F.concat("n_name", F.lit(", 12 b "))).otherwise(F.concat("n_name", F.lit(" tie")))
    street, number = text.query_parts(q)
    return d.table("nation").select(n.alias("id"), text.fold(F.col("n_name")).alias("folded"), street.alias("street"), number.alias("number"))


# -- profiles and lines


@query("""
, c as (select line, seq, height from height),
g(line, seq, anchor, extreme, rising, gain, loss) as (
  select line, seq, height, height, true, 0e0, 0e0 from c where seq = 0
  union all
  select c.line, c.seq,
    case when g.rising and c.height < g.extreme and g.extreme - c.height > 2 or not g.rising and c.height > g.extreme and c.height - g.extreme > 2 then g.extreme else g.anchor end,
    case when g.rising and (c.height >= g.extreme or g.extreme - c.height > 2) or not g.rising and (c.height <= g.extreme or c.height - g.extreme > 2) then c.height else g.extreme end,
    case when g.rising and g.extreme - c.height > 2 then false when not g.rising and c.height - g.extreme > 2 then true else g.rising end,
    g.gain + case when g.rising and g.extreme - c.height > 2 then g.extreme - g.anchor else 0 end,
    g.loss + case when not g.rising and c.height - g.extreme > 2 then g.anchor - g.extreme else 0 end
  from g join c on c.line = g.line and c.seq = g.seq + 1),
last as (select line, max(seq) as seq from c group by line)
select g.line, round(case when l.seq = 0 then 0 else gain + case when rising then extreme - anchor else 0 end end, 2) as gain, round(case when l.seq = 0 then 0 else loss + case when rising then 0 else anchor - extreme end end, 2) as loss from g join last l using (line, seq)""")
def gain_loss(d):
    return lines.climb(d.height, "line", ["seq"], "height").select("line", r("gain", 2).alias("gain"), r("loss", 2).alias("loss"))


@query("select line, seq, round(avg(height) over (partition by line order by dist range between 50 preceding and 50 following), 3) as smooth from height")
def profile_smooth(d):
    return lines.smooth(d.height, "line", "dist", "height").select("line", "seq", r("smooth").alias("smooth"))


@query("""
, t as (select line, max(dist) as total, count(*) as n from height group by line),
c as (select h.line, h.dist, h.height, floor(case when total > 0 then dist / total else 0 end * 4) as c from height h join t using (line) where n > 4),
e as (select line, c, arg_min(dist, struct_pack(h := height, d := dist)) as lo_d, min(height) as lo, arg_max(dist, struct_pack(h := height, d := -dist)) as hi_d, max(height) as hi from c group by line, c)
select h.line, h.dist, h.height from height h join t using (line) where n <= 4 union all select line, lo_d, lo from e union all select line, hi_d, hi from e""")
def profile_thin(d):
    return lines.thin(d.height, "line", "dist", "height", 4)


def _polyline(d) -> DataFrame:
    """Rows of the grid as lines of up to 30 points."""
    return d.node.select(F.floor(F.col("node") / 30).alias("line"), (F.col("node") % 30).alias("pos"), "lon", "lat")


@query(f"""
, p as (select node // 30 as line, node % 30 as pos, lon, lat, lead(lon) over w as lon2, lead(lat) over w as lat2 from node window w as (partition by node // 30 order by node)),
s as (select *, coalesce({_distance("lon", "lat", "lon2", "lat2")}, 0) as len from p), q as (select *, sum(len) over (partition by line order by pos) as fin from s),
i as (select line, k * 25e0 as along, lon + (k * 25e0 - (fin - len)) / len * (lon2 - lon) as lon, lat + (k * 25e0 - (fin - len)) / len * (lat2 - lat) as lat from q, generate_series(0, 400) g(k) where lon2 is not null and k * 25e0 >= fin - len and k * 25e0 < fin)
select line, round(along, 2) as along, round(lon, 6) as lon, round(lat, 6) as lat from i union all select line, round(fin, 2), round(lon, 6), round(lat, 6) from q where lon2 is null""")
def resample_line(d):
    return lines.resample(_polyline(d), "line", "pos").select("line", r("at", 2).alias("along"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""
, line as (select a * 2 + case when b - a = 1 then 0 else 1 end as edge, lon_a, lat_a, lon_b, lat_b, length, bearing from segment),
h as (select edge, degrees(atan2((lon_b - lon_a) * cos(radians((lat_a + lat_b) / 2)) * 111320e0, (lat_b - lat_a) * 110540e0)) as x, * exclude (edge) from line),
l as (select *, case when x < 0 then x + 180 when x >= 180 then x - 180 else x end as lb from h),
s as (select edge * 1000 + k as sample, edge % 2 + 1 as tier, lon_a + k * 1e0 / n * (lon_b - lon_a) + 2e-5 as lon, lat_a + k * 1e0 / n * (lat_b - lat_a) as lat, lb from (select *, greatest(floor({_distance("lon_a", "lat_a", "lon_b", "lat_b")} / 10), 1) as n from l), generate_series(0, 20) g(k) where k < n),
near as (select s.sample, s.tier, l.edge, {_distance("s.lon", "s.lat", "l.lon_a", "l.lat_a")} as m from s join l on abs(l.lon_a - s.lon) < 1e-3 and abs(l.lat_a - s.lat) < 1e-3 where least(abs(s.lb - l.lb) % 180, 180 - abs(s.lb - l.lb) % 180) <= 35),
own as (select *, row_number() over (partition by sample order by m, edge) as k from near where m < 14),
c as (select edge, count(*) * 10e0 as metres, max(tier) as tier from own where k = 1 group by edge)
select c.edge, tier, metres from c join line using (edge) where metres >= 0.4e0 * length""")
def winter_claim(d):
    rows = d.segment.withColumn("edge", F.col("a") * 2 + F.when(F.col("b") - F.col("a") == 1, 0).otherwise(1))
    heading = geo.line_bearing("lon_a", "lat_a", "lon_b", "lat_b")
    point = F.array(F.struct(F.lit(0).alias("pos"), F.col("lon_a").alias("lon"), F.col("lat_a").alias("lat")), F.struct(F.lit(1).alias("pos"), F.col("lon_b").alias("lon"), F.col("lat_b").alias("lat")))
    drawn = rows.select("edge", F.explode(point).alias("p")).select("edge", "p.*")
    samples = lines.sample_headings(drawn, "edge", "pos").select((F.col("edge") * 1000 + F.col("k")).alias("sample"), (F.col("edge") % 2 + 1).alias("tier"), (F.col("lon") + 2e-5).alias("lon"), "lat", "heading")
    vertices = rows.select("edge", F.col("lon_a").alias("to_lon"), F.col("lat_a").alias("to_lat"), heading.alias("bearing"))
    return winter.winter_claims(samples, vertices, rows.select("edge", "length"))


# -- evaluation


@query("select place, year, daily from (select *, row_number() over (partition by place order by year desc, seq) as k from counter) where k = 1")
def counter_newest(d):
    return evaluate.newest(d.counter, "place", "year", "seq").select("place", "year", "daily")


@query("""
, rk as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2e0 as x, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2e0 as y from part)
select count(*) as n, round(corr(x, y), 6) as rho from rk""")
def spearman(d):
    return evaluate.spearman(d.table("part"), "p_size", "p_retailprice").select("n", F.round("rho", 6).alias("rho"))


@query(f"""
, m as (select p.point, p.city, min({_distance("p.lon", "p.lat", "n.lon", "n.lat")}) as m from register p, node n where n.kind >= 1 group by all)
select city, count(*) as points, sum(case when m <= 40 then 1 else 0 end) as near, sum(case when m <= 80 then 1 else 0 end) as far from m group by grouping sets ((city), ())""")
def coverage_by_city(d):
    met = d.node.filter("kind >= 1").select(F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    return evaluate.coverage(d.register, met)


@query("""
, ridden as (select a, b from edge where class & 2 = 0 or class & 1 <> 0), ends as (select a as node from ridden union select b from ridden)
select node.node, kind from node join ends on ends.node = node.node where kind >= 2""")
def rider_met_signals(d):
    ridden = d.edge.filter((F.col("class").bitwiseAND(C.SIDEPATH) == 0) | (F.col("class").bitwiseAND(C.DEDICATED) != 0))
    ends = ridden.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return d.node.filter("kind >= 2").join(ends, "node", "left_semi").select("node", "kind")


@query("""
, u as (select lon, lat, city, point as seq from register union all select lon, lat, 'again', 1000000 + node from node where node % 3 = 0 union all select lon + 1e-6, lat, 'copy', 2000000 + point from register),
k as (select *, row_number() over (partition by round(lon, 4), round(lat, 4) order by seq) as k from u)
select city, count(*) as points from k where k = 1 group by city""")
def register_union_dedupe(d):
    a = d.register.select("lon", "lat", "city", F.lit(None).cast("string").alias("name"), F.col("point").alias("seq"))
    b = d.node.filter("node % 3 = 0").select("lon", "lat", F.lit("again").alias("city"), F.lit(None).cast("string").alias("name"), (F.col("node") + 1000000).alias("seq"))
    c = a.select((F.col("lon") + 1e-6).alias("lon"), "lat", F.lit("copy").alias("city"), "name", (F.col("seq") + 2000000).alias("seq"))
    return signals.register_union([a, b, c]).groupBy("city").agg(F.count(F.lit(1)).alias("points"))


@query("""
select s_suppkey as id, case when s_suppkey % 4 = 0 then null else (s_suppkey % 4) * 1.5e0 end as traffic, case when s_suppkey % 3 = 0 then null else 20e0 + s_suppkey % 50 end as signal_delay from supplier""", derived=False)
def profile_token(d):
    """A token with known and unknown letters and numbers out of range, read back."""
    s = F.col("s_suppkey")
    taste = F.when(s % 4 == 0, "c500").otherwise(F.concat(F.lit("c0.07c"), ((s % 4) * 1.5).cast("string")))
    cost = F.when(s % 3 == 0, "S-4").otherwise(F.concat(F.lit("S"), (20 + s % 50).cast("string")))
    m = profile.decode(F.concat(taste, F.lit("q7"), cost))
    return d.table("supplier").select(s.alias("id"), m["traffic"].alias("traffic"), m["signal_delay_s"].alias("signal_delay"))


from velonet.plans import details, graphs  # noqa: E402, F401  registers further queries here
