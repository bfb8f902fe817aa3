"""The whole build of a routing graph: signals, contraction, roads beside cycleways, the largest component, numbers.

The order matters: lights are decided on the full network, as contraction dissolves the nodes they stand on; the test for
parallel cycleways needs contracted edges with the points inside them; the cut comes last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.operators import network, profile, signals, winter
from velonet.operators.spatial import grid_join
from velonet.sources.shared import cut_lineage

#: Which evidence lit a node.
UNLIT, TAGGED, GOVERNING, REGISTERED = 0, 1, 2, 3


@dataclass
class Graph:
    """edges (edge_id, a, b, ...), nodes (node from 0, node_id, lon, lat, kind, barrier, degree, source), shapes (edge_id, pos, lon, lat, kind), census (outcome, n)."""

    edges: DataFrame
    nodes: DataFrame
    shapes: DataFrame
    census: DataFrame


def _places(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with their headings (cycle, road), ``elevated`` and ``roads``, none null."""
    given = set(nodes.columns)
    elevated = F.coalesce(F.col("elevated"), F.lit(False)) if "elevated" in given else F.lit(False)
    none = F.array().cast("array<long>")
    roads = F.coalesce(F.col("roads").cast("array<long>"), none) if "roads" in given else none
    empty = F.array().cast("array<double>")
    rows = nodes.select("node", "lon", "lat", F.coalesce("kind", F.lit(0)).alias("kind"), elevated.alias("elevated"), roads.alias("roads"))
    return rows.join(network.bearings_by_node(segments), "node", "left").withColumns({c: F.coalesce(F.col(c), empty) for c in ("cycle", "road")})


def attach_signals(segments: DataFrame, nodes: DataFrame, register: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, kind, source) of every node, and a census (outcome, n).

    segments: a, b, length, class, bearing_a. nodes: node, lon, lat, kind; optional elevated (on a bridge, in a tunnel) and roads (carriageways that meet
    there). register: point, city, lon, lat: signalised junctions.

    1. A tagged light is the rider's own.
    2. A light on a carriageway is theirs too where their cycleway cuts across it, once a crossing: of two such nodes
       near each other on one carriageway the first by node stays.
    3. A junction of the register lights the nearest place that a rider reaches from it by a short ride and where they cross
       traffic, on cycleways and on roads, unless one is lit there by whatever evidence, this pass included.
    """
    segments = cut_lineage(segments.select("a", "b", "length", "class", "bearing_a"), "segments")
    at = cut_lineage(_places(segments, nodes), "places")
    tagged = at.filter(F.col("kind") >= C.SIGNAL)
    on_road = at.filter(F.size("road") > 0).select(F.col("node").alias("light"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), F.col("road").alias("road_bearings"), F.col("kind").alias("light_kind"))
    meets = at.filter((F.col("kind") < C.SIGNAL) & (F.size("cycle") > 0) & ((F.size("road") > 0) | (F.col("kind") == C.CROSSING)))
    seen = signals.crossing_signals(meets.select("node", "lon", "lat", F.col("cycle").alias("bearings")), on_road.filter(F.col("light_kind") >= C.SIGNAL))
    governing = signals.suppress_near(cut_lineage(meets.join(seen, "node").select("node", "lon", "lat", "roads"), "governed"))
    lit = cut_lineage(tagged.select("node", F.lit(TAGGED).alias("source")).unionByName(governing.select("node", F.lit(GOVERNING).alias("source"))), "lit")
    census = None
    if register is not None:
        claims = cut_lineage(_register_claims(at, segments, on_road, lit, register), "claims")
        new = claims.filter("outcome <> 'known'").select("node").distinct().join(lit, "node", "left_anti")
        lit = cut_lineage(lit.unionByName(new.withColumn("source", F.lit(REGISTERED))), "lit")
        census = _census(claims, register)
    kinds = at.select("node", "kind").join(lit, "node", "left")
    kind = F.when(F.col("source") > TAGGED, C.SIGNAL).otherwise(F.col("kind")).cast("int")
    kinds = kinds.select("node", kind.alias("kind"), F.coalesce("source", F.lit(UNLIT)).alias("source"))
    names = {TAGGED: "tagged", GOVERNING: "governing", REGISTERED: "registered"}
    lights = lit.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("source")).alias("outcome"), "n")
    return kinds, lights if census is None else lights.unionByName(census)


def _register_claims(at: DataFrame, segments: DataFrame, on_road: DataFrame, lit: DataFrame, register: DataFrame) -> DataFrame:
    """(point, kind, node, outcome, metres) of every register point and kind of way that is served."""
    points = register.select("point", "lon", "lat")
    ground = at.filter("not elevated")
    anchors = signals.anchors(points, ground.filter(F.size("road") > 0).select("node", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat")))
    anchors = cut_lineage(anchors.select("point", F.col("node").alias("anchor")), "anchors")
    arcs = cut_lineage(network.both_ways(segments, ["length"]).select("tail", "head", "length"), "arcs")
    walks = signals.walk(arcs, anchors.select(F.col("anchor").alias("start")).distinct()).select(F.col("start").alias("anchor"), "node", F.lit(True).alias("walkable"))
    ways = F.array_compact(F.array(F.when(F.size("cycle") > 0, F.lit("cycleway")), F.when(F.size("road") > 0, F.lit("road"))))
    near = at.select("node", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), F.col("kind").alias("own"), (~F.col("elevated")).alias("grounded"), "cycle", F.explode(ways).alias("kind"))
    pairs = grid_join(points, near, C.REGISTER_FAR, 0.001).drop("lon", "lat").join(anchors, "point").join(walks, ["anchor", "node"])
    pairs = cut_lineage(pairs, "candidates")
    # where no tag says crossing, a cycleway must cut across a road close by
    asked = pairs.filter((F.col("own") != C.CROSSING) & (F.size("cycle") > 0)).select("node", F.col("to_lon").alias("lon"), F.col("to_lat").alias("lat"), F.col("cycle").alias("bearings")).dropDuplicates(["node"])
    cut = signals.crossing_signals(asked, on_road.drop("light_kind"), C.REGISTER_NEAR).withColumn("cut", F.lit(True))
    own = pairs.join(cut, "node", "left").join(lit.select("node", F.lit(True).alias("lit")), "node", "left")
    crossing = (F.col("own") == C.CROSSING) | (F.size("cycle") == 0) | F.coalesce("cut", F.lit(False))
    rows = cut_lineage(own.select("point", "kind", "node", "metres", F.coalesce("lit", F.lit(False)).alias("lit"), "grounded", "walkable", crossing.alias("crossing")).filter("crossing"), "candidates")
    served = signals.claim(register, rows).join(rows.select("point", "kind", "node", "metres"), ["point", "kind", "node"])
    further = (F.col("outcome") == "claimed") & (F.col("metres") > C.REGISTER_NEAR)
    return served.withColumn("outcome", F.when(further, "further").otherwise(F.col("outcome")))


def _census(claims: DataFrame, register: DataFrame) -> DataFrame:
    """(outcome, n): known, added, of these further, apart (no way of this kind may be lit), unreached (neither kind)."""
    by = register.select("point").join(claims.groupBy("point").agg(*(F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("known", "claimed", "further"))), "point", "left")
    served = sum((F.coalesce(F.col(o), F.lit(0)) for o in ("known", "claimed", "further")), F.lit(0))
    counts = {"known": F.sum("known"), "added": F.sum(F.col("claimed") + F.col("further")), "further": F.sum("further"), "apart": F.sum(2 - served), "unreached": F.sum(F.when(served == 0, 1).otherwise(0))}
    row = by.agg(*(F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counts.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("outcome"), F.col(k).alias("n")) for k in counts))).alias("x")).select("x.*")


def polylines(edges: DataFrame, shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, pos, lon, lat): each edge's first node at pos 0, the points inside, its last node."""
    end = lambda c: nodes.select(F.col("node").alias(c), "lon", "lat")
    inner = shapes.select("edge_id", (F.col("pos") + 1).alias("pos"), "lon", "lat")
    first = edges.join(end("a"), "a").select("edge_id", F.lit(0).alias("pos"), "lon", "lat")
    last = edges.join(end("b"), "b").select("edge_id", F.col("segments").cast("int").alias("pos"), "lon", "lat")
    return first.unionByName(inner).unionByName(last)


def mark_parallel(edges: DataFrame, shapes: DataFrame, nodes: DataFrame, folded: bool = False) -> DataFrame:
    """``edges`` with the sidepath bit where a cycleway runs beside most of a road, whatever its tags say."""
    w = Window.partitionBy("edge_id").orderBy("pos")
    line = polylines(edges, shapes, nodes).join(edges.select("edge_id", "length", "class"), "edge_id")
    dedicated, told = F.col("class").bitwiseAND(C.DEDICATED) != 0, F.col("class").bitwiseAND(C.SIDEPATH) != 0
    pieces = line.filter(dedicated).select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2")).filter("lon2 is not null")
    pieces = pieces.withColumn("bearing", geo.bearing("lon1", "lat1", "lon2", "lat2"))
    samples = winter.parallel_samples(line.filter(~dedicated & ~told), "edge_id", "pos").withColumnRenamed("edge_id", "edge")
    beside = winter.parallel_share(samples, pieces, folded).filter("beside").select(F.col("edge").alias("edge_id"), F.lit(C.SIDEPATH).alias("_bit"))
    return edges.join(beside, "edge_id", "left").withColumn("class", F.col("class").bitwiseOR(F.coalesce("_bit", F.lit(0)))).drop("_bit")


def build_graph(segments: DataFrame, nodes: DataFrame, register: DataFrame | None = None, bounds: tuple[float, float, float, float] | None = None) -> Graph:
    """From deduped segments and tagged nodes to the graph that is routed on; ``bounds`` is west, south, east, north."""
    segments, nodes = cut_lineage(segments, "segments"), cut_lineage(nodes, "nodes")
    kinds, census = attach_signals(segments, nodes, register)
    kinds = cut_lineage(kinds, "kinds")
    own = nodes.select("node", "lon", "lat", F.coalesce("barrier", F.lit(0)).alias("barrier")).join(kinds, "node")
    if bounds is not None:
        west, south, east, north = bounds
        own = own.withColumn("inside", F.col("lon").between(west, east) & F.col("lat").between(south, north))
    own = cut_lineage(own, "nodes")
    edges, shapes = network.contract_with_shapes(segments, own, closed=True)
    key = ["a", "b", "first"]
    edges = cut_lineage(network.number_rows(edges, key, "edge_id"), "edges")
    shapes = cut_lineage(shapes.join(edges.select(*key, "edge_id"), key).select("edge_id", "pos", "lon", "lat", "kind"), "shapes")
    edges = cut_lineage(mark_parallel(edges, shapes, own), "marked")
    kept = cut_lineage(network.largest_scc(network.directed_states(edges).select("tail", "head")), "component")
    # what is left is numbered anew, and so is all that refers to it
    left = own.join(kept, "node", "left_semi").join(network.degrees(segments), "node").withColumnRenamed("node", "node_id")
    left = cut_lineage(network.number_rows(left, ["node_id"], "node").select("node", "node_id", "lon", "lat", "kind", "barrier", "degree", "source"), "nodes")
    edges = cut_lineage(network.number_rows(network.restrict(edges, kept).withColumnRenamed("edge_id", "old_edge"), ["old_edge"], "edge_id"), "edges")
    shapes = shapes.withColumnRenamed("edge_id", "old_edge").join(edges.select("old_edge", "edge_id"), "old_edge").select("edge_id", "pos", "lon", "lat", "kind")
    for end in ("a", "b"):
        number = left.select(F.col("node_id").alias(end), F.col("node").alias("_n"))
        edges = edges.join(number, end).withColumn(end, F.col("_n")).drop("_n")
    return Graph(cut_lineage(edges.drop("old_edge", "first"), "edges"), left, cut_lineage(shapes, "shapes"), census)


def climb(graph: Graph, tiles: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge_id, ascent, descent), (node, height), (edge_id, pos, height) from a raster, as ``profile.sample_heights`` reads it."""
    line = polylines(graph.edges, graph.shapes, graph.nodes)
    samples = profile.sample_heights(profile.resample(line, "edge_id", "pos"), tiles, cells)
    edges = profile.climb(samples, "edge_id", ["at"], "height").select("edge_id", F.col("gain").alias("ascent"), F.col("loss").alias("descent"))
    at_nodes = profile.sample_heights(graph.nodes.select("node", "lon", "lat"), tiles, cells).select("node", "height")
    return edges, at_nodes, profile.sample_heights(graph.shapes.select("edge_id", "pos", "lon", "lat"), tiles, cells).select("edge_id", "pos", "height")


def winter_tiers(graph: Graph, lines: DataFrame) -> DataFrame:
    """(edge_id, tier, metres) of the edges that lines of winter upkeep (line, pos, lon, lat, tier) claim."""
    headed = profile.sample_headings(lines.select("line", "pos", "lon", "lat"), "line", "pos").join(lines.select("line", "pos", "tier"), ["line", "pos"])
    samples = headed.withColumn("sample", F.struct("line", "pos", "k"))
    w = Window.partitionBy("edge_id").orderBy("pos")
    line = polylines(graph.edges, graph.shapes, graph.nodes)
    starts = line.select("edge_id", "lon", "lat", F.lead("lon").over(w).alias("_lon"), F.lead("lat").over(w).alias("_lat")).filter("_lon is not null")
    starts = starts.select(F.col("edge_id").alias("edge"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), geo.line_bearing("lon", "lat", "_lon", "_lat").alias("bearing"))
    claims = winter.winter_claims(samples.select("sample", "lon", "lat", "heading", "tier"), starts, graph.edges.select(F.col("edge_id").alias("edge"), "length"))
    return claims.withColumnRenamed("edge", "edge_id")
