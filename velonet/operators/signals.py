"""Where riders wait: lights seen from crossings, and registers matched to junctions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.operators.spatial import grid_join, nearest_within
from velonet.sources.shared import Parts, Rounds, cut_lineage


def crosses(a: str, b: str):
    """Whether any heading of one array cuts across any of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: geo.cuts_across(x, y)))


def crossing_signals(cycle_nodes: DataFrame, signals: DataFrame, reach: float = C.SIGNAL_REACH) -> DataFrame:
    """The cycle nodes (node, lon, lat, bearings) with a light (light, to_lon, to_lat, road_bearings) in reach whose road they cut across: (node)."""
    met = grid_join(cycle_nodes, signals, reach, 0.001)
    return met.filter(crosses("bearings", "road_bearings")).select("node").distinct()


#: Degrees of a block within which rivals are settled one after another.
BLOCK = 0.05


def _settled(rows: pa.Table) -> pa.Table:
    """(node, kept) of the nodes of a block that its own earlier ones settle; ``others`` are the open rivals, here or elsewhere."""
    rows = rows.sort_by("node")
    state: dict[int, bool | None] = {}
    for node, others in zip(rows["node"].to_pylist(), rows["others"].to_pylist()):
        known = [state.get(o) for o in others]
        state[node] = False if True in known else None if None in known else True
    done = {n: k for n, k in state.items() if k is not None}
    return pa.table({"node": pa.array(done.keys(), pa.int64()), "kept": pa.array(done.values(), pa.bool_())})


def suppress_near(candidates: DataFrame, within: float = C.SIGNAL_MERGE, max_rounds: int = 10_000) -> DataFrame:
    """Greedy in node order: a candidate (node, lon, lat, roads) goes if an earlier kept one lies nearer than
    ``within`` and they share a road (or either has none). (node) of those kept.

    That is the lexicographically first independent set: each round keeps, block by block, those without an undecided smaller
    rival and drops their later rivals, so there are as many rounds as a chain of rivals crosses blocks.
    """
    left = candidates.select("node", "lon", "lat", "roads")
    right = candidates.select(F.col("node").alias("other"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"), F.col("roads").alias("other_roads"))
    shared = F.arrays_overlap("roads", "other_roads") | (F.size("roads") == 0) | (F.size("other_roads") == 0)
    rivals = cut_lineage(grid_join(left, right, within, 0.001).filter((F.col("other") < F.col("node")) & (F.col("metres") < within) & shared).select("other", "node"), "rivals")
    open_ = cut_lineage(candidates.select(F.col("node").cast("long").alias("node"), geo.cell("lon", BLOCK).alias("x"), geo.cell("lat", BLOCK).alias("y")), "open")
    kept = None
    for _ in range(max_rounds):
        waits = rivals.join(open_.select(F.col("node").alias("other")), "other", "left_semi").groupBy("node").agg(F.collect_list("other").alias("others"))
        rows = open_.join(waits, "node", "left").withColumn("others", F.coalesce("others", F.array().cast("array<long>")))
        now = cut_lineage(rows.groupBy("x", "y").applyInArrow(_settled, "node long, kept boolean"), "settled")
        own = now.filter("kept").select("node")
        kept = own if kept is None else kept.unionByName(own)
        gone = rivals.join(own.withColumnRenamed("node", "other"), "other", "left_semi").select("node")
        open_ = cut_lineage(open_.join(now.select("node").unionByName(gone).distinct(), "node", "left_anti"), "open")
        if open_.isEmpty():
            return kept
    raise RuntimeError(f"undecided candidates after {max_rounds} rounds")


def anchors(register: DataFrame, road_nodes: DataFrame, radius: float = C.REGISTER_FAR) -> DataFrame:
    """(point, node, metres): the nearest road node of each register point (point, lon, lat) within ``radius``."""
    return nearest_within(register, road_nodes, "point", ["node"], radius, 0.001)


def match_register(register: DataFrame, nodes: DataFrame, near: float = C.REGISTER_NEAR, far: float = C.REGISTER_FAR) -> DataFrame:
    """(point, node, metres, source): the nearest node within ``near``, else within ``far``; points without one are absent."""
    pairs = grid_join(register, nodes, far, 0.001)
    best = lambda c: F.min(F.when(c, F.struct("metres", "node")))
    both = pairs.groupBy("point").agg(best(F.col("metres") <= near).alias("n"), best(F.lit(True)).alias("f"))
    one = F.coalesce("n", "f")
    return both.select("point", one["node"].alias("node"), one["metres"].alias("metres"), F.when(F.col("n").isNotNull(), "near").otherwise("far").alias("source"))


def walk(arcs: DataFrame, starts: DataFrame, budget: float = C.WALK_M, max_rounds: int = 10_000) -> DataFrame:
    """(start, node, metres): nodes within ``budget`` metres of riding of each start, undirected arcs (tail, head, length)."""
    known = Parts("walk", lambda t: t.groupBy("start", "node").agg(F.min("metres").alias("metres")))
    frontier = known.add(starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("metres")))
    for _ in range(max_rounds):
        step = frontier.join(arcs.hint("merge"), frontier["node"] == arcs["tail"]).select("start", F.col("head").alias("node"), (F.col("metres") + F.col("length")).alias("metres")).filter(F.col("metres") <= budget)
        step = step.groupBy("start", "node").agg(F.min("metres").alias("metres"))
        before = known.table().select(F.col("start").alias("_s"), F.col("node").alias("_n"), F.col("metres").alias("_m"))
        # hints: neither side is sent to the driver, round after round
        frontier = known.add(step.join(before.hint("merge"), (F.col("start") == F.col("_s")) & (F.col("node") == F.col("_n")) & (F.col("_m") <= F.col("metres")), "left_anti"))
        if frontier.isEmpty():
            return known.merged()
    raise RuntimeError("the walk did not end")


def claim(register: DataFrame, candidates: DataFrame, near: float = C.REGISTER_NEAR, far: float = C.REGISTER_FAR, max_rounds: int = 10_000) -> DataFrame:
    """Register points take lights in order of (city, lon, lat), cycleways before roads: (point, kind, node, outcome).

    register: point, city, lon, lat. candidates: point, kind ('cycleway' or 'road'), node, metres, lit, grounded, and whether
    the point may reach it (walkable) and it is crossed there (crossing); no other node counts. A light already lit within ``near`` is ``known``; else
    the nearest grounded node within ``near``, or ``far``, is claimed and counts as lit for later points.

    What a point would claim is the same whatever is lit, so an earlier point only matters to those within ``near`` of its pick. Each
    round settles all points whose earlier rivals are settled: no group of points is gathered, however many hang together.
    """
    order = F.struct("city", "lon", "lat", "point")
    rows = candidates.filter(F.col("walkable") & F.col("crossing")).join(register.select("point", order.alias("turn")), "point")
    rows = cut_lineage(rows.select("point", "kind", "node", "metres", "lit", "grounded", "turn"), "ways")
    best = lambda c: F.min(F.when(c, F.struct("metres", "node")))["node"]
    at = rows.groupBy("point", "kind").agg(F.first("turn").alias("turn"), best(F.col("grounded") & (F.col("metres") <= far)).alias("pick"), F.bool_or(F.col("lit") & (F.col("metres") <= near)).alias("known"))
    at = cut_lineage(at.withColumn("known", F.coalesce("known", F.lit(False))), "turns")
    # who stands near the pick of an earlier one that may claim; those that know a light of old don't
    picks = at.filter("pick is not null and not known").select("kind", F.col("pick").alias("node"), F.col("point").alias("other"), F.col("turn").alias("sooner"))
    rivals = cut_lineage(rows.filter(F.col("metres") <= near).join(picks, ["kind", "node"]).filter(F.col("sooner") < F.col("turn")).select("point", "kind", "node", "metres", "other"), "rivals")
    key = ["point", "kind"]
    sooner = rivals.select(*key, "other").distinct()
    open_ = cut_lineage(at.filter("not known").select(*key, F.col("pick").isNotNull().alias("may")), "open")
    claimed = Parts("claimed", lambda t: t)
    for _ in range(max_rounds):
        other = open_.filter("may").select(F.col("point").alias("other"), "kind")
        waits = sooner.join(open_.select(*key), key, "left_semi").join(other, ["other", "kind"], "left_semi").select(*key).distinct()
        now = claimed.add(open_.join(waits, key, "left_anti").filter("may").select(*key))
        # all that have no open rival are settled, and so are those near what was just claimed
        knows = sooner.join(now.select(F.col("point").alias("other"), "kind"), ["other", "kind"], "left_semi").select(*key).distinct()
        open_ = cut_lineage(open_.join(waits, key, "left_semi").join(knows, key, "left_anti"), "open")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"points unsettled after {max_rounds} rounds")
    made = cut_lineage(claimed.merged(), "claimed")
    old = rows.filter(F.col("lit") & (F.col("metres") <= near)).select(*key, "node", "metres")
    new = rivals.join(made.select(F.col("point").alias("other"), "kind"), ["other", "kind"], "left_semi").select(*key, "node", "metres")
    known = old.unionByName(new).groupBy(*key).agg(F.min(F.struct("metres", "node"))["node"].alias("node"))
    return known.select(*key, "node", F.lit("known").alias("outcome")).unionByName(at.join(made, key, "left_semi").select(*key, F.col("pick").alias("node"), F.lit("claimed").alias("outcome")))


def point_groups(candidates: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(point, group): the least point that each point is connected to through shared candidates (point, kind, node)."""
    met = cut_lineage(candidates.select("point", "kind", "node").distinct(), "met")
    rounds = Rounds("groups")
    now = rounds.write(met.select("point", F.col("point").alias("group")).distinct())
    for _ in range(max_rounds):
        least = met.join(now, "point").groupBy("kind", "node").agg(F.min("group").alias("group"))
        seen = met.join(least, ["kind", "node"]).groupBy("point").agg(F.min("group").alias("group"))
        # a group's own point may have found a smaller one meanwhile
        further = seen.join(seen.select(F.col("point").alias("group"), F.col("group").alias("g")), "group").select("point", F.col("g").alias("group"))
        before, now = now.agg(F.sum(F.col("group").cast("decimal(38,0)"))).first()[0], rounds.write(further)
        if now.agg(F.sum(F.col("group").cast("decimal(38,0)"))).first()[0] == before:
            return now
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def register_union(registers: list[DataFrame]) -> DataFrame:
    """Registers (lon, lat, city, name, seq) as one: the first of each place by four decimals, in order (city, lon, lat)."""
    rows = registers[0]
    for r in registers[1:]:
        rows = rows.unionByName(r)
    place = Window.partitionBy(F.round("lon", 4), F.round("lat", 4)).orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n").orderBy("city", "lon", "lat")
