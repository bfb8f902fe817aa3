"""Simulated trips: weighted origins and goals, drawn by inverse distribution and hashes, so that any partitioning gives the same trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.sources.shared import cut_lineage

#: Draws of a trip that are tried at once, and metres that a trip spans at least and at most.
ATTEMPTS, SPAN = 8, (1_500.0, 20_000.0)
#: Stretches of equal width into which the sum of weights is cut; a row of each is sent to every task.
STRETCHES = 1 << 16


def cumulative(places: DataFrame, partitions: int = 64) -> DataFrame:
    """places (node, lon, lat, weight: whole numbers) with ``low`` and ``high``: each one's share of 0 to the sum of weights, in order of node.

    Range partitions are summed, then their sums, so no task holds all.
    """
    rows = places.filter("weight > 0").select("node", "lon", "lat", F.col("weight").cast("long").alias("weight"))
    rows = cut_lineage(rows.repartitionByRange(partitions, "node").withColumn("_p", F.spark_partition_id()), "places")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_p").agg(F.sum("weight").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    high = F.col("_base") + F.sum("weight").over(Window.partitionBy("_p").orderBy("node"))
    return rows.join(F.broadcast(base.select("_p", "_base")), "_p").withColumn("high", high).withColumn("low", F.col("high") - F.col("weight")).select("node", "lon", "lat", "low", "high")


def _drawn(seed: str, end: str, total: int) -> Column:
    """A whole number below ``total`` for each (trip, attempt)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(end), F.col("trip").cast("string"), F.col("attempt").cast("string")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % total


def _stretch(c: str | Column, total: int, buckets: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(max(1, -(-total // buckets)))).cast("long")


def _spread(shares: DataFrame, total: int, buckets: int) -> DataFrame:
    """``shares`` once for each stretch (_b) that they touch."""
    return shares.withColumn("_b", F.explode(F.sequence(_stretch("low", total, buckets), _stretch(F.col("high") - 1, total, buckets))))


def pick(draws: DataFrame, shares: DataFrame, u: str, total: int, buckets: int = STRETCHES) -> DataFrame:
    """``draws`` with node, lon and lat of the share that holds ``u``: both sides meet by stretches of equal width, then exactly."""
    met = draws.withColumn("_b", _stretch(u, total, buckets)).join(_spread(shares, total, buckets), "_b")
    return met.filter((F.col("low") <= F.col(u)) & (F.col(u) < F.col("high"))).drop("_b", "low", "high", u)


def boxes(shares: DataFrame, total: int, end: str, buckets: int = STRETCHES) -> DataFrame:
    """The bounds of what stands in each stretch: {end}_b, {end}_west, {end}_south, {end}_east, {end}_north."""
    by = _spread(shares, total, buckets).groupBy(F.col("_b").alias(f"{end}_b"))
    return by.agg(F.min("lon").alias(f"{end}_west"), F.min("lat").alias(f"{end}_south"), F.max("lon").alias(f"{end}_east"), F.max("lat").alias(f"{end}_north"))


def _apart() -> Column:
    """Metres that the boxes of a start and a goal are apart at least."""
    gap = lambda low, high: F.greatest(F.lit(0.0), F.col(f"start_{low}") - F.col(f"goal_{high}"), F.col(f"goal_{low}") - F.col(f"start_{high}"))
    low, high = F.least("start_south", "goal_south"), F.greatest("start_north", "goal_north")
    pole = ((low <= 90.0) & (high >= 90.0)) | ((low <= -90.0) & (high >= -90.0))
    shrink = F.when(pole, 0.0).otherwise(F.least(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high)))))
    return F.hypot(gap("west", "east") * C.METRES_LON * shrink, gap("south", "north") * C.METRES_LAT)


def trips(ids: DataFrame, origins: DataFrame, goals: DataFrame, seed: str = "trips", span: tuple[float, float] = SPAN, max_rounds: int = 50, all_found: bool = True) -> DataFrame:
    """(trip, start, goal, metres): for each id (trip) an origin and a goal, drawn in proportion to weight, the first draw that spans ``span`` metres.

    origins, goals: node, lon, lat, weight. A draw is looked up only if the stretches that its ends fall into are near enough. Trips that find no such pair in ``max_rounds`` times ``ATTEMPTS`` draws are an error: then hardly any pair spans so much. Without ``all_found`` they have no row.
    """
    ends = {"start": cut_lineage(cumulative(origins), "origins"), "goal": cut_lineage(cumulative(goals), "goals")}
    totals = {k: v.agg(F.max("high")).first()[0] for k, v in ends.items()}
    if None in totals.values():
        raise ValueError("no origin or no goal has a weight")
    near = {k: F.broadcast(cut_lineage(boxes(v, totals[k], k), "boxes")) for k, v in ends.items()}
    left, out = cut_lineage(ids.select(F.col("trip").cast("long").alias("trip")).distinct(), "trips"), None
    for r in range(max_rounds):
        rows = left.withColumn("attempt", F.explode(F.sequence(F.lit(r * ATTEMPTS), F.lit((r + 1) * ATTEMPTS - 1))))
        for end in ends:
            rows = rows.withColumn(f"{end}_u", _drawn(seed, end, totals[end]))
            rows = rows.withColumn(f"{end}_b", _stretch(f"{end}_u", totals[end], STRETCHES)).join(near[end], f"{end}_b")
        # whatever rounding does to a bound, it is kept wider
        rows = rows.filter(_apart() <= span[1] * (1 + 1e-9) + 1e-3).select("trip", "attempt", "start_u", "goal_u")
        rows = cut_lineage(rows, "draws")
        for end, shares in ends.items():
            rows = pick(rows, shares, f"{end}_u", totals[end])
            rows = rows.withColumnsRenamed({"node": end, "lon": f"{end}_lon", "lat": f"{end}_lat"})
        rows = rows.withColumn("metres", geo.distance_m("start_lon", "start_lat", "goal_lon", "goal_lat")).filter(F.col("metres").between(*span))
        first = rows.groupBy("trip").agg(F.min(F.struct("attempt", "start", "goal", "metres")).alias("x"))
        found = cut_lineage(first.select("trip", "x.start", "x.goal", "x.metres"), "trips")
        out = found if out is None else out.unionByName(found)
        left = cut_lineage(left.join(found.select("trip"), "trip", "left_anti"), "trips")
        if left.isEmpty():
            return out
    if not all_found:
        return out
    raise RuntimeError(f"trips without a pair that spans {span} after {max_rounds * ATTEMPTS} draws")
