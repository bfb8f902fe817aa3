"""Ordered operators on height profiles and lines: hysteresis, smoothing, thinning, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.sources import raster


def gain_loss(heights, threshold: float = C.CLIMB_THRESHOLD):
    """STRUCT<gain, loss> of an array of heights in order; nulls and NaN are skipped, moves up to ``threshold`` ignored.

    An anchor, the extreme since, and the direction: only a reversal of more than the threshold books a leg.
    """
    heights = F.filter(heights, lambda h: h.isNotNull() & ~F.isnan(h))
    first = F.get(heights, F.lit(0))
    state = lambda a, e, r, g, l: F.struct(a.alias("anchor"), e.alias("extreme"), r.alias("rising"), g.alias("gain"), l.alias("loss"))  # noqa: E731, E741
    start = state(F.coalesce(first, F.lit(0.0)), F.coalesce(first, F.lit(0.0)), F.lit(True), F.lit(0.0), F.lit(0.0))

    def fold(s, h):
        up = s["rising"]
        further = F.when(up, h >= s["extreme"]).otherwise(h <= s["extreme"])
        back = F.when(up, s["extreme"] - h > threshold).otherwise(h - s["extreme"] > threshold)
        turn = ~further & back
        leg = F.abs(s["extreme"] - s["anchor"])
        return state(
            F.when(turn, s["extreme"]).otherwise(s["anchor"]), F.when(further | back, h).otherwise(s["extreme"]), F.when(turn, ~up).otherwise(up),
            s["gain"] + F.when(turn & up, leg).otherwise(0.0), s["loss"] + F.when(turn & ~up, leg).otherwise(0.0),
        )

    def finish(s):
        leg = F.abs(s["extreme"] - s["anchor"])
        return F.struct((s["gain"] + F.when(s["rising"], leg).otherwise(0.0)).alias("gain"), (s["loss"] + F.when(s["rising"], F.lit(0.0)).otherwise(leg)).alias("loss"))

    none = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))
    return F.when(F.size(heights) < 2, none).otherwise(F.aggregate(heights, start, fold, finish))


def climb(profile: DataFrame, key: str, order: list[str], height: str, threshold: float = C.CLIMB_THRESHOLD) -> DataFrame:
    """(key, gain, loss) of each profile."""
    lists = profile.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(height).cast("double").alias("_h")))).alias("_r"))
    return lists.select(key, gain_loss(F.transform("_r", lambda r: r["_h"]), threshold).alias("g")).select(key, "g.*")


def smooth(profile: DataFrame, key: str, dist: str, height: str, metres: float = C.SMOOTH_M) -> DataFrame:
    """Adds ``smooth``: the mean height within half of ``metres`` on either side, by distance."""
    # a frame of fractional distances can only be said in SQL
    half = f"{metres / 2:.6f}D"
    return profile.withColumn("smooth", F.expr(f"avg(`{height}`) over (partition by `{key}` order by `{dist}` range between {half} preceding and {half} following)"))


def thin(profile: DataFrame, key: str, dist: str, height: str, columns: int) -> DataFrame:
    """(key, dist, height): the lowest and highest point of each of ``columns`` equal stretches, in order of distance.

    A profile of at most ``columns`` points stays; a stretch of one point gives it twice.
    """
    total = profile.groupBy(key).agg(F.max(dist).alias("_total"), F.count(F.lit(1)).alias("_n"))
    rows = profile.join(total, key)
    few = rows.filter(F.col("_n") <= columns).select(key, F.col(dist).alias("dist"), F.col(height).alias("height"))
    share = F.when(F.col("_total") > 0, F.col(dist) / F.col("_total")).otherwise(0.0)
    many = rows.filter(F.col("_n") > columns).withColumn("_c", F.floor(share * columns))
    ends = many.groupBy(key, "_c").agg(F.min(F.struct(F.col(height).alias("h"), F.col(dist).alias("d"))).alias("lo"), F.max(F.struct(F.col(height).alias("h"), (-F.col(dist)).alias("d"))).alias("hi"))
    both = ends.select(key, F.explode(F.array(F.struct(F.col("lo.d").alias("dist"), F.col("lo.h").alias("height")), F.struct((-F.col("hi.d")).alias("dist"), F.col("hi.h").alias("height")))).alias("p"))
    return few.unionByName(both.select(key, "p.dist", "p.height"))


def resample(points: DataFrame, key: str, pos: str, step: float = C.CLIMB_STEP) -> DataFrame:
    """(key, at, lon, lat): points every ``step`` metres along each line, both ends kept.

    points: key, pos, lon, lat. Each segment emits the samples that fall into it, so nothing is searched.
    """
    w = Window.partitionBy(key).orderBy(pos)
    seg = points.withColumn("_lon2", F.lead("lon").over(w)).withColumn("_lat2", F.lead("lat").over(w))
    seg = seg.withColumn("_len", F.coalesce(geo.distance_m("lon", "lat", "_lon2", "_lat2"), F.lit(0.0)))
    seg = seg.withColumn("_end", F.sum("_len").over(w)).withColumn("_begin", F.col("_end") - F.col("_len"))
    seg = seg.withColumn("_run", F.max("_end").over(Window.partitionBy(key)))
    first, last = F.ceil(F.col("_begin") / step), F.ceil(F.col("_end") / step) - 1
    inner = seg.filter("_lon2 is not null and _len > 0").withColumn("_k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("_k") * step - F.col("_begin")) / F.col("_len")
    inner = inner.select(key, (F.col("_k") * step).alias("at"), (F.col("lon") + t * (F.col("_lon2") - F.col("lon"))).alias("lon"), (F.col("lat") + t * (F.col("_lat2") - F.col("lat"))).alias("lat"))
    ends = seg.filter("_lon2 is null").select(key, F.col("_run").alias("at"), "lon", "lat")
    return inner.unionByName(ends)


def sample_headings(points: DataFrame, key: str, pos: str, step: float = C.WINTER_STEP) -> DataFrame:
    """(key, pos, k, lon, lat, heading): samples every ``step`` metres inside each segment, with its line heading; no end points."""
    w = Window.partitionBy(key).orderBy(pos)
    seg = points.withColumn("_lon2", F.lead("lon").over(w)).withColumn("_lat2", F.lead("lat").over(w)).filter("_lon2 is not null")
    seg = seg.withColumn("_span", geo.distance_m("lon", "lat", "_lon2", "_lat2")).filter("_span > 0")
    n = F.greatest(F.floor(F.col("_span") / step), F.lit(1))
    seg = seg.withColumn("heading", geo.line_bearing("lon", "lat", "_lon2", "_lat2")).withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    t = F.col("k") / F.col("_n")
    return seg.select(key, pos, "k", (F.col("lon") + t * (F.col("_lon2") - F.col("lon"))).alias("lon"), (F.col("lat") + t * (F.col("_lat2") - F.col("lat"))).alias("lat"), "heading")


def sample_heights(points: DataFrame, tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """points with ``height``: the raster cell they fall into, of the first tile (by ``rank``) that covers them; else null.

    tiles: tile, rank, west, north, size (degrees a cell), rows, cols. cells: tile, row, col, height. Points and tiles meet by the squares of a grid as wide
    as the largest tile, of which a tile touches four at most.
    """
    side = tiles.agg(F.max(F.greatest("rows", "cols") * F.col("size"))).first()[0] or 1.0
    square = lambda c: F.floor(c / F.lit(side))
    span = lambda a, b: F.explode(F.sequence(square(a), square(b)))
    spread = tiles.withColumn("_x", span(F.col("west"), F.col("west") + F.col("cols") * F.col("size"))).withColumn("_y", span(F.col("north") - F.col("rows") * F.col("size"), F.col("north")))
    x, y = F.floor((F.col("lon") - F.col("west")) / F.col("size")), F.floor((F.col("north") - F.col("lat")) / F.col("size"))
    inside = (x >= 0) & (x < F.col("cols")) & (y >= 0) & (y < F.col("rows"))
    key = [c for c in points.columns]
    keyed = points.withColumn("_x", square(F.col("lon"))).withColumn("_y", square(F.col("lat")))
    met = keyed.join(spread, ["_x", "_y"]).filter(inside).select(*key, "tile", "rank", y.alias("row"), x.alias("col"))
    first = met.join(cells, ["tile", "row", "col"]).filter("height is not null and not isnan(height)").groupBy(*key).agg(F.min_by("height", "rank").alias("height"))
    return points.join(first, key, "left")


def sample_raster(points: DataFrame, path: str, key: list[str]) -> DataFrame:
    """points (key, lon, lat) with ``height``: the cell of a raster they fall into, of the first file by name that has data there; else null.

    Only blocks within the points' bounds are read, and a point meets one block of each file that covers it. ``key`` must tell points apart;
    those without a place have no height. Raises where the files differ in reference system, or have one that ``geo`` can't project to.
    """
    spark = points.sparkSession
    tiles = raster.tiles(spark, path)
    crs, across, down = tiles.agg(F.first("crs"), F.max(F.col("cols") * F.col("dx")), F.max(F.col("rows") * F.col("dy"))).first()
    if crs not in geo.GRIDS and crs not in geo.DEGREES:
        raise ValueError(f"{path} is in {crs}, which is not projected to")
    x, y = geo.to_grid("lon", "lat", crs) if crs in geo.GRIDS else (F.col("lon"), F.col("lat"))
    at = points.select(*key, x.alias("_east"), y.alias("_north")).filter("_east is not null and _north is not null")
    west, south, east, north = at.agg(F.min("_east"), F.min("_north"), F.max("_east"), F.max("_north")).first()
    if west is None:
        return points.withColumn("height", F.lit(None).cast("double"))
    squares = lambda a, b, side: F.explode(F.sequence(F.floor(a / F.lit(side)), F.floor(b / F.lit(side))))
    right, bottom = F.col("west") + F.col("cols") * F.col("dx"), F.col("north") - F.col("rows") * F.col("dy")
    spread = tiles.withColumn("_x", squares(F.col("west"), right, across)).withColumn("_y", squares(bottom, F.col("north"), down))
    at = at.withColumn("_x", F.floor(F.col("_east") / F.lit(across))).withColumn("_y", F.floor(F.col("_north") / F.lit(down)))
    met = at.join(spread, ["_x", "_y"]).filter((F.col("_east") >= F.col("west")) & (F.col("_east") < right) & (F.col("_north") > bottom) & (F.col("_north") <= F.col("north")))
    row = F.least(F.floor((F.col("north") - F.col("_north")) / F.col("dy")), F.col("rows") - 1)
    col = F.least(F.floor((F.col("_east") - F.col("west")) / F.col("dx")), F.col("cols") - 1)
    met = met.withColumn("_row", row).withColumn("_col", col)
    block = lambda c, n: F.floor(F.col(c) / F.col(n)).cast("int")
    inside = (F.col("_row") % F.col("block_rows")) * F.col("block_cols") + F.col("_col") % F.col("block_cols")
    met = met.select(*key, "tile", "rank", block("_row", "block_rows").alias("block_row"), block("_col", "block_cols").alias("block_col"), inside.cast("int").alias("_i"))
    cells = met.join(raster.blocks(spark, path, (west, south, east, north)), ["tile", "block_row", "block_col"]).select(*key, "rank", F.get("heights", F.col("_i")).cast("double").alias("height"))
    first = cells.filter("not isnan(height)").groupBy(*key).agg(F.min_by("height", "rank").alias("height"))
    return points.join(first, key, "left")


def deltas(rows: DataFrame, key: str, pos: str, value: str, anchor: str) -> DataFrame:
    """Adds ``delta``: what each value adds to the one before; the first of a key adds to ``anchor``."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(pos)), F.col(anchor))
    return rows.withColumn("delta", F.col(value) - before)


def undo_deltas(rows: DataFrame, key: str, pos: str, delta: str, anchor: str) -> DataFrame:
    """Adds ``value``: the anchor and all deltas up to each row."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.col(anchor) + F.sum(delta).over(w))
