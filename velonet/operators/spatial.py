"""Range and nearest-neighbour joins through a grid of cells.

A theta join on distance would compare everything with everything. Here each left row lists the
cells its radius reaches, the right side is keyed by its own cell, and an equi-join on the cell
leaves only neighbours to the exact test. Cells widen in longitude as the reach does, up to the whole circle at a pole, so
a row lists as few there as anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.sources.shared import cut_lineage


#: Right rows that ``nearest`` sends to every task.
FEW = 20_000


def reach_cells(lat: Column, radius_m: float, cell: float) -> tuple[Column, Column]:
    """Cells to look at on either side, in longitude and latitude."""
    # a little wider than the row's own latitude asks for: the other end may lie further north, and around a pole every cell is in reach
    high, whole = F.abs(lat), F.lit(360.0 / cell)
    least = F.least(*(F.abs(F.cos(F.radians(x))) for x in (high + cell, high - cell)))
    lon = F.when((F.abs(high - 90.0) <= cell) | (least == 0), whole).otherwise(F.least(radius_m * 1.01 / (cell * C.METRES_LON * least), whole))
    lon = F.ceil(lon).cast("int")
    return lon, F.ceil(F.lit(radius_m * 1.01 / (cell * C.METRES_LAT))).cast("int")


def stretch(band: Column, cell: float) -> Column:
    """How many cells of longitude are one in a band of latitude."""
    low, high = band * cell, (band + 1) * cell
    least = F.least(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high))))
    whole = F.lit(max(1, int(360.0 / cell))).cast("long")
    pole = ((low <= 90.0) & (high >= 90.0)) | ((low <= -90.0) & (high >= -90.0)) | (least * whole < 1)
    return F.when(pole, whole).otherwise(F.floor(1.0 / least))


def listed(left: DataFrame, radius_m: float, cell: float, at=("lon", "lat")) -> DataFrame:
    """Each row once for every cell (_cx, _cy) that it reaches."""
    lon_n, lat_n = reach_cells(F.col(at[1]), radius_m, cell)
    bands = left.withColumns({"_n": lon_n, "_x": geo.cell(at[0], cell), "_cy": F.explode(F.sequence(geo.cell(at[1], cell) - lat_n, geo.cell(at[1], cell) + lat_n))})
    bands = bands.withColumn("_w", stretch(F.col("_cy"), cell))
    return bands.withColumn("_cx", F.explode(F.sequence(F.floor((F.col("_x") - F.col("_n")) / F.col("_w")), F.floor((F.col("_x") + F.col("_n")) / F.col("_w"))))).drop("_n", "_x", "_w")


def grid_join(left: DataFrame, right: DataFrame, radius_m: float, cell: float, at=("lon", "lat"), to=("to_lon", "to_lat"), few: bool = False) -> DataFrame:
    """Pairs within ``radius_m``, with column ``metres``. ``at`` names the left coordinates, ``to`` the right ones.

    ``few`` right rows are sent to every task; left rows never are, as Spark takes them for as many as they were before they listed their cells.
    """
    keyed = listed(left, radius_m, cell, at)
    other = right.withColumn("_cy", geo.cell(to[1], cell)).withColumn("_cx", F.floor(geo.cell(to[0], cell) / stretch(F.col("_cy"), cell)))
    pairs = (keyed.join(F.broadcast(other), ["_cx", "_cy"]) if few else keyed.hint("merge").join(other, ["_cx", "_cy"])).drop("_cx", "_cy")
    return pairs.withColumn("metres", geo.distance_m(at[0], at[1], to[0], to[1])).filter(F.col("metres") <= radius_m)


def nearest_within(left: DataFrame, right: DataFrame, key: str, payload: list[str], radius_m: float, cell: float, at=("lon", "lat"), to=("to_lon", "to_lat"), few: bool = False) -> DataFrame:
    """(key, metres, payload...): the nearest right row of each left key; ties go to the least payload. Keys without one are absent."""
    best = grid_join(left, right, radius_m, cell, at, to, few).groupBy(key).agg(F.min(F.struct(F.col("metres"), *payload)).alias("_b"))
    return best.select(key, "_b.metres", *(F.col("_b")[p].alias(p) for p in payload))


def nearest(left: DataFrame, right: DataFrame, key: str, payload: list[str], cell: float = 0.01, start_m: float = 500.0, farthest_m: float = 5e7, at=("lon", "lat"), to=("to_lon", "to_lat")) -> DataFrame:
    """The exact nearest right row of every left key: the radius grows fourfold for keys that have none yet.

    Only keys and their coordinates are carried between rounds. The cell grows with the radius, so a round never
    lists more than a few dozen cells a key. Up to ``FEW`` right rows meet the keys where these are, as far rounds have hardly more cells than one.
    """
    if right.isEmpty():
        return nearest_within(left, right, key, payload, start_m, cell, at, to)
    right = cut_lineage(right.select(*payload, *to), "right")  # read in every round
    few, tasks = right.count() <= FEW, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest, radius, found = left.select(key, *at).distinct(), start_m, None
    while True:
        size = max(cell, radius / C.METRES_LAT)
        near = cut_lineage(nearest_within(rest.repartition(tasks, key), right, key, payload, radius, size, at, to, few), "near")
        found = near if found is None else found.unionByName(near)
        if radius >= farthest_m:
            return found
        rest = cut_lineage(rest.join(near.select(key), key, "left_anti"), "rest")
        if rest.isEmpty():
            return found
        radius *= 4
