"""Map matching: lines claim network edges, and samples beside cycleways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.operators.spatial import grid_join


def parallel_share(samples: DataFrame, cycleways: DataFrame, folded: bool = False) -> DataFrame:
    """(edge, share, beside): the share of each edge's samples (edge, k, lon, lat, heading) that run beside a cycleway segment
    (lon1, lat1, lon2, lat2, bearing), and whether it is enough. ``folded`` also takes segments drawn the other way."""
    middle = cycleways.withColumns({"to_lon": (F.col("lon1") + F.col("lon2")) / 2, "to_lat": (F.col("lat1") + F.col("lat2")) / 2, "_half": geo.distance_m("lon1", "lat1", "lon2", "lat2") / 2})
    # a segment reaches half its length from its middle; long ones are cut so that the reach has a bound
    pieces = F.greatest(F.ceil(F.col("_half") / 50.0).cast("int"), F.lit(1))
    t = lambda c, i: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * i / F.col("_n")
    cut = middle.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cut = cut.select("bearing", *(t(c, F.col("_i")).alias(f"{c}1") for c in ("lon", "lat")), *(t(c, F.col("_i") + 1).alias(f"{c}2") for c in ("lon", "lat")))
    cut = cut.withColumns({"to_lon": (F.col("lon1") + F.col("lon2")) / 2, "to_lat": (F.col("lat1") + F.col("lat2")) / 2})
    near = grid_join(samples, cut, C.PARALLEL_M + 51.0, 0.002)
    hit = near.filter((geo.segment_distance_m("lon", "lat", "lon1", "lat1", "lon2", "lat2") <= C.PARALLEL_M) & geo.same_heading("heading", "bearing", folded=folded))
    flags = samples.select("edge", "k").join(hit.select("edge", "k").distinct().withColumn("hit", F.lit(1)), ["edge", "k"], "left")
    share = flags.groupBy("edge").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("share"))
    return share.withColumn("beside", F.col("share") >= C.PARALLEL_SHARE)


def parallel_samples(points: DataFrame, key: str, pos: str, metres: float = C.PARALLEL_STEP) -> DataFrame:
    """(key, k, lon, lat, heading): the middles of every so many segments of each line (key, pos from 0, lon, lat, length), about one in ``metres``."""
    w = Window.partitionBy(key).orderBy(pos)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    step = F.greatest(F.lit(1), F.floor(n / F.greatest(F.lit(1.0), F.bround(F.col("length") / metres)))).cast("long")
    seg = points.withColumns({"_lon2": F.lead("lon").over(w), "_lat2": F.lead("lat").over(w), "_step": step}).filter(F.col("_lon2").isNotNull() & (F.col(pos) % F.col("_step") == 0))
    return seg.select(key, F.col(pos).alias("k"), ((F.col("lon") + F.col("_lon2")) / 2).alias("lon"), ((F.col("lat") + F.col("_lat2")) / 2).alias("lat"), geo.bearing("lon", "lat", "_lon2", "_lat2").alias("heading"))


def winter_claims(samples: DataFrame, vertices: DataFrame, lengths: DataFrame, share: float = C.WINTER_SHARE_MIN) -> DataFrame:
    """(edge, tier, metres): edges that samples (sample, lon, lat, heading, tier) claim.

    Each sample goes to its nearest segment start (edge, to_lon, to_lat, bearing: line heading) nearer than 14 m and within 35 degrees; it
    stands for 10 m. An edge is claimed from ``share`` of its length on, with the highest tier.
    """
    near = grid_join(samples, vertices, C.WINTER_M, 0.001).filter((F.col("metres") < C.WINTER_M) & (geo.line_angle("heading", "bearing") <= C.WINTER_DEGREES))
    own = near.groupBy("sample", "tier").agg(F.min(F.struct("metres", "edge")).alias("b")).select("sample", "tier", F.col("b.edge").alias("edge"))
    claimed = own.groupBy("edge").agg((F.count(F.lit(1)) * C.WINTER_STEP).alias("metres"), F.max("tier").alias("tier"))
    return claimed.join(lengths, "edge").filter(F.col("metres") >= share * F.col("length")).select("edge", "tier", "metres")
