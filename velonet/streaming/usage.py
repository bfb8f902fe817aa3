"""Usage of edges as trips come in: a windowed count with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_stream(trips: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(begin, edge, trips) of trips (ts timestamp, edges array<long>); rows later than ``late`` are dropped, so state stays bounded."""
    rows = trips.withWatermark("ts", late).select("ts", F.explode("edges").alias("edge"))
    counts = rows.groupBy(F.window("ts", window).alias("w"), "edge").agg(F.count(F.lit(1)).alias("trips"))
    return counts.select(F.col("w.start").alias("begin"), "edge", "trips")


def start(trips: DataFrame, path: str, checkpoint: str, **options) -> "object":
    """Appends closed windows as Parquet; ``checkpoint`` must lie in a shared folder."""
    return usage_stream(trips, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
