"""Gating on streams: tumbling frames and shared (sliding) views with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, width: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Count and energy of each frame of ``width``; rows later than ``late`` do not change closed frames."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.col(value)).alias("energy")).select("window.start", "window.end", "n", "energy")


def shared_views(stream: DataFrame, time: str, width: str, slide: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Frames every ``slide`` that share the shots of ``width``."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width, slide))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("window.start", "window.end", "n", "mean")
