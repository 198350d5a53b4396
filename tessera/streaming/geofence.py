"""Streams of points. All row-wise functions work on streams as they are; here is what keeps state.

This goes beyond row-wise kernels: counts by fence and window with late data
bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import native
from tessera.types import geo


def in_fences(points: DataFrame, fences: DataFrame, point: str, fence: str, size: float) -> DataFrame:
    """Each point of a stream with the fences it meets: a stream joined with a table, without state. size: width of a cell; boxes must not be wider than that."""
    p, f = geo(points, point), geo(fences, fence)
    at = points.withColumn("_cx", F.floor(p.column["x"] / size).cast("long")).withColumn("_cy", F.floor(p.column["y"] / size).cast("long"))
    b = native.bounding_rect(f).column
    cells = fences.withColumn("_b", b).withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_b.xmin") / size).cast("long"), F.floor(F.col("_b.xmax") / size).cast("long"))))
    cells = cells.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_b.ymin") / size).cast("long"), F.floor(F.col("_b.ymax") / size).cast("long")))).drop("_b")
    met = at.join(cells, ["_cx", "_cy"]).drop("_cx", "_cy")
    return met.filter(native.polygon_intersects_point(geo(met, fence, f.type), geo(met, point, p.type)))


def fence_counts(met: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Points by window of event time and by fence; rows later than late go."""
    return met.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


