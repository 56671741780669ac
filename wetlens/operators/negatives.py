"""Negative samples near watercourses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetlens.constants import NEGATIVE_ATTEMPTS, SEED, STREAM_BUFFER_M
from wetlens.operators.evaluation import uniform_points
from wetlens.operators.near import containing
from wetlens.operators.windows import near_segments


def extents(rasters: DataFrame) -> DataFrame:
    """region and box of each raster."""
    return rasters.select(F.col("path").alias("region"), "x0", (F.col("y0") - F.col("height") * F.col("res")).alias("y0"), (F.col("x0") + F.col("width") * F.col("res")).alias("x1"), F.col("y0").alias("y1"))


def sample(rasters: DataFrame, segments: DataFrame | None, n: int, seed: int = SEED, attempts: int = NEGATIVE_ATTEMPTS) -> DataFrame:
    """seq, x, y: the first ``n`` of ``n * attempts`` even draws that lie in a raster and near a segment.

    Draws come from the bounds of the segments with their buffer (of the rasters if
    there are no segments), cut to those of the rasters.  Fewer than ``n`` rows if too
    few draws hit; none for an empty table.
    """
    spark = rasters.sparkSession
    e = extents(rasters)
    lo = [F.min(c) for c in ("x0", "y0")] + [F.max(c) for c in ("x1", "y1")]
    bounds = list(e.agg(*lo).first())
    if segments is not None:
        s = segments.agg(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
        if s[0] is None:
            bounds[0] = None
        elif bounds[0] is not None:
            b = STREAM_BUFFER_M
            bounds = [max(bounds[0], s[0] - b), max(bounds[1], s[1] - b), min(bounds[2], s[2] + b), min(bounds[3], s[3] + b)]
    if n <= 0 or bounds[0] is None or bounds[0] >= bounds[2] or bounds[1] >= bounds[3]:
        return spark.createDataFrame([], "seq int, x double, y double")
    pts = uniform_points(spark, tuple(bounds), n * attempts, seed)
    inside = containing(pts.select(F.col("attempt").alias("id"), "x", "y"), e).filter("region is not null").select(F.col("id").alias("attempt"))
    kept = pts.join(inside, "attempt", "left_semi")
    if segments is not None:
        boxes = kept.select("attempt", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
        kept = kept.join(near_segments(boxes, segments, ["attempt"]), "attempt", "left_semi")
    from pyspark.sql import Window as W

    first = kept.orderBy("attempt").limit(n)
    return first.select((F.row_number().over(W.orderBy("attempt")) - 1).alias("seq"), "x", "y")
