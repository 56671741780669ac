"""Chips around labelled points: offsets, pixels, names."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetlens.constants import CHIP_TAGS, TILE

#: Side of the grid cells where points and rasters meet.
CELL = 2048.0


def _dealt(boxes: DataFrame, margin: float) -> DataFrame:
    cell = lambda c: F.floor(c / CELL).cast("long")
    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo) - margin), cell(F.col(hi) + margin)))
    return boxes.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def _placed(points: DataFrame) -> DataFrame:
    far = 2.0**40
    ok = functools.reduce(operator.and_, (F.col(c).between(-far, far) for c in "xy"))
    return points.select("id", "x", "y").filter(ok).withColumn("cx", F.floor(F.col("x") / CELL).cast("long")).withColumn("cy", F.floor(F.col("y") / CELL).cast("long"))


def covering(points: DataFrame, regions: DataFrame) -> DataFrame:
    """id, region: the first region, by name, whose closed box holds the point; other points are left out."""
    boxes = regions.select("region", "x0", F.col("y0"), "x1", "y1").distinct()
    p = _placed(points).join(_dealt(boxes, 0.0), ["cx", "cy"]).filter("x between x0 and x1 and y between y0 and y1")
    return p.groupBy("id").agg(F.min("region").alias("region"))


def centred(points: DataFrame, rasters: DataFrame, size: int = TILE) -> DataFrame:
    """id, path, col_off, row_off: the chips of the points in every raster they overlap.

    The pixel of a point is cut towards zero; a chip may reach over the raster's edge, and
    the point itself may lie outside by less than half a chip.
    """
    half = size // 2
    r = rasters.select("path", "res", "width", "height", F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("x0"), (F.col("y0") - F.col("height") * F.col("res")).alias("y0"), (F.col("x0") + F.col("width") * F.col("res")).alias("x1"), F.col("y0").alias("y1"))
    widest = r.agg(F.max("res")).first()[0] or 1.0
    j = _placed(points).join(_dealt(r, (half + 1) * widest), ["cx", "cy"])
    at = lambda d: (d / F.col("res")).cast("int") - half
    j = j.select("id", "path", "width", "height", at(F.col("x") - F.col("left")).alias("col_off"), at(F.col("top") - F.col("y")).alias("row_off"))
    return j.filter((F.col("col_off") + size > 0) & (F.col("row_off") + size > 0) & (F.col("col_off") < F.col("width")) & (F.col("row_off") < F.col("height"))).select("id", "path", "col_off", "row_off")


def clamped(points: DataFrame, rasters: DataFrame, size: int = TILE) -> DataFrame:
    """As :func:`centred`, but with the window moved inside the raster instead of padded."""
    inside = lambda off, n: F.greatest(F.lit(0), F.least(F.col(off), F.col(n) - size))
    c = centred(points, rasters, size).join(rasters.select("path", "width", "height"), "path")
    return c.select("id", "path", inside("col_off", "width").alias("col_off"), inside("row_off", "height").alias("row_off"))


def chip_pixels(chips: DataFrame, pixels: DataFrame, size: int = TILE) -> DataFrame:
    """id, path, y, x, nir, red, grn of each chip's pixels that lie in the raster.

    Pixels (path, y, x, bands) meet chips by cells of one chip's side; pixels beyond the
    raster are absent and stand for 0.
    """
    div = lambda c: F.floor(c / size).cast("long")
    span = lambda off: F.explode(F.array(div(F.col(off)), div(F.col(off) + (size - 1))))
    c = chips.withColumn("by", span("row_off")).withColumn("bx", span("col_off")).distinct()
    p = pixels.withColumn("by", div(F.col("y"))).withColumn("bx", div(F.col("x")))
    j = c.join(p, ["path", "by", "bx"])
    y, x = F.col("y") - F.col("row_off"), F.col("x") - F.col("col_off")
    return j.select("id", "path", y.alias("y"), x.alias("x"), "nir", "red", "grn").filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))


def chip_name(path: Column, label: Column, index: Column) -> Column:
    """``{stem}_{tag}_{index}.npy`` with at least four digits."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    tag = F.lit("pos")
    for k, name in CHIP_TAGS.items():
        tag = F.when(label == k, name).otherwise(tag)
    return F.format_string("%s_%s_%04d.npy", stem, tag, index)
