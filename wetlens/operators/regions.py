"""Detected regions: connected grid cells, their areas, confidences and outlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.constants import MIN_AREA_M2, PATCH, STRIDE, THRESHOLD
from wetlens.operators import dualtree

_LABELS = T.StructType([T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), T.StructField("comp", T.LongType())])


def grid_labels(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the first cell (by row, then column) of each cell's edge-connected component."""
    order = np.lexsort((c, r))
    place = np.empty(len(r), np.int64)
    place[order] = np.arange(len(r))
    key = r[order] * (2**31) + c[order]

    def links():
        for step in (1, 2**31):
            at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
            hit = np.flatnonzero(key[at] == key + step)
            yield hit, at[hit]

    return order[dualtree.components(len(r), links())[place]] if len(r) else np.zeros(0, np.int64)


def components(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, r, c, comp: edge-connected components of the cells of each raster.

    ``comp`` is row * 2**31 + column of the component's first cell.  Repeated cells count
    once.  Components never cross rasters, so a task holds the cells of one raster, whose
    number the raster's size bounds.
    """
    schema = T.StructType([*(cells.schema[k] for k in keys), *_LABELS.fields])

    def label(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        first = grid_labels(r, c)
        return pa.table({**{k: table.column(k) for k in keys}, "r": r, "c": c, "comp": r[first] * 2**31 + c[first]})

    dealt = cells.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).filter("r is not null and c is not null").distinct()
    return dealt.groupBy(*keys).applyInArrow(label, schema)


def exact_mean(v) -> Column:
    """The mean of values of up to 12 decimals, the same whatever the order they are added in."""
    return F.sum(v.cast("decimal(28,12)")).cast("double") / F.count(v)


def dense_cells(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Patches whose probability, as float32, reaches the threshold; NULL and NaN are 0."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    p = F.coalesce(F.nanvl(F.col("p").cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float"))
    return scores.filter(p >= F.lit(threshold).cast("float"))


def score_regions(scores: DataFrame, keys: list[str], cell_m2: float, threshold: float = THRESHOLD, min_area: float = MIN_AREA_M2, touching: bool = False) -> DataFrame:
    """Regions of a probability map: keys, comp, n_cells, area_m2, confidence.

    Confidence is the mean over the region's own cells; with ``touching`` also over the
    cells around it that were not detected, which count as they are, absent ones as 0 times.
    """
    comps = components(dense_cells(scores, threshold), *keys)
    areas = comps.groupBy(*keys, "comp").agg(F.count("*").alias("n_cells"))
    at = comps
    if touching:
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        at = comps.withColumn("d", F.explode(around)).select(*keys, "comp", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).distinct()
    p = F.coalesce(F.nanvl(F.col("p"), F.lit(0.0)), F.lit(0.0))
    conf = at.join(scores.select(*keys, "r", "c", p.alias("p")), [*keys, "r", "c"]).groupBy(*keys, "comp").agg(exact_mean(F.col("p")).alias("confidence"))
    out = areas.join(conf, [*keys, "comp"], "left").withColumn("area_m2", F.col("n_cells") * F.lit(float(cell_m2)))
    return out.filter(F.col("area_m2") >= min_area).select(*keys, "comp", "n_cells", "area_m2", F.coalesce("confidence", F.lit(float(threshold))).alias("confidence"))


def candidates(boxes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidate windows that count: a confidence, not NaN, of at least the threshold."""
    return boxes.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.col("confidence") >= threshold))


def window_cells(boxes: DataFrame, rasters: DataFrame) -> DataFrame:
    """boxes with r and c, one row per grid cell of half a window that a box covers."""
    g = boxes.drop("x0", "y0", "res").join(rasters.select("path", "x0", "y0", "res"), "path")
    step = F.col("res") * STRIDE
    first = lambda v: F.floor(v / step + 1e-9).cast("long")
    last = lambda v: F.ceil(v / step - 1e-9).cast("long") - 1
    return g.withColumn("r", F.explode(F.sequence(first(F.col("y0") - F.col("ymax")), last(F.col("y0") - F.col("ymin"))))).withColumn("c", F.explode(F.sequence(first(F.col("xmin") - F.col("x0")), last(F.col("xmax") - F.col("x0"))))).drop("x0", "y0", "res")


def merge_windows(boxes: DataFrame, rasters: DataFrame, keys: list[str], min_area: float = MIN_AREA_M2) -> DataFrame:
    """Regions of overlapping candidate windows: keys, comp, area_m2, confidence, n_candidates.

    ``boxes``: keys (with path), cand_id, confidence, xmin, ymin, xmax, ymax, on a grid of
    half windows from the raster's corner.  The union of windows is a set of grid cells;
    cells cut by the raster's edge count by what is inside.  Confidence is the mean over
    all candidates that touch the region, corners included.
    """
    g = window_cells(boxes, rasters)
    comps = components(g.select(*keys, "r", "c"), *keys)
    size = lambda n, at: F.greatest(F.lit(0), F.least(F.lit(STRIDE), F.col(n) - F.col(at) * STRIDE)) * F.col("res")
    area = comps.join(rasters.select("path", "res", "width", "height"), "path").groupBy(*keys, "comp").agg(F.sum(size("height", "r") * size("width", "c")).alias("area_m2"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    reach = comps.withColumn("d", F.explode(around)).select(*keys, "comp", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"))
    touching = g.select(*keys, "cand_id", "confidence", "r", "c").join(reach, [*keys, "r", "c"]).select(*keys, "comp", "cand_id", "confidence").distinct()
    conf = touching.groupBy(*keys, "comp").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n_candidates"))
    return area.filter(F.col("area_m2") >= min_area).join(conf, [*keys, "comp"], "left").select(*keys, "comp", "area_m2", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def ring_area(ring: Column) -> Column:
    """The area inside a closed ring, array<struct<x, y>>; NULL for NULL."""
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)) / 2


def outlines(r: np.ndarray, c: np.ndarray) -> list[list[tuple[int, int]]]:
    """The outer ring of each part of a set of unit cells, as closed (column, row) corners, holes left out.

    Cells that touch at a corner only are different parts.
    """
    cells = set(zip(r.tolist(), c.tolist()))
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in cells:
        for a, b, beside in (((x, y), (x + 1, y), (y - 1, x)), ((x + 1, y), (x + 1, y + 1), (y, x + 1)), ((x + 1, y + 1), (x, y + 1), (y + 1, x)), ((x, y + 1), (x, y), (y, x - 1))):
            if beside not in cells:
                after.setdefault(a, []).append(b)
    out = []
    while after:
        start = min(after)
        ring, at, came = [start], start, (1, 0)
        while True:
            options = after[at]
            # at a corner shared by two cells turn right, so rings stay simple
            pick = max(options, key=lambda b: came[0] * (b[1] - at[1]) - came[1] * (b[0] - at[0]))
            options.remove(pick)
            if not options:
                del after[at]
            came, at = (pick[0] - at[0], pick[1] - at[1]), pick
            ring.append(at)
            if at == start:
                break
        # holes run the other way round
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) > 0:
            keep = [p for i, p in enumerate(ring[:-1]) if i == 0 or (ring[i][0] - ring[i - 1][0]) * (ring[i + 1][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[i + 1][0] - ring[i][0])]
            out.append([*keep, keep[0]])
    return out


def rings(comps: DataFrame, keys: list[str], cell: int = PATCH) -> DataFrame:
    """keys (with path, x0, y0, res), comp, part, ring: array<struct<x, y>> of the outer ring of each part of a region, in metres."""
    point = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    schema = T.StructType([*(comps.schema[k] for k in keys), T.StructField("comp", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("ring", point)])

    def trace(table: pa.Table) -> pa.Table:
        x0, y0, res = (table.column(n)[0].as_py() for n in ("x0", "y0", "res"))
        found = [[{"x": x0 + x * cell * res, "y": y0 - y * cell * res} for x, y in ring] for ring in outlines(table.column("r").to_numpy(), table.column("c").to_numpy())]
        arrow = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        same = lambda n: pa.array([table.column(n)[0].as_py()] * len(found), table.schema.field(n).type)
        return pa.table({**{k: same(k) for k in keys}, "comp": same("comp"), "part": pa.array(range(len(found)), pa.int32()), "ring": pa.array(found, arrow)})

    return comps.groupBy(*keys, "comp").applyInArrow(trace, schema)
