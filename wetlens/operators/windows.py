"""Sliding windows over rasters, restricted to the surroundings of watercourses.

A mask is a table of segments; "within the buffer" is a distance to a segment, so no
buffer polygons are built.  Boxes and segments meet by grid cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetlens.constants import EPSG, STREAM_BUFFER_M, STRIDE, TILE
from wetlens.session import written

CELL = 256.0
_EDGES = ("xmin", "ymin", "xmax", "ymax")


def usable(rasters: DataFrame) -> DataFrame:
    """One row per path of the rasters in the expected reference system."""
    return rasters.filter(F.col("epsg") == EPSG).dropDuplicates(["path"])


def windows(rasters: DataFrame, size: int = TILE, stride: int = STRIDE) -> DataFrame:
    """Every window: path, row_off, col_off, w, h (cut at the edge), res and its box in metres.

    A raster without rows or columns has none.  Rasters are few bytes but many windows,
    so they are dealt to all cores first, by a number that is not coalesced by size.
    """
    rasters = rasters.repartition(rasters.sparkSession.sparkContext.defaultParallelism, "path")
    offs = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1, F.lit(stride)))
    w = rasters.select("path", "x0", "y0", "res", "width", "height", F.explode(offs("height")).alias("row_off")).withColumn("col_off", F.explode(offs("width")))
    w = w.withColumn("w", F.least(F.lit(size), F.col("width") - F.col("col_off"))).withColumn("h", F.least(F.lit(size), F.col("height") - F.col("row_off")))
    xmin, ymax = F.col("x0") + F.col("col_off") * F.col("res"), F.col("y0") - F.col("row_off") * F.col("res")
    return w.select("path", "row_off", "col_off", "w", "h", "res", xmin.alias("xmin"), (ymax - F.col("h") * F.col("res")).alias("ymin"), (xmin + F.col("w") * F.col("res")).alias("xmax"), ymax.alias("ymax"))


def shrunk(boxes: DataFrame, by: float | None = None) -> DataFrame:
    """Boxes less ``by`` pixels (a quarter window) on each side; boxes that vanish are left out."""
    d = F.lit(TILE / 4 if by is None else by) * F.col("res")
    b = boxes.withColumns({"xmin": F.col("xmin") + d, "ymin": F.col("ymin") + d, "xmax": F.col("xmax") - d, "ymax": F.col("ymax") - d})
    return b.filter("xmax > xmin and ymax > ymin")


def distance2_sql(box: tuple[str, ...] = _EDGES, seg: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> str:
    """SQL of the squared distance between a closed box and a segment, 0 if they meet."""
    x0, y0, x1, y1 = box
    ax, ay, bx, by = seg

    def to_box(px, py):
        dx, dy = f"greatest(0.0, {x0} - {px}, {px} - {x1})", f"greatest(0.0, {y0} - {py}, {py} - {y1})"
        return f"({dx} * {dx} + {dy} * {dy})"

    def to_segment(px, py):
        ux, uy = f"({bx} - {ax})", f"({by} - {ay})"
        t = f"greatest(0.0, least(1.0, (({px} - {ax}) * {ux} + ({py} - {ay}) * {uy}) / greatest(1e-12, {ux} * {ux} + {uy} * {uy})))"
        dx, dy = f"({px} - {ax} - {t} * {ux})", f"({py} - {ay} - {t} * {uy})"
        return f"({dx} * {dx} + {dy} * {dy})"

    def side(px, py):
        return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"

    corners = [(x, y) for x in (x0, x1) for y in (y0, y1)]
    sides = [side(*c) for c in corners]
    apart = f"greatest({ax}, {bx}) < {x0} OR least({ax}, {bx}) > {x1} OR greatest({ay}, {by}) < {y0} OR least({ay}, {by}) > {y1} OR least({', '.join(sides)}) > 0 OR greatest({', '.join(sides)}) < 0"
    least = ", ".join([to_box(ax, ay), to_box(bx, by), *(to_segment(*c) for c in corners)])
    return f"CASE WHEN {apart} THEN least({least}) ELSE 0.0 END"


def near_segments(boxes: DataFrame, segments: DataFrame, keys: list[str], buffer: float = STREAM_BUFFER_M) -> DataFrame:
    """The keys of the boxes within ``buffer`` of a segment, each once.

    Boxes and segments are dealt to the grid cells they touch (boxes with the buffer
    around them); an equi-join with the exact distance as residual decides.
    """
    cell = lambda c: F.floor(c / CELL).cast("long")
    span = lambda lo, hi: F.explode(F.sequence(cell(lo), cell(hi)))
    b = boxes.filter(" and ".join(f"{e} is not null" for e in _EDGES)).select(*keys, *_EDGES)
    b = b.withColumn("cx", span(F.col("xmin") - buffer, F.col("xmax") + buffer)).withColumn("cy", span(F.col("ymin") - buffer, F.col("ymax") + buffer))
    s = segments.select("x1", "y1", "x2", "y2").filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null").distinct()
    s = s.withColumn("cx", span(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("cy", span(F.least("y1", "y2"), F.greatest("y1", "y2")))
    # the boxes around both first: most pairs of a cell need no distance
    reach = (F.greatest("s.x1", "s.x2") >= F.col("b.xmin") - buffer) & (F.least("s.x1", "s.x2") <= F.col("b.xmax") + buffer) & (F.greatest("s.y1", "s.y2") >= F.col("b.ymin") - buffer) & (F.least("s.y1", "s.y2") <= F.col("b.ymax") + buffer)
    # then the distance of the box's centre, which settles all but a ring of half a diagonal around the buffer
    px, py = (F.col("b.xmin") + F.col("b.xmax")) / 2, (F.col("b.ymin") + F.col("b.ymax")) / 2
    ux, uy = F.col("s.x2") - F.col("s.x1"), F.col("s.y2") - F.col("s.y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("s.x1")) * ux + (py - F.col("s.y1")) * uy) / F.greatest(F.lit(1e-12), ux * ux + uy * uy)))
    dx, dy = px - F.col("s.x1") - t * ux, py - F.col("s.y1") - t * uy
    centre = F.sqrt(dx * dx + dy * dy)
    half = F.sqrt((F.col("b.xmax") - F.col("b.xmin")) ** 2 + (F.col("b.ymax") - F.col("b.ymin")) ** 2) / 2
    # the long exact expression stays out of the generated method, which the JVM would not compile with it
    exact = F.expr(f"exists(array(0.0d), z -> z + {distance2_sql(tuple(f'b.{e}' for e in _EDGES), ('s.x1', 's.y1', 's.x2', 's.y2'))} <= {buffer * buffer})")
    near = (centre <= buffer) | ((centre <= half + F.lit(buffer)) & exact)
    hit = (F.col("b.cx") == F.col("s.cx")) & (F.col("b.cy") == F.col("s.cy")) & reach & near
    return b.alias("b").join(s.alias("s"), hit, "left_semi").select(*keys).distinct()


def stream_segments(segments: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """The segments of the wanted layers; all of them if none of the layers is there."""
    wanted = segments.filter(F.col("layer").isin(*layers))
    return segments if wanted.isEmpty() else wanted


def masked_windows(rasters: DataFrame, segments: DataFrame | None, erode: bool = True, size: int = TILE, stride: int = STRIDE, buffer: float = STREAM_BUFFER_M) -> DataFrame:
    """The windows to scan.

    Without segments, and for a raster no segment comes near, all windows; else those
    whose box (less a quarter window on each side if ``erode``) is within the buffer.
    """
    w = windows(rasters, size, stride)
    if segments is None:
        return w
    edges = rasters.select("path", F.col("x0").alias("xmin"), (F.col("y0") - F.col("height") * F.col("res")).alias("ymin"), (F.col("x0") + F.col("width") * F.col("res")).alias("xmax"), F.col("y0").alias("ymax"))
    covered = written(near_segments(edges, segments, ["path"], buffer), "covered")
    keys = ["path", "row_off", "col_off"]
    passed = near_segments(shrunk(w) if erode else w, segments, keys, buffer)
    return w.join(passed.withColumn("_in", F.lit(True)), keys, "left").join(covered.withColumn("_mask", F.lit(True)), "path", "left").filter("_mask is null or _in").drop("_in", "_mask")
