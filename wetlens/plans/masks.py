"""Queries on windows, watercourse masks and points in rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.constants import PATCH, STREAM_LAYERS, TILE
from wetlens.functions.geo import position
from wetlens.operators import windows as O
from wetlens.operators.chips import centred, covering
from wetlens.operators.negatives import extents, sample
from wetlens.plans import oracle
from wetlens.session import load

_KEYS = ["path", "row_off", "col_off"]


def _rasters(spark, d):
    return O.usable(load(spark, d, "raster"))


def _segments(spark, d):
    return O.stream_segments(load(spark, d, "mask_segment"), STREAM_LAYERS)


def win_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detection windows with their boxes."""
    return O.windows(_rasters(spark, sf_dir)).drop("res")


def win_erode_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose box, a quarter window smaller on each side, is within 50 m of a watercourse."""
    return O.near_segments(O.shrunk(O.windows(_rasters(spark, sf_dir))), _segments(spark, sf_dir), _KEYS)


def jn_mask_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that do not overlap, within 50 m of a watercourse."""
    return O.near_segments(O.windows(_rasters(spark, sf_dir), TILE, TILE), _segments(spark, sf_dir), _KEYS)


def jn_patch_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches within 50 m of a watercourse."""
    return O.near_segments(O.windows(_rasters(spark, sf_dir), PATCH, PATCH), _segments(spark, sf_dir), _KEYS)


def jn_mask_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows to scan, with the mask of flood areas only: rasters without one are scanned whole."""
    s = load(spark, sf_dir, "mask_segment").filter("layer = 'tulvaalue'")
    return O.masked_windows(_rasters(spark, sf_dir), s).select(*_KEYS)


def jn_points_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips: each placed manifest row with every raster its chip overlaps, and the chip's offsets."""
    m = load(spark, sf_dir, "manifest").select(F.col("row_idx").alias("id"), position(F.col("x"), F.col("y")).alias("p")).filter("p is not null")
    return centred(m.select("id", F.col("p.e").alias("x"), F.col("p.n").alias("y")), _rasters(spark, sf_dir)).select(F.col("id").alias("row_idx"), "path", "col_off", "row_off")


def jn_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first raster, by path, that covers each placed label of the manifest, edges included."""
    m = load(spark, sf_dir, "manifest").select(F.col("row_idx").alias("id"), position(F.col("x"), F.col("y")).alias("p")).filter("p is not null")
    return covering(m.select("id", F.col("p.e").alias("x"), F.col("p.n").alias("y")), extents(_rasters(spark, sf_dir))).select(F.col("id").alias("row_idx"), F.col("region").alias("path"))


def fn_pixel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel of plainly written positions in the raster at the origin of the tables."""
    first = F.lit(0.5)
    m = load(spark, sf_dir, "manifest").filter("x > 100000 and x < 800000 and y > 6600000 and y < 7800000")
    return m.select("row_idx", ((F.col("x") - 111000.0) / first).cast("int").alias("col"), ((F.lit(6615000.0) - F.col("y")) / first).cast("int").alias("row"))


def agg_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the watercourses with their buffer."""
    b = 50.0
    return _segments(spark, sf_dir).agg(*((f(F.least(*p) if f is F.min else F.greatest(*p)) + d).alias(n) for n, f, p, d in (("minx", F.min, ("x1", "x2"), -b), ("miny", F.min, ("y1", "y2"), -b), ("maxx", F.max, ("x1", "x2"), b), ("maxy", F.max, ("y1", "y2"), b))))


def smp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty negatives in a raster and near a watercourse (the number is the operator's argument)."""
    return sample(_rasters(spark, sf_dir), _segments(spark, sf_dir), 20).select("seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_R = "r AS (SELECT DISTINCT path, x0, y0, res, width, height FROM raster WHERE epsg = 3067)"
_S = "s AS (SELECT DISTINCT x1, y1, x2, y2 FROM mask_segment WHERE layer IN ('virtavesialue', 'tulvaalue', 'virtavesikapea'))"


def _w(size: int, stride: int) -> str:
    return f"""o AS (SELECT *, cast(unnest(range(0, height, {stride})) AS INTEGER) AS row_off FROM r), q AS (SELECT *, cast(unnest(range(0, width, {stride})) AS INTEGER) AS col_off FROM o),
      w AS (SELECT path, row_off, col_off, cast(least({size}, width - col_off) AS INTEGER) AS w, cast(least({size}, height - row_off) AS INTEGER) AS h, res,
        x0 + col_off * res AS xmin, y0 - (row_off + least({size}, height - row_off)) * res AS ymin, x0 + (col_off + least({size}, width - col_off)) * res AS xmax, y0 - row_off * res AS ymax FROM q)"""


def _semi(of: str, where: str = "", seg: str = "s") -> str:
    d = oracle.box_segment_sql()
    near = "greatest(s.x1, s.x2) >= w.xmin - 50 AND least(s.x1, s.x2) <= w.xmax + 50 AND greatest(s.y1, s.y2) >= w.ymin - 50 AND least(s.y1, s.y2) <= w.ymax + 50"
    return f"SELECT DISTINCT w.path, w.row_off, w.col_off FROM {of} w JOIN {seg} s ON {near} WHERE {d} <= 2500 {where}"


_E = "e AS (SELECT * REPLACE (xmin + 128 * res AS xmin, ymin + 128 * res AS ymin, xmax - 128 * res AS xmax, ymax - 128 * res AS ymax) FROM w), e2 AS (SELECT * FROM e WHERE xmax > xmin AND ymax > ymin)"
QUERIES = {f.__name__: f for f in (win_generate, win_erode_mask, jn_mask_semi, jn_patch_semi, jn_mask_fallback, jn_points_rasters, jn_covering, fn_pixel_index, agg_bounds, smp_negatives)}
SQL = {
    "win_generate": f"WITH {_R}, {_w(512, 256)} SELECT path, row_off, col_off, w, h, xmin, ymin, xmax, ymax FROM w",
    "win_erode_mask": f"WITH {_R}, {_S}, {_w(512, 256)}, {_E} {_semi('e2')}",
    "jn_mask_semi": f"WITH {_R}, {_S}, {_w(512, 512)} {_semi('w')}",
    "jn_patch_semi": f"WITH {_R}, {_S}, {_w(64, 64)} {_semi('w')}",
    "jn_mask_fallback": f"""WITH {_R}, s AS (SELECT DISTINCT x1, y1, x2, y2 FROM mask_segment WHERE layer = 'tulvaalue'), {_w(512, 256)}, {_E},
      whole AS (SELECT path, 0 AS row_off, 0 AS col_off, x0 AS xmin, y0 - height * res AS ymin, x0 + width * res AS xmax, y0 AS ymax FROM r), hit AS ({_semi('whole')}), good AS ({_semi('e2')})
      SELECT path, row_off, col_off FROM w WHERE path NOT IN (SELECT path FROM hit) UNION ALL SELECT g.path, g.row_off, g.col_off FROM good g JOIN hit USING (path)""",
    "jn_points_rasters": f"""WITH {oracle.POSITION}, {_R}, j AS (SELECT row_idx, path, cast(trunc((e - x0) / res) AS INTEGER) - 256 AS col_off, cast(trunc((y0 - n) / res) AS INTEGER) - 256 AS row_off, width, height
        FROM pos JOIN r ON e > x0 - 300 * res AND e < x0 + (width + 300) * res AND n < y0 + 300 * res AND n > y0 - (height + 300) * res)
      SELECT row_idx, path, col_off, row_off FROM j WHERE col_off + 512 > 0 AND row_off + 512 > 0 AND col_off < width AND row_off < height""",
    "jn_covering": f"WITH {oracle.POSITION}, {_R} SELECT row_idx, min(path) AS path FROM pos JOIN r ON e BETWEEN x0 AND x0 + width * res AND n BETWEEN y0 - height * res AND y0 GROUP BY 1",
    "fn_pixel_index": "SELECT row_idx, cast(trunc((x - 111000) / cast(0.5 AS double)) AS INTEGER) AS col, cast(trunc((6615000 - y) / cast(0.5 AS double)) AS INTEGER) AS row FROM manifest WHERE x > 100000 AND x < 800000 AND y > 6600000 AND y < 7800000",
    "agg_bounds": f"WITH {_S} SELECT min(least(x1, x2)) - 50 AS minx, min(least(y1, y2)) - 50 AS miny, max(greatest(x1, x2)) + 50 AS maxx, max(greatest(y1, y2)) + 50 AS maxy FROM s",
    "smp_negatives": f"""WITH {_R}, {_S}, b AS (SELECT greatest(min(x0), (SELECT min(least(x1, x2)) - 50 FROM s)) AS bx0, greatest(min(y0 - height * res), (SELECT min(least(y1, y2)) - 50 FROM s)) AS by0,
        least(max(x0 + width * res), (SELECT max(greatest(x1, x2)) + 50 FROM s)) AS bx1, least(max(y0), (SELECT max(greatest(y1, y2)) + 50 FROM s)) AS by1 FROM r),
      d AS (SELECT i AS attempt, cast(('0x' || substr(md5('42|' || i || '|x'), 1, 8)) AS BIGINT) AS dx, cast(('0x' || substr(md5('42|' || i || '|y'), 1, 8)) AS BIGINT) AS dy FROM range(10000) t(i)),
      p AS (SELECT attempt, bx0 + dx / cast(4294967296 AS double) * (bx1 - bx0) AS x, by0 + dy / cast(4294967296 AS double) * (by1 - by0) AS y FROM d, b),
      i AS (SELECT attempt, x, y, x AS xmin, y AS ymin, x AS xmax, y AS ymax FROM p WHERE EXISTS (SELECT 1 FROM r WHERE x >= x0 AND x < x0 + width * res AND y >= y0 - height * res AND y < y0)),
      k AS (SELECT DISTINCT w.attempt, w.x, w.y FROM i w JOIN s ON greatest(s.x1, s.x2) >= w.x - 50 AND least(s.x1, s.x2) <= w.x + 50 AND greatest(s.y1, s.y2) >= w.y - 50 AND least(s.y1, s.y2) <= w.y + 50
        WHERE {oracle.box_segment_sql()} <= 2500)
      SELECT cast(row_number() OVER (ORDER BY attempt) - 1 AS INTEGER) AS seq, round(x, 4) AS x, round(y, 4) AS y FROM k ORDER BY attempt LIMIT 20""",
}
