"""Queries on positions: p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.functions.geo import position
from wetlens.operators.near import containing, near_pairs
from wetlens.plans import oracle
from wetlens.session import load

NEAR = 30.0


def placed(manifest: DataFrame) -> DataFrame:
    """id, x, y of the manifest rows that have a position."""
    return manifest.select(F.col("row_idx").alias("id"), position(F.col("x"), F.col("y")).alias("p")).filter("p is not null").select("id", F.col("p.e").alias("x"), F.col("p.n").alias("y"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of manifest rows at most 30 m apart."""
    return near_pairs(placed(load(spark, sf_dir, "manifest")), NEAR).select(F.col("id_a").alias("row_a"), F.col("id_b").alias("row_b"))


def p4_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster tile (epsg 3067) that contains each manifest row with a position."""
    r = load(spark, sf_dir, "raster").filter("epsg = 3067")
    boxes = r.select(F.col("path").alias("region"), F.col("x0"), (F.col("y0") - F.col("height") * F.col("res")).alias("y0"), (F.col("x0") + F.col("width") * F.col("res")).alias("x1"), F.col("y0").alias("y1"))
    return containing(placed(load(spark, sf_dir, "manifest")), boxes).select(F.col("id").alias("row_idx"), F.col("region").alias("tile"))


QUERIES = {"p4_found": p4_found, "p4_tile": p4_tile}
SQL = {
    "p4_found": f"WITH {oracle.POSITION}, {oracle.near_sql(NEAR)} SELECT row_a, row_b FROM near",
    "p4_tile": f"""WITH {oracle.POSITION} SELECT pos.row_idx, min(r.path) AS tile FROM pos LEFT JOIN raster r
      ON r.epsg = 3067 AND e >= r.x0 AND e < r.x0 + r.width * r.res AND n >= r.y0 - r.height * r.res AND n < r.y0 GROUP BY 1""",
}
