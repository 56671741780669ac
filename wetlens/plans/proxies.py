"""Pixels, probability grids, points and epochs derived from the star-schema tables.

No imagery lies among the tables, so these fixed projections of them stand in for it.
Each comes as a DataFrame and as SQL with the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wetlens.session import load

_PX = """SELECT l_suppkey AS chip, l_partkey % 256 AS nir, l_orderkey % 251 AS red,
  (l_partkey * 7 + l_orderkey * 13) % 256 AS grn, l_linenumber <= 2 AS is_center FROM {lineitem}"""
_GRID = """SELECT o_orderkey {div} 4096 AS tile, (o_orderkey % 4096) {div} 64 AS r, o_orderkey % 64 AS c,
  ((o_custkey * 37 + o_orderkey * 11) % 1000) / cast(1000 AS double) AS p FROM {orders}"""
_PTS = """SELECT c_custkey, cast(20 AS double) + (c_custkey % 1100) * cast(0.01 AS double) AS lon,
  cast(60 AS double) + ((c_custkey * 7) % 900) * cast(0.01 AS double) AS lat FROM {customer}"""

PX_SQL, PTS_SQL = _PX.format(lineitem="lineitem"), _PTS.format(customer="customer")
GRID_SQL = _GRID.format(orders="orders", div="//")


def _run(spark: SparkSession, sf_dir: str, sql: str, table: str, **more) -> DataFrame:
    return spark.sql(sql.format(**{table: "{t}"}, **more), t=load(spark, sf_dir, table))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels: chip, nir, red, grn, is_center."""
    return _run(spark, sf_dir, _PX, "lineitem")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability map per tile: tile, r, c, p."""
    return _run(spark, sf_dir, _GRID, "orders", div="div")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: c_custkey, lon, lat."""
    return _run(spark, sf_dir, _PTS, "customer")
