"""Queries on pixels: indices, features, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.functions import spectral as S
from wetlens.operators.blocks import block_sums, context_stats, context_sums
from wetlens.plans.proxies import PX_SQL, px
from wetlens.session import load

_NDVI = "(cast(nir AS double) - cast(red AS double)) / (cast(nir AS double) + cast(red AS double) + cast(1e-6 AS double))"
_NDWI = "(cast(grn AS double) - cast(nir AS double)) / (cast(grn AS double) + cast(nir AS double) + cast(1e-6 AS double))"


def prj_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select("chip", "nir", "red", F.round(S.ndvi(), 6).alias("ndvi"))


def prj_ndwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select("chip", "nir", "grn", F.round(S.ndwi(), 6).alias("ndwi"))


def agg_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and quartiles of each band and chip."""
    out = [f.alias(f"{b}_{n}") for b in S.BANDS for n, f in (("mean", F.round(F.avg(b), 6)), ("std", F.round(F.stddev_pop(b), 6)), ("p25", F.round(F.percentile(F.col(b), F.lit(0.25)), 6)), ("p75", F.round(F.percentile(F.col(b), F.lit(0.75)), 6)))]
    return px(spark, sf_dir).groupBy("chip").agg(*out)


def agg_features36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of each chip, one row per entry."""
    f = S.features(px(spark, sf_dir), "chip")
    return f.select("chip", F.posexplode("features").alias("idx", "v")).select("chip", "idx", F.round("v", 6).alias("value"))


def mdl_chip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of one 512-pixel chip per returnflag of lineitem, its centre cut by position; one row per entry."""
    t = load(spark, sf_dir, "lineitem")
    p = t.select(F.col("l_returnflag").alias("chip"), F.pmod(F.col("l_orderkey") * 7, F.lit(512)).alias("y"), F.pmod(F.col("l_partkey") * 13 + F.col("l_orderkey"), F.lit(512)).alias("x"), *(e.alias(b) for b, e in (("nir", F.col("l_partkey") % 256), ("red", F.col("l_orderkey") % 251), ("grn", (F.col("l_partkey") * 7 + F.col("l_orderkey") * 13) % 256))))
    f = S.features(p.withColumn("is_center", S.center(F.col("y"), F.col("x"), F.lit(512), F.lit(512))), "chip")
    return f.select("chip", F.posexplode("features").alias("idx", "v")).select("chip", "idx", F.round("v", 6).alias("value"))


def agg_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.norm_stats(px(spark, sf_dir))
    return s.select(F.posexplode(F.arrays_zip("mean", "std")).alias("band", "v")).select("band", F.round("v.mean", 8).alias("mean"), F.round("v.std", 8).alias("std"))


def fn_band_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands in six slots, summed per chip and slot."""
    six = px(spark, sf_dir).select("chip", F.posexplode(S.six_bands()).alias("slot", "v"))
    return six.groupBy("chip", "slot").agg(F.sum("v").alias("total"))


def agg_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and mean value of each chip's bands, for the diagnosis of a point."""
    return px(spark, sf_dir).groupBy("chip").agg(*(f(b).alias(f"{b}_{n}") for b in S.BANDS for n, f in (("min", F.min), ("max", F.max))), *(F.round(F.avg(b), 6).alias(f"{b}_mean") for b in S.BANDS))


def blk_context_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context statistics of 64-pixel patches over one pixel plane per returnflag of lineitem."""
    t = load(spark, sf_dir, "lineitem")
    p = t.select(F.col("l_returnflag").alias("tile"), F.pmod(F.col("l_orderkey") * 7, F.lit(2048)).alias("y"), F.pmod(F.col("l_partkey") * 13 + F.col("l_orderkey"), F.lit(2048)).alias("x"), *(e.alias(b) for b, e in (("nir", F.col("l_partkey") % 256), ("red", F.col("l_orderkey") % 251), ("grn", (F.col("l_partkey") * 7 + F.col("l_orderkey") * 13) % 256))))
    s = context_stats(context_sums(block_sums(p, "tile"), "tile"), "tile")
    return s.select("tile", "pr", "pc", "n", *(F.round(c, 6).alias(c) for c in s.columns if c.endswith(("_mean", "_std"))))


_CHIP_SQL = """SELECT l_returnflag AS chip, l_partkey % 256 AS nir, l_orderkey % 251 AS red, (l_partkey * 7 + l_orderkey * 13) % 256 AS grn,
  (l_orderkey * 7) % 512 BETWEEN 224 AND 287 AND (l_partkey * 13 + l_orderkey) % 512 BETWEEN 224 AND 287 AS is_center FROM lineitem"""


def _features_sql(source: str = PX_SQL) -> str:
    parts = []
    i = 0
    for flt in ("FILTER (WHERE is_center)", ""):
        for b in S.BANDS:
            for e in (f"avg({b})", f"stddev_pop({b})", f"quantile_cont({b}, 0.25)", f"quantile_cont({b}, 0.75)"):
                parts.append(f"{e} {flt}")
        for e, cut in (("ndvi", 0.2), ("ndwi", 0.0)):
            for a in (f"avg({e})", f"stddev_pop({e})", f"avg(CASE WHEN {e} > {cut} THEN cast(1 AS double) ELSE cast(0 AS double) END)"):
                parts.append(f"{a} {flt}")
    rows = " UNION ALL ".join(f"SELECT chip, cast({i} AS INTEGER) AS idx, round(f{i}, 6) AS value FROM f" for i in range(len(parts)))
    cols = ", ".join(f"cast({p} AS double) AS f{i}" for i, p in enumerate(parts))
    return f"WITH px AS ({source}), i AS (SELECT *, {_NDVI} AS ndvi, {_NDWI} AS ndwi FROM px), f AS (SELECT chip, {cols} FROM i GROUP BY chip) {rows}"


_STATS = ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_pop({b}), 6) AS {b}_std, round(quantile_cont({b}, 0.25), 6) AS {b}_p25, round(quantile_cont({b}, 0.75), 6) AS {b}_p75" for b in S.BANDS)
_NORM = " UNION ALL ".join(
    f"SELECT cast({i} AS INTEGER) AS band, round(avg({b} / cast(255 AS double)), 8) AS mean, round(sqrt(greatest(avg(({b} / cast(255 AS double)) * ({b} / cast(255 AS double))) - avg({b} / cast(255 AS double)) * avg({b} / cast(255 AS double)), 0)), 8) AS std FROM px" for i, b in enumerate(S.BANDS)
)
_CTX = ", ".join(f"round(sum(b.{b}_s) / sum(b.n), 6) AS {b}_mean, round(sqrt(greatest(0, sum(b.{b}_q) / sum(b.n) - (sum(b.{b}_s) / sum(b.n)) * (sum(b.{b}_s) / sum(b.n)))), 6) AS {b}_std" for b in S.BANDS)

QUERIES = {f.__name__: f for f in (prj_ndvi, prj_ndwi, agg_band_stats, agg_features36, mdl_chip_features, agg_norm_stats, fn_band_adapter, agg_bands, blk_context_sums)}
SQL = {
    "prj_ndvi": f"WITH px AS ({PX_SQL}) SELECT chip, nir, red, round({_NDVI}, 6) AS ndvi FROM px",
    "prj_ndwi": f"WITH px AS ({PX_SQL}) SELECT chip, nir, grn, round({_NDWI}, 6) AS ndwi FROM px",
    "agg_band_stats": f"WITH px AS ({PX_SQL}) SELECT chip, {_STATS} FROM px GROUP BY chip",
    "agg_features36": _features_sql(),
    "mdl_chip_features": _features_sql(_CHIP_SQL),
    "agg_norm_stats": f"WITH px AS ({PX_SQL}) {_NORM}",
    "fn_band_adapter": f"WITH px AS ({PX_SQL}) " + " UNION ALL ".join(f"SELECT chip, cast({i} AS INTEGER) AS slot, cast(sum({b}) AS double) AS total FROM px GROUP BY chip" for i, b in enumerate(("0", "grn", "red", "nir", "0", "0"))),
    "agg_bands": f"WITH px AS ({PX_SQL}) SELECT chip, {', '.join(f'min({b}) AS {b}_min, max({b}) AS {b}_max, round(avg({b}), 6) AS {b}_mean' for b in S.BANDS)} FROM px GROUP BY chip",
    "blk_context_sums": f"""WITH p AS (SELECT l_returnflag AS tile, (l_orderkey * 7) % 2048 AS y, (l_partkey * 13 + l_orderkey) % 2048 AS x,
        l_partkey % 256 AS nir, l_orderkey % 251 AS red, (l_partkey * 7 + l_orderkey * 13) % 256 AS grn FROM lineitem),
      b AS (SELECT tile, y // 32 AS br, x // 32 AS bc, count(*) AS n, {', '.join(f'sum(cast({b} AS double)) AS {b}_s, sum(cast({b} AS double) * {b}) AS {b}_q' for b in S.BANDS)} FROM p GROUP BY 1, 2, 3),
      g AS (SELECT DISTINCT tile, br // 2 * 2 AS br, bc // 2 * 2 AS bc FROM b)
      SELECT g.tile, cast(g.br // 2 AS INTEGER) AS pr, cast(g.bc // 2 AS INTEGER) AS pc, cast(sum(b.n) AS BIGINT) AS n, {_CTX}
      FROM g JOIN b ON g.tile = b.tile AND b.br BETWEEN g.br - 7 AND g.br + 8 AND b.bc BETWEEN g.bc - 7 AND g.bc + 8 GROUP BY 1, 2, 3, g.br, g.bc""",
}
