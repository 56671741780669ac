"""Dense segmentation features from block partials: each pixel is read once.

A patch's context of 512 pixels is 16 x 16 blocks of 32, so sums over contexts are two
separable sums over block sums instead of one pass over the pixels per patch.
Blocks beyond the raster repeat its edge pixels, as the context of an edge patch does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetlens.constants import BLOCK, CONTEXT_OFFSET, NDVI_CUT, NDWI_CUT, PATCH, TILE
from wetlens.functions.spectral import BANDS, ndvi, ndwi
from wetlens.session import written


def block_sums(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, br, bc, n and, per band, sum and sum of squares of each 32-pixel block."""
    div = lambda v: F.floor(F.col(v) / BLOCK).cast("int")
    sums = [f(v).alias(f"{b}_{n}") for b in BANDS for n, f, v in (("s", F.sum, F.col(b).cast("double")), ("q", F.sum, F.col(b).cast("double") * F.col(b)))]
    return pixels.withColumn("br", div("y")).withColumn("bc", div("x")).groupBy(*keys, "br", "bc").agg(F.count("*").alias("n"), *sums)


def padded(pixels: DataFrame, rasters: DataFrame, key: str) -> DataFrame:
    """Pixels with the raster's edge repeated outwards as far as the contexts of its patches reach."""
    before, after = CONTEXT_OFFSET, TILE - CONTEXT_OFFSET - PATCH
    dims = rasters.select(key, F.col("height").alias("_h"), F.col("width").alias("_w"))
    out = pixels.join(dims, key)
    for v, n in (("y", "_h"), ("x", "_w")):
        end = F.ceil(F.col(n) / PATCH).cast("int") * PATCH + after
        lo, hi = F.col(v) == 0, F.col(v) == F.col(n) - 1
        first = F.when(lo, F.lit(-before)).otherwise(F.col(v))
        last = F.when(hi, end - 1).otherwise(F.col(v))
        out = out.withColumn(v, F.explode(F.sequence(first, last)))
    return out.drop("_h", "_w")


def spread(blocks: DataFrame, keys: list[str], values: list[str], width: int, lead: int) -> DataFrame:
    """keys, pr, pc and the values summed over the ``width`` x ``width`` blocks from ``lead`` before each patch.

    Each block adds to the patch rows it belongs to, then each such row sum to the patch
    columns, so gaps between blocks do no harm and a block is copied twice by a few, not
    once by many.  Patches that no block reaches have no row.
    """
    step, trail = PATCH // BLOCK, width - lead - 1
    patches = lambda c: F.explode(F.sequence(F.ceil((F.col(c) - trail) / step).cast("int"), F.floor((F.col(c) + lead) / step).cast("int")))
    total = [F.sum(c).alias(c) for c in values]
    rows = blocks.withColumn("pr", patches("br")).groupBy(*keys, "pr", "bc").agg(*total)
    return rows.withColumn("pc", patches("bc")).groupBy(*keys, "pr", "pc").agg(*total)


def context_sums(blocks: DataFrame, *keys: str) -> DataFrame:
    """Sums over the 16 x 16 blocks around each patch: keys, pr, pc and the columns of :func:`block_sums`.

    Patches without any pixel of their own have no row.
    """
    values = [c for c in blocks.columns if c not in (*keys, "br", "bc")]
    step = PATCH // BLOCK
    own = blocks.select(*keys, F.floor(F.col("br") / step).cast("int").alias("pr"), F.floor(F.col("bc") / step).cast("int").alias("pc")).distinct()
    return spread(blocks, list(keys), values, TILE // BLOCK, CONTEXT_OFFSET // BLOCK).join(own, [*keys, "pr", "pc"], "left_semi")


def _patch_features(moments: DataFrame, counts: DataFrame, width: int, lead: int) -> DataFrame:
    """path, pr, pc, v: the 18 features of each patch's surroundings from block moments and value counts."""
    values = [c for c in moments.columns if c not in ("path", "br", "bc")]
    sums = spread(moments, ["path"], values, width, lead)
    hist = spread(counts, ["path", "band", "value"], ["n"], width, lead)
    quart = [F.percentile(F.when(F.col("band") == i, F.col("value")), F.lit(q), F.col("n")).alias(f"{b}_{q}") for i, b in enumerate(BANDS) for q in (0.25, 0.75)]
    both = sums.join(hist.groupBy("path", "pr", "pc").agg(*quart), ["path", "pr", "pc"])
    out = []
    for c in (*BANDS, "ndvi", "ndwi"):
        mean = F.col(f"{c}_s") / F.col("n")
        out += [mean, F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}_q") / F.col("n") - mean * mean))]
        out += [F.col(f"`{c}_0.25`"), F.col(f"`{c}_0.75`")] if c in BANDS else [F.col(f"{c}_c") / F.col("n")]
    return both.select("path", "pr", "pc", F.array(*out).alias("v"))


def dense_features(rasters: DataFrame, pixels: DataFrame) -> DataFrame:
    """path, pr, pc, features of each 64-pixel patch: its own 18, then its 512-pixel context's.

    Pixels are reduced once to moments and value counts of 32-pixel blocks, which are
    all that is shuffled further; quartiles of merged counts are exact.
    """
    own = padded(pixels, rasters, "path")
    div = lambda v: F.floor(F.col(v) / BLOCK).cast("int")
    q = own.withColumns({"ndvi": ndvi(), "ndwi": ndwi(), "br": div("y"), "bc": div("x")})
    each = []
    for c in (*BANDS, "ndvi", "ndwi"):
        v = F.col(c).cast("double")
        each += [F.sum(v).alias(f"{c}_s"), F.sum(v * v).alias(f"{c}_q")]
    each += [F.sum((F.col(c) > cut).cast("double")).alias(f"{c}_c") for c, cut in (("ndvi", NDVI_CUT), ("ndwi", NDWI_CUT))]
    moments = written(q.groupBy("path", "br", "bc").agg(F.count("*").alias("n"), *each), "moments")
    value = F.posexplode(F.array(*BANDS)).alias("band", "value")
    counts = written(q.select("path", "br", "bc", value).groupBy("path", "br", "bc", "band", "value").agg(F.count("*").alias("n")), "counts")
    mine = _patch_features(moments, counts, PATCH // BLOCK, 0).withColumnRenamed("v", "a")
    full = _patch_features(moments, counts, TILE // BLOCK, CONTEXT_OFFSET // BLOCK).withColumnRenamed("v", "b")
    dims = rasters.select("path", F.ceil(F.col("height") / PATCH).alias("_r"), F.ceil(F.col("width") / PATCH).alias("_c"))
    inside = mine.join(full, ["path", "pr", "pc"]).join(dims, "path").filter("pr >= 0 and pc >= 0 and pr < _r and pc < _c")
    return inside.select("path", "pr", "pc", F.concat("a", "b").alias("features"))


def context_stats(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, pr, pc and per band mean and population deviation of the context."""
    out = []
    for b in BANDS:
        mean = F.col(f"{b}_s") / F.col("n")
        out += [mean.alias(f"{b}_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col(f"{b}_q") / F.col("n") - mean * mean)).alias(f"{b}_std")]
    return sums.select(*keys, "pr", "pc", "n", *out)
