"""Vegetation and water indices, and the feature vector of a chip, over long-form pixels.

Pixels are rows (chip, nir, red, grn, is_center).  All aggregates are built-in, so they
are combined before the shuffle and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetlens.constants import INDEX_EPSILON, NDVI_CUT, NDWI_CUT, PATCH

BANDS = ("nir", "red", "grn")


def ndvi(nir: Column | str = "nir", red: Column | str = "red") -> Column:
    """(nir - red) / (nir + red + epsilon), in double; 0 where both are 0."""
    a, b = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (nir, red))
    return (a - b) / (a + b + F.lit(INDEX_EPSILON))


def ndwi(nir: Column | str = "nir", grn: Column | str = "grn") -> Column:
    """(green - nir) / (green + nir + epsilon), in double."""
    a, b = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (nir, grn))
    return (b - a) / (b + a + F.lit(INDEX_EPSILON))


def center(y: Column, x: Column, height: Column, width: Column, size: int = PATCH) -> Column:
    """True in the central square of a chip; the whole chip if it is smaller."""

    def within(v, n):
        start = F.greatest(F.lit(0), F.floor((n - size) / 2))
        return (v >= start) & (v < start + size)

    return within(y, height) & within(x, width)


def region_features(inside: Column | None = None) -> list[Column]:
    """18 aggregates: mean, population deviation, quartiles per band, then NDVI and NDWI mean, deviation, share above cut."""
    only = (lambda c: F.when(inside, c)) if inside is not None else (lambda c: c)
    out = []
    for b in BANDS:
        v = only(F.col(b).cast("double"))
        out += [F.avg(v), F.stddev_pop(v), F.percentile(v, F.lit(0.25)), F.percentile(v, F.lit(0.75))]
    for index, cut in ((ndvi(), NDVI_CUT), (ndwi(), NDWI_CUT)):
        v = only(index)
        out += [F.avg(v), F.stddev_pop(v), F.avg(only((index > cut).cast("double")))]
    return out


def features(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys and ``features``, array<double> of 36: the centre's 18, then the whole chip's 18.

    One aggregate; NULL entries where a chip has no pixel in its centre.
    """
    return pixels.groupBy(*keys).agg(F.array(*region_features(F.col("is_center")), *region_features()).alias("features"))


def norm_stats(pixels: DataFrame) -> DataFrame:
    """One row: mean and std, array<double> per band, of values over 255 of all pixels."""
    mean = [F.avg(F.col(b) / 255.0) for b in BANDS]
    square = [F.avg((F.col(b) / 255.0) * (F.col(b) / 255.0)) for b in BANDS]
    return pixels.agg(F.array(*mean).alias("mean"), F.array(*(F.sqrt(F.greatest(s - m * m, F.lit(0.0))) for m, s in zip(mean, square))).alias("std"))


def six_bands() -> Column:
    """Three bands in the six slots the encoder expects: green, red, nir in slots 1 to 3, zeros elsewhere."""
    zero = F.lit(0.0)
    return F.array(zero, *(F.col(b).cast("double") for b in ("grn", "red", "nir")), zero, zero)
