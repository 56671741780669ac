"""Feature types, labels, tiers and coordinate text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wetlens.constants import CLASS_NAMES, LABELS, OTHER_LABEL

_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def feature_type(name: Column) -> Column:
    """A placemark's name, stripped of all white space and lower case; NULL and empty are ``unknown``."""
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(F.lower(F.regexp_replace(name, _SPACE, "")))


def label(kind: Column) -> Column:
    """0 negative, 1 flooded, 2 any other type."""
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(OTHER_LABEL))


def collapsed(value: Column) -> Column:
    """Labels 1 and 2 as 1."""
    return F.least(value, F.lit(1))


def class_name(value: Column) -> Column:
    """A label's name in reports."""
    table = F.create_map(*(F.lit(x) for pair in CLASS_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), F.lit("?"))


def tier(confidence: Column) -> Column:
    """high from 0.8, medium from 0.6, else low (NaN and NULL too)."""
    c = F.nanvl(confidence, F.lit(-1.0))
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def coordinates(text: Column) -> Column:
    """array<struct<lon, lat>> of ``lon,lat[,alt]`` tokens; malformed tokens are left out."""
    tokens = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, ""), r"(?U)\s+")
    pairs = F.transform(tokens, lambda t: F.struct(F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"), F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat")))
    return F.filter(pairs, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())


def centroid(pairs: Column) -> Column:
    """struct<lon, lat>: the mean of the listed vertices, NULL of none."""
    n = F.size(pairs)
    mean = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p[f]) / n
    return F.when(n > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))
