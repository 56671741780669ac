"""Detections as a styled KML document."""

from __future__ import annotations

import os
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.constants import MODEL_COLOURS, TIER_COLOURS
from wetlens.functions.geo import to_lonlat
from wetlens.functions.labels import tier
from wetlens.operators.ordering import numbered

NAMESPACE = "http://www.opengis.net/kml/2.2"


@F.pandas_udf(T.StringType())
def _two(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else f"{x:.2f}")


@F.pandas_udf(T.StringType())
def _none(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else f"{x:.0f}")


@F.pandas_udf(T.StringType())
def _ring(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else " ".join(f"{x:.6f},{y:.6f},0" for x, y in zip(a, b)) for a, b in zip(lon, lat)], dtype=object)


def fields(number: Column, confidence: Column, area: Column, model: Column) -> list[Column]:
    """name, description and style of a placemark: by model if it is known, else by tier."""
    known = F.coalesce(model.isin(*MODEL_COLOURS), F.lit(False))
    conf, size = F.coalesce(_two(confidence.cast("double")), F.lit("nan")), F.coalesce(_none(area.cast("double")), F.lit("nan"))
    name = F.concat(F.lit("Flooded area "), number.cast("string"))
    text = F.concat(F.lit("Confidence: "), conf, F.lit("\nArea: "), size, F.lit(" m²"))
    return [
        F.when(known, F.concat(name, F.lit(" ["), F.upper(model), F.lit("]"))).otherwise(name).alias("name"),
        F.when(known, F.concat(F.lit("Model: "), F.upper(model), F.lit("\n"), text)).otherwise(text).alias("description"),
        F.when(known, F.concat(F.lit("#model_"), model)).otherwise(F.concat(F.lit("#flood_"), tier(confidence))).alias("style"),
    ]


def ring_text(ring: Column) -> Column:
    """``lon,lat,0`` of each vertex of an outer ring in metres, six decimals, separated by blanks."""
    at = F.transform(ring, lambda p: to_lonlat(p["x"], p["y"]))
    return _ring(F.transform(at, lambda p: p["lon"]), F.transform(at, lambda p: p["lat"]))


def placemarks(rois: DataFrame, order: str) -> DataFrame:
    """number, name, description, style, coordinates of regions (order, geom, confidence, area_m2, model_type).

    Numbers run from 1 in the order given.  Holes are not written.
    """
    return numbered(rois, [order], "number").withColumn("number", F.col("number") + 1).select("number", *fields(F.col("number"), F.col("confidence"), F.col("area_m2"), F.col("model_type")), ring_text(F.col("geom")).alias("coordinates"))


def styles() -> str:
    """The six styles, by tier and by model."""
    out = []
    for prefix, table in (("flood", TIER_COLOURS), ("model", MODEL_COLOURS)):
        for name, (line, fill) in table.items():
            out.append(f'    <Style id="{prefix}_{name}"><LineStyle><color>{line}</color><width>2</width></LineStyle><PolyStyle><color>{fill}</color><outline>1</outline></PolyStyle></Style>')
    return "\n".join(out)


def write(rois: DataFrame, path: str, order: str = "roi_idx", title: str = "Flooded areas") -> int:
    """Writes the document, one row at a time, and returns the number of placemarks.

    Parent folders are made.  Rows stream to the driver partition by partition, in order.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="{NAMESPACE}">\n  <Document>\n    <name>{escape(title)}</name>\n{styles()}\n')
        for r in placemarks(rois, order).orderBy("number").toLocalIterator():
            ring = f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{r['coordinates'] or ''}</coordinates></LinearRing></outerBoundaryIs></Polygon>"
            f.write(f"    <Placemark><name>{escape(r['name'])}</name><description>{escape(r['description'])}</description><styleUrl>{r['style']}</styleUrl>{ring}</Placemark>\n")
            n += 1
        f.write("  </Document>\n</kml>\n")
    return n
