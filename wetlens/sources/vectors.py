"""Watercourses from GeoJSON, GeoPackage and shapefiles, as segments.

Geometry is decoded with the standard library only; every line and ring becomes segments.
Reference systems 3067, 4326 and 4258 are understood, others are refused.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.constants import CENTRELINE_LAYER, EPSG, STREAM_LAYERS
from wetlens.functions.geo import to_grid
from wetlens.sources.files import vector_files

SEGMENTS = "file string, layer string, epsg int, x1 double, y1 double, x2 double, y2 double"
DEGREES = (4326, 4258)


def _lines(geometry: dict) -> Iterator[list]:
    kind, c = geometry.get("type"), geometry.get("coordinates") or []
    if kind == "LineString":
        yield c
    elif kind in ("Polygon", "MultiLineString"):
        yield from c
    elif kind == "MultiPolygon":
        for p in c:
            yield from p
    elif kind == "GeometryCollection":
        for g in geometry.get("geometries", []):
            yield from _lines(g)


def geojson(text: str) -> Iterator[tuple[str | None, int, list]]:
    """(layer, epsg, vertices) of each line of a GeoJSON text; without a crs it is 4326."""
    doc = json.loads(text)
    name = ((doc.get("crs") or {}).get("properties") or {}).get("name", "EPSG:4326")
    epsg = 4326 if name.endswith("CRS84") else int(name.rpartition(":")[2])
    for f in doc.get("features", [doc] if "geometry" in doc else []):
        for line in _lines(f.get("geometry") or {}):
            yield (f.get("properties") or {}).get("layer"), epsg, line


def wkb(data: bytes, at: int = 0) -> tuple[list[list], int]:
    """The lines of a well-known-binary geometry, and the position after it."""
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4
    flags, code = kind & 0xE0000000, kind & 0x1FFFFFFF
    dims = 2 + bool(flags & 0x80000000) + bool(flags & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    code %= 1000

    def count():
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def line():
        nonlocal at
        n = count()
        v = struct.unpack_from(f"{order}{n * dims}d", data, at)
        at += 8 * n * dims
        return [v[i : i + 2] for i in range(0, len(v), dims)]

    if code == 1:
        return [], at + 8 * dims
    if code == 2:
        out = [line()]
    elif code == 3:
        out = [line() for _ in range(count())]
    elif code in (4, 5, 6, 7):
        out = []
        for _ in range(count()):
            more, at = wkb(data, at)
            out += more
    else:
        raise ValueError(f"geometry type {code} is not understood")
    return out, at


def _blob(data: bytes) -> list[list]:
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(data[3] >> 1) & 7]
    return [] if data[3] & 16 else wkb(data, 8 + envelope)[0]


def layers_of(path: str) -> list[str] | None:
    """Names of the feature layers of a GeoPackage; None for files that have none to list."""
    if not path.lower().endswith(".gpkg"):
        return None
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid")]


def geopackage(path: str, layer: str) -> Iterator[tuple[str, int, list]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        column, srs = c.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        ref = c.execute("SELECT organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs,)).fetchone()
        q = lambda s: '"' + s.replace('"', '""') + '"'
        for (blob,) in c.execute(f"SELECT {q(column)} FROM {q(layer)} WHERE {q(column)} IS NOT NULL"):
            for line in _blob(blob):
                yield layer, ref[0] if ref else srs, line


def shapefile(path: str) -> Iterator[tuple[None, int, list]]:
    """Lines of polylines and polygons; the reference system is told from the .prj beside it."""
    prj = os.path.splitext(path)[0] + ".prj"
    if not os.path.exists(prj):
        raise ValueError(f"there is no reference system for {path}")
    with open(prj, encoding="utf-8") as f:
        text = f.read()
    epsg = EPSG if "TM35" in text else 4326 if not text.startswith("PROJCS") and ("WGS" in text or "ETRS" in text) else 0
    with open(path, "rb") as f:
        data = f.read()
    at = 100
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<ii", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            v = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            xy = [v[i : i + 2] for i in range(0, len(v), 2)]
            for a, b in zip(starts, starts[1:]):
                yield None, epsg, xy[a:b]
        at += 8 + size


def _read(path: str, wanted: tuple[str, ...], strict: bool) -> Iterator[tuple]:
    names = layers_of(path)
    if names is not None:
        chosen = [n for n in wanted if n in names] or ([] if strict else names[:1])
        lines = (line for n in chosen for line in geopackage(path, n))
    elif strict:
        lines = iter(())
    elif path.lower().endswith(".shp"):
        lines = shapefile(path)
    elif path.lower().endswith(".fgb"):
        raise ValueError(f"there is no reader for {path}")
    else:
        with open(path, encoding="utf-8") as f:
            lines = geojson(f.read())
    for layer, epsg, v in lines:
        for a, b in zip(v, v[1:]):
            yield path, layer, epsg, float(a[0]), float(a[1]), float(b[0]), float(b[1])


def _segments(spark: SparkSession, place: str, wanted: tuple[str, ...], strict: bool) -> DataFrame:
    files = vector_files(place)
    if not files and not strict:
        raise ValueError(f"there are no vector files at {place}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SEGMENTS.split(", ")]
        for b in batches:
            for path in b["path"]:
                rows = []
                for row in _read(path, wanted, strict):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    raw = names.mapInPandas(read, SEGMENTS)
    known = F.col("epsg").isin(EPSG, *DEGREES)
    raw = raw.withColumn("epsg", F.when(known, F.col("epsg")).otherwise(F.raise_error(F.concat(F.lit("unknown reference system in "), F.col("file")))))
    plane = F.col("epsg") == EPSG
    a, b = to_grid(F.col("x1"), F.col("y1")), to_grid(F.col("x2"), F.col("y2"))
    pick = lambda own, g, f: F.when(plane, F.col(own)).otherwise(g[f])
    return raw.select("file", "layer", pick("x1", a, "e").alias("x1"), pick("y1", a, "n").alias("y1"), pick("x2", b, "e").alias("x2"), pick("y2", b, "n").alias("y2"))


def stream_segments(spark: SparkSession, place: str) -> DataFrame:
    """Segments of the watercourse layers of all vector files directly inside a folder, in metres.

    Of a GeoPackage the wanted layers count, or its first layer if it has none of them;
    files of one layer count whole.  No file at all fails.
    """
    return _segments(spark, place, STREAM_LAYERS, strict=False)


def centrelines(spark: SparkSession, place: str) -> DataFrame | None:
    """Segments of the centreline layer; None if no file has it.  Files without layers are skipped."""
    lines = _segments(spark, place, (CENTRELINE_LAYER,), strict=True) if vector_files(place) else None
    return None if lines is None or lines.isEmpty() else lines
