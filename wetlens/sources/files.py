"""Discovery of files, rasters as pixel blocks, chips, manifests, statistics and models."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.constants import EPSG, VECTOR_SUFFIXES

MANIFEST = "path string, label int, feature_type string, x double, y double"
RASTER = "path string, epsg int, x0 double, y0 double, res double, width int, height int, bands int"
PIXELS = "path string, y int, x int, nir int, red int, grn int"


def listing(spark: SparkSession, place: str, suffix: str) -> DataFrame:
    """path, length of the files under a folder whose name ends with ``suffix``, whatever its case; sorted.

    A single file is returned whatever its suffix.  Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place).select("path", "length")
    return files.filter(F.lower("path").endswith(suffix.lower()) | F.lit(os.path.isfile(place))).orderBy("path")


def vector_files(place: str) -> list[str]:
    """The vector files directly inside a folder, sorted; or the one file named."""
    if os.path.isfile(place):
        return [place]
    return sorted(e.path for e in os.scandir(place) if e.is_file() and os.path.splitext(e.name)[1].lower() in VECTOR_SUFFIXES)


def npy(content: bytes) -> np.ndarray:
    """The array of a .npy file; arrays with objects in them are refused."""
    return np.load(io.BytesIO(content), allow_pickle=False)


def rasters(spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
    """Metadata of rasters kept as ``name.npy`` (bands, rows, columns) beside ``name.json``.

    The JSON has epsg, x0, y0 and res.  With ``check`` a raster of another reference
    system than expected fails.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                m = json.loads(content)
                rows.append((path[: -len("json")] + "npy", m["epsg"], m["x0"], m["y0"], m["res"], m["width"], m["height"], m["bands"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RASTER.split(", ")])

    out = files.select("path", "content").mapInPandas(read, RASTER)
    if check:
        ok = F.coalesce(F.col("epsg") == EPSG, F.lit(False))
        out = out.withColumn("epsg", F.when(ok, F.col("epsg")).otherwise(F.raise_error(F.concat(F.lit(f"the reference system is not EPSG:{EPSG}: "), F.col("path")))))
    return out


def pixels(spark: SparkSession, folder: str, decode: Callable[[bytes], np.ndarray] = npy, glob: str = "*.npy") -> DataFrame:
    """Long-form pixels of all rasters under a folder; ``decode`` turns a file into (bands, rows, columns).

    One task reads one file and yields it in strips of rows, so no raster is expanded as a whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                a = decode(content)
                _, h, w = a.shape
                for top in range(0, h, 64):
                    s = a[:, top : top + 64]
                    n = s.shape[1]
                    yield pd.DataFrame({"path": path, "y": np.repeat(np.arange(top, top + n, dtype=np.int32), w), "x": np.tile(np.arange(w, dtype=np.int32), n), **{k: s[i].ravel().astype(np.int32) for i, k in enumerate(("nir", "red", "grn"))}})

    return files.select("path", "content").mapInPandas(read, PIXELS)


def chips(spark: SparkSession, folder: str, glob: str = "*.npy") -> DataFrame:
    """chip_id (the path), bands, h, w, data of .npy chips; arrays with objects in them are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = [npy(c) for c in b["content"]]
            yield pd.DataFrame({"chip_id": b["path"], "bands": [v.shape[0] for v in a], "h": [v.shape[1] for v in a], "w": [v.shape[2] for v in a], "data": [np.ascontiguousarray(v, np.uint8).tobytes() for v in a]})

    return files.select("path", "content").mapInPandas(read, "chip_id string, bands int, h int, w int, data binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with header."""
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def norm_stats(spark: SparkSession, path: str) -> DataFrame:
    """mean and std, array<double>, of a statistics file."""
    return spark.read.schema("mean array<double>, std array<double>").option("multiLine", True).json(path)
