"""Square cuts of rasters (windows and chips), made in the tasks that decode the rasters.

Only rasters of which something is wanted are read, pixels never become rows, and what is
shuffled are the wanted places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.constants import BLOCK, CONTEXT_OFFSET, INDEX_EPSILON, NDVI_CUT, NDWI_CUT, PATCH, TILE
from wetlens.sources.files import npy

#: Cuts a task makes of one raster, and cuts handed on at once.
PER_TASK, BATCH = 2048, 16


def cut(spark: SparkSession, folder: str, places: DataFrame, size: int = TILE, decode: Callable[[bytes], np.ndarray] = npy, glob: str = "*.npy") -> DataFrame:
    """``places`` (path, row_off, col_off, more) with bands, h, w and ``data``: the bytes of three bands, 0 beyond the raster.

    ``decode`` turns a file into (bands, rows, columns).  A raster with more than ``PER_TASK`` places is
    decoded once for each so many.  Places of files that are not there are left out.
    """
    keys = places.columns
    schema = T.StructType([*places.schema.fields, *(T.StructField(n, T.IntegerType()) for n in ("bands", "h", "w")), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, at in zip(b["content"], b["at"]):
                a = decode(content)
                rows: list = []
                for p in at:
                    rows.append((*(p[k] for k in keys), 3, size, size, padded(a, p["row_off"], p["col_off"], size).tobytes()))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

    return _dealt(spark, folder, places, glob, PER_TASK).mapInPandas(run, schema)


def _dealt(spark: SparkSession, folder: str, places: DataFrame, glob: str, most: int) -> DataFrame:
    """content, at: each file of which places are wanted, with its places, at most about ``most`` at a time."""
    keys = places.columns
    crowd = places.groupBy("path").agg(F.ceil(F.count("*") / most).cast("long").alias("_n"))
    dealt = places.join(crowd, "path").withColumn("_part", F.pmod(F.xxhash64(*keys), F.col("_n")))
    lists = dealt.groupBy("path", "_part").agg(F.collect_list(F.struct(*keys)).alias("at"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.join(lists, "path").select("content", "at")


def padded(a: np.ndarray, row: int, col: int, size: int) -> np.ndarray:
    """The first three bands of a window of an image, 0 beyond its edges."""
    out = np.zeros((3, size, size), np.uint8)
    _, h, w = a.shape
    y0, y1, x0, x1 = max(row, 0), min(row + size, h), max(col, 0), min(col + size, w)
    if y0 < y1 and x0 < x1:
        out[:, y0 - row : y1 - row, x0 - col : x1 - col] = a[:3, y0:y1, x0:x1]
    return out


def _region(a: np.ndarray) -> list[float]:
    v = a.reshape(3, -1).astype(float)
    out: list[float] = []
    for b in v:
        out += [b.mean(), b.std(), *np.percentile(b, (25, 75))]
    nir, red, grn = v
    for index, least in (((nir - red) / (nir + red + INDEX_EPSILON), NDVI_CUT), ((grn - nir) / (grn + nir + INDEX_EPSILON), NDWI_CUT)):
        out += [index.mean(), index.std(), (index > least).mean()]
    return [float(x) for x in out]


def chip_vector(a: np.ndarray) -> list[float]:
    """The 36 features of a chip (bands, rows, columns): its centre's 18, then the whole chip's."""
    y, x = (max(0, (n - PATCH) // 2) for n in a.shape[1:])
    return _region(a[:, y : y + PATCH, x : x + PATCH]) + _region(a)


def features(cuts: DataFrame) -> DataFrame:
    """``cuts`` without data, with ``features``: array<double> of 36."""
    kept = [f for f in cuts.schema.fields if f.name not in ("bands", "h", "w", "data")]
    schema = T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [chip_vector(np.frombuffer(d, np.uint8).reshape(n, h, w)) for n, h, w, d in zip(b["bands"], b["h"], b["w"], b["data"])]
            yield b[[f.name for f in kept]].assign(features=v)

    return cuts.mapInPandas(run, schema)


def _quartiles(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and third quartile of value counts (..., 256), interpolated between values."""
    cum = hist.cumsum(-1)
    out = []
    for q in (0.25, 0.75):
        at = q * (cum[..., -1] - 1)
        lo = np.floor(at)
        low, high = ((cum <= k[..., None]).sum(-1) for k in (lo, np.ceil(at)))
        out.append(low + (at - lo) * (high - low))
    return out[0], out[1]


def patch_vectors(a: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(pr, (columns, 36) features) of each row of 64-pixel patches of which one is ``wanted`` (rows, columns of patches).

    A patch's own 18 features, then its 512-pixel context's; edge pixels are repeated beyond the
    raster.  Value counts and index sums of 32-pixel blocks are made once, and summed over contexts.
    """
    _, h, w = a.shape
    nr, nc = -(-h // PATCH), -(-w // PATCH)
    full = np.pad(a[:3], ((0, 0), (CONTEXT_OFFSET, nr * PATCH - h + CONTEXT_OFFSET), (CONTEXT_OFFSET, nc * PATCH - w + CONTEXT_OFFSET)), mode="edge")
    cols, lead, wide, step = full.shape[2] // BLOCK, CONTEXT_OFFSET // BLOCK, TILE // BLOCK, PATCH // BLOCK
    base = np.repeat(np.arange(cols), BLOCK) * 768
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block_row(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in known:
            v = full[:, k * BLOCK : (k + 1) * BLOCK].astype(np.int64)
            hist = np.bincount((base + np.arange(3)[:, None, None] * 256 + v).ravel(), minlength=cols * 768).reshape(cols, 3, 256)
            nir, red, grn = v.astype(float)
            sums = []
            for index, least in (((nir - red) / (nir + red + INDEX_EPSILON), NDVI_CUT), ((grn - nir) / (grn + nir + INDEX_EPSILON), NDWI_CUT)):
                sums += [index, index * index, index > least]
            known[k] = hist, np.stack([s.reshape(BLOCK, cols, BLOCK).sum((0, 2)) for s in sums], 1)
        return known[k]

    def region(first: int, n_rows: int, lead_col: int, n_cols: int) -> np.ndarray:
        rows = [block_row(k) for k in range(first, first + n_rows)]
        out = []
        for part in (0, 1):
            total = sum(r[part] for r in rows)
            cum = np.concatenate([np.zeros((1, *total.shape[1:])), total.cumsum(0)])
            at = np.arange(nc) * step + lead_col
            out.append(cum[at + n_cols] - cum[at])
        hist, sums = out
        n = float(n_rows * n_cols * BLOCK * BLOCK)
        value = np.arange(256.0)
        mean = hist @ value / n
        std = np.sqrt(np.maximum(0.0, hist @ (value * value) / n - mean * mean))
        q1, q3 = _quartiles(hist)
        bands = np.stack([mean, std, q1, q3], 2).reshape(nc, 12)
        index = []
        for i in (0, 3):
            m = sums[:, i] / n
            index += [m, np.sqrt(np.maximum(0.0, sums[:, i + 1] / n - m * m)), sums[:, i + 2] / n]
        return np.concatenate([bands, np.stack(index, 1)], 1)

    for pr in np.flatnonzero(wanted.any(1)):
        top = int(pr) * step
        for k in [k for k in known if k < top]:
            del known[k]
        yield int(pr), np.concatenate([region(top + lead, step, lead, step), region(top, wide, 0, wide)], 1)


def patches(spark: SparkSession, folder: str, places: DataFrame, decode: Callable[[bytes], np.ndarray] = npy, glob: str = "*.npy") -> DataFrame:
    """path, pr, pc, features of the wanted 64-pixel patches (path, pr, pc), made in the tasks that decode the rasters."""
    schema = "path string, pr int, pc int, features array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, at in zip(b["content"], b["at"]):
                a = decode(content)
                wanted = np.zeros((-(-a.shape[1] // PATCH), -(-a.shape[2] // PATCH)), bool)
                for p in at:
                    wanted[p["pr"], p["pc"]] = True
                for pr, v in patch_vectors(a, wanted):
                    pc = np.flatnonzero(wanted[pr])
                    yield pd.DataFrame({"path": at[0]["path"], "pr": np.int32(pr), "pc": pc.astype(np.int32), "features": [x.tolist() for x in v[pc]]})

    return _dealt(spark, folder, places.select("path", "pr", "pc"), glob, 10**9).mapInPandas(run, schema)


def statistics(cuts: DataFrame) -> DataFrame:
    """One row: mean and std, array<double> per band, of all pixels of the cuts over 255; sums per task are added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(3), np.zeros(3)
        for b in batches:
            for d in b["data"]:
                v = np.frombuffer(d, np.uint8).reshape(3, -1) / 255.0
                n, total, square = n + v.shape[1], total + v.sum(1), square + (v * v).sum(1)
        yield pd.DataFrame([(n, *total, *square)], columns=["n", *(f"{k}{i}" for k in "sq" for i in range(3))])

    sums = cuts.select("data").mapInPandas(run, "n long, " + ", ".join(f"{k}{i} double" for k in "sq" for i in range(3)))
    mean = [F.sum(f"s{i}") / F.sum("n") for i in range(3)]
    return sums.agg(F.array(*mean).alias("mean"), F.array(*(F.sqrt(F.greatest(F.sum(f"q{i}") / F.sum("n") - m * m, F.lit(0.0))) for i, m in enumerate(mean))).alias("std"))
