"""Manifests, statistics, chips and previews as files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_manifest(rows: DataFrame, path: str, order: str = "row_idx") -> None:
    """One CSV with header ``path,label,feature_type,x,y`` in the given order."""
    rows.select(order, "path", "label", "feature_type", "x", "y").coalesce(1).sortWithinPartitions(order).drop(order).write.mode("overwrite").option("header", True).csv(path)


def write_norm_stats(stats: DataFrame, path: str) -> dict:
    """The one row of statistics as a JSON file; returns it."""
    r = stats.first()
    out = {"mean": list(r["mean"]), "std": list(r["std"])}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2)
    return out


def write_chips(pixels: DataFrame, folder: str, size: int) -> DataFrame:
    """name, n_bytes of chips (name, y, x, nir, red, grn) written as .npy; absent pixels are 0.

    One task assembles one chip, whose size is fixed, and renames it into place.
    """

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((3, size, size), np.uint8)
        if pdf["y"].notna().all():
            for i, b in enumerate(("nir", "red", "grn")):
                a[i, pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf[b]
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, pdf["name"].iloc[0])
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, path)
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "n_bytes": [os.path.getsize(path)]})

    return pixels.groupBy("name").applyInPandas(save, "name string, n_bytes long")


def write_cuts(cuts: DataFrame, folder: str) -> DataFrame:
    """name, n_bytes of cuts (name, bands, h, w, data) written as .npy into a folder all executors share.

    Each file is written under a name of its own and renamed into place, so a repeated task does no harm.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            sizes = []
            for name, bands, h, w, data in zip(b["name"], b["bands"], b["h"], b["w"], b["data"]):
                path = os.path.join(folder, name)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    np.save(f, np.frombuffer(data, np.uint8).reshape(bands, h, w))
                os.replace(part, path)
                sizes.append(os.path.getsize(path))
            yield pd.DataFrame({"name": b["name"], "n_bytes": sizes})

    return cuts.select("name", "bands", "h", "w", "data").mapInPandas(save, "name string, n_bytes long")


def preview(pixels: DataFrame):
    """pixels with each band stretched to 0..1 over the least and largest value of all bands."""
    v = F.array("nir", "red", "grn")
    lo, hi = pixels.agg(F.min(F.array_min(v)), F.max(F.array_max(v))).first()
    return pixels.withColumns({b: (F.col(b) - lo) / (hi - lo + 1e-6) for b in ("nir", "red", "grn")}) if lo is not None else pixels


def write_png(image: np.ndarray, path: str) -> bool:
    """An image (rows, columns, 3) of 0..1 as PNG; False, and nothing written, without matplotlib."""
    try:
        from matplotlib import image as writer
    except ImportError:
        return False
    writer.imsave(path, np.clip(image, 0, 1))
    return True
