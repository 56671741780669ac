"""Whole runs: detection, training sets, evaluation, diagnosis of a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wetlens.constants import EXCLUDED_TYPES, FEW_POSITIVES, MIN_AREA_M2, PATCH, SEED, STRIDE, TEST_SHARE, THRESHOLD, TILE
from wetlens.functions import labels as L
from wetlens.functions import spectral
from wetlens.functions.geo import to_grid
from wetlens.models import forest
from wetlens.operators import blocks, chips, evaluation, regions
from wetlens.operators.agreement import merge_regions
from wetlens.operators.negatives import extents, sample
from wetlens.operators.ordering import numbered
from wetlens.operators.windows import masked_windows
from wetlens.session import written


def window_features(pixels: DataFrame, windows: DataFrame, size: int = TILE) -> DataFrame:
    """path, row_off, col_off, features of each window; pixels beyond the raster count as 0.

    Pixels meet windows by cells of half a window; an edge window's missing pixels are
    added as zeros.
    """
    div = lambda c: F.floor(F.col(c) / STRIDE).cast("int")
    steps = size // STRIDE
    w = windows.select("path", "row_off", "col_off", "w", "h").withColumn("br", F.explode(F.sequence(div("row_off"), div("row_off") + (steps - 1)))).withColumn("bc", F.explode(F.sequence(div("col_off"), div("col_off") + (steps - 1))))
    p = pixels.withColumn("br", div("y")).withColumn("bc", div("x"))
    j = w.join(p, ["path", "br", "bc"]).select("path", "row_off", "col_off", (F.col("y") - F.col("row_off")).alias("wy"), (F.col("x") - F.col("col_off")).alias("wx"), "nir", "red", "grn")
    short = windows.filter((F.col("w") < size) | (F.col("h") < size)).withColumn("wy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("wx", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).filter("wy >= h or wx >= w")
    zero = short.select("path", "row_off", "col_off", "wy", "wx", *(F.lit(0).alias(b) for b in spectral.BANDS))
    n = F.lit(size)
    full = j.unionByName(zero).withColumn("is_center", spectral.center(F.col("wy"), F.col("wx"), n, n))
    return spectral.features(full, "path", "row_off", "col_off")


def detect_windows(rasters: DataFrame, pixels: DataFrame, score, segments: DataFrame | None = None, threshold: float = THRESHOLD, min_area: float = MIN_AREA_M2) -> DataFrame:
    """Regions from sliding windows: path, comp, area_m2, confidence, and their 256-pixel cells r, c.

    One row per cell.  ``score`` adds predicted and confidence to window features, here made of pixel rows;
    :func:`detect_scored` takes windows scored in any other way.
    """
    w = written(masked_windows(rasters, segments), "windows")
    return detect_scored(rasters, w, score(window_features(pixels, w)), threshold, min_area)


def detect_scored(rasters: DataFrame, w: DataFrame, scored: DataFrame, threshold: float = THRESHOLD, min_area: float = MIN_AREA_M2) -> DataFrame:
    """Regions of the windows ``w`` (:func:`masked_windows`) that ``scored`` (path, row_off, col_off, predicted, confidence) detects.

    path, comp, area_m2, confidence, and the 256-pixel cells r, c; one row per cell.
    """
    scored = forest.detected(scored, threshold)
    boxes = scored.join(w, ["path", "row_off", "col_off"]).withColumn("cand_id", F.xxhash64("path", "row_off", "col_off")).select("path", "cand_id", "confidence", "xmin", "ymin", "xmax", "ymax")
    boxes = written(boxes, "boxes")
    found = regions.merge_windows(boxes, rasters, ["path"], min_area)
    cells = regions.components(regions.window_cells(boxes, rasters), "path")
    return cells.join(found, ["path", "comp"])


def masked_patches(rasters: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """path, pr, pc of the 64-pixel patches near watercourses, or of all without any."""
    w = masked_windows(rasters, segments, erode=False, size=PATCH, stride=PATCH)
    return w.select("path", (F.col("row_off") / PATCH).cast("int").alias("pr"), (F.col("col_off") / PATCH).cast("int").alias("pc"))


def detect_dense(rasters: DataFrame, pixels: DataFrame, score, segments: DataFrame | None = None, threshold: float = THRESHOLD, min_area: float = MIN_AREA_M2) -> DataFrame:
    """:func:`detect_patches` with features made of pixel rows.  ``score`` adds p1."""
    wanted = blocks.dense_features(rasters, pixels).join(masked_patches(rasters, segments), ["path", "pr", "pc"], "left_semi")
    return detect_patches(rasters, score(wanted), threshold, min_area)


def detect_patches(rasters: DataFrame, scored: DataFrame, threshold: float = THRESHOLD, min_area: float = MIN_AREA_M2) -> DataFrame:
    """Regions of scored 64-pixel patches (path, pr, pc, p1): path, comp, area_m2, confidence, and their cells r, c.

    One row per cell.
    """
    scored = written(scored.select("path", F.col("pr").alias("r"), F.col("pc").alias("c"), F.col("p1").alias("p")), "scores")
    out = None
    for (res,) in rasters.select("res").distinct().collect():
        mine = scored.join(rasters.filter(F.col("res") == res).select("path"), "path", "left_semi")
        one = regions.score_regions(mine, ["path"], (PATCH * res) ** 2, threshold, min_area)
        out = one if out is None else out.unionByName(one)
    cells = regions.components(regions.dense_cells(scored, threshold), "path")
    return cells.join(out.drop("n_cells"), ["path", "comp"]) if out is not None else cells.limit(0)


def outlined(found: DataFrame, rasters: DataFrame, cell: int, model: str | None) -> DataFrame:
    """roi_idx, region, geom, confidence, area_m2, model_type of regions given by cells, for the KML sink.

    A region of several parts (they touch at corners, or were united) has one row per part, each with the region's area.
    """
    at = found.join(rasters.select("path", "x0", "y0", "res"), "path").select("path", "x0", "y0", "res", F.col("comp").cast("long").alias("comp"), "r", "c")
    rings = regions.rings(at, ["path", "x0", "y0", "res"], cell).select("path", "comp", "part", F.col("ring").alias("geom"))
    facts = found.groupBy("path", "comp").agg(F.first("confidence").alias("confidence"), F.first("area_m2").alias("area_m2"), *([F.first("model_type").alias("model_type")] if model is None else []))
    kind = F.col("model_type") if model is None else F.lit(model)
    return rings.join(facts, ["path", "comp"]).select(F.concat_ws("|", "path", F.lpad(F.col("comp").cast("string"), 20, "0"), F.lpad(F.col("part").cast("string"), 6, "0")).alias("roi_idx"), F.concat_ws("|", "path", "comp").alias("region"), "geom", "confidence", "area_m2", kind.alias("model_type"))


def patches(found: DataFrame, rasters: DataFrame) -> DataFrame:
    """Regions given by 256-pixel cells, given by the 64-pixel cells inside the raster instead."""
    n = STRIDE // PATCH
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(n)))
    fine = found.withColumn("d", F.explode(steps)).withColumn("r", F.col("r") * n + F.col("d.i")).withColumn("c", F.col("c") * n + F.col("d.j")).drop("d")
    inside = fine.join(rasters.select("path", "height", "width"), "path").filter((F.col("r") * PATCH < F.col("height")) & (F.col("c") * PATCH < F.col("width")))
    return inside.select(*found.columns)


def both_models(rf: DataFrame, cnn: DataFrame, rasters: DataFrame) -> DataFrame:
    """roi_idx, region, geom, confidence, area_m2, model_type of both models' regions reconciled."""
    facts, cells = merge_regions(rf, cnn, rasters)
    named = facts.withColumn("comp", F.xxhash64("path", "roi").bitwiseAND(2**62 - 1))
    return outlined(cells.join(named, ["path", "roi"]), rasters, PATCH, None)


def training_set(rasters: DataFrame, labels: DataFrame, segments: DataFrame | None = None, n_negatives: int | None = None, seed: int = SEED, excluded: tuple[str, ...] = EXCLUDED_TYPES) -> DataFrame:
    """row_idx, path, chip, label, feature_type, x, y, row_off, col_off of all chips.

    Raster by raster, positives before negatives; each kind is numbered before chips
    outside a raster are left out, so names have gaps.  ``n_negatives`` is the number of
    positives unless given.
    """
    positive = labels.filter(~F.col("feature_type").isin(*excluded)).select("x", "y", "feature_type")
    positive = written(numbered(positive, ["x", "y", "feature_type"], "seq"), "positives")
    n = positive.count() if n_negatives is None else n_negatives
    negative = sample(rasters, segments, n, seed).select("x", "y", F.lit("negative").alias("feature_type"), "seq")
    points = positive.withColumn("kind", F.lit(0)).unionByName(negative.withColumn("kind", F.lit(1)))
    points = written(points.withColumn("id", F.col("kind").cast("long") * 2**40 + F.col("seq")), "points")
    c = chips.centred(points, rasters).join(points, "id").withColumn("label", L.label(F.col("feature_type")))
    return numbered(c, ["path", "kind", "seq"], "row_idx").select("row_idx", "path", chips.chip_name(F.col("path"), F.col("label"), F.col("seq")).alias("chip"), "label", "feature_type", "x", "y", "row_off", "col_off")


def chip_features(pixels: DataFrame, chip_rows: DataFrame) -> DataFrame:
    """row_idx, label, features of the chips of :func:`training_set`; pixels beyond the raster are 0."""
    ids = chip_rows.select(F.col("row_idx").alias("id"), "path", "row_off", "col_off")
    inside = chips.chip_pixels(ids, pixels).select("id", "y", "x", "nir", "red", "grn")
    cells = ids.select("id").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1))))
    zero = cells.join(inside.select("id", "y", "x"), ["id", "y", "x"], "left_anti").select("id", "y", "x", *(F.lit(0).alias(b) for b in spectral.BANDS))
    n = F.lit(TILE)
    full = inside.unionByName(zero).withColumn("is_center", spectral.center(F.col("y"), F.col("x"), n, n))
    return spectral.features(full, "id").join(chip_rows.select(F.col("row_idx").alias("id"), "label"), "id").select(F.col("id").alias("row_idx"), "label", "features")


def check_training(rows: DataFrame) -> dict:
    """Chips per feature type; fails without positives, notes when there are few."""
    counts = {r["feature_type"]: r["n"] for r in rows.filter("label = 1").groupBy("feature_type").agg(F.count("*").alias("n")).orderBy("feature_type").collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("there are no positive chips")
    return {"positives": counts, "few": total < FEW_POSITIVES}


def evaluate(chip_rows: DataFrame, models: dict, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """model and its metrics on the hold-out; each model adds ``predicted`` to the rows."""
    held = written(evaluation.holdout(chip_rows, "row_idx", share, seed).withColumn("truth", F.least("label", F.lit(1))), "held")
    out = None
    for name, score in models.items():
        one = evaluation.confusion(score(held), "truth", "predicted").select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _at(spark: SparkSession, lon: float, lat: float) -> DataFrame:
    """id, x, y of one point."""
    return spark.createDataFrame([(0, lon, lat)], "id long, lon double, lat double").select("id", to_grid(F.col("lon"), F.col("lat")).alias("g")).select("id", F.col("g.e").alias("x"), F.col("g.n").alias("y"))


def covering_raster(spark: SparkSession, rasters: DataFrame, lon: float, lat: float) -> Row:
    """The first raster that covers a point; fails where none does."""
    tile = chips.covering(_at(spark, lon, lat), extents(rasters)).select("region")
    found = rasters.join(tile, F.col("path") == F.col("region"), "left_semi").first()
    if found is None:
        raise ValueError("no raster covers the point")
    return found


def diagnose(spark: SparkSession, rasters: DataFrame, pixels: DataFrame, lon: float, lat: float) -> tuple[DataFrame, DataFrame]:
    """The chip around a point, moved inside the first raster that covers it: (its pixels, its features and band statistics)."""
    mine = rasters.filter(F.col("path") == covering_raster(spark, rasters, lon, lat)["path"])
    px = chips.chip_pixels(chips.clamped(_at(spark, lon, lat), mine), pixels)
    n = F.lit(TILE)
    marked = px.withColumn("is_center", spectral.center(F.col("y"), F.col("x"), n, n))
    bands = px.agg(*(f(b).alias(f"{b}_{k}") for b in spectral.BANDS for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    return px, spectral.features(marked, "id").join(bands)
