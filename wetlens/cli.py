"""Commands: train, cnn-train, detect, evaluate, embed, diagnose.

Imagery is a folder of ``.npy`` rasters with ``.json`` metadata, labels are KML or KMZ,
watercourses GeoJSON, GeoPackage or shapefiles.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens import pipeline
from wetlens.constants import PATCH, STRIDE, TEST_SHARE, THRESHOLD
from wetlens.functions import labels
from wetlens.models import encoder, forest, head
from wetlens.operators import cuts
from wetlens.operators.windows import masked_windows
from wetlens.session import written
from wetlens.sinks import files as out
from wetlens.sinks import kml as kml_sink
from wetlens.sources import files, kml, vectors


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wetlens")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *required, **optional):
        s = sub.add_parser(name)
        for r in required:
            s.add_argument(f"--{r}", required=True)
        for o, (kind, default) in optional.items():
            s.add_argument(f"--{o.replace('_', '-')}", type=kind, default=default)
        return s

    add("train", "imagery", "labels", "model", hydro=(str, None), manifest=(str, None), chips=(str, None))
    add("cnn-train", "imagery", "labels", "model", "norm-stats", hydro=(str, None), epochs=(int, 30), lr=(float, 1e-3), rows=(int, 100_000), variants=(int, 1), encoder=(str, None))
    d = add("detect", "imagery", "output", hydro=(str, None), rf_model=(str, None), cnn_model=(str, None), norm_stats=(str, None), encoder=(str, None), threshold=(float, THRESHOLD))
    d.add_argument("--method", choices=("rf", "cnn", "both"), default="rf")
    d.add_argument("--windows", action="store_true", help="score the forest by windows instead of patches")
    add("evaluate", "manifest", "chips", rf_model=(str, None), cnn_model=(str, None), norm_stats=(str, None), encoder=(str, None), test_fraction=(float, TEST_SHARE))
    add("embed", "chips", "output", norm_stats=(str, None), encoder=(str, None))
    g = add("diagnose", "imagery", "model", out=(str, "chip.png"))
    g.add_argument("--lon", type=float, required=True)
    g.add_argument("--lat", type=float, required=True)
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Fails with a message where a method lacks its model."""
    if args.command == "detect":
        if args.method in ("rf", "both") and not args.rf_model:
            sys.exit("--rf-model is needed for this method")
        if args.method in ("cnn", "both") and not (args.cnn_model and args.norm_stats):
            sys.exit("--cnn-model and --norm-stats are needed for this method")
    if args.command == "evaluate" and args.cnn_model and not args.norm_stats:
        sys.exit("--norm-stats is needed with --cnn-model")
    return args


def _rasters(spark: SparkSession, folder: str) -> DataFrame:
    if not os.path.exists(folder):
        sys.exit(f"there is no imagery at {folder}")
    r = written(files.rasters(spark, folder), "rasters")
    if r.isEmpty():
        sys.exit(f"there is no imagery at {folder}")
    return r


def _segments(spark: SparkSession, place: str | None) -> DataFrame | None:
    return written(vectors.stream_segments(spark, place), "segments") if place else None


def _training(spark: SparkSession, args) -> tuple[DataFrame, DataFrame]:
    """The rows of the training set, and their chips cut out of the imagery."""
    r = _rasters(spark, args.imagery)
    places = written(kml.labels(kml.read(spark, args.labels)), "labels") if os.path.exists(args.labels) else None
    if places is None or places.isEmpty():
        sys.exit(f"there are no labels at {args.labels}")
    rows = written(pipeline.training_set(r, places, _segments(spark, args.hydro)), "training")
    report = pipeline.check_training(rows)
    for kind, n in sorted(report["positives"].items()):
        print(f"{kind}: {n} chips")
    if report["few"]:
        print("few positive chips: the model will be weak")
    chips = cuts.cut(spark, args.imagery, rows.select("path", "row_off", "col_off", F.col("chip").alias("name"), "label"))
    return rows, written(chips.drop("path", "row_off", "col_off"), "chips")


def train(spark: SparkSession, args) -> None:
    rows, chips = _training(spark, args)
    if args.manifest:
        out.write_manifest(rows.drop("path").withColumnRenamed("chip", "path"), args.manifest)
    if args.chips:
        print(f"{out.write_cuts(chips, args.chips).agg(F.count('*')).first()[0]} chips written")
    forest.train(cuts.features(chips)).write().overwrite().save(args.model)


def cnn_train(spark: SparkSession, args) -> None:
    """Fits the head on at most ``--rows`` embeddings of chips and their augmented variants, taken by hash."""
    _, chips = _training(spark, args)
    stats = out.write_norm_stats(cuts.statistics(chips), args.norm_stats)
    e = head.encode(chips, encoder.load(args.encoder), stats["mean"], stats["std"], variants=args.variants).withColumn("label", F.least("label", F.lit(1)))
    sample = written(e, "embeddings").orderBy(F.xxhash64("name", "variant")).limit(args.rows).toPandas()
    w, log = head.fit(np.stack(sample["embedding"].to_numpy()).astype(float), sample["label"].to_numpy(int), epochs=args.epochs, rate=args.lr)
    for row in log:
        print(f"epoch {row['epoch']}: loss {row['train_loss']:.4f}, accuracy {row['val_acc']:.3f}")
    os.makedirs(os.path.dirname(os.path.abspath(args.model)), exist_ok=True)
    np.savez(args.model, **w)


def _stats(path: str | None) -> tuple[list | None, list | None]:
    if not path:
        return None, None
    with open(path, encoding="utf-8") as f:
        s = json.load(f)
    return s["mean"], s["std"]


def embed(spark: SparkSession, args) -> None:
    """Embeddings of a folder of chips, as parquet: chip_id, embedding."""
    head.encode(files.chips(spark, args.chips), encoder.load(args.encoder), *_stats(args.norm_stats)).drop("variant").write.mode("overwrite").parquet(args.output)


def _head(path: str) -> dict:
    with np.load(path if path.endswith(".npz") else f"{path}.npz", allow_pickle=False) as f:
        return dict(f)


def _windows(spark: SparkSession, args, r: DataFrame, segments: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The windows of the mask, and their pixels; prints how many were checked."""
    w = written(masked_windows(r, segments), "windows")
    print(f"{masked_windows(r, None).count()} windows, {w.count()} of them to be scored")
    return w, cuts.cut(spark, args.imagery, w.select("path", "row_off", "col_off"))


def _reported(model: str, found: DataFrame) -> DataFrame:
    """The regions of a model, written; prints their number."""
    found = written(found, model)
    print(f"{model}: {found.select('path', 'comp').distinct().count()} regions")
    return found


def detect(spark: SparkSession, args) -> None:
    r = _rasters(spark, args.imagery)
    segments = _segments(spark, args.hydro)
    rf = cnn = None
    patch = not args.windows
    if args.method in ("rf", "both"):
        model = RandomForestClassificationModel.load(args.rf_model)
        if patch:
            places = written(pipeline.masked_patches(r, segments), "patches")
            print(f"{places.count()} patches to be scored")
            rf = pipeline.detect_patches(r, forest.predict(model, cuts.patches(spark, args.imagery, places)), args.threshold)
        else:
            w, chips = _windows(spark, args, r, segments)
            rf = pipeline.detect_scored(r, w, forest.predict(model, cuts.features(chips)), args.threshold)
        rf = _reported("rf", rf)
    if args.method in ("cnn", "both"):
        w, chips = _windows(spark, args, r, segments)
        e = head.encode(chips, encoder.load(args.encoder), *_stats(args.norm_stats))
        scored = written(head.predict(e, _head(args.cnn_model)).select("path", "row_off", "col_off", "predicted", "confidence"), "scored")
        print(f"{forest.detected(scored, args.threshold).count()} windows passed")
        cnn = _reported("cnn", pipeline.detect_scored(r, w, scored, args.threshold))
    if args.method == "both":
        rois = written(pipeline.both_models(rf if patch else pipeline.patches(rf, r), cnn, r), "rois")
        for kind, n in rois.groupBy("model_type").agg(F.countDistinct("region")).orderBy("model_type").collect():
            print(f"{kind}: {n} regions")
    else:
        # a run of one model is coloured by confidence
        rois = pipeline.outlined(rf if cnn is None else cnn, r, PATCH if cnn is None and patch else STRIDE, "")
    print(f"{kml_sink.write(rois, args.output)} placemarks")


def evaluate(spark: SparkSession, args) -> None:
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    # the hold-out depends on a chip's name only, not on where its row stands
    rows = files.manifest(spark, args.manifest).withColumn("path", name).withColumn("row_idx", F.xxhash64("path", "label", "feature_type", "x", "y"))
    chips = files.chips(spark, args.chips).withColumn("path", F.regexp_extract("chip_id", r"([^/]*)\z", 1)).drop("chip_id")
    models = {}
    if args.rf_model:
        model = RandomForestClassificationModel.load(args.rf_model)
        models["rf"] = lambda h: forest.predict(model, cuts.features(chips.join(h, "path")))
    if args.cnn_model:
        models["cnn"] = lambda h: head.predict(head.encode(chips.join(h, "path"), encoder.load(args.encoder), *_stats(args.norm_stats)), _head(args.cnn_model))
    if not models:
        sys.exit("a model is needed")
    pipeline.evaluate(rows, models, args.test_fraction).show(truncate=False)


def diagnose(spark: SparkSession, args) -> None:
    r = _rasters(spark, args.imagery)
    tile = pipeline.covering_raster(spark, r, args.lon, args.lat)
    # only the raster that covers the point is read
    px = files.pixels(spark, tile["path"], glob="*")
    chip, f = pipeline.diagnose(spark, r, px, args.lon, args.lat)
    scored = forest.predict(RandomForestClassificationModel.load(args.model), f).drop("features")
    scored.withColumn("class_name", labels.class_name(F.col("predicted"))).show(truncate=False)
    image = np.zeros((512, 512, 3))
    for p in out.preview(chip).select("y", "x", "nir", "red", "grn").toLocalIterator():
        image[p["y"], p["x"]] = p["nir"], p["red"], p["grn"]
    print(args.out if out.write_png(image, args.out) else "no image: matplotlib is not installed")


COMMANDS = {"train": train, "cnn-train": cnn_train, "detect": detect, "evaluate": evaluate, "embed": embed, "diagnose": diagnose}


def main(argv: list[str] | None = None) -> None:
    args = checked(parser().parse_args(argv))
    spark = SparkSession.builder.appName("wetlens").getOrCreate()
    COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main()
