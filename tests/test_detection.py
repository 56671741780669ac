"""Detection end to end on small rasters, against direct computation."""

import json
import math
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wetlens import pipeline
from wetlens.functions import labels as L
from wetlens.functions import spectral
from wetlens.functions.geo import position, to_grid, to_lonlat
from wetlens.models import forest, head
from wetlens.operators import agreement, blocks, cuts, evaluation, regions, windows
from wetlens.operators.negatives import sample
from wetlens.sinks import files as out
from wetlens.sinks import kml as sink
from wetlens.sources import files, kml, vectors

R1 = ("r1", 3067, 327488.0, 6821512.0, 1.0, 1024, 1024, 3)


def rasters(spark, *rows):
    return spark.createDataFrame(list(rows), files.RASTER)


def px(spark, chip, key="c"):
    b, h, w = chip.shape
    y, x = np.mgrid[:h, :w]
    import pandas as pd

    d = pd.DataFrame({"path": key, "y": y.ravel(), "x": x.ravel(), **{n: chip[i].ravel().astype(int) for i, n in enumerate(("nir", "red", "grn"))}})
    return spark.createDataFrame(d)


def direct(a):
    """The 18 features of a region, directly."""
    a = a.astype(float)
    out = []
    for b in a:
        out += [b.mean(), b.std(), np.percentile(b, 25), np.percentile(b, 75)]
    for i, cut in (((a[0] - a[1]) / (a[0] + a[1] + 1e-6), 0.2), ((a[2] - a[0]) / (a[2] + a[0] + 1e-6), 0.0)):
        out += [i.mean(), i.std(), (i > cut).mean()]
    return out


def test_features_of_constant_and_halved_chips(spark):
    golden = [((150, 50, 100), 0.5, 1, -0.2, 0), ((100, 100, 100), 0, 0, 0, 0), ((50, 80, 150), -0.230769, 0, 0.5, 1), ((200, 100, 50), 0.333333, 1, -0.6, 0), ((30, 40, 180), -0.142857, 0, 0.714286, 1), ((200, 40, 80), 0.666667, 1, -0.428571, 0), ((0, 0, 0), 0, 0, 0, 0)]
    for bands, ndvi, plants, ndwi, water in golden:
        p = px(spark, np.full((3, 8, 8), 0) + np.array(bands)[:, None, None]).withColumn("is_center", F.lit(True))
        f = spectral.features(p, "path").first()["features"]
        assert len(f) == 36 and f[:18] == f[18:]
        assert np.allclose([f[12], f[14], f[15], f[17]], [ndvi, plants, ndwi, water], atol=1e-5)
    half = np.zeros((3, 64, 128), int)
    half[:, :, :64], half[:, :, 64:] = np.array([30, 40, 180])[:, None, None], np.array([200, 40, 80])[:, None, None]
    f = spectral.features(px(spark, half).withColumn("is_center", F.lit(False)), "path").first()["features"]
    assert f[:18] == [None] * 18
    assert np.allclose(f[18:], [115, 85, 30, 200, 40, 0, 40, 40, 130, 50, 80, 180, 0.261905, 0.404762, 0.5, 0.142857, 0.571429, 0.5], atol=1e-5)


def test_center_clamps_on_small_chips(spark):
    for n, want in ((512, 64), (63, 63), (40, 40)):
        d = spark.range(n).select(F.col("id").alias("y"))
        lit = F.lit(n)
        assert d.filter(spectral.center(F.col("y"), lit / 2, lit, lit)).count() == want


@pytest.mark.parametrize("label,p,thr,min_area,n", [(1, 0.9, 0.5, 500.0, 1), (0, 0.9, 0.5, 500.0, 0), (1, 0.9, 0.95, 500.0, 0), (1, 0.9, 0.5, 1e12, 0)])
def test_window_detection_with_a_mock(spark, label, p, thr, min_area, n):
    r = rasters(spark, R1)
    w = windows.masked_windows(r, None)
    assert w.count() == 16
    scored = forest.detected(w.withColumns({"predicted": F.lit(label), "confidence": F.lit(p)}), thr)
    boxes = scored.withColumn("cand_id", F.xxhash64("row_off", "col_off"))
    found = regions.merge_windows(boxes, r, ["path"], min_area).collect()
    assert len(found) == n
    if n:
        assert found[0]["area_m2"] == 1048576.0 and abs(found[0]["confidence"] - 0.9) < 1e-12


def test_merge_of_windows(spark):
    r = rasters(spark, ("a", 3067, 0.0, 1024.0, 1.0, 1024, 1024, 3))

    def merge(*boxes, min_area=200.0):
        b = spark.createDataFrame([("a", i, c, float(x0), float(y0), float(x1), float(y1)) for i, (x0, y0, x1, y1, c) in enumerate(boxes)], "path string, cand_id long, confidence double, xmin double, ymin double, xmax double, ymax double")
        return sorted((x["area_m2"], round(x["confidence"], 6)) for x in regions.merge_windows(b, r, ["path"], min_area).collect())

    assert merge() == []
    assert merge((0, 0, 256, 256, 0.8), (256, 0, 512, 256, 0.9)) == [(131072.0, 0.85)]
    assert merge((0, 0, 256, 256, 0.8), (256, 256, 512, 512, 0.9)) == [(65536.0, 0.85)] * 2
    assert merge((0, 0, 256, 256, 0.8), min_area=1e6) == []


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        cells = sorted({tuple(c) for c in rng.integers(0, 25, (n, 2)).tolist()})
        got = {(r["r"], r["c"]): r["comp"] for r in regions.components(spark.createDataFrame([("t", *c) for c in cells] * 2, "tile string, r int, c int"), "tile").collect()}
        want, left = {}, set(cells)
        while left:
            start = min(left)
            todo = [start]
            left.discard(start)
            while todo:
                y, x = todo.pop()
                want[y, x] = start[0] * 2**31 + start[1]
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
        assert got == want


def test_score_regions_nulls_and_touching(spark):
    s = spark.createDataFrame([("t", 0, 0, 0.9), ("t", 0, 1, 0.7), ("t", 1, 1, 0.3), ("t", 3, 3, None), ("t", 5, 5, float("nan"))], "path string, r int, c int, p double")
    r = regions.score_regions(s, ["path"], 1024.0, 0.7, 500.0).collect()
    assert [(x["n_cells"], round(x["confidence"], 6)) for x in r] == [(2, 0.8)]  # 0.7 counts, as float32
    t = regions.score_regions(s, ["path"], 1024.0, 0.7, 500.0, touching=True).first()
    assert abs(t["confidence"] - 1.9 / 3) < 1e-9
    with pytest.raises(ValueError):
        regions.dense_cells(s, 0.0)


def test_outline_leaves_holes_out():
    cells = np.array([(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)])
    (ring,) = regions.outlines(cells[:, 0], cells[:, 1])
    assert ring[0] == ring[-1] and set(ring) == {(0, 0), (3, 0), (3, 3), (0, 3)}
    # cells that touch at a corner are two parts
    assert [set(p) for p in regions.outlines(np.array([0, 1]), np.array([0, 1]))] == [{(0, 0), (1, 0), (1, 1), (0, 1)}, {(1, 1), (2, 1), (2, 2), (1, 2)}]
    assert regions.outlines(np.zeros(0, int), np.zeros(0, int)) == []


def test_two_models_by_boxes(spark):
    t = "path string, cand_id long, confidence double, xmin double, ymin double, xmax double, ymax double"
    A, B, C, D = (1, 0.6, 0, 0, 10, 10), (2, 0.9, 5, 0, 15, 10), (3, 0.8, 8, 0, 18, 10), (4, 0.7, 14, 0, 24, 10)

    def merged(rf, cnn):
        d = lambda rows: spark.createDataFrame([("a", i, c, *map(float, b)) for i, c, *b in rows], t)
        return sorted((r["model_type"], r["area_m2"], r["confidence"]) for r in agreement.first_match(d(rf), d(cnn), "cand_id", ["path"]).collect())

    assert merged([A], [B]) == [("both", 150.0, 0.9)]
    assert merged([A], []) == [("rf", 100.0, 0.6)]
    assert merged([], [B]) == [("cnn", 100.0, 0.9)]
    assert merged([A], [B, C]) == [("both", 150.0, 0.9), ("cnn", 100.0, 0.8)]
    assert merged([A, D], [B]) == [("both", 150.0, 0.9), ("both", 190.0, 0.9)]


def test_two_models_by_cells(spark):
    r = rasters(spark, ("a", 3067, 0.0, 600.0, 1.0, 600, 600, 3))
    t = "path string, comp long, confidence double, r long, c long"
    rf = spark.createDataFrame([("a", 1, 0.6, 0, 4), ("a", 2, 0.7, 9, 9)], t)
    cnn = spark.createDataFrame([("a", 1, 0.9, 0, 0), ("a", 7, 0.8, 2, 0)], t)
    facts, cells = agreement.merge_regions(rf, cnn, r)
    got = {x["roi"]: (x["model_type"], x["area_m2"], x["confidence"]) for x in facts.collect()}
    assert got == {"rf-1": ("both", 256.0 * 256 + 64 * 64, 0.9), "rf-2": ("rf", 4096.0, 0.7), "cnn-7": ("cnn", 256.0 * 88, 0.8)}
    assert cells.groupBy("path", "roi", "r", "c").count().filter("count > 1").isEmpty()


def test_masks(spark):
    r = rasters(spark, R1, ("far", 3067, 0.0, 1024.0, 1.0, 1024, 1024, 3))
    s = spark.createDataFrame([(327490.0, 6821500.0, 327600.0, 6821400.0, "x"), (None, 1.0, 2.0, 3.0, None)], "x1 double, y1 double, x2 double, y2 double, layer string")
    got = windows.masked_windows(r, s).groupBy("path").count().collect()
    assert {x["path"]: x["count"] for x in got} == {"r1": 1, "far": 16}  # no watercourse near: scanned whole
    rng = np.random.default_rng(0)
    b = rng.uniform(0, 3000, (300, 2))
    seg = rng.uniform(0, 3000, (40, 2)).repeat(2, 1).reshape(-1, 2, 2).transpose(0, 2, 1).reshape(-1, 4) + rng.uniform(-200, 200, (40, 4))
    boxes = spark.createDataFrame([(i, *map(float, (x, y, x + 60, y + 40))) for i, (x, y) in enumerate(b)], "id long, xmin double, ymin double, xmax double, ymax double")
    segs = spark.createDataFrame([tuple(map(float, v)) for v in seg], "x1 double, y1 double, x2 double, y2 double")
    got = {x["id"] for x in windows.near_segments(boxes, segs, ["id"]).collect()}

    def near(box, v):
        t = np.linspace(0, 1, 4001)
        px_, py = v[0] + t * (v[2] - v[0]), v[1] + t * (v[3] - v[1])
        dx, dy = np.maximum(0, np.maximum(box[0] - px_, px_ - box[0] - 60)), np.maximum(0, np.maximum(box[1] - py, py - box[1] - 40))
        return np.sqrt(dx**2 + dy**2).min()

    d = {i: min(near(q, v) for v in seg) for i, q in enumerate(b)}
    assert {i for i, v in d.items() if v < 49.8} <= got <= {i for i, v in d.items() if v <= 50.0}


def test_dense_features_equal_direct_ones(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (3, 150, 210))
    r = rasters(spark, ("c", 3067, 0.0, 150.0, 1.0, 210, 150, 3))
    got = {(x["pr"], x["pc"]): x["features"] for x in blocks.dense_features(r, px(spark, a)).collect()}
    assert set(got) == {(i, j) for i in range(3) for j in range(4)}
    big = np.pad(a, ((0, 0), (224, 512), (224, 512)), mode="edge")
    for i, j in ((0, 0), (1, 2), (2, 3)):
        ctx = big[:, 64 * i : 64 * i + 512, 64 * j : 64 * j + 512]
        own = ctx[:, 224:288, 224:288]
        assert np.allclose(got[i, j], direct(own) + direct(ctx), atol=1e-6)


def test_patches_cut_in_the_decoding_task(spark, tmp_path):
    """The same features as those of pixel rows."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (3, 150, 210)).astype(np.uint8)
    np.save(tmp_path / "a.npy", a)
    path = f"file:{tmp_path}/a.npy"
    want = {(x["pr"], x["pc"]): x["features"] for x in blocks.dense_features(rasters(spark, (path, 3067, 0.0, 150.0, 1.0, 210, 150, 3)), px(spark, a, path)).collect()}
    places = spark.createDataFrame([(path, r, c) for r, c in want if (r, c) != (1, 1)], "path string, pr int, pc int")
    got = {(x["pr"], x["pc"]): x["features"] for x in cuts.patches(spark, str(tmp_path), places).collect()}
    assert set(got) == set(want) - {(1, 1)} and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_detect_on_files(spark, tmp_path):
    """Rasters on disk to KML: a wet square in dry land is found by the forest."""
    rng = np.random.default_rng(0)
    a = rng.integers(60, 100, (3, 256, 256))
    a[:, 64:192, 64:192] = np.stack([rng.integers(30, 60, (128, 128)), rng.integers(40, 80, (128, 128)), rng.integers(150, 200, (128, 128))])
    np.save(tmp_path / "t.npy", a.astype(np.uint8))
    (tmp_path / "t.json").write_text(json.dumps({"epsg": 3067, "x0": 328000.0, "y0": 6821256.0, "res": 1.0, "width": 256, "height": 256, "bands": 3}))
    r, p = files.rasters(spark, str(tmp_path)), files.pixels(spark, str(tmp_path))
    assert p.count() == 256 * 256
    f = blocks.dense_features(r, p).withColumn("label", (F.col("pr").between(1, 2) & F.col("pc").between(1, 2)).cast("int"))
    f = f.cache()
    model = forest.train(f, trees=20, depth=5)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    one, two = (sorted(map(tuple, forest.predict(m, f).select("pr", "pc", "predicted", "p1").collect())) for m in (model, again))
    assert one == two
    found = pipeline.detect_dense(r, p, lambda d: forest.predict(again, d))
    rois = pipeline.outlined(found, r, 64, "rf")
    x = rois.first()
    assert rois.count() == 1 and x["area_m2"] == 128.0 * 128
    assert {(q["x"], q["y"]) for q in x["geom"]} == {(328064.0, 6821192.0), (328192.0, 6821192.0), (328192.0, 6821064.0), (328064.0, 6821064.0)}
    assert sink.write(rois, str(tmp_path / "new/folder/out.kml")) == 1
    assert len(ET.parse(tmp_path / "new/folder/out.kml").getroot().findall(f".//{{{sink.NAMESPACE}}}Polygon")) == 1
    (tmp_path / "t.json").write_text(json.dumps({"epsg": 4326, "x0": 0, "y0": 0, "res": 1, "width": 256, "height": 256, "bands": 3}))
    with pytest.raises(Exception, match="reference system"):
        files.rasters(spark, str(tmp_path)).collect()


def test_kml_sink(spark, tmp_path):
    box = lambda: [{"x": x, "y": y} for x, y in ((328000.0, 6821000.0), (328256.0, 6821000.0), (328256.0, 6821256.0), (328000.0, 6821256.0), (328000.0, 6821000.0))]
    t = "roi_idx long, geom array<struct<x double, y double>>, confidence double, area_m2 double, model_type string"
    rois = spark.createDataFrame([(i, box(), c, 65536.0, m) for i, (c, m) in enumerate(((0.85, None), (0.65, None), (0.45, None), (0.125, "both"), (0.5, "other")))], t)
    assert sink.write(rois, str(tmp_path / "a.kml")) == 5
    root = ET.parse(tmp_path / "a.kml").getroot()
    n = f"{{{sink.NAMESPACE}}}"
    assert [e.text for e in root.iter(f"{n}styleUrl")] == ["#flood_high", "#flood_medium", "#flood_low", "#model_both", "#flood_low"]
    assert len(root.findall(f".//{n}Style")) == 6
    names = [e.text for e in root.iter(f"{n}name")][1:]
    assert names[0] == "Flooded area 1" and names[3] == "Flooded area 4 [BOTH]"
    assert "Confidence: 0.12\nArea: 65536 m²" in [e.text for e in root.iter(f"{n}description")][3]
    for c in root.iter(f"{n}coordinates"):
        for lon, lat, _ in (map(float, v.split(",")) for v in c.text.split()):
            assert 19 < lon < 32 and 59 < lat < 71
    assert sink.write(rois.limit(0), str(tmp_path / "b.kml")) == 0


def test_projection(spark):
    d = spark.createDataFrame([(23.761, 61.498, 327615.2683, 6822542.5762), (25.123, 62.456, 403170.2545, 6926387.1595), (27.0, 60.0, 500000.0, 6651411.1902)], "lon double, lat double, e double, n double")
    for r in d.select("*", to_grid(F.col("lon"), F.col("lat")).alias("g"), to_lonlat(F.col("e"), F.col("n")).alias("b")).collect():
        assert abs(r["g"]["e"] - r["e"]) < 1e-3 and abs(r["g"]["n"] - r["n"]) < 1e-3
        assert abs(r["b"]["lon"] - r["lon"]) < 1e-8 and abs(r["b"]["lat"] - r["lat"]) < 1e-8


def test_position_readings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(328000.0, 6821000.0, True), (6821000.0, 328000.0, True), (23.76965008, 61.48434523, True), (61.48434523, 23.76965008, True), (0.0, 0.0, False), (nan, 6821000.0, False), (inf, inf, False), (None, 1.0, False), (9999999.0, -1.0, False), (100000.0, 6821000.0, False)]
    d = spark.createDataFrame(rows, "x double, y double, ok boolean")
    for r in d.select("ok", position(F.col("x"), F.col("y")).alias("p")).collect():
        assert (r["p"] is not None) == r["ok"]
        if r["ok"]:
            assert abs(r["p"]["e"] - 328000) < 0.01 and abs(r["p"]["n"] - 6821000) < 0.01


def test_labels_from_kml_and_kmz(spark, tmp_path):
    def doc(inner, ns=' xmlns="http://www.opengis.net/kml/2.2"'):
        return f'<?xml version="1.0"?><kml{ns}><Document>{inner}</Document></kml>'

    text = doc(
        "<Placemark><name> Wet_Forest </name><Point><coordinates>23.761,61.498,0</coordinates></Point></Placemark>"
        "<Placemark><Point><coordinates>23.761,61.498</coordinates></Point></Placemark>"
        "<Placemark><name>none</name></Placemark>"
        "<Placemark><name>bad</name><Point><coordinates>x,y 23.5</coordinates></Point></Placemark>"
        "<Placemark><name>  </name><MultiGeometry><LineString><coordinates>0,0 2,2</coordinates></LineString><Point><coordinates>23.761,61.498</coordinates></Point></MultiGeometry></Placemark>"
        "<Placemark><name>dam</name><LineString><coordinates>23.7,61.4 23.9,61.6</coordinates></LineString></Placemark>"
    )
    (tmp_path / "a.kml").write_text(text)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("files/x.txt", "no")
        z.writestr("doc.kml", text)
    rows = kml.labels(kml.read(spark, str(tmp_path)), "path", "place").collect()
    one = {r["place"]: (r["feature_type"], r["x"]) for r in rows if r["path"].endswith("kml")}
    two = {r["place"]: (r["feature_type"], r["x"]) for r in rows if r["path"].endswith("kmz")}
    assert one == two
    assert {k: v[0] for k, v in one.items()} == {0: "wet_forest", 1: "unknown", 4: "", 5: "dam"}
    assert all(100000 < v[1] < 800000 for v in one.values())
    assert abs(one[4][1] - one[0][1]) < 1e-6  # the point in the collection counts
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("x.txt", "no")
    with pytest.raises(Exception, match="no .kml file"):
        kml.read(spark, str(tmp_path)).collect()


def test_label_map_and_tier(spark):
    d = spark.createDataFrame([("negative", 0.9), ("wet_forest", 0.8), ("beaver_flood", 0.79), ("unknown", 0.6), ("dam", 0.59), (None, None), ("Dam", float("nan"))], "k string, c double")
    got = d.select(L.label(F.col("k")).alias("l"), L.tier(F.col("c")).alias("t")).collect()
    assert [r["l"] for r in got] == [0, 1, 1, 1, 2, 2, 2]
    assert [r["t"] for r in got] == ["high", "high", "medium", "medium", "low", "low", "low"]


def test_chips_and_training_set(spark, tmp_path):
    r = rasters(spark, R1)
    near = spark.createDataFrame([(1, 328000.0, 6821000.0), (2, 329000.0 + 100, 6821000.0), (3, 327488.0 - 200, 6821000.0)], "id long, x double, y double")
    from wetlens.operators.chips import centred, chip_name, clamped

    got = {x["id"]: (x["col_off"], x["row_off"]) for x in centred(near, r).collect()}
    assert got == {1: (256, 256), 3: (-200 - 256, 256)}
    assert {x["id"]: x["col_off"] for x in clamped(near, r).collect()} == {1: 256, 3: 0}
    one = spark.createDataFrame([("/a/t.x.jp2", 1, 7), ("s", 0, 12345), ("q.jp2", 5, 1)], "p string, l int, i int")
    assert [x[0] for x in one.select(chip_name(F.col("p"), F.col("l"), F.col("i"))).collect()] == ["t.x_dam_0007.npy", "s_neg_12345.npy", "q_pos_0001.npy"]
    labels = spark.createDataFrame([(328000.0, 6821000.0, "wet_forest"), (328000.0, 6821000.0, "dam"), (328000.0, 6821000.0, "old"), (328000.0, 6821000.0, "lodge"), (1.0, 1.0, "beaver_flood")], "x double, y double, feature_type string")
    s = spark.createDataFrame([(327600.0, 6820600.0, 328400.0, 6821400.0)], "x1 double, y1 double, x2 double, y2 double")
    rows = pipeline.training_set(r, labels, s, n_negatives=2).orderBy("row_idx").collect()
    assert [x["label"] for x in rows].count(0) == 2 and {x["feature_type"] for x in rows} == {"wet_forest", "old", "negative"}
    assert [x["row_idx"] for x in rows] == list(range(len(rows)))
    assert rows[0]["label"] == 2 or rows[0]["label"] == 1
    out.write_manifest(spark.createDataFrame([(x["row_idx"], x["chip"], x["label"], x["feature_type"], x["x"], x["y"]) for x in rows], "row_idx long, path string, label int, feature_type string, x double, y double"), str(tmp_path / "m.csv"))
    assert files.manifest(spark, str(tmp_path / "m.csv")).count() == len(rows)
    assert pipeline.check_training(spark.createDataFrame(rows))["few"]
    with pytest.raises(ValueError):
        pipeline.check_training(spark.createDataFrame(rows).filter("label = 0"))


def test_negatives(spark):
    r = rasters(spark, ("a", 3067, 320000.0, 6825000.0, 1.0, 10000, 10000, 3))
    s = spark.createDataFrame([(321000.0, 6816000.0, 329000.0, 6824000.0)], "x1 double, y1 double, x2 double, y2 double")
    a, b = (sorted(map(tuple, sample(r, s, 20).collect())) for _ in range(2))
    assert len(a) == 20 and a == b
    assert all(320000 <= x <= 330000 and 6815000 <= y <= 6825000 for _, x, y in a)
    assert all(abs((x - 321000) - (y - 6816000)) / math.sqrt(2) <= 50.0001 for _, x, y in a)
    assert sample(r, s.limit(0), 5).isEmpty() and sample(r, None, 5).count() == 5 and sample(r.limit(0), None, 5).isEmpty()


def test_metrics_and_splits(spark):
    for t, p, want in (([1, 1, 0, 0], [1, 0, 1, 0], (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)), ([0, 0], [0, 0], (0, 2, 0, 0, 1, 0, 0, 0)), ([1, 0], [2, 0], (0, 1, 0, 0, 1, 0, 0, 0))):
        d = spark.createDataFrame(list(zip(t, p)), "t int, p int")
        assert tuple(evaluation.confusion(d, "t", "p").first()) == pytest.approx(want)
    for n in (0, 1, 3, 1000):
        d = spark.range(n)
        held = {r[0] for r in evaluation.holdout(d, "id").collect()}
        assert len(held) == (max(1, n // 5) if n else 0)
        assert held == {r[0] for r in evaluation.holdout(d.repartition(7), "id").collect()}
    e = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, 0.1)], "epoch int, val_acc double")
    assert tuple(evaluation.best_epoch(e).first()) == (2, 0.9)
    w = {r["label"]: r["weight"] for r in evaluation.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int"), "label").collect()}
    assert w == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}


def test_forest_on_separable_chips(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(20):
        wet = i < 10
        a = np.stack([rng.integers(30, 60, 64), rng.integers(40, 80, 64), rng.integers(150, 200, 64)]) if wet else rng.integers(60, 100, (3, 64))
        rows.append((i, int(wet), [float(v) for v in direct(a) * 2]))
    d = spark.createDataFrame(rows, "id int, label int, features array<double>")
    m = forest.train(d, trees=20, depth=5)
    got = forest.predict(m, d).collect()
    assert all(r["predicted"] == r["label"] and 0 <= r["confidence"] <= 1 for r in got)
    with pytest.raises(ValueError):
        forest.train(d.filter("label = 1"))


def test_head(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    y = (x[:, 0] > 0).astype(int)
    w, log = head.fit(x, y, epochs=40, hidden=32, rate=0.01)
    assert len(log) == 40 and (head.forward(x, w).argmax(1) == y).mean() > 0.9
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    got = head.predict(d, w).orderBy("id").collect()
    assert [r["predicted"] for r in got] == head.forward(x, w).argmax(1).tolist()
    # the gradient, against differences
    g, _ = head._gradient(x[:20], y[:20], w, 0.0, rng)
    for k in ("scale", "w1", "b2"):
        at = (0,) * w[k].ndim
        loss = []
        for s in (1e-5, -1e-5):
            v = {**w, k: w[k].copy()}
            v[k][at] += s
            loss.append(-np.log(head.forward(x[:20], v)[np.arange(20), y[:20]]).mean())
        assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-5
    a = np.arange(3 * 4 * 4).reshape(3, 4, 4)
    assert np.allclose(head.resized(a, 4), a) and head.tensor(a, side=2).shape == (3, 2, 2)
    assert head.augmented(head.tensor(a, side=4), rng).shape == (3, 4, 4)
    chips = spark.createDataFrame([("a", 3, 4, 4, bytearray(a.astype(np.uint8).tobytes()))], "chip_id string, bands int, h int, w int, data binary")
    e = head.encode(chips, lambda t: t.reshape(len(t), -1)[:, :5]).first()
    assert len(e["embedding"]) == 5


def test_vectors(spark, tmp_path):
    import sqlite3
    import struct

    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {}, "geometry": {"type": "LineString", "coordinates": [[23.76965008, 61.48434523], [23.77421137, 61.48675347]]}}, {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[24, 61], [24.1, 61], [24.1, 61.1], [24, 61]]]}}]}))
    line = struct.pack("<BII4d", 1, 2, 2, 328000.0, 6821000.0, 328256.0, 6821256.0)
    with sqlite3.connect(tmp_path / "b.gpkg") as c:
        c.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT); CREATE TABLE gpkg_spatial_ref_sys (srs_id INT, organization_coordsys_id INT); INSERT INTO gpkg_spatial_ref_sys VALUES (3067, 3067)")
        for name in ("jarvi", "virtavesikapea"):
            c.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (name,))
            c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 3067)", (name,))
            c.execute(f"CREATE TABLE {name} (geom BLOB)")
            c.execute(f"INSERT INTO {name} VALUES (?)", (b"GP\0\1" + struct.pack("<i", 3067) + line,))
    (tmp_path / "note.txt").write_text("x")
    body = struct.pack("<i4d2ii4d", 3, 0, 0, 1, 1, 1, 2, 0, 328000.0, 6821000.0, 328256.0, 6821256.0)
    (tmp_path / "c.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    (tmp_path / "c.prj").write_text('PROJCS["ETRS89_TM35FIN"]')
    got = vectors.stream_segments(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["file"].rpartition("/")[2], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a.geojson": 4, "b.gpkg": 1, "c.shp": 1}
    assert by["b.gpkg"][0]["layer"] == "virtavesikapea"
    for k in by:
        assert abs(by[k][0]["x1"] - 328000) < 0.01 and abs(by[k][0]["y2"] - 6821256) < 0.01
    assert vectors.centrelines(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.gpkg").unlink()
    assert vectors.centrelines(spark, str(tmp_path)) is None
    (tmp_path / "c.prj").unlink()
    with pytest.raises(Exception, match="reference system"):
        vectors.stream_segments(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        vectors.stream_segments(spark, str(tmp_path / "empty"))


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    np.save(tmp_path / "d/x.npy", np.arange(48, dtype=np.uint8).reshape(3, 4, 4))
    assert files.listing(spark, str(tmp_path), ".NPY").count() == 1
    assert files.chips(spark, str(tmp_path)).first()["h"] == 4
    stats = spectral.norm_stats(files.pixels(spark, str(tmp_path)))
    want = out.write_norm_stats(stats, str(tmp_path / "s/n.json"))
    got = files.norm_stats(spark, str(tmp_path / "s/n.json")).first()
    a = np.arange(48).reshape(3, -1) / 255
    assert got["mean"] == want["mean"] == pytest.approx(a.mean(1)) and got["std"] == pytest.approx(a.std(1))
    p = files.pixels(spark, str(tmp_path)).withColumn("name", F.lit("y.npy"))
    assert out.write_chips(p, str(tmp_path / "o"), 4).count() == 1
    assert np.array_equal(np.load(tmp_path / "o/y.npy"), np.load(tmp_path / "d/x.npy"))
    s = out.preview(p).agg(F.min("nir"), F.max("grn")).first()
    assert s[0] == 0 and s[1] == pytest.approx(1, abs=1e-6)


def test_streaming(spark, tmp_path):
    from wetlens.streaming import watch

    rasters(spark, R1).write.json(str(tmp_path / "in"))
    q = watch(spark, str(tmp_path / "in"), windows.windows, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 16


def test_cli_guards():
    from wetlens.cli import checked, parser

    with pytest.raises(SystemExit):
        checked(parser().parse_args(["detect", "--imagery", "a", "--output", "b", "--method", "rf"]))
    with pytest.raises(SystemExit):
        checked(parser().parse_args(["detect", "--imagery", "a", "--output", "b", "--method", "both", "--rf-model", "m"]))
    assert checked(parser().parse_args(["detect", "--imagery", "a", "--output", "b", "--rf-model", "m"])).threshold == 0.5


def test_cuts(spark, tmp_path, monkeypatch):
    """Windows and chips cut in the decoding task, against the pixels as rows."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (3, 80, 100)).astype(np.uint8)
    np.save(tmp_path / "a.npy", a)
    at = f"file:{tmp_path}/a.npy"
    places = spark.createDataFrame([(at, 0, 0, "x"), (at, -30, 60, "y"), (at, 500, 0, "z"), (f"file:{tmp_path}/none.npy", 0, 0, "n")], "path string, row_off int, col_off int, name string")
    monkeypatch.setattr(cuts, "PER_TASK", 2)
    c = cuts.cut(spark, str(tmp_path), places, 70)
    got = {r["name"]: np.frombuffer(r["data"], np.uint8).reshape(3, 70, 70) for r in c.collect()}
    assert set(got) == {"x", "y", "z"} and np.array_equal(got["x"], a[:, :70, :70]) and not got["z"].any()
    assert np.array_equal(got["y"][:, 30:, :40], a[:, :40, 60:]) and not got["y"][:, :30].any() and not got["y"][:, :, 40:].any()
    f = {r["name"]: r["features"] for r in cuts.features(c).collect()}
    rows = px(spark, got["x"].astype(int)).withColumn("is_center", spectral.center(F.col("y"), F.col("x"), F.lit(70), F.lit(70)))
    assert f["x"] == pytest.approx(spectral.features(rows, "path").first()["features"]) and f["x"] == pytest.approx(direct(got["x"][:, 3:67, 3:67]) + direct(got["x"]))
    s = cuts.statistics(c.filter("name = 'x'")).first()
    assert s["mean"] == pytest.approx((got["x"] / 255).mean((1, 2))) and s["std"] == pytest.approx((got["x"] / 255).std((1, 2)))
    assert cuts.features(c.limit(0)).count() == 0


def test_commands_end_to_end(spark, tmp_path, capsys, monkeypatch):
    """From files alone: train, cnn-train, detect with either model and both, evaluate, embed, diagnose."""
    from wetlens import cli

    rng = np.random.default_rng(1)
    a = rng.integers(60, 100, (3, 1024, 1024))
    a[:, 256:768, 256:768] = np.stack([rng.integers(30, 60, (512, 512)), rng.integers(40, 80, (512, 512)), rng.integers(150, 200, (512, 512))])
    (tmp_path / "img").mkdir()
    np.save(tmp_path / "img/t.npy", a.astype(np.uint8))
    (tmp_path / "img/t.json").write_text(json.dumps({"epsg": 3067, "x0": 327488.0, "y0": 6821512.0, "res": 1.0, "width": 1024, "height": 1024, "bands": 3}))
    places = spark.createDataFrame([(328000.0 + d, 6821000.0 + e) for d in (-9, 0, 9) for e in (-9, 0, 9)], "e double, n double").select(to_lonlat(F.col("e"), F.col("n")).alias("p")).select("p.*").collect()
    marks = "".join(f"<Placemark><name>wet_forest</name><Point><coordinates>{p['lon']!r},{p['lat']!r},0</coordinates></Point></Placemark>" for p in places)
    (tmp_path / "l.kml").write_text(f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>')
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)

    def run(*args):
        cli.main([str(x) for x in args])
        return capsys.readouterr().out

    io = ("--imagery", tmp_path / "img", "--labels", tmp_path / "l.kml")
    text = run("train", *io, "--model", tmp_path / "rf", "--manifest", tmp_path / "m.csv", "--chips", tmp_path / "chips")
    assert "wet_forest: 9 chips" in text and len(list((tmp_path / "chips").glob("*.npy"))) == 18
    text = run("cnn-train", *io, "--model", tmp_path / "cnn", "--norm-stats", tmp_path / "n.json", "--epochs", 20, "--lr", 0.01)
    assert "epoch 19" in text and len(json.loads((tmp_path / "n.json").read_text())["mean"]) == 3
    cnn, rf = ("--cnn-model", tmp_path / "cnn", "--norm-stats", tmp_path / "n.json"), ("--rf-model", tmp_path / "rf")
    text = run("detect", "--imagery", tmp_path / "img", "--output", tmp_path / "o.kml", "--method", "both", *rf, *cnn, "--windows")
    assert "windows passed" in text and "placemarks" in text and (tmp_path / "o.kml").exists()
    assert "patches to be scored" in run("detect", "--imagery", tmp_path / "img", "--output", tmp_path / "p.kml", *rf)
    text = run("evaluate", "--manifest", tmp_path / "m.csv", "--chips", tmp_path / "chips", *rf, *cnn, "--test-fraction", 0.5)
    assert "rf" in text and "cnn" in text
    run("embed", "--chips", tmp_path / "chips", "--output", tmp_path / "e", "--norm-stats", tmp_path / "n.json")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 18
    text = run("diagnose", "--imagery", tmp_path / "img", "--model", tmp_path / "rf", "--lon", places[0]["lon"], "--lat", places[0]["lat"], "--out", tmp_path / "c.png")
    assert "dam" in text


def test_diagnosis_and_evaluation(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (3, 64, 64))
    r = rasters(spark, ("c", 3067, 327968.0, 6821032.0, 1.0, 64, 64, 3))
    p, f = pipeline.diagnose(spark, r, px(spark, a), 23.76965008, 61.48434523)
    assert p.count() == 64 * 64 and f.first()["nir_max"] == a[0].max()
    with pytest.raises(ValueError):
        pipeline.diagnose(spark, r, px(spark, a), 27.0, 60.0)
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "row_idx long, label int")
    m = pipeline.evaluate(rows, {"all": lambda d: d.withColumn("predicted", F.lit(1)), "right": lambda d: d.withColumn("predicted", F.col("truth"))}).collect()
    assert {x["model"]: x["tp"] + x["tn"] + x["fp"] + x["fn"] for x in m} == {"all": 10, "right": 10}
    assert [x["accuracy"] for x in m if x["model"] == "right"] == [1.0]
