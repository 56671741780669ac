"""Queries on detections, regions, models and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.models import forest, head
from wetlens.operators import evaluation as E
from wetlens.operators import regions as R
from wetlens.operators.agreement import first_match, meeting
from wetlens.operators.windows import usable
from wetlens.functions import spectral
from wetlens.plans.proxies import GRID_SQL, grid, px
from wetlens.session import load, written

CUT, CELL_M2 = 0.8, 1024.0


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that count; of repeated windows the first."""
    c = R.candidates(load(spark, sf_dir, "candidate"), 0.5)
    key = ["path", "model", "xmin", "ymin", "xmax", "ymax"]
    return c.groupBy(*key).agg(F.min(F.struct("cand_id", "confidence")).alias("f")).select(*key, "f.cand_id", "f.confidence")


def flt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidates(load(spark, sf_dir, "candidate"), 0.7).select("cand_id", "model", "confidence")


def flt_dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches at or above the threshold, per tile."""
    return R.dense_cells(grid(spark, sf_dir), 0.7).groupBy("tile").agg(F.count("*").alias("n"), F.round(R.exact_mean(F.col("p")), 6).alias("mean_p"))


def cc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each detected patch."""
    return R.components(R.dense_cells(grid(spark, sf_dir), CUT), "tile")


def roi_area_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of at least 2000 square metres, with the mean probability of their patches."""
    r = R.score_regions(grid(spark, sf_dir), ["tile"], CELL_M2, CUT, 2000.0)
    return r.select("tile", "comp", "n_cells", "area_m2", F.round("confidence", 6).alias("confidence"))


def roi_zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all patches that touch the region."""
    r = R.score_regions(grid(spark, sf_dir), ["tile"], CELL_M2, CUT, 2000.0, touching=True)
    return r.select("tile", "comp", F.round("confidence", 6).alias("confidence"))


def roi_merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of overlapping candidate windows per raster and model."""
    r = R.merge_windows(_boxes(spark, sf_dir), usable(load(spark, sf_dir, "raster")), ["path", "model"])
    return r.select("path", "model", "comp", "area_m2", "n_candidates", F.round("confidence", 6).alias("confidence"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return first_match(b.filter("model = 'rf'").drop("model"), b.filter("model = 'cnn'").drop("model"), "cand_id", ["path"])


def jn_merge_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' windows reconciled."""
    return _merged(spark, sf_dir).select("path", "rf_id", "cnn_id", "model_type", F.round("confidence", 6).alias("confidence"), "area_m2")


def agg_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("model_type").agg(F.count("*").alias("n"))


def set_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cnn windows that no rf window meets."""
    b = _boxes(spark, sf_dir)
    rf, cnn = b.filter("model = 'rf'").drop("model"), b.filter("model = 'cnn'").drop("model")
    met = meeting(rf, cnn, ["path"]).select(F.col("b_cand_id").alias("cand_id"))
    return cnn.select("cand_id").join(met, "cand_id", "left_anti")


def set_union_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both kinds together, numbered from 0 within each kind."""
    m = load(spark, sf_dir, "manifest")
    pos, neg = m.filter("label >= 1").select("row_idx", F.lit("positive").alias("kind")), m.filter("label = 0").select("row_idx", F.lit("negative").alias("kind"))
    return pos.unionByName(neg).groupBy("kind").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))


def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a rule (the file's tag) against the label, per subset."""
    m = load(spark, sf_dir, "manifest").filter("path is not null and label is not null and subset is not null")
    m = m.select("subset", F.least("label", F.lit(1)).alias("truth"), F.when(F.lower("path").contains("_neg"), 0).otherwise(1).alias("pred"))
    c = E.confusion(m, "truth", "pred", "subset")
    return c.select("subset", "tp", "tn", "fp", "fn", *(F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")))


def agg_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.class_weights(load(spark, sf_dir, "manifest"), "label").select("label", "n_rows", F.round("weight", 8).alias("weight"))


def ord_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth of the manifest held out."""
    return E.holdout(load(spark, sf_dir, "manifest").select("row_idx"), "row_idx")


def ord_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation rows of the train subset."""
    rows = load(spark, sf_dir, "manifest").filter("subset = 'train'").select("row_idx")
    return E.first_by_draw(rows, "row_idx", 0.2, 7)[0].select("row_idx", F.when(F.col("picked"), "val").otherwise("train").alias("part"))


def _head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = [[math.sin(i) for i in range(64)], [math.cos(i) for i in range(64)]]
    return load(spark, sf_dir, "embeddings").select("vec_id", head.linear_softmax(F.col("embedding"), w, [0.1, -0.1]).alias("p"))


def fn_head_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of a linear head on the embeddings."""
    return _head_scores(spark, sf_dir).select("vec_id", F.round(F.element_at("p", 1), 6).alias("p0"), F.round(F.element_at("p", 2), 6).alias("p1"))


def ord_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelier class of each embedding and its probability."""
    return _head_scores(spark, sf_dir).select("vec_id", head.argmax(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence"))


def win_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best epoch of each event type, user_id standing for the epoch."""
    e = load(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("epoch")).agg(F.count("*").alias("val_acc"))
    return E.best_epoch(e, "event_type")


def mdl_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a forest trained on the pixel chips; label 1 where near infrared is above the mean."""
    chips = written(spectral.features(px(spark, sf_dir), "chip"), "chips")
    bright = F.col("features")[18]
    chips = chips.withColumn("label", (bright > F.lit(chips.agg(F.avg(bright)).first()[0])).cast("int"))
    model = forest.train(chips, trees=20, depth=5)
    return forest.predict(model, chips).select("chip", "label", "predicted", F.round("confidence", 6).alias("confidence"))


_DENSE = f"g AS ({GRID_SQL}), d AS (SELECT DISTINCT tile, r, c FROM g WHERE cast(p AS FLOAT) >= cast({CUT} AS FLOAT))"
_CC = f"""WITH RECURSIVE {_DENSE}, k AS (SELECT tile, r, c, r * 2147483648 + c AS id FROM d),
 e AS (SELECT a.tile, a.id AS u, b.id AS v FROM k a JOIN k b ON a.tile = b.tile AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
 t(tile, u, v) AS (SELECT tile, id, id FROM k UNION SELECT t.tile, t.u, e.v FROM t JOIN e ON t.tile = e.tile AND t.v = e.u),
 cc AS (SELECT tile, u, min(v) AS comp FROM t GROUP BY 1, 2), comps AS (SELECT k.tile, k.r, k.c, cc.comp FROM k JOIN cc ON k.tile = cc.tile AND k.id = cc.u)"""
_BOX = """b AS (SELECT path, model, xmin, ymin, xmax, ymax, min(cand_id) AS cand_id, arg_min(confidence, cand_id) AS confidence FROM candidate
  WHERE confidence IS NOT NULL AND cast(confidence AS VARCHAR) <> 'nan' AND confidence >= 0.5 GROUP BY 1, 2, 3, 4, 5, 6)"""
_PAIR = f"""{_BOX}, p AS (SELECT a.path, a.cand_id AS rf_id, c.cand_id AS cnn_id, greatest(a.confidence, c.confidence) AS confidence,
    (a.xmax - a.xmin) * (a.ymax - a.ymin) + (c.xmax - c.xmin) * (c.ymax - c.ymin) - greatest(0, least(a.xmax, c.xmax) - greatest(a.xmin, c.xmin)) * greatest(0, least(a.ymax, c.ymax) - greatest(a.ymin, c.ymin)) AS area_m2
  FROM b a JOIN b c ON a.path = c.path AND a.model = 'rf' AND c.model = 'cnn' AND a.xmin <= c.xmax AND c.xmin <= a.xmax AND a.ymin <= c.ymax AND c.ymin <= a.ymax),
 f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY rf_id ORDER BY cnn_id) = 1),
 m AS (SELECT path, rf_id, cnn_id, 'both' AS model_type, confidence, area_m2 FROM f
  UNION ALL SELECT path, cand_id, NULL, 'rf', confidence, (xmax - xmin) * (ymax - ymin) FROM b WHERE model = 'rf' AND cand_id NOT IN (SELECT rf_id FROM f)
  UNION ALL SELECT path, NULL, cand_id, 'cnn', confidence, (xmax - xmin) * (ymax - ymin) FROM b WHERE model = 'cnn' AND cand_id NOT IN (SELECT cnn_id FROM f))"""
_SCORES = ", ".join(f"{' + '.join(f'cast(embedding[{i + 1}] AS double) * cast({f(i)!r} AS double)' for i in range(64))} + {b} AS s{j}" for j, (f, b) in enumerate(((math.sin, 0.1), (math.cos, -0.1))))
_HEAD = f"WITH s AS (SELECT vec_id, {_SCORES} FROM embeddings), e AS (SELECT vec_id, exp(s0 - greatest(s0, s1)) AS e0, exp(s1 - greatest(s0, s1)) AS e1 FROM s), q AS (SELECT vec_id, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM e)"
_DRAW = lambda seed: f"cast(('0x' || substr(md5('{seed}|' || row_idx), 1, 8)) AS BIGINT)"
_CONF = """WITH m AS (SELECT subset, least(label, 1) AS truth, CASE WHEN lower(path) LIKE '%\\_neg%' ESCAPE '\\' THEN 0 ELSE 1 END AS pred FROM manifest WHERE path IS NOT NULL AND label IS NOT NULL AND subset IS NOT NULL),
 c AS (SELECT subset, count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn FROM m GROUP BY 1),
 d AS (SELECT *, (tp + tn) / greatest(1, tp + tn + fp + fn) AS accuracy, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall FROM c)
 SELECT subset, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(1e-9, precision + recall), 6) AS f1 FROM d"""

QUERIES = {
    f.__name__: f
    for f in (flt_candidates, flt_dense_threshold, cc_components, roi_area_conf, roi_zonal_mean, roi_merge_windows, jn_merge_first_match, agg_merge_counts, set_unmatched, set_union_labels, agg_confusion, agg_class_weights, ord_holdout, ord_split, fn_head_softmax, ord_argmax, win_best_epoch, mdl_rf)
}
_W = f"""WITH RECURSIVE {_BOX}, ra AS (SELECT DISTINCT path, x0, y0, res, width, height FROM raster WHERE epsg = 3067),
 g AS (SELECT b.path, model, cand_id, confidence, unnest(range(cast(round((y0 - ymax) / (256 * res)) AS BIGINT), cast(ceil((y0 - ymin) / (256 * res)) AS BIGINT))) AS r, cast(round((xmin - x0) / (256 * res)) AS BIGINT) AS ca, cast(ceil((xmax - x0) / (256 * res)) AS BIGINT) AS cb FROM b JOIN ra USING (path)),
 h AS (SELECT path, model, cand_id, confidence, r, unnest(range(ca, cb)) AS c FROM g), k AS (SELECT DISTINCT path, model, r, c, r * 2147483648 + c AS id FROM h),
 e AS (SELECT a.path, a.model, a.id AS u, b.id AS v FROM k a JOIN k b ON a.path = b.path AND a.model = b.model AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
 t(path, model, u, v) AS (SELECT path, model, id, id FROM k UNION SELECT t.path, t.model, t.u, e.v FROM t JOIN e ON t.path = e.path AND t.model = e.model AND t.v = e.u),
 cc AS (SELECT path, model, u, min(v) AS comp FROM t GROUP BY 1, 2, 3), cm AS (SELECT k.*, comp FROM k JOIN cc ON k.path = cc.path AND k.model = cc.model AND k.id = cc.u),
 ar AS (SELECT cm.path, cm.model, comp, sum(greatest(0, least(256, height - r * 256)) * res * greatest(0, least(256, width - c * 256)) * res) AS area_m2 FROM cm JOIN ra USING (path) GROUP BY 1, 2, 3),
 tc AS (SELECT DISTINCT h.path, h.model, comp, cand_id, confidence FROM h JOIN cm ON h.path = cm.path AND h.model = cm.model AND abs(h.r - cm.r) <= 1 AND abs(h.c - cm.c) <= 1)
 SELECT path, model, comp, area_m2, count(*) AS n_candidates, round(avg(confidence), 6) AS confidence FROM ar JOIN tc USING (path, model, comp) WHERE area_m2 >= 500 GROUP BY 1, 2, 3, 4"""
#: A mean that does not depend on the order of its rows.
_MEAN_P = "cast(sum(cast(p AS DECIMAL(28, 12))) AS DOUBLE) / count(p)"
SQL = {
    "flt_candidates": "SELECT cand_id, model, confidence FROM candidate WHERE confidence >= 0.7 AND cast(confidence AS VARCHAR) <> 'nan'",
    "flt_dense_threshold": f"WITH g AS ({GRID_SQL}) SELECT tile, count(*) AS n, round({_MEAN_P}, 6) AS mean_p FROM g WHERE cast(p AS FLOAT) >= cast(0.7 AS FLOAT) GROUP BY 1",
    "cc_components": f"{_CC} SELECT tile, r, c, comp FROM comps",
    "roi_area_conf": f"{_CC} SELECT comps.tile, comp, count(*) AS n_cells, count(*) * cast(1024 AS double) AS area_m2, round({_MEAN_P}, 6) AS confidence FROM comps JOIN g ON g.tile = comps.tile AND g.r = comps.r AND g.c = comps.c GROUP BY 1, 2 HAVING count(*) * 1024 >= 2000",
    "roi_zonal_mean": f"""{_CC}, big AS (SELECT tile, comp FROM comps GROUP BY 1, 2 HAVING count(*) * 1024 >= 2000),
      z AS (SELECT DISTINCT comps.tile, comp, g.r, g.c, g.p FROM comps JOIN big USING (tile, comp) JOIN g ON g.tile = comps.tile AND abs(g.r - comps.r) <= 1 AND abs(g.c - comps.c) <= 1) SELECT tile, comp, round({_MEAN_P}, 6) AS confidence FROM z GROUP BY 1, 2""",
    "roi_merge_windows": _W,
    "jn_merge_first_match": f"WITH {_PAIR} SELECT path, rf_id, cnn_id, model_type, round(confidence, 6) AS confidence, area_m2 FROM m",
    "agg_merge_counts": f"WITH {_PAIR} SELECT model_type, count(*) AS n FROM m GROUP BY 1",
    "set_unmatched": f"WITH {_PAIR} SELECT cand_id FROM b WHERE model = 'cnn' AND cand_id NOT IN (SELECT cnn_id FROM p)",
    "set_union_labels": "SELECT CASE WHEN label >= 1 THEN 'positive' ELSE 'negative' END AS kind, count(*) AS n, min(row_idx) AS first, max(row_idx) AS last FROM manifest WHERE label >= 0 GROUP BY 1",
    "agg_confusion": _CONF,
    "agg_class_weights": "WITH p AS (SELECT label, count(*) AS n_rows FROM manifest WHERE label IS NOT NULL GROUP BY 1) SELECT label, n_rows, round((SELECT sum(n_rows) FROM p) / ((SELECT count(*) FROM p) * n_rows), 8) AS weight FROM p",
    "ord_holdout": f"SELECT row_idx FROM manifest QUALIFY row_number() OVER (ORDER BY {_DRAW(42)}, row_idx) <= (SELECT greatest(1, cast(trunc(count(*) * 0.2) AS BIGINT)) FROM manifest)",
    "ord_split": f"WITH t AS (SELECT row_idx FROM manifest WHERE subset = 'train') SELECT row_idx, CASE WHEN row_number() OVER (ORDER BY {_DRAW(7)}, row_idx) <= (SELECT greatest(1, cast(trunc(count(*) * 0.2) AS BIGINT)) FROM t) THEN 'val' ELSE 'train' END AS part FROM t",
    "fn_head_softmax": f"{_HEAD} SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM q",
    "ord_argmax": f"{_HEAD} SELECT vec_id, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS predicted, round(greatest(p0, p1), 6) AS confidence FROM q",
    "win_best_epoch": "WITH e AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, user_id AS epoch, n AS val_acc FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id DESC) = 1",
}
