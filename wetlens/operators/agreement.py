"""Reconciling the regions of two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetlens.constants import PATCH, STRIDE
from wetlens.session import written

CELL = 256.0
_EDGES = ("xmin", "ymin", "xmax", "ymax")


def meeting(first: DataFrame, second: DataFrame, keys: list[str], cell: float = CELL) -> DataFrame:
    """Pairs of boxes that meet (edges count): keys, then the columns of both with ``a_`` and ``b_`` before.

    Boxes are dealt to grid cells, and a pair counts only in the cell of the lower left
    corner of what they share, so no pair comes twice and no distinct is needed.  Boxes
    with a NULL edge meet none.
    """
    at = lambda v: F.floor(v / cell).cast("long")

    def dealt(df, p):
        d = df.filter(" and ".join(f"{e} is not null" for e in _EDGES)).select(*keys, *(F.col(c).alias(p + c) for c in df.columns if c not in keys))
        span = lambda lo, hi: F.explode(F.sequence(at(F.col(p + lo)), at(F.col(p + hi))))
        return d.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))

    p = dealt(first, "a_").join(dealt(second, "b_"), [*keys, "cx", "cy"])
    meet = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    mine = (at(F.greatest("a_xmin", "b_xmin")) == F.col("cx")) & (at(F.greatest("a_ymin", "b_ymin")) == F.col("cy"))
    return p.filter(meet & mine).drop("cx", "cy")


def _area(p: str = "") -> Column:
    return (F.col(f"{p}xmax") - F.col(f"{p}xmin")) * (F.col(f"{p}ymax") - F.col(f"{p}ymin"))


def first_match(rf: DataFrame, cnn: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """keys, rf_id, cnn_id, model_type, confidence, area_m2 of both models' boxes together.

    Each rf box takes the meeting cnn box of the smallest id, which several rf boxes may
    share: type ``both``, the larger confidence, the area of the union.  Other rf boxes
    stay ``rf``, cnn boxes that none has taken stay ``cnn``.
    """
    columns = [*keys, id, "confidence", *_EDGES]
    rf, cnn = rf.select(*columns), cnn.select(*columns)
    shared = F.greatest(F.lit(0.0), F.least("a_xmax", "b_xmax") - F.greatest("a_xmin", "b_xmin")) * F.greatest(F.lit(0.0), F.least("a_ymax", "b_ymax") - F.greatest("a_ymin", "b_ymin"))
    pairs = meeting(rf, cnn, keys).select(*keys, F.col(f"a_{id}").alias("rf_id"), F.col(f"b_{id}").alias("cnn_id"), F.greatest("a_confidence", "b_confidence").alias("conf"), (_area("a_") + _area("b_") - shared).alias("area"))
    taken = pairs.groupBy(*keys, "rf_id").agg(F.min(F.struct("cnn_id", "conf", "area")).alias("m")).select(*keys, "rf_id", "m.*")
    r = rf.select(*keys, F.col(id).alias("rf_id"), "confidence", _area().alias("own")).join(taken, [*keys, "rf_id"], "left")
    matched = F.col("cnn_id").isNotNull()
    first = r.select(*keys, "rf_id", "cnn_id", F.when(matched, "both").otherwise("rf").alias("model_type"), F.when(matched, F.col("conf")).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("area", "own").alias("area_m2"))
    left = cnn.select(*keys, F.col(id).alias("cnn_id"), "confidence", _area().alias("area_m2")).join(taken.select(*keys, "cnn_id"), [*keys, "cnn_id"], "left_anti")
    return first.unionByName(left.select(*keys, F.lit(None).cast("long").alias("rf_id"), "cnn_id", F.lit("cnn").alias("model_type"), "confidence", "area_m2"))


def merge_regions(rf: DataFrame, cnn: DataFrame, rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both models' regions, given as cells, reconciled per raster: (regions, their cells).

    ``rf`` and ``cnn``: path, comp, confidence and the cells r, c of each region, rf's of
    64 pixels and cnn's of 256.  On 64-pixel cells two regions meet if a cell of one
    touches a cell of the other, corners included; the order of cnn regions is that of
    ``comp``.  An rf cell counts whole even over the raster's edge, others by what is inside.
    Regions: path, roi, model_type, confidence, area_m2; cells: path, roi, r, c.
    """
    fine = STRIDE // PATCH
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(fine) for j in range(fine)))
    c = cnn.withColumn("d", F.explode(steps)).select("path", F.col("comp").alias("cnn"), (F.col("r") * fine + F.col("d.i")).alias("r"), (F.col("c") * fine + F.col("d.j")).alias("c"))
    dims = rasters.select("path", "res", "width", "height")
    c = c.join(dims, "path").filter((F.col("r") * PATCH < F.col("height")) & (F.col("c") * PATCH < F.col("width"))).select("path", "cnn", "r", "c")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    reach = rf.withColumn("d", F.explode(around)).select("path", F.col("comp").alias("rf"), (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).distinct()
    taken = written(reach.join(c, ["path", "r", "c"]).groupBy("path", "rf").agg(F.min("cnn").alias("cnn")), "taken")
    name = lambda *parts: F.concat_ws("-", *parts)
    mine = rf.select("path", F.col("comp").alias("rf"), "r", "c", "confidence").join(taken, ["path", "rf"], "left")
    own = mine.select("path", name(F.lit("rf"), "rf").alias("roi"), F.when(F.col("cnn").isNull(), "rf").otherwise("both").alias("model_type"), "r", "c", F.lit(True).alias("whole"))
    given = taken.join(c, ["path", "cnn"]).select("path", name(F.lit("rf"), "rf").alias("roi"), F.lit("both").alias("model_type"), "r", "c", F.lit(False).alias("whole"))
    left = c.join(taken, ["path", "cnn"], "left_anti").select("path", name(F.lit("cnn"), "cnn").alias("roi"), F.lit("cnn").alias("model_type"), "r", "c", F.lit(False).alias("whole"))
    cells = written(own.unionByName(given).unionByName(left).groupBy("path", "roi", "model_type", "r", "c").agg(F.max("whole").alias("whole")), "cells")
    size = lambda n, at: F.when(F.col("whole"), F.lit(PATCH)).otherwise(F.greatest(F.lit(0), F.least(F.lit(PATCH), F.col(n) - F.col(at) * PATCH))) * F.col("res")
    area = cells.join(dims, "path").groupBy("path", "roi", "model_type").agg(F.sum(size("height", "r") * size("width", "c")).alias("area_m2"))
    cc = cnn.select("path", F.col("comp").alias("cnn"), F.col("confidence").alias("other")).distinct()
    one = rf.select("path", F.col("comp").alias("rf"), "confidence").distinct().join(taken, ["path", "rf"], "left").join(cc, ["path", "cnn"], "left")
    conf = one.select("path", name(F.lit("rf"), "rf").alias("roi"), F.greatest("confidence", "other").alias("confidence"))
    alone = cc.join(taken, ["path", "cnn"], "left_anti").select("path", name(F.lit("cnn"), "cnn").alias("roi"), F.col("other").alias("confidence"))
    return area.join(conf.unionByName(alone), ["path", "roi"]), cells.select("path", "roi", "r", "c")
