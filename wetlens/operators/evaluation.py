"""Hold-outs, splits, samples and metrics, deterministic at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wetlens.constants import SEED, TEST_SHARE


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A whole number below 2**32 from md5 of the seed and the keys, the same in any engine."""
    parts = [F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def first_by_draw(rows: DataFrame, key: str, share: float, seed: int = SEED) -> tuple[DataFrame, int]:
    """rows with ``picked``: True for max(1, int(n * share)) of them, in the order of their draws.

    The bound of the draw is found by counting in 4096 classes and sorting only within
    the class it falls into, so the rows are never sorted or gathered as a whole.
    """
    d = rows.withColumn("_d", draw(seed, key))
    sums = {r[0]: r[1] for r in d.groupBy(F.shiftright("_d", 20).alias("c")).count().collect()}
    n = sum(sums.values())
    want = max(1, int(n * share)) if n else 0
    left, cls = want, -1
    for c in sorted(sums):
        if left <= sums[c]:
            cls = c
            break
        left -= sums[c]
    in_class = F.shiftright("_d", 20) == cls
    rank = d.filter(in_class).select(F.col(key).alias("_k"), F.row_number().over(W.orderBy("_d", key)).alias("_r")).filter(F.col("_r") <= left)
    picked = (F.shiftright("_d", 20) < cls) | F.col("_r").isNotNull()
    return d.join(rank, d[key] == rank["_k"], "left").withColumn("picked", F.coalesce(picked, F.lit(False))).drop("_d", "_k", "_r"), want


def holdout(rows: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """The hold-out rows: exactly max(1, int(n * share)) of n."""
    return first_by_draw(rows, key, share, seed)[0].filter("picked").drop("picked")


def confusion(rows: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    """keys, tp, tn, fp, fn, accuracy, precision, recall, f1; labels other than 0 and 1 count nowhere."""
    t, p = F.col(truth), F.col(predicted)
    c = rows.groupBy(*keys).agg(*(F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))))
    total = F.greatest(F.lit(1), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    precision, recall = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    c = c.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / total, "precision": precision, "recall": recall})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n_rows, weight: n / (classes * rows of the class)."""
    per = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    all_ = per.agg(F.sum("n_rows").alias("n"), F.count("*").alias("k"))
    return per.join(F.broadcast(all_)).select("label", "n_rows", (F.col("n") / (F.col("k") * F.col("n_rows"))).alias("weight"))


def best_epoch(epochs: DataFrame, *keys: str) -> DataFrame:
    """keys, epoch, val_acc of the best accuracy; of equal ones the last."""
    return epochs.groupBy(*keys).agg(F.max(F.struct("val_acc", "epoch")).alias("b")).select(*keys, "b.epoch", "b.val_acc")


def cosine_rate(start: float, epoch: Column, epochs: int) -> Column:
    """The learning rate of an epoch, annealed from ``start`` to 0 along a half cosine."""
    return F.lit(start / 2) * (F.lit(1.0) + F.cos(F.pi() * epoch / epochs))


def uniform_points(spark, bounds: tuple[float, float, float, float], attempts: int, seed: int = SEED) -> DataFrame:
    """attempt, x, y: points spread evenly over the bounds, the same for the same seed."""
    x0, y0, x1, y1 = bounds
    part = lambda name, lo, hi: F.lit(lo) + draw(seed, F.col("attempt"), F.lit(name)) / F.lit(2.0**32) * F.lit(hi - lo)
    return spark.range(attempts).select(F.col("id").alias("attempt"), part("x", x0, x1).alias("x"), part("y", y0, y1).alias("y"))
