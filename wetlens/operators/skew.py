"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may get.
HOT = 1_000_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, spread: str, how: str = "left", limit: int = HOT) -> DataFrame:
    """``left`` joined with ``right``, in which each key stands once.

    ``hot``: the keys with more than ``limit`` rows of ``left`` and their ``count``, or None if there are none.
    Their rows are dealt to parts by a hash of the column ``spread``, and the one row of ``right``
    is sent to each part.  NULL keys join nothing.
    """
    if hot is None or hot.isEmpty():
        return left.join(right, keys, how)
    parts = hot.select(*keys, F.ceil(F.col("count") / limit).cast("long").alias("_parts"))
    dealt = left.join(parts, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0))).drop("_parts")
    sent = right.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(sent, [*keys, "_part"], how).drop("_part")
