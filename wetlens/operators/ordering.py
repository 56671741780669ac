"""Numbering rows in a global order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wetlens.session import written


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of the columns ``order`` (NULL first), as a long.

    Rows are dealt to tasks by ranges of the order, counted per range, and numbered within it;
    what reaches the driver is one count per range.  Rows equal in ``order`` are numbered in any order among themselves.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dict(dealt.groupBy("_range").count().collect())
    starts, at = [], 0
    for r in sorted(counts):
        starts.append((r, at))
        at += counts[r]
    first = rows.sparkSession.createDataFrame(starts, "_range int, _first long")
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, within).join(first, "_range").withColumn(name, F.col(name) + F.col("_first")).drop("_range", "_first")
