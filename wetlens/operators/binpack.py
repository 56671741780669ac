"""Packing items into bins of one capacity, in tasks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.session import written

#: Bins filled to less than this share are packed again with those of other tasks.
GOOD = 0.98
#: A turn that fills bins with less than this share of its items is the last one.
LEAST_GAIN = 0.25

_PACKED = T.StructType([T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bin", T.StringType()), T.StructField("full", T.BooleanType())])


def tasks_for(n: int, total: int, capacity: int, bins_per_task: int, items_per_task: int) -> int:
    """Tasks among which ``n`` items are dealt by hash, so that none gets more than ``items_per_task``.

    The mean lies six standard deviations below the bound.
    """
    mean = max(1.0, items_per_task - 6 * math.sqrt(items_per_task))
    return max(1, -(-total // (capacity * bins_per_task)), math.ceil(n / mean) if n > items_per_task else 1)


def packed(items: DataFrame, capacity: int, fit: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]], bins_per_task: int, items_per_task: int, good: float = GOOD) -> DataFrame:
    """(id, size, bin) of ``items`` (id, size), each once.

    Items are dealt at random to tasks; ``fit`` packs a task's sizes and returns the bin
    number of each and the room left per bin.  Items of bins that stayed badly filled
    are dealt again, among as many tasks as their number asks for, until one task is enough
    or a turn gains too little: items that no partner fits (all just over half a bin, say)
    stay as they are.  So no task ever holds more than ``items_per_task`` items, and beside one
    task for all items each task of the last turn wastes at most about one bin.
    """
    todo = written(items.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")), "items")
    n, total = todo.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    done: list[DataFrame] = []
    while True:
        tasks = tasks_for(n, total, capacity, bins_per_task, items_per_task)
        out = written(_turn(todo, capacity, fit, tasks, len(done), good), "packed")
        left = out.filter(~F.col("full"))
        n_left, total = left.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if tasks == 1 or n_left == 0 or n - n_left < LEAST_GAIN * n:
            done.append(out.select("id", "size", "bin"))
            break
        done.append(out.filter("full").select("id", "size", "bin"))
        todo, n = left.select("id", "size"), n_left
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _turn(todo: DataFrame, capacity: int, fit: Callable, tasks: int, turn: int, good: float) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        of, room = fit(table.column("size").to_numpy(), capacity)
        return pa.table({"id": table.column("id"), "size": table.column("size"), "bin": [f"{turn}-{key[0].as_py()}-{b}" for b in of], "full": (room <= capacity * (1 - good))[of]})

    dealt = todo.withColumn("task", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(run, _PACKED)
