"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetlens.operators import dualtree
from wetlens.operators.skew import HOT, join_hot
from wetlens.session import dropped, written


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent), by pointer jumping: paths halve in each turn.

    Parents of very many nodes are dealt to parts, so a component may hold any share of the nodes.
    """
    crowded = parents.count() > HOT
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hot = None
        if crowded:
            hot = written(parents.groupBy("parent").count().filter(F.col("count") > HOT), "hot")
        new = written(join_hot(parents, up, ["parent"], hot, "node", "inner").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "jump")
        dropped(parents)
        parents = new
        if new.filter("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("root"))


#: Edges that one task may join by itself (16 bytes each).
SMALL = 1_000_000
_STARS = "node long, root long"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a task."""
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, at = np.unique(np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
    u, v = at[: len(table)], at[len(table) :]
    root = dualtree.components(len(nodes), iter([(u, v)]))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def connected(edges: DataFrame, u: str = "u", v: str = "v", small: int = SMALL) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes and roots are whole numbers.

    In each round every node hooks onto its smallest neighbour, pointer jumping turns the
    chains into stars, and the edges shrink to those between different stars; at least
    half of the stars that still have an edge merge.  Once no more than ``small`` edges are
    left, one task does the same to them.  All state is in written tables.
    Loops and repeated edges do no harm; edges with a NULL end are left out.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total = None
    while True:
        left = e.count()
        if left <= small:
            last = e.coalesce(1).mapInArrow(_joined, _STARS) if left else e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            last = written(last, "joined")
            return last if total is None else _moved(total, last) if left else total
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = written(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("parent"), F.count("*").alias("count")).withColumnRenamed("u", "node"), "hubs")
        stars = _jumped(written(nodes.select("node", "parent"), "parents"))
        total = stars if total is None else _moved(total, stars)
        hubs = nodes.filter(F.col("count") > HOT)
        hub = written(hubs.select("node", "count"), "hubs") if not hubs.isEmpty() else None
        a, b = (stars.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
        at_u, at_v = (None if hub is None else hub.withColumnRenamed("node", x) for x in "uv")
        moved = join_hot(join_hot(e, a, ["u"], at_u, "v", "inner"), b, ["v"], at_v, "u", "inner").filter("ru != rv")
        rest = written(moved.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), "edges")
        dropped(e, nodes)
        e = rest


def _moved(total: DataFrame, stars: DataFrame) -> DataFrame:
    """``total`` (node, root) with roots replaced by their own roots in ``stars``."""
    hot = written(total.groupBy("root").count().filter(F.col("count") > HOT), "hot") if total.count() > HOT else None
    return written(join_hot(total, stars.select(F.col("node").alias("root"), F.col("root").alias("up")), ["root"], hot, "node").select("node", F.coalesce("up", "root").alias("root")), "roots")
