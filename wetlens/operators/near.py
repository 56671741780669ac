"""Points near other points, and the region that contains a point.

:func:`near_pairs` is a dual-tree join in two tiers.  The upper tier is a quadtree of
DataFrames: square nodes split only where they hold too many points, and pairs of nodes
descend together, compared by their bounding boxes.  The lower tier runs in tasks: one
leaf node with some of the points other leaves have within the radius of its box, searched by
:mod:`wetlens.operators.dualtree`.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.operators import dualtree
from wetlens.session import written

#: Side of the upper tree's largest nodes in metres; each level has a quarter of it.
TOP = 4096.0
LEVELS = 8
#: Points a leaf may hold before it is split (the last level into blocks of rows), and foreign points a task may get.
CAP = 20_000
#: Coordinates from which a position counts as none; nothing on Earth lies there.
FAR = 2.0**27 - 1
#: Bits of a node's number: level, column and row of its largest node, four for each step down.
_LEVEL, _COLUMN, _ROW = 60, 44, 28


def _node(level: int, x: Column, y: Column, top: float) -> Column:
    side = F.lit(top / 4**level)
    fx, fy = F.floor(x / side).cast("long"), F.floor(y / side).cast("long")
    key = F.lit(level * 2**_LEVEL) + (F.shiftright(fx, 2 * level) + F.lit(2**15)) * F.lit(2**_COLUMN) + (F.shiftright(fy, 2 * level) + F.lit(2**15)) * F.lit(2**_ROW)
    for step in range(1, level + 1):
        down = 2 * (level - step)
        key = key + (F.shiftright(fx, down).bitwiseAND(3) * 4 + F.shiftright(fy, down).bitwiseAND(3)) * F.lit(2 ** (_ROW - 4 * step))
    return key


def _ancestor(leaf: Column, level: int) -> Column:
    """The node of a level that holds a leaf, or the leaf itself once it is no deeper."""
    kept = 2**_LEVEL - 2 ** (_ROW - 4 * level)
    return F.when(F.shiftright(leaf, _LEVEL) <= level, leaf).otherwise(leaf.bitwiseAND(F.lit(kept)) + F.lit(level * 2**_LEVEL))


def _gap2(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    dx = F.greatest(F.lit(0.0), ax0 - bx1, bx0 - ax1)
    dy = F.greatest(F.lit(0.0), ay0 - by1, by0 - ay1)
    return dx * dx + dy * dy


def _leaves(points: DataFrame, top: float, cap: int) -> tuple[DataFrame, int]:
    """points with leaf (long) and blk (int), and the number of levels that were split.

    A node is split while it holds more than ``cap`` points.  Nodes of the last level
    that still do are cut into blocks of rows by a hash of the id.  Counts are combined
    before they are shuffled; the tables of split nodes have at most one row in ``cap``
    points and join without hints, so the optimizer sizes them.
    """
    pts = points.withColumn("leaf", _node(0, F.col("x"), F.col("y"), top)).withColumn("blk", F.lit(0))
    hot = written(pts.groupBy("leaf").count().filter(F.col("count") > cap), "hot")
    level = 0
    while level + 1 < LEVELS and not hot.isEmpty():
        level += 1
        pts = (
            pts.join(hot.select("leaf", F.lit(True).alias("_hot")), "leaf", "left")
            .withColumn("leaf", F.when(F.col("_hot"), _node(level, F.col("x"), F.col("y"), top)).otherwise(F.col("leaf")))
            .drop("_hot")
        )
        hot = written(pts.filter(F.col("leaf") >= level * 2**_LEVEL).groupBy("leaf").count().filter(F.col("count") > cap), "hot")
    if level + 1 == LEVELS and not hot.isEmpty():
        # six standard deviations below the cap, so that no block exceeds it
        parts = hot.select("leaf", F.ceil(F.col("count") / max(1.0, cap - 6 * math.sqrt(cap))).cast("long").alias("_n"))
        pts = pts.join(parts, "leaf", "left").withColumn("blk", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_n")), F.lit(0)).cast("int")).drop("_n")
    return pts, level


_BOX = ("x0", "y0", "x1", "y1")


def _boxes(df: DataFrame, *keys: str) -> DataFrame:
    lo, hi = (F.min, F.max)
    return df.groupBy(*keys).agg(lo("x0").alias("x0"), lo("y0").alias("y0"), hi("x1").alias("x1"), hi("y1").alias("y1"), F.sum("n").alias("n"))


def _leaf_pairs(pts: DataFrame, split: int, radius: float, top: float) -> DataFrame:
    """Pairs of leaf nodes whose boxes come within the radius: (leaf, blk, box) of a and (b, bblk, n) of b.

    The descent: nodes of level k that are leaves stay, others are replaced by their
    children of level k + 1; pairs of nodes too far apart are dropped at each level.
    """
    leaves = written(_boxes(pts.select("leaf", "blk", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(1).alias("n")), "leaf", "blk"), "leaves")
    leaf = F.col("leaf")
    reach = int(np.ceil(radius / top))
    near = _gap2(*(F.col(f"a.{c}") for c in _BOX), *(F.col(f"b.{c}") for c in _BOX)) <= radius * radius
    node = _boxes(leaves.withColumn("node", _ancestor(leaf, 0)), "node")
    steps = F.array(*(F.lit(dx * 2**_COLUMN + dy * 2**_ROW) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if (dx, dy) >= (0, 0)))
    front = (
        node.withColumn("to", F.explode(F.transform(steps, lambda s: s + F.col("node"))))
        .alias("a")
        .join(node.alias("b"), F.col("a.to") == F.col("b.node"))
        .filter(near)
        .select(F.col("a.node").alias("p"), F.col("b.node").alias("q"))
    )
    for level in range(1, split + 1):
        front = written(front, "front")
        node = written(_boxes(leaves.withColumn("up", _ancestor(leaf, level - 1)).withColumn("node", _ancestor(leaf, level)), "up", "node"), "nodes")
        front = (
            front.join(node.alias("a"), F.col("p") == F.col("a.up"))
            .join(node.alias("b"), F.col("q") == F.col("b.up"))
            .filter(near & ((F.col("p") < F.col("q")) | (F.col("a.node") <= F.col("b.node"))))
            .select(F.least("a.node", "b.node").alias("p"), F.greatest("a.node", "b.node").alias("q"))
        )
    # nodes to their blocks: one block each but for crowded nodes of the last level
    return (
        front.join(leaves.alias("a"), F.col("p") == F.col("a.leaf"))
        .join(leaves.alias("b"), F.col("q") == F.col("b.leaf"))
        .filter(near & ((F.col("p") < F.col("q")) | (F.col("a.blk") < F.col("b.blk"))))
        .select("a.leaf", "a.blk", *(F.col(f"a.{c}") for c in _BOX), F.col("b.leaf").alias("b"), F.col("b.blk").alias("bblk"), F.col("b.n").alias("n"))
    )


def _within(radius: float) -> Column:
    """Whether the point x, y lies within the radius of the box x0, y0, x1, y1."""
    x, y = F.col("x"), F.col("y")
    return _gap2(*(F.col(c) for c in _BOX), x, y, x, y) <= radius * radius


def dealt(points: DataFrame, radius: float, cap: int = CAP, top: float = TOP) -> DataFrame:
    """points (id, x, y) dealt to search tasks: columns owner, oblk, part, core, id, x, y.

    Each point is core (True) in its own leaf's tasks; it is also sent, core False, to every leaf of
    a smaller number whose box it lies within ``radius`` of.  The foreign points of a leaf are
    cut into parts by the leaf they come from, and each part is a task with the leaf's core; part 0
    is there for every leaf and also pairs its core with itself.  So each pair within
    the radius meets in exactly one task, and a task has at most ``cap`` core and ``cap`` foreign
    points, however many lie on one spot.  NULL coordinates are not allowed.
    """
    top = max(top, float(radius))
    pts, split = _leaves(written(points, "points"), top, cap)
    pairs = written(_leaf_pairs(pts, split, radius, top), "leafpairs")
    owner = ["leaf", "blk"]
    # the leaves foreign points may come from can hold more than the strip within the radius: there it is counted
    crowded = written(pairs.groupBy(*owner).agg(F.sum("n").alias("most")).filter(F.col("most") > cap // 2).select(*owner), "crowded")
    if not crowded.isEmpty():
        unsure = pairs.drop("n").join(crowded, owner, "left_semi")
        here = pts.select(F.col("leaf").alias("b"), F.col("blk").alias("bblk"), "x", "y")
        strip = here.join(unsure, ["b", "bblk"]).filter(_within(radius)).groupBy(*owner, "b", "bblk").agg(F.count("*").alias("n"))
        pairs = pairs.join(crowded, owner, "left_anti").unionByName(unsure.join(strip, [*owner, "b", "bblk"]))
    before = W.partitionBy(*owner).orderBy("b", "bblk")
    alone = F.col("n") > cap // 2
    part = F.when(alone, -F.sum(alone.cast("long")).over(before)).otherwise(F.floor((F.sum(F.when(alone, 0).otherwise(F.col("n"))).over(before) - F.col("n")) / max(1, cap // 2)))
    pairs = written(pairs.withColumn("part", part.cast("long")), "parts")
    everywhere = (F.lit(-math.inf), F.lit(-math.inf), F.lit(math.inf), F.lit(math.inf))
    parts = pairs.filter("part != 0").select(*owner, "part").distinct().unionByName(pts.select(*owner, F.lit(0).cast("long").alias("part")).distinct())
    own = parts.select(*owner, F.col("leaf").alias("owner"), F.col("blk").alias("oblk"), "part", F.lit(True).alias("core"), *(v.alias(c) for v, c in zip(everywhere, _BOX)))
    foreign = pairs.select(F.col("b").alias("leaf"), F.col("bblk").alias("blk"), F.col("leaf").alias("owner"), F.col("blk").alias("oblk"), "part", F.lit(False).alias("core"), *_BOX)
    return pts.join(own.unionByName(foreign), owner).filter(_within(radius)).select("owner", "oblk", "part", "core", "id", "x", "y")


_PAIRS = T.StructType([T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType())])


def _search(radius: float, own: bool, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of a task's core, if ``own``, and of its core with its foreign points, a batch at a time."""
    ids, x, y, core = (table.column(c).to_numpy() for c in ("id", "x", "y", "core"))
    ids_c, xc, yc = ids[core], x[core], y[core]
    ids_h, xh, yh = ids[~core], x[~core], y[~core]
    found = ((ids_c[i], ids_c[j]) for i, j in dualtree.pairs(xc, yc, radius)) if own else ()
    for some in (found, ((ids_c[i], ids_h[j]) for i, j in dualtree.pairs(xc, yc, radius, xh, yh))):
        for a, b in some:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["id_a", "id_b"])


def positions(points: DataFrame, id: str = "id", x: str = "x", y: str = "y", more: tuple[str, ...] = ()) -> DataFrame:
    """id (long), x, y (and ``more`` columns) of the rows that have an id and two coordinates within ``FAR``."""
    pts = points.select(F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *more)
    return pts.filter(functools.reduce(operator.and_, (F.col(c).between(-FAR, FAR) for c in "xy")) & F.col("id").isNotNull())


def near_pairs(points: DataFrame, radius: float, id: str = "id", x: str = "x", y: str = "y", cap: int = CAP, top: float = TOP) -> DataFrame:
    """Pairs of points at most ``radius`` apart: (id_a, id_b), id_a < id_b, each once.

    ``id`` is a unique whole number.  Rows with a NULL, NaN or infinite coordinate (or one
    beyond ``FAR``) or a NULL id are near nothing.  Equal positions are near each other.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    limit = float(radius)

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(limit, key[2].as_py() == 0, pa.Table.from_batches(list(batches)))

    return dealt(positions(points, id, x, y), radius, cap, top).groupBy("owner", "oblk", "part").applyInArrow(search, _PAIRS)


def containing(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The rectangle that contains each point: (id, region), NULL region where none does.

    ``points``: id (unique), x, y.  ``regions``: region, x0, y0, x1, y1 (x0 <= x < x1, y0 <= y < y1).
    A region belongs to the grid whose cells, of 2**k metres, are no smaller than it, so it lies in
    at most four of them; a point looks up its cell of every grid that has regions.  Of several regions
    that contain a point the smallest counts.  Points without a position have NULL; regions
    with a NULL or NaN corner contain nothing; repeated regions count once.
    """
    pts = points.select(F.col("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    boxes = regions.select("region", *_BOX).distinct().filter(functools.reduce(operator.and_, (F.col(c).between(-FAR, FAR) for c in _BOX)) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    grid = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))).cast("int")
    at = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("long")
    k = F.col("k")
    tiles = boxes.withColumn("k", grid).withColumn("cx", F.explode(F.sequence(at("x0", k), at("x1", k)))).withColumn("cy", F.explode(F.sequence(at("y0", k), at("y1", k))))
    grids = [r[0] for r in tiles.select("k").distinct().collect()]  # at most 28
    cells = F.array(*(F.struct(F.lit(g).alias("k"), at("x", F.lit(g)).alias("cx"), at("y", F.lit(g)).alias("cy")) for g in grids)) if grids else F.array(F.lit(None).cast("struct<k:int,cx:bigint,cy:bigint>"))
    ok = F.col("x").between(-FAR, FAR) & F.col("y").between(-FAR, FAR)
    keyed = pts.withColumn("c", F.explode_outer(F.when(ok, cells))).select("id", "x", "y", "c.*")
    x, y = F.col("x"), F.col("y")
    hit = (F.col("x0") <= x) & (x < F.col("x1")) & (F.col("y0") <= y) & (y < F.col("y1"))
    return keyed.join(tiles, ["k", "cx", "cy"], "left").groupBy("id").agg(F.min(F.when(hit, F.col("region"))).alias("region"))
