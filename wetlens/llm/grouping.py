"""Splits that keep related records together: a persisted, growing table of components.

The table is a folder.  ``rows`` and ``cells`` of each batch are written once and never
changed; what later batches do to components of earlier ones is a small table of changes, component ->
(root, subset), that alone is written anew.  A version is one file that names the folders it
consists of; it is created only if it is not there, so readers see a whole version and of two
writers one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.functions.geo import position
from wetlens.llm.matching import blank, manifest_meanings, with_meaning
from wetlens.operators.graph import connected
from wetlens.operators.near import FAR
from wetlens.operators.skew import HOT, join_hot
from wetlens.session import create, dropped, file_system, load, read_text, shared_dir, written

RADIUS = 40.0
#: A component above one in LARGE of all rows is assigned by itself, smaller ones by bucket.
LARGE, BUCKETS = 10_000, 4096
QUARANTINE = "quarantine"
#: Pairs of points up to which two cells are compared point by point at once; beyond, their cells are halved first.
DIRECT = 1024
#: Cells along a side of the squares by which cells meet.
SQUARE = 24

_CELL = ["kind", "cx", "cy"]
_BOX = (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))


def _side(radius: float) -> float:
    """Side of a cell: its diagonal is half the radius, so the points of one cell, and of cells that touch, are all linked."""
    return radius / 8**0.5


def _celled(points: DataFrame, radius: float) -> DataFrame:
    side = F.lit(_side(radius))
    return points.withColumn("cx", F.floor(F.col("x") / side).cast("long")).withColumn("cy", F.floor(F.col("y") / side).cast("long"))


def _gap2(far: bool = False):
    """Squared distance of the boxes a and b: the least there can be between their points, or the most."""
    c = lambda t, n: F.col(f"{t}.{n}")
    if far:
        dx, dy = (F.greatest(c("a", f"{v}1") - c("b", f"{v}0"), c("b", f"{v}1") - c("a", f"{v}0")) for v in "xy")
    else:
        dx, dy = (F.greatest(F.lit(0.0), c("a", f"{v}0") - c("b", f"{v}1"), c("b", f"{v}0") - c("a", f"{v}1")) for v in "xy")
    return dx * dx + dy * dy


def _squares(nodes: DataFrame, low: tuple, high: tuple, radius: float) -> DataFrame:
    """nodes with ``square``: a hash of kind and of each square that holds the corners x0, y0 from ``low`` to ``high``."""
    side = F.lit(SQUARE * _side(radius))
    at = lambda c: F.floor(c / side).cast("long")
    x, y = (F.explode(F.sequence(at(a), at(b))) for a, b in zip(low, high))
    return nodes.withColumn("_kx", x).withColumn("_ky", y).withColumn("square", F.xxhash64("kind", "_kx", "_ky")).drop("_kx", "_ky")


def _own_square(nodes: DataFrame, radius: float) -> DataFrame:
    side = F.lit(SQUARE * _side(radius))
    return nodes.withColumn("square", F.xxhash64("kind", F.floor(F.col("x0") / side).cast("long"), F.floor(F.col("y0") / side).cast("long")))


def _touched(nodes: DataFrame, radius: float) -> DataFrame:
    """The squares whose cells may lie within the radius of a node."""
    back, c = F.lit(radius + _side(radius)), F.col
    return _squares(nodes.select("kind", *(n for n, _, _ in _BOX)), (c("x0") - back, c("y0") - back), (c("x1") + radius, c("y1") + radius), radius).select("square").distinct()


def _near_cells(new: DataFrame, old: DataFrame | None, radius: float) -> DataFrame:
    """Pairs of cells of one kind whose boxes come within the radius: kind, va, vb, sure, b_old, and number and corner of each.

    ``new`` and ``old``: kind, v, n, box.  Pairs of two old cells are left out; of a mixed pair b is the
    old one.  A cell is joined with the square of its own corner and looks for others ahead of it, so
    each pair comes once.  A square has a bounded number of cells, so no key is hot, however many points a cell holds.
    """
    # n is below 0 for old cells
    box, c = [n for n, _, _ in _BOX], F.col
    all_ = new.select("kind", "v", "n", *box)
    if old is not None:
        all_ = all_.unionByName(old.select("kind", "v", (-c("n")).alias("n"), *box))
    ahead = _squares(all_, (c("x0"), c("y0") - F.lit(radius + _side(radius))), (c("x1") + radius, c("y1") + radius), radius)
    a_old, b_old = c("a.n") < 0, c("b.n") < 0
    first = (c("a.x0") < c("b.x0")) | ((c("a.x0") == c("b.x0")) & (F.struct(a_old, c("a.v"), c("a.y0")) < F.struct(b_old, c("b.v"), c("b.y0"))))
    met = ahead.alias("a").join(_own_square(all_, radius).alias("b"), "square").filter((c("a.kind") == c("b.kind")) & first & (_gap2() <= radius * radius) & ~(a_old & b_old))
    side = lambda n: [F.when(a_old, c(f"b.{n}")).otherwise(c(f"a.{n}")), F.when(a_old, c(f"a.{n}")).otherwise(c(f"b.{n}"))]
    ends = [(F.abs(e) if n == "n" else e).alias(f"{t}_{n}") for n in ("n", "x0", "y0") for t, e in zip("ab", side(n))]
    va, vb = side("v")
    return met.select(c("a.kind").alias("kind"), va.alias("va"), vb.alias("vb"), (_gap2(far=True) <= radius * radius).alias("sure"), (a_old | b_old).alias("b_old"), *ends)


def _linked(unsure: DataFrame, new: DataFrame, old: DataFrame | None, radius: float) -> DataFrame:
    """(u, v): the pairs of ``unsure`` that have two points within the radius.

    ``new`` and ``old``: points kind, x, y, cx, cy.  Cells of few points are compared point by point.  Others
    are cut into sixteen, level by level: a pair of parts that surely are near settles their pair of
    cells, parts too far apart are dropped, the rest is cut again.  A part of one position is always
    settled, so the descent ends.
    """
    names = [*(f"{t}_{c}" for t in "ab" for c in ("cx", "cy")), "kind", "va", "vb", "b_old"]
    ids = ["va", "vb"]

    def points_of(pairs: DataFrame, t: str, level: int) -> DataFrame:
        """The points of the pairs' cells (of level - 1) on one side, by cell of this level."""
        side = F.lit(_side(radius) / 4**level)
        at = [(F.floor(F.col(v) / side)).cast("long").alias(f"{t}_s{v}") for v in "xy"]
        p = new.withColumn("_old", F.lit(False))
        if t == "b" and old is not None:
            p = p.unionByName(old.withColumn("_old", F.lit(True)))
        wanted = pairs.select("kind", F.col(f"{t}_cx").alias("cx"), F.col(f"{t}_cy").alias("cy"), (F.col("b_old") if t == "b" else F.lit(False)).alias("_old")).distinct()
        p = p.join(wanted, [*_CELL, "_old"], "left_semi")
        return p.select("kind", F.col("cx").alias(f"{t}_cx"), F.col("cy").alias(f"{t}_cy"), "x", "y", *at, *([F.col("_old").alias("b_old")] if t == "b" else []))

    few = F.col("a_n") * F.col("b_n") <= DIRECT
    small = unsure.filter(few).select(*names)
    at = {t: ["kind", f"{t}_cx", f"{t}_cy"] + (["b_old"] if t == "b" else []) for t in "ab"}
    a, b = (points_of(small, t, 0).select(*at[t], F.col("x").alias(f"{t}x"), F.col("y").alias(f"{t}y")) for t in "ab")
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    found = written(small.join(a, at["a"]).join(b, at["b"]).filter(d2 <= radius * radius).select(*ids).distinct(), "linked")
    todo, level = unsure.filter(~few).select(*names), 0
    while not todo.isEmpty():
        level += 1
        part = {}
        for t in "ab":
            box = [f(v).alias(n) for n, f, v in _BOX]
            up = [] if level == 1 else [F.shiftright(f"{t}_s{v}", 2).alias(f"{t}_p{v}") for v in "xy"]
            part[t] = points_of(todo, t, level).groupBy(*at[t], f"{t}_sx", f"{t}_sy").agg(*box).select("*", *up)
        on = {t: at[t] + ([] if level == 1 else [f"{t}_px", f"{t}_py"]) for t in "ab"}
        j = todo.join(part["a"].select(*on["a"], "a_sx", "a_sy", F.struct("x0", "y0", "x1", "y1").alias("a")), on["a"]).join(part["b"].select(*on["b"], "b_sx", "b_sy", F.struct("x0", "y0", "x1", "y1").alias("b")), on["b"])
        j = written(j.filter(_gap2() <= radius * radius).select(*names, *(F.col(f"{t}_s{v}").alias(f"{t}_p{v}") for t in "ab" for v in "xy"), (_gap2(far=True) <= radius * radius).alias("sure")), "parts")
        here = j.filter("sure").select(*ids).distinct()
        found = written(found.unionByName(here), "linked")
        todo = written(j.filter("not sure").drop("sure").join(here, ids, "left_anti"), "todo")
    return found.select(F.col("va").alias("u"), F.col("vb").alias("v"))


def _rooted(nodes: DataFrame, column: str, roots: DataFrame, spread: str) -> DataFrame:
    """``nodes`` with ``column`` replaced by its root where it has one."""
    known = nodes.count() > HOT
    hot = written(nodes.groupBy(F.col(column).alias("node")).count().filter(F.col("count") > HOT), "hot") if known else None
    return join_hot(nodes.withColumnRenamed(column, "node"), roots, ["node"], hot, spread).withColumn(column, F.coalesce("root", "node")).drop("node", "root")


def _fill(fresh: DataFrame, counts: dict, targets: dict) -> DataFrame:
    """(component, subset) of new components, largest deficits first.

    Components above one in ``LARGE`` of all rows (so fewer than ``LARGE`` of them) go one
    by one, largest first, to the subset that lacks most rows.  The others are hashed to
    ``BUCKETS`` buckets, of which only the sums reach the driver, and buckets fill what
    is then lacking.
    """
    n = fresh.agg(F.sum("size")).first()[0] or 0
    total = n + sum(counts.values())
    names = sorted(targets)
    lack = {s: targets[s] * total - counts.get(s, 0) for s in names}
    limit = max(1, total // LARGE)
    chosen = []
    for c, size in sorted(map(tuple, fresh.filter(F.col("size") > limit).select("component", "size").collect()), key=lambda r: (-r[1], r[0])):
        s = max(names, key=lambda k: lack[k])
        lack[s] -= size
        chosen.append((c, s))
    small = fresh.filter(F.col("size") <= limit).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int"))
    of_bucket = []
    for b, size in sorted(map(tuple, small.groupBy("bucket").agg(F.sum("size")).collect()), key=lambda r: (-r[1], r[0])):
        s = max(names, key=lambda k: lack[k])
        lack[s] -= size
        of_bucket.append((b, s))
    spark = fresh.sparkSession
    big = spark.createDataFrame(chosen, "component long, subset string")
    buckets = spark.createDataFrame(of_bucket, "bucket int, subset string")
    return big.unionByName(small.join(F.broadcast(buckets), "bucket").select("component", "subset"))


class Table:
    """The persisted component table in the folder ``location``: rows of all batches, with component and subset.

    A component is named by its smallest id.
    """

    def __init__(self, spark: SparkSession, location: str, radius: float = RADIUS):
        self.spark, self.location, self.radius = spark, location.rstrip("/"), radius

    def version(self) -> dict:
        """The newest version: its number, the folders of its batches and of its changes."""
        fs, of = file_system(self.spark, self.location)
        found = [s.getPath().getName() for s in (fs.globStatus(of(f"{self.location}/version-*.json")) or [])]
        return json.loads(read_text(self.spark, f"{self.location}/{max(found)}")) if found else {"number": 0, "batches": [], "changes": None}

    def _read(self, version: dict, name: str) -> DataFrame | None:
        """A table of all batches of a version."""
        if not version["batches"]:
            return None
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*(f"{self.location}/{b}/{name}" for b in version["batches"]))

    def _changes(self, version: dict) -> DataFrame | None:
        return self.spark.read.schema(_SCHEMAS["changes"]).parquet(f"{self.location}/{version['changes']}") if version["changes"] else None

    def rows(self, version: dict | None = None) -> DataFrame:
        """(id, x, y, kind, component, linked, subset) of all rows; ``linked`` is False for a row alone."""
        v = version or self.version()
        rows, changes = self._read(v, "rows"), self._changes(v)
        if rows is None:
            return self.spark.createDataFrame([], "id long, x double, y double, kind int, component long, linked boolean, subset string")
        full = self._changed(rows, changes, v)
        return full.select("id", "x", "y", "kind", "component", "linked", "subset")

    def _changed(self, facts: DataFrame, changes: DataFrame | None, version: dict, spread: str = "id") -> DataFrame:
        """Rows or component facts as later batches left them.  Components of very many rows are dealt to parts."""
        if changes is None:
            return facts
        hot = self._read(version, "components").groupBy("component").agg(F.sum("n").alias("count")).filter(F.col("count") > HOT)
        hot = written(hot, "hot") if version["n"] > HOT and spread == "id" else None
        c = changes.select("component", "root", F.col("subset").alias("_subset"), F.lit(True).alias("_changed"))
        j = join_hot(facts, c, ["component"], hot, spread).withColumn("component", F.coalesce("root", "component")).withColumn("subset", F.coalesce("_subset", "subset"))
        if "linked" in facts.columns:
            j = j.withColumn("linked", F.col("linked") | F.coalesce("_changed", F.lit(False)))
        return j.drop("root", "_subset", "_changed")

    def grow(self, new: DataFrame, targets: dict[str, float] | None = None) -> "Table":
        """Adds a batch of rows: id, x, y, kind; ids are unique over all batches.

        Rows of one kind at most ``radius`` apart are linked, through others too.  Rows with a NULL, NaN or useless position or
        a NULL kind are components of their own.  With ``targets`` (share per subset) each
        component has a subset: one that was there keeps it, with its new rows; a new one gets
        the subset that lacks most rows; where new rows merge components of different subsets,
        the merged component is set to ``quarantine`` (as is one merged with such).  What is read of earlier
        batches are the cells and component facts; their rows only where cells near new ones leave the
        distance open.
        """
        v, r = self.version(), self.radius
        new = written(new.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("kind").cast("int").alias("kind")), "new")
        points = _celled(_usable(new), r)
        nodes = written(points.groupBy(*_CELL).agg(F.min("id").alias("v"), F.count("*").alias("n"), *(f(c).alias(n) for n, f, c in _BOX)), "nodes")
        old, cells, changes = None, self._read(v, "cells"), self._changes(v)
        if cells is not None:
            # written, so that the optimizer knows whether it is small enough for the cells to stay where they are
            touched = written(_touched(nodes, r), "touched")
            near = _own_square(cells, r).join(touched, "square", "left_semi").drop("square")
            if changes is not None:
                near = near.join(changes.select("component", "root"), "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
            near = near.withColumnRenamed("component", "v")
            if len(v["batches"]) > 1:
                # the cells of one place in several batches belong to one component
                near = near.groupBy(*_CELL).agg(F.min("v").alias("v"), F.sum("n").alias("n"), *(f(n).alias(n) for n, f, _ in _BOX))
            old = written(near.select("kind", "v", "n", *(n for n, _, _ in _BOX)), "old")
        pairs = written(_near_cells(nodes, old, r), "pairs")
        roots = connected(pairs.filter("sure").select(F.col("va").alias("u"), F.col("vb").alias("v")))
        unsure = pairs.filter("not sure")
        for e in ("va", "vb"):
            unsure = unsure.join(roots.select(F.col("node").alias(e), F.col("root").alias(f"r{e}")), e, "left").withColumn(f"r{e}", F.coalesce(f"r{e}", e))
        side = F.lit(_side(r))
        corners = [F.floor(F.col(f"{t}_{c}0") / side).cast("long").alias(f"{t}_c{c}") for t in "ab" for c in "xy"]
        unsure = written(unsure.filter("rva != rvb").select("kind", F.col("rva").alias("va"), F.col("rvb").alias("vb"), "b_old", "a_n", "b_n", *corners), "unsure")
        late = None
        if not unsure.isEmpty():
            before = None if old is None else _celled(_usable(self._read(v, "rows").select("id", "x", "y", "kind")), r).select(*_CELL, "x", "y")
            late = connected(_linked(unsure, points.select(*_CELL, "x", "y"), before, r))

        def settled(t: DataFrame, column: str, spread: str) -> DataFrame:
            one = _rooted(t, column, roots, spread)
            return one if late is None else _rooted(written(one, "rooted"), column, late, spread)

        named = written(settled(nodes.select("v", "n", F.col("v").alias("component")), "component", "v"), "named")
        singles = new.filter(~F.coalesce(_has_place(), F.lit(False)))
        sizes = named.groupBy("component").agg(F.sum("n").alias("n")).unionByName(singles.select(F.col("id").alias("component"), F.lit(1).cast("long").alias("n")))
        moved = None
        if old is not None:
            facts = self._changed(self._read(v, "components"), changes, v, "component")
            reached = written(old.select(F.col("v").alias("component")).distinct(), "reached")
            was = facts.join(reached, "component", "left_semi").groupBy("component").agg(F.max("subset").alias("subset"))
            moved = written(settled(was.withColumn("root", F.col("component")).withColumnRenamed("root", "to"), "to", "component"), "moved")
            moved = written(moved.join(named.select(F.col("component").alias("to")).distinct(), "to", "left_semi").select("component", "to", "subset"), "moved")
        self._commit(v, new, points, nodes, named, singles, sizes, moved, changes, targets)
        dropped(*(t for t in (new, nodes, old, pairs, unsure, named, moved) if t is not None))
        return self

    def _commit(self, v: dict, new: DataFrame, points: DataFrame, nodes: DataFrame, named: DataFrame, singles: DataFrame, sizes: DataFrame, moved: DataFrame | None, changes: DataFrame | None, targets: dict | None) -> None:
        batch, table = f"batch-{uuid.uuid4().hex}", self.location
        if moved is not None:
            one = moved.groupBy(F.col("to").alias("component")).agg(F.min("subset").alias("lo"), F.max("subset").alias("hi"), F.lit(True).alias("kept"))
            one = one.select("component", "kept", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), F.lit(QUARANTINE)).alias("subset"))
            sizes = sizes.join(one, "component", "left")
        else:
            sizes = sizes.withColumn("kept", F.lit(None).cast("boolean")).withColumn("subset", F.lit(None).cast("string"))
        sizes = written(sizes.withColumn("linked", (F.col("n") > 1) | F.col("kept").isNotNull()), "sizes")
        now = changes
        if moved is not None:
            given = moved.join(sizes.select(F.col("component").alias("to"), F.col("subset").alias("given")), "to").select("component", F.col("to").alias("root"), F.col("given").alias("subset"))
            now = given
            if changes is not None:
                # earlier changes lead to the new roots of what they led to
                later = given.select(F.col("component").alias("root"), F.col("root").alias("_root"), F.col("subset").alias("_subset"))
                kept = changes.join(later, "root", "left").select("component", F.coalesce("_root", "root").alias("root"), F.coalesce("_subset", "subset").alias("subset"))
                now = kept.unionByName(given.join(kept.select("component"), "component", "left_anti"))
            now = written(now, "changes")
        if targets is not None:
            counts: dict = {}
            if v["batches"]:
                past = self._changed(self._read(v, "components"), now, v, "component")
                counts = {s: n for s, n in past.groupBy("subset").agg(F.sum("n")).collect() if s}
            for s, n in sizes.filter("subset is not null").groupBy("subset").agg(F.sum("n")).collect():
                counts[s] = counts.get(s, 0) + n
            counts.pop(QUARANTINE, None)
            filled = _fill(sizes.filter("kept is null").select("component", F.col("n").alias("size")), counts, targets)
            sizes = written(sizes.drop("subset").join(filled.unionByName(sizes.filter("kept is not null").select("component", "subset")), "component"), "sizes")
        facts = sizes.select("component", "linked", "subset")
        hot = written(named.groupBy("component").count().filter(F.col("count") > HOT), "hot") if v.get("n", 0) + named.count() > HOT else None
        labels = written(join_hot(named.select("v", "component"), facts, ["component"], hot, "v"), "labels")
        cells = written(nodes.join(labels, "v"), "celled")
        crowded = cells.filter(F.col("n") > HOT).select(*_CELL, F.col("n").alias("count"))
        rows = join_hot(points, cells.select(*_CELL, "component", "linked", "subset"), _CELL, None if crowded.isEmpty() else crowded, "id", "inner").select(*_ROWS)
        rows = rows.unionByName(singles.join(facts, F.col("id") == F.col("component")).select(*_ROWS))
        rows.write.parquet(f"{table}/{batch}/rows")
        cells.select(*_CELLS).write.parquet(f"{table}/{batch}/cells")
        sizes.select("component", "n", "subset").write.parquet(f"{table}/{batch}/components")
        folder = v["changes"]
        if now is not None and moved is not None:
            folder = f"{batch}/changes"
            now.select("component", "root", "subset").write.parquet(f"{table}/{folder}")
        nxt = {"number": v["number"] + 1, "batches": [*v["batches"], batch], "changes": folder, "n": v.get("n", 0) + new.count()}
        create(self.spark, f"{table}/version-{nxt['number']:09d}.json", json.dumps(nxt))
        dropped(labels, cells, sizes)


_ROWS = ("id", "x", "y", "kind", "component", "linked", "subset")
_CELLS = (*_CELL, "n", "component", *(n for n, _, _ in _BOX))
_SCHEMAS = {
    "rows": "id long, x double, y double, kind int, component long, linked boolean, subset string",
    "cells": "kind int, cx long, cy long, n long, component long, x0 double, y0 double, x1 double, y1 double",
    "components": "component long, n long, subset string",
    "changes": "component long, root long, subset string",
}


def _has_place():
    """Whether a row has an id, a kind and a position."""
    return F.col("id").isNotNull() & F.col("kind").isNotNull() & F.col("x").between(-FAR, FAR) & F.col("y").between(-FAR, FAR)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(_has_place())


def manifest_points(manifest: DataFrame, reference: DataFrame, *more: str) -> DataFrame:
    """id, x, y, kind (and ``more`` columns) of all manifest rows: kind is the meaning of feature_type, NULL if it has none."""
    m = manifest.select("row_idx", "feature_type", "x", "y", *more)
    matched = manifest_meanings(m, reference)
    unknown = reference.filter("name = 'unknown'").agg(F.min("ref_id")).first()[0]
    kind = F.when(blank(F.col("feature_type")), F.lit(unknown)).when(F.col("ref_id") > 0, F.col("ref_id"))
    rows = with_meaning(m, "feature_type", matched, "row_idx").select(F.col("row_idx").alias("id"), position(F.col("x"), F.col("y")).alias("p"), kind.alias("kind"), *more)
    return rows.select("id", F.col("p.e").alias("x"), F.col("p.n").alias("y"), "kind", *more)


#: Rows added from then on are the second batch of the queries.
LATER = "2023-01-01"


def _grown(spark: SparkSession, sf_dir: str, targets: dict | None) -> DataFrame:
    """The component table after two batches: rows added before ``LATER``, then the rest."""
    m = load(spark, sf_dir, "manifest")
    early = F.coalesce(F.col("added_at") < F.lit(LATER).cast("timestamp"), F.lit(False))
    points = written(manifest_points(m.withColumn("early", early), load(spark, sf_dir, "feature_ref"), "early"), "points")
    table = Table(spark, f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}")
    for batch in ("early", "not early"):
        table.grow(points.filter(batch), targets)
    return table.rows()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each manifest row that belongs together with another."""
    return _grown(spark, sf_dir, None).filter("linked").select(F.col("id").alias("row_idx"), F.col("component").alias("group_row_idx"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir, {r["subset"]: r["target_share"] for r in load(spark, sf_dir, "split_target").collect()})


def p2_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and new subset of every manifest row, grown in two batches."""
    return _assigned(spark, sf_dir).select(F.col("id").alias("row_idx"), F.col("component").alias("group_row_idx"), F.col("subset").alias("new_subset"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share of each new subset beside its target."""
    t = _assigned(spark, sf_dir)
    per = t.groupBy("subset").agg(F.count("*").alias("n_rows"), F.count_if(F.col("id") == F.col("component")).alias("n_groups"))
    n = t.count()
    return per.join(load(spark, sf_dir, "split_target"), "subset", "left").select("subset", "n_rows", "n_groups", (F.col("n_rows") / F.lit(n)).alias("share"), "target_share")


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the assignment: rows, rows twice (0), rows without a subset of the targets or quarantine (0), groups in two subsets (0)."""
    t = written(_assigned(spark, sf_dir), "assigned")
    names = [r[0] for r in load(spark, sf_dir, "split_target").select("subset").collect()]
    apart = t.groupBy("component").agg((F.min("subset") != F.max("subset")).alias("two")).agg(F.count_if("two").alias("n_apart"))
    known = F.coalesce(F.col("subset").isin(*names, QUARANTINE), F.lit(False))
    return t.agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("id")).alias("n_twice"), F.count_if(~known).alias("n_without")).join(apart)


QUERIES = {"p2_found": p2_found, "p2_assign": p2_assign, "p2_shares": p2_shares, "p2_limits": p2_limits}
SQL = {
    "p2_limits": "SELECT count(*) AS n_rows, cast(0 AS BIGINT) AS n_twice, cast(0 AS BIGINT) AS n_without, cast(0 AS BIGINT) AS n_apart FROM manifest",
}
