"""Records that occur in more than one split, exactly or almost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.functions.geo import position
from wetlens.functions.paths import canonical_path
from wetlens.operators import skew
from wetlens.plans import oracle
from wetlens.session import load, written

TRAIN, EVAL = ("train",), ("val", "test")
RADIUS = 2.0
#: Cells whose hashes stand for a place; a record is sought in all cells within the radius.
CELL = 8.0
#: Rows of one key a task may hold on either side before the key is salted.
HOT = 10_000


def canonical_records(manifest: DataFrame, *more: str) -> DataFrame:
    """(id, held, h1, h2, e, n) and ``more`` columns of the train and evaluation rows.

    ``h1, h2``: 96 bits of hash of the canonical path, NULL without a path or a blank one; ``e, n``: the
    position, NULL without one.  Rows of other or no splits are left out.
    """
    s = manifest.select(
        F.col("row_idx").cast("long").alias("id"), F.col("subset").isin(*EVAL).alias("held"), canonical_path(F.col("path")).alias("p"), position(F.col("x"), F.col("y")).alias("at"), F.col("subset"), *more
    ).filter(F.col("subset").isin(*TRAIN, *EVAL))
    has = F.col("p").isNotNull() & (F.col("p") != "")
    return s.select("id", "held", F.when(has, F.xxhash64("p")).alias("h1"), F.when(has, F.hash("p").bitwiseAND(2**31 - 1)).alias("h2"), F.col("at.e").alias("e"), F.col("at.n").alias("n"), *more)


def _keyed(rec: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Keys of train rows and of evaluation rows: (id, e, n, k1, k2); k2 is -1 for places."""
    cell = lambda c: F.floor(c / F.lit(CELL)).cast("long")
    place = lambda cx, cy: F.struct((cx * F.lit(2**32) + cy).alias("k1"), F.lit(-1).alias("k2"))
    file = F.filter(F.array(F.struct(F.col("h1").alias("k1"), F.col("h2").alias("k2"))), lambda k: k["k1"].isNotNull())
    e, n, placed = F.col("e"), F.col("n"), F.col("e").isNotNull()
    own = F.when(placed, F.array(place(cell(e), cell(n)))).otherwise(F.array())
    xs, ys = (F.sequence(cell(c - radius), cell(c + radius)) for c in (e, n))
    around = F.when(placed, F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: place(cx, cy))))).otherwise(F.array())

    def out(df, places):
        return df.withColumn("k", F.explode(F.concat(file, places))).select("id", "e", "n", "k.k1", "k.k2")

    return out(rec.filter(~F.col("held")), own), out(rec.filter("held"), around)


def overlap_pairs(manifest: DataFrame, radius: float = RADIUS, hot: int = HOT) -> DataFrame:
    """(train_id, held_id): a train row and a val or test row of one file or one place.

    Hashes of the canonical path and of the cells around a position are joined; a pair
    by place counts if the positions are at most ``radius`` apart.  Each pair comes once.
    NULL and blank paths equal nothing, rows without a position are near nothing; repeated rows
    all count; other columns are ignored.  Keys with more than ``hot`` rows on a side are
    cut into blocks, and each block of one side meets each of the other in its own task.
    """
    rec = written(canonical_records(manifest), "records")
    train, held = _keyed(rec, radius)
    counts = train.select("k1", "k2", F.lit(1).alias("t"), F.lit(0).alias("h")).unionByName(held.select("k1", "k2", F.lit(0).alias("t"), F.lit(1).alias("h"))).groupBy("k1", "k2").agg(F.sum("t").alias("t"), F.sum("h").alias("h"))
    blocks = written(counts.filter((F.greatest("t", "h") > hot) & (F.least("t", "h") > 0)).select("k1", "k2", F.ceil(F.col("t") / hot).alias("p"), F.ceil(F.col("h") / hot).alias("q")), "hotkeys")
    keys = ["k1", "k2"]
    if not blocks.isEmpty():
        keys = ["k1", "k2", "i", "j"]

        def dealt(df, mine, other, a, b):
            d = df.join(blocks, ["k1", "k2"], "left").withColumn(a, F.coalesce(F.pmod(F.xxhash64("id"), F.col(mine)), F.lit(0)))
            return d.withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)).cast("long") - 1))).drop("p", "q")

        train, held = dealt(train, "p", "q", "i", "j"), dealt(held, "q", "p", "j", "i")
    both = train.alias("t").join(held.alias("h"), keys)
    d2 = (F.col("t.e") - F.col("h.e")) ** 2 + (F.col("t.n") - F.col("h.n")) ** 2
    near = F.coalesce(d2 <= radius * radius, F.lit(False))
    # a pair that is near comes by its one common cell, so not again by its file
    return both.filter(near == (F.col("k2") == -1)).select(F.col("t.id").alias("train_id"), F.col("h.id").alias("held_id"))


def _counted(rows: DataFrame, held: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with the count of their keys, 0 where there is none; keys of very many rows of ``held`` are dealt to parts."""
    hot = None
    if held.count() > skew.HOT:
        hot = written(held.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).count().filter(F.col("count") > skew.HOT), "hot")
    return skew.join_hot(rows, counts, keys, hot, "id").withColumn(name, F.coalesce("t", F.lit(0))).drop("t")


def _near_counts(train: DataFrame, held: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(keys, e, n, t): train rows of equal keys within the radius of each place; both sides are distinct, train with t rows.

    Places meet by the cells of :func:`_keyed`.  What is joined are distinct places, so rows at one place count once.
    """
    cell = lambda c: F.floor(c / F.lit(CELL)).cast("long")
    around = F.flatten(F.transform(F.sequence(cell(F.col("e") - radius), cell(F.col("e") + radius)), lambda cx: F.transform(F.sequence(cell(F.col("n") - radius), cell(F.col("n") + radius)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    a = held.withColumn("c", F.explode(around)).select(*keys, "e", "n", "c.cx", "c.cy")
    b = train.select(*keys, F.col("e").alias("te"), F.col("n").alias("tn"), "t", cell(F.col("e")).alias("cx"), cell(F.col("n")).alias("cy"))
    d2 = (F.col("e") - F.col("te")) ** 2 + (F.col("n") - F.col("tn")) ** 2
    return a.join(b, [*keys, "cx", "cy"]).filter(d2 <= radius * radius).groupBy(*keys, "e", "n").agg(F.sum("t").alias("t"))


def overlap_report(manifest: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(subset, source, n_rows, n_overlapping, n_pairs) of the evaluation splits.

    The pairs of :func:`overlap_pairs` are counted, not listed: for each evaluation row the train rows of its
    file, and those near its place, less those that are both.
    """
    rec = written(canonical_records(manifest.withColumn("_subset", F.col("subset")).withColumn("_source", F.col("source")), "_subset", "_source"), "records")
    train, held = rec.filter("not held"), rec.filter("held")
    file, place = ["h1", "h2"], ["e", "n"]
    per = lambda keys: train.filter(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("t"))
    of = lambda keys: held.filter(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull()).select(*keys).distinct()
    both = [*file, *place]
    rows = _counted(held, held, per(file), file, "by_file")
    rows = _counted(rows, held, _near_counts(per(place), of(place), [], radius), place, "by_place")
    rows = _counted(rows, held, _near_counts(per(both), of(both), file, radius), both, "by_both")
    pairs = F.col("by_file") + F.col("by_place") - F.col("by_both")
    return rows.groupBy(F.col("_subset").alias("subset"), F.col("_source").alias("source")).agg(F.count("*").alias("n_rows"), F.count_if(pairs > 0).alias("n_overlapping"), F.sum(pairs).alias("n_pairs"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of manifest rows that overlap across train and val or test."""
    return overlap_pairs(load(spark, sf_dir, "manifest")).select(F.least("train_id", "held_id").alias("row_a"), F.greatest("train_id", "held_id").alias("row_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation subset and source."""
    return overlap_report(load(spark, sf_dir, "manifest"))


_FOUND = f"""{oracle.POSITION}, {oracle.near_sql(RADIUS)},
files AS (SELECT row_idx, {oracle.path_sql("path")} AS p FROM manifest WHERE path IS NOT NULL),
joined AS (SELECT row_a, row_b FROM near UNION SELECT a.row_idx, b.row_idx FROM files a JOIN files b ON a.p = b.p AND a.row_idx < b.row_idx),
found AS (SELECT row_a, row_b, CASE WHEN a.subset = 'train' THEN row_b ELSE row_a END AS held FROM joined
  JOIN manifest a ON a.row_idx = row_a JOIN manifest b ON b.row_idx = row_b
  WHERE (a.subset = 'train' AND b.subset IN ('val', 'test')) OR (b.subset = 'train' AND a.subset IN ('val', 'test')))"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": f"WITH {_FOUND} SELECT row_a, row_b FROM found",
    "p1_report": f"""WITH {_FOUND}, per AS (SELECT held, count(*) AS m FROM found GROUP BY 1)
      SELECT subset, source, count(*) AS n_rows, count(m) AS n_overlapping, coalesce(sum(m), 0)::BIGINT AS n_pairs
      FROM manifest LEFT JOIN per ON held = row_idx WHERE subset IN ('val', 'test') GROUP BY 1, 2""",
}
