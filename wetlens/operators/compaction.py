"""Consolidating small files: frozen listing, bin packing, verified rewrite, atomic commit."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.functions.paths import canonical_path
from wetlens.operators.binpack import packed
from wetlens.session import create, file_system, read_text, written

TARGET = 128 * 2**20
#: Full bins a packing task makes, and files it may hold.
BINS_PER_TASK, FILES_PER_TASK = 64, 50_000


def one_per_file(listing: DataFrame, suffix: str = ".npy") -> DataFrame:
    """The rows of a listing that stand for a file: (file_id, path, h1, h2, n_bytes).

    ``listing``: file_id (unique), path, n_bytes, written_at.  A row counts if its
    canonical path ends with ``suffix`` and n_bytes > 0; of several rows of one file only
    the one with most bytes, then the earliest written_at (NULL last), then the smallest
    file_id.  NULL paths and sizes never count.  Choosing is an aggregate, combined before
    the shuffle, so a file listed any number of times is no hot spot.
    """
    rows = listing.filter(F.col("n_bytes") > 0).select(
        F.col("file_id").cast("long").alias("file_id"), canonical_path(F.col("path")).alias("path"), F.col("n_bytes").cast("long").alias("n_bytes"), F.unix_micros(F.col("written_at").cast("timestamp")).alias("at")
    )
    # the suffix is looked at after the aggregate: before it, the optimizer would parse each path twice
    keyed = rows.select("file_id", "n_bytes", "at", F.xxhash64("path").alias("h1"), F.hash("path").alias("h2"), F.col("path").endswith(suffix).alias("chip"))
    rank = F.struct((-F.col("n_bytes")).alias("b"), F.coalesce("at", F.lit(2**63 - 1)).alias("at"), F.col("file_id").alias("id"))
    best = keyed.groupBy("h1", "h2").agg(F.min(rank).alias("best"), F.max("chip").alias("chip")).filter("chip")
    return best.select(F.col("best.id").alias("file_id"), "h1", "h2", (-F.col("best.b")).alias("n_bytes"))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each item, and the room left per bin.  Items above capacity stand alone."""
    order = np.argsort(-sizes, kind="stable")
    values, starts = np.unique(-sizes[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    room = np.zeros(16, np.int64)
    of = np.empty(len(sizes), np.int64)
    used = 0
    for size, at, end in zip(-values, starts, ends):
        while at < end:
            fits = np.flatnonzero(room[:used] >= size)
            if len(fits):
                b = fits[0]
                k = min(end - at, room[b] // size if size else end - at)
            else:
                if used == len(room):
                    room = np.concatenate([room, np.zeros(used, np.int64)])
                b, used = used, used + 1
                room[b] = capacity
                k = min(end - at, max(1, capacity // size if size else end - at))
            of[order[at : at + k]] = b
            room[b] -= k * size
            at += k
    return of, room[:used]


def pack(files: DataFrame, capacity: int = TARGET) -> DataFrame:
    """Bins by first-fit decreasing: (id, size, bin); ``files``: id (unique), size.

    Each file comes out once, a file above capacity in a bin of its own.  NULL sizes
    count as 0.  An empty table gives no bins.
    """
    return packed(files, capacity, first_fit_decreasing, BINS_PER_TASK, FILES_PER_TASK)


_COMMITTED = "_committed.json"


def _content_sums() -> tuple:
    """Count, bytes and a checksum of rows (path, content) that binds each content to its path."""
    return (F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes"), F.sum(F.xxhash64("path", "content").cast("decimal(20,0)")).alias("check"))


def compact(spark: SparkSession, source: str, target: str, capacity: int = TARGET, glob: str = "*.npy") -> DataFrame:
    """Rewrites all files under ``source`` into parquet files of about ``capacity`` bytes.

    The listing is frozen first; each file becomes one row (path, n_bytes, content) of
    its bin, in a folder of ``target`` of this run's own.  Rows are read back, and their number, bytes and a
    checksum over path and content are compared with the sources', per bin; only then is the run
    committed, by creating the one file ``_committed.json`` of ``target``, which names the run's folder.
    The file is created only if it is not there, so of two runs one commits and the other
    fails; on any failure nothing is committed and the run's folder is removed.  Read the result
    with :func:`consolidated`.  Returns (bin, files, bytes).
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    frozen = written(reader.load(source).select("path", F.col("length").alias("size")), "frozen")
    frozen = written(frozen.withColumn("id", F.xxhash64("path")), "frozen")
    if frozen.select("id").distinct().count() != frozen.count():
        raise ValueError("two paths have one hash")
    plan = written(pack(frozen, capacity).join(frozen.select("id", "path"), "id"), "plan")
    bins = plan.select("bin").distinct().count()
    run = f"run-{uuid.uuid4().hex}"
    content = reader.load(source).select("path", "content").join(plan.select("path", "bin", F.col("size").alias("n_bytes")), "path")
    content.repartition(max(1, bins), "bin").write.partitionBy("bin").parquet(f"{target}/{run}")
    back = _rows(spark, f"{target}/{run}").groupBy("bin").agg(*_content_sums())
    want = plan.groupBy("bin").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = reader.load(source).select("path", "content").join(plan.select("path", "bin"), "path").groupBy("bin").agg(_content_sums()[2].alias("want"))
    checked = written(want.join(sums, "bin", "left").join(back, "bin", "full"), "compacted")
    fs, path = file_system(spark, target)
    try:
        if not checked.filter("not (files <=> n and bytes <=> size and check <=> want)").isEmpty():
            raise ValueError("the rewritten files differ from their sources")
        create(spark, f"{target}/{_COMMITTED}", json.dumps({"run": run}))
    except Exception:
        fs.delete(path(f"{target}/{run}"), True)
        raise
    return checked.select("bin", "files", "bytes")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, n_bytes long, content binary, bin string").parquet(folder)


def consolidated(spark: SparkSession, target: str) -> DataFrame:
    """(path, n_bytes, content, bin) of a committed :func:`compact`; fails where none is committed."""
    named = json.loads(read_text(spark, f"{target}/{_COMMITTED}"))
    return _rows(spark, f"{target}/{named['run']}")
