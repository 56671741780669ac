"""Queries on file listings: p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.functions.paths import canonical_path
from wetlens.operators.compaction import TARGET, one_per_file, pack
from wetlens.plans import oracle
from wetlens.session import load, written


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows that add nothing to the consolidated files."""
    listing = load(spark, sf_dir, "chip_file").select("file_id", "path", "n_bytes", "written_at")
    return listing.select("file_id").join(one_per_file(listing).select("file_id"), "file_id", "left_anti")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = one_per_file(load(spark, sf_dir, "chip_file"))
    named = load(spark, sf_dir, "manifest").select(canonical_path(F.col("path")).alias("p")).filter("p is not null").select(F.xxhash64("p").alias("h1"), F.hash("p").alias("h2"))
    wanted = chips.join(named, ["h1", "h2"], "left_semi")
    return pack(wanted.select(F.col("file_id").alias("id"), F.col("n_bytes").alias("size")), TARGET)


def p5_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated file of each chip that the manifest names and the listing has."""
    return _plan(spark, sf_dir).select(F.col("id").alias("file_id"), "bin", F.col("size").alias("n_bytes"))


def p5_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each consolidated file."""
    return written(_plan(spark, sf_dir), "plan").groupBy("bin").agg(F.count("*").alias("files"), F.sum("size").alias("n_bytes"))


def p5_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the plan: chips and bytes, chips planned twice (0), and files above the target of more than one chip (0)."""
    plan = written(_plan(spark, sf_dir), "plan")
    per = plan.groupBy("bin").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    over = per.agg(F.count_if((F.col("bytes") > TARGET) & (F.col("n") > 1)).alias("n_over"))
    return plan.agg(F.count("*").alias("n_chips"), F.sum("size").alias("n_bytes"), (F.count("*") - F.count_distinct("id")).alias("n_twice")).join(over)


QUERIES = {"p5_found": p5_found, "p5_plan": p5_plan, "p5_bins": p5_bins, "p5_total": p5_total}
_CHIPS = f"""c AS (SELECT file_id, n_bytes, written_at, {oracle.path_sql("path")} AS p FROM chip_file),
      r AS (SELECT file_id, n_bytes, p, row_number() OVER (PARTITION BY p ORDER BY n_bytes DESC, written_at ASC NULLS LAST, file_id) AS k FROM c WHERE n_bytes > 0 AND p LIKE '%.npy'),
      m AS (SELECT DISTINCT {oracle.path_sql("path")} AS p FROM manifest)"""
SQL = {
    "p5_total": f"WITH {_CHIPS} SELECT count(*) AS n_chips, sum(n_bytes)::BIGINT AS n_bytes, cast(0 AS BIGINT) AS n_twice, cast(0 AS BIGINT) AS n_over FROM r WHERE k = 1 AND p IN (SELECT p FROM m WHERE p IS NOT NULL)",
    "p5_found": f"""WITH c AS (SELECT file_id, n_bytes, written_at, {oracle.path_sql("path")} AS p FROM chip_file),
      r AS (SELECT file_id, row_number() OVER (PARTITION BY p ORDER BY n_bytes DESC, written_at ASC NULLS LAST, file_id) AS k FROM c WHERE n_bytes > 0 AND p LIKE '%.npy')
      SELECT file_id FROM chip_file WHERE file_id NOT IN (SELECT file_id FROM r WHERE k = 1)""",
}
