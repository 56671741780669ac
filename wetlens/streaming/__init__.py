"""Detections of rasters as their metadata arrive, tile by tile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wetlens.sources.files import RASTER


def watch(spark: SparkSession, folder: str, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs ``detect`` on each batch of new raster metadata (JSON lines in ``folder``), appending to ``out``.

    Detection is independent per raster, so batches need no state.  A batch is written
    to a folder of its own number, so one that is repeated after a failure replaces itself.
    """
    fresh = spark.readStream.schema(RASTER).json(folder)

    def one(batch: DataFrame, number: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
