"""Incoming tiles as a stream: first copy of each id wins, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_tiles(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row for each (archive, tile_id) within the watermark; state is dropped as it passes."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["archive", "tile_id"])


def arrivals(stream: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, archive, n_tiles): tiles by window of arrival, for append output."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width), "archive").agg(F.count("*").alias("n_tiles"))
    return grouped.select(F.col("window.start").alias("window_start"), "archive", "n_tiles")


def append_to(path: str):
    """A foreachBatch sink that writes each batch once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
