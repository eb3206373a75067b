"""The native archive layout, tile lists, and rasters cut to tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_npy, encode_npy, encode_png


def write_archive(tiles: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet by archive and zoom, files ordered by tile_id, so that ranges of ids skip row groups.

    Ids follow the Hilbert curve, so range partitions are compact areas.
    """
    keys = ["archive", "z", "tile_id"]
    dealt = tiles.repartitionByRange(files, *keys) if files else tiles.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("archive", "z").parquet(path)


def read_archive(spark: SparkSession, path: str, archive: str | None = None, zoom: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if archive is not None:
        df = df.where(F.col("archive") == archive)
    return df if zoom is None else df.where(F.col("z") == zoom)


def write_tile_list(tiles: DataFrame, path: str) -> None:
    tiles.select("tile_id").distinct().sort("tile_id").write.mode("overwrite").parquet(path)


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet list, or a folder of npy files of ids."""
    if not path.endswith(".npy"):
        return spark.read.parquet(path).select("tile_id")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(decode_npy(raw).astype(np.int64).ravel())], ["tile_id"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(ids, "tile_id long")


def cut_tiles(schedule: DataFrame, read: Callable[[int, int, int], tuple[np.ndarray, np.ndarray] | None], kind: str = "visual") -> DataFrame:
    """(tile_id, z, x, y, payload) of a schedule, by ``read(z, x, y)`` -> (bands, mask) or None outside.

    visual: three bands and the mask as alpha, PNG.  sar: two bands scaled to
    [0, vv, vh, mask], PNG.  npy: the bands on the last axis.  Tiles outside
    the raster are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, made = [], []
            for i, (z, x, y) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                got = read(z, x, y)
                if got is None:
                    continue
                bands, valid = got
                if kind == "npy":
                    made.append(encode_npy(np.moveaxis(bands, 0, -1)))
                elif kind == "sar":
                    scaled = np.floor(np.clip(bands[:2] / 1000, 0, 1) * 255).astype(np.uint8)
                    made.append(encode_png(np.dstack([np.zeros_like(scaled[0]), scaled[0], scaled[1], valid.astype(np.uint8)])))
                else:
                    made.append(encode_png(np.dstack([*bands[:3].astype(np.uint8), valid.astype(np.uint8)])))
                keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in range(4)] + [pa.array(made, pa.binary())], ["tile_id", "z", "x", "y", "payload"])

    keys = schedule.select("tile_id", F.col("z").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"))
    return keys.mapInArrow(run, "tile_id long, z int, x int, y int, payload binary")
