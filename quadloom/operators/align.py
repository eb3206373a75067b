"""Alignment of modalities by tile id, and stitching of children to parents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tilemath as tm


def keys_of(tiles: DataFrame, archive: str) -> DataFrame:
    """Distinct ids of one archive."""
    return tiles.where(F.col("archive") == archive).select("tile_id").distinct()


def align(*keys: DataFrame) -> DataFrame:
    """Ids that all key tables hold; payloads are joined afterwards."""
    out = keys[0]
    for k in keys[1:]:
        out = out.join(k, "tile_id", "left_semi")
    return out


def align_payloads(named: dict[str, DataFrame]) -> DataFrame:
    """(tile_id, one payload column for each name): keys are aligned before payloads are read."""
    common = align(*[d.select("tile_id").distinct() for d in named.values()])
    for name, d in named.items():
        common = common.join(d.select("tile_id", F.col("payload").alias(name)), "tile_id")
    return common


def missing(tiles: DataFrame, present: str, absent: str) -> DataFrame:
    """Ids of one archive that another one lacks."""
    return keys_of(tiles, present).join(keys_of(tiles, absent), "tile_id", "left_anti")


def union_dataset(tiles: DataFrame, order: list[str]) -> DataFrame:
    """(tile_id, archives): each id with its archives in dataset order."""
    place = F.array_position(F.lit(order), F.col("archive"))
    held = tiles.where(F.col("archive").isin(order)).select("tile_id", place.alias("ord"), "archive").distinct()
    return held.groupBy("tile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "archive"))), lambda s: s["archive"]).alias("archives"))


def complete_parents(tiles: DataFrame) -> DataFrame:
    """(z, x, y, n_children) of parents all of whose children are there."""
    up = tiles.select("z", "x", "y").distinct().groupBy((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
    return up.agg(F.count("*").alias("n_children")).where("n_children = 4")


def stitch_4x(tiles: DataFrame) -> DataFrame:
    """(parent_id, payload): the four children (tile_id, payload) of each complete parent in one image."""
    from ..functions.codec import decode_png, encode_png, stitch

    at = tm.tile_of(F.col("tile_id"))
    quadrant = F.when(at["y"] % 2 == 0, at["x"] % 2).otherwise(3 - at["x"] % 2)  # top left, top right, bottom right, bottom left
    held = tiles.select(tm.parent_id(F.col("tile_id")).alias("parent_id"), F.struct(quadrant.alias("q"), "payload").alias("child"))
    grouped = held.groupBy("parent_id").agg(F.sort_array(F.collect_list("child")).alias("children")).where("size(children) = 4")

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_png(stitch([decode_png(c["payload"]) for c in four])) for four in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["parent_id", "payload"])

    return grouped.mapInArrow(paste, "parent_id long, payload binary")
