"""Tile schedules, zoom expansion and pyramids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tilemath as tm


def schedule(boxes: DataFrame, min_zoom: int = 6, max_zoom: int = 14) -> DataFrame:
    """``boxes`` (west, south, east, north and keys) with (z, x, y, tile_id) of each tile they touch.

    Zooms run from min_zoom to below max_zoom.  Tiles are generated from the
    corner tiles, then held against the box, edges included.
    """
    z = F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom - 1))).alias("z")
    rows = boxes.select("*", z)
    rows = rows.select("*", F.explode(F.sequence(tm.column_at(F.col("west"), F.col("z")), tm.column_at(F.col("east"), F.col("z")))).alias("x"))
    rows = rows.select("*", F.explode(F.sequence(tm.row_at(F.col("north"), F.col("z")), tm.row_at(F.col("south"), F.col("z")))).alias("y"))
    box = tm.bounds(F.col("z"), F.col("x"), F.col("y"))
    inside = tm.bbox_overlaps({k: box[k] for k in ("west", "south", "east", "north")}, {k: F.col(k) for k in ("west", "south", "east", "north")})
    return rows.where(inside).withColumn("tile_id", tm.tile_id(F.col("z"), F.col("x"), F.col("y")))


def legacy_schedule(boxes: DataFrame, min_zoom: int = 1, max_zoom: int = 20) -> DataFrame:
    """As ``schedule``, with max_zoom included, and from the zoom of the smallest tile that holds the box where that is lower."""
    whole = tm.bounding_tile(*[F.col(k) for k in ("west", "south", "east", "north")])
    first = boxes.agg(F.min(whole["z"])).first()[0]
    rows = schedule(boxes, min(min_zoom, min_zoom if first is None else first), max_zoom + 1)
    return rows.where((F.col("z") >= min_zoom) | (F.col("z") >= whole["z"]))


def burn(areas: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """(aoi_id, z, x, y, tile_id): tiles that share some area with the polygon ``ring`` of (aoi_id, ring).

    ring: an array of (x, y) in degrees.  The tiles of its box are generated,
    then held against the polygon in Arrow batches; zooms run from min_zoom to
    below max_zoom.
    """
    from ..functions.polygons import box_ring, covered_area

    def end(f, axis: str) -> Column:
        return f(F.transform("ring", lambda p: p[axis].cast("double")))

    boxes = areas.select("aoi_id", "ring", end(F.array_min, "x").alias("west"), end(F.array_min, "y").alias("south"), end(F.array_max, "x").alias("east"), end(F.array_max, "y").alias("north"))
    box = tm.bounds(F.col("z"), F.col("x"), F.col("y"))
    edges = ("west", "south", "east", "north")
    rows = schedule(boxes, min_zoom, max_zoom).select("aoi_id", F.col("z").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"), "tile_id", "ring", *[box[k].alias(k) for k in edges])

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings = [[(p["x"], p["y"]) for p in r] for r in b.column("ring").to_pylist()]
            sides = zip(*(b.column(k).to_pylist() for k in edges), strict=True)
            inside = [covered_area(r, [box_ring(*s)]) > 1e-12 for r, s in zip(rings, sides, strict=True)]
            yield b.filter(pa.array(inside, pa.bool_())).select(["aoi_id", "z", "x", "y", "tile_id"])

    return rows.mapInArrow(touch, "aoi_id long, z int, x int, y int, tile_id long")


def zoom_expand(tiles: DataFrame, source: int, targets: list[int]) -> DataFrame:
    """Distinct descendants (tile_id) at the target zooms of the tiles of zoom ``source``; the same zoom is the tile itself."""
    low, high = tm.zoom_range(source)
    start = tiles.select("tile_id").where(F.col("tile_id").between(low, high)).distinct()
    out = None
    for target in sorted(set(targets)):
        if target < source:
            raise ValueError(f"zoom {target} lies above {source}")
        k = target - source
        first = F.lit(tm.zoom_range(target)[0]) + F.shiftleft(F.col("tile_id") - low, 2 * k)
        level = start.select(F.explode(F.sequence(first, first + ((1 << 2 * k) - 1))).alias("tile_id"))
        out = level if out is None else out.unionByName(level)
    return out


def pyramid_keys(tiles: DataFrame, source: int, final: int) -> DataFrame:
    """Distinct (z, tile_id) of all ancestors from ``source`` - 1 up to ``final``, in one pass."""
    if final >= source:
        raise ValueError("the final zoom must lie above the source zoom")
    low, high = tm.zoom_range(source)
    up = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), (F.lit(tm.zoom_range(z)[0]) + F.shiftright(F.col("tile_id") - low, 2 * (source - z))).alias("tile_id")) for z in range(final, source)])).alias("a")
    return tiles.where(F.col("tile_id").between(low, high)).select("tile_id").distinct().select(up).select("a.z", "a.tile_id").distinct()


def pyramid_counts(tiles: DataFrame, source: int, final: int) -> DataFrame:
    return pyramid_keys(tiles, source, final).groupBy("z").agg(F.count("*").alias("n_tiles"))


def downsample_pixels(pixels: DataFrame, size: int) -> DataFrame:
    """One level up by nearest pixels: (pz, px, py, row, col, ch, value) from (z, x, y, row, col, ch, value).

    A parent's pixel (r, c) is pixel (2r + 1, 2c + 1) of the four children side
    by side, so three of four pixels are dropped before the shuffle-free step.
    """
    odd = pixels.where((F.col("row") % 2 == 1) & (F.col("col") % 2 == 1))
    half = size // 2
    at = lambda v, t: ((F.col(t) % 2) * half + F.shiftright(v, 1)).cast("int")
    return odd.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), at("row", "y").alias("row"), at("col", "x").alias("col"), "ch", "value")


def downsample_images(tiles: DataFrame, how: str = "nearest") -> DataFrame:
    """(tile_id, payload) of the parents of (tile_id, payload); absent children stay clear."""
    from ..functions.codec import decode_png, encode_png, mosaic

    at = tm.tile_of(F.col("tile_id"))
    held = tiles.select(tm.parent_id(F.col("tile_id")).alias("tile_id"), F.struct((at["x"] % 2).alias("dx"), (at["y"] % 2).alias("dy"), "payload").alias("child")).where("tile_id IS NOT NULL")
    grouped = held.groupBy("tile_id").agg(F.collect_list("child").alias("children"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_png(mosaic({(c["dx"], c["dy"]): decode_png(c["payload"]) for c in four}, how)) for four in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["tile_id", "payload"])

    return grouped.mapInArrow(reduce, "tile_id long, payload binary")


def build_pyramid(tiles: DataFrame, source: int, final: int = 1, how: str = "nearest") -> DataFrame:
    """``tiles`` with all levels from ``source`` - 1 to ``final``; a generated tile replaces one that was there.

    Each level reads the one below, at most 26 steps; every level is a quarter
    of the one below, so the whole is a third more work than the first.
    """
    if final >= source:
        raise ValueError("the final zoom must lie above the source zoom")
    spark = tiles.sparkSession
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    low, high = tm.zoom_range(source)
    level, made = tiles.where(F.col("tile_id").between(low, high)).select("tile_id", "payload"), None
    for _ in range(source - final):
        level = downsample_images(level, how)
        # Each level is made once: kept where all executors find it, or else where it can be made again.
        level = level.checkpoint() if shared else level.persist()
        made = level if made is None else made.unionByName(level)
    kept = tiles.select("tile_id", "payload").join(made.select("tile_id"), "tile_id", "left_anti")
    return kept.unionByName(made)
