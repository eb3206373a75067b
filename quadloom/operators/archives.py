"""Tile archives as tables of (archive, tile_id, ...): lists, merges, filters, repair.

Keys and payloads are separate columns, so id-only work never reads a payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tilemath as tm

PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def with_ids(tiles: DataFrame) -> DataFrame:
    """``tiles`` (z, x, y) with tile_id."""
    return tiles.withColumn("tile_id", tm.tile_id(F.col("z"), F.col("x"), F.col("y")))


def tile_list(tiles: DataFrame) -> DataFrame:
    """Distinct ids of all archives."""
    return tiles.select("tile_id").distinct()


def _before(counts: DataFrame, bits: int) -> DataFrame:
    """(slot, base): the sum of n over smaller slots of (slot, n), level by level.

    Sums are taken within groups of 2**bits neighbouring slots, and those groups
    are slots of the next level, so no task orders more than 2**bits rows.
    """
    reach = counts.agg(F.min("slot").alias("low"), F.max("slot").alias("high")).first()
    if reach["low"] is None or reach["low"] >> bits == reach["high"] >> bits:
        group = F.lit(0).cast("long")
    else:
        group = F.shiftright("slot", bits)
    inner = Window.partitionBy("group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("group", group).select("slot", "group", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inner"))
    if reach["low"] is None or reach["low"] >> bits == reach["high"] >> bits:
        return ranked.select("slot", F.col("inner").alias("base"))
    above = _before(counts.groupBy(F.shiftright("slot", bits).alias("slot")).agg(F.sum("n").alias("n")), bits)
    return ranked.join(above.select(F.col("slot").alias("group"), F.col("base").alias("outer")), "group").select("slot", (F.col("inner") + F.col("outer")).alias("base"))


def ordinal(df: DataFrame, key: str, bits: int = 12, slot: Column | None = None) -> DataFrame:
    """``df`` with ordinal, the number of rows with a smaller ``key`` (an integer, unique).

    Ranks are taken within ranges of 2**bits keys and raised by the counts of
    the ranges before, so no task holds more than a range.  ``slot`` names
    other ranges, integers that come first in the order.
    """
    dealt = df.withColumn("_slot", F.shiftright(F.col(key).cast("long"), bits) if slot is None else slot.cast("long"))
    counts = dealt.groupBy(F.col("_slot").alias("slot")).agg(F.count("*").alias("n"))
    base = _before(counts, 12).select(F.col("slot").alias("_slot"), F.col("base").alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_slot").orderBy(key)) - 1
    return dealt.withColumn("_rank", inner).join(base, "_slot").withColumn("ordinal", (F.col("_rank") + F.col("_base")).cast("long")).drop("_slot", "_rank", "_base")


def point_lookup(tiles: DataFrame, tile: int) -> DataFrame:
    """Rows of one id; the equality reaches the scan."""
    return tiles.where(F.col("tile_id") == tile)


def zoom_filter(tiles: DataFrame, zoom: int) -> DataFrame:
    """Rows of one zoom, as a range of ids."""
    low, high = tm.zoom_range(zoom)
    return tiles.where(F.col("tile_id").between(low, high))


def membership(tiles: DataFrame, keys: DataFrame) -> DataFrame:
    return tiles.join(keys.select("tile_id"), "tile_id", "left_semi")


def merge_schedule(tiles: DataFrame) -> DataFrame:
    """(tile_id, sources): the archives that hold each tile, in order."""
    return tiles.groupBy("tile_id").agg(F.sort_array(F.collect_set("archive")).alias("sources"))


def merge_counts(tiles: DataFrame) -> DataFrame:
    """Tiles to merge and tiles to copy."""
    held = tiles.select("tile_id", "archive").distinct().groupBy("tile_id").agg(F.count("*").alias("n"))
    return held.agg(F.count_if(F.col("n") > 1).alias("n_merge"), F.count_if(F.col("n") == 1).alias("n_copy"))


def archive_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("archive").agg(F.count("*").alias("n_tiles"))


def zoom_histogram(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z").agg(F.count("*").alias("n_tiles"))


def headers(tiles: DataFrame) -> DataFrame:
    """A header for each archive: zooms, bounds in 10^-7 degrees, and counts."""
    box = tm.bounds(F.col("z"), F.col("x"), F.col("y"))
    rows = tiles.select("archive", "z", *[box[k].alias(k) for k in ("west", "south", "east", "north")])
    return rows.groupBy("archive").agg(
        F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"),
        tm.e7(F.min("west")).alias("min_lon_e7"), tm.e7(F.min("south")).alias("min_lat_e7"),
        tm.e7(F.max("east")).alias("max_lon_e7"), tm.e7(F.max("north")).alias("max_lat_e7"), F.count("*").alias("n_tiles"),
    )


def merge_headers(heads: DataFrame) -> DataFrame:
    """One header over all: extremes, and centres cut to integers."""
    both = heads.agg(*[(F.min if k.startswith("min") else F.max)(k).alias(k) for k in ("min_zoom", "max_zoom", "min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7")])
    middle = lambda a, b: ((F.col(a) + F.col(b)) / 2).cast("long")
    return both.select("*", middle("min_zoom", "max_zoom").alias("center_zoom"), middle("min_lon_e7", "max_lon_e7").alias("center_lon_e7"), middle("min_lat_e7", "max_lat_e7").alias("center_lat_e7"))


def overlay_fold(pixels: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, row, col, ch, value): images with alpha 0 or 255 pasted in order, each through its alpha.

    ``pixels``: key, order, row, col, rgba (four values).  The first image is
    the base whatever its alpha; the last one that is opaque at a pixel wins.
    """
    first = F.min(F.col(order))
    spot = pixels.groupBy(*key, "row", "col").agg(
        F.max_by("rgba", order).alias("_any"),  # keeps the type in the plan
        F.min_by("rgba", order).alias("base"),
        F.max_by("rgba", F.when(F.element_at("rgba", 4) == 255, F.col(order))).alias("top"),
        first.alias("_first"),
    )
    return spot.select(*key, "row", "col", F.posexplode(F.coalesce("top", "base")).alias("ch", "value"))


def merge_tilesets(tiles: DataFrame) -> DataFrame:
    """(tile_id, n_sources, payload): archives merged in the order ``ord``.

    ``tiles``: tile_id, ord, payload.  A tile of one archive is copied without
    being decoded; the rest are folded image by image.
    """
    from ..functions.codec import decode_png, encode_png, overlay

    # Which ids are in several archives is known from the keys alone; only those payloads are gathered.
    shared = tiles.groupBy("tile_id").agg(F.count("*").alias("n")).where("n > 1").select("tile_id")
    single = tiles.join(shared, "tile_id", "left_anti").select("tile_id", F.lit(1).alias("n_sources"), "payload")
    grouped = tiles.join(shared, "tile_id", "left_semi").groupBy("tile_id").agg(F.sort_array(F.collect_list(F.struct("ord", "payload"))).alias("held"))
    several = grouped.select("tile_id", F.size("held").alias("n_sources"), F.transform("held", lambda h: h["payload"]).alias("payloads"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for images in b.column(2).to_pylist():
                rgba = [decode_png(p) for p in images]
                rgba = [x if x.shape[2] == 4 else np.dstack([x[..., :3], np.full(x.shape[:2], 255, np.uint8)]) for x in rgba]
                made.append(encode_png(overlay(rgba)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["tile_id", "n_sources", "payload"])

    return single.unionByName(several.mapInArrow(fold, "tile_id long, n_sources int, payload binary"))


def alpha_filter(images: DataFrame, share: Column, threshold: float = 0.05) -> DataFrame:
    """Images whose share of clear pixels is at most ``threshold``; those without alpha go too."""
    return images.where(share <= threshold)


def alpha_filter_stats(images: DataFrame, share: Column, threshold: float = 0.05) -> DataFrame:
    """How many images there are, are kept, and the share dropped (null if there are none)."""
    kept = F.count_if(F.coalesce(share <= threshold, F.lit(False)))
    return images.agg(F.count("*").alias("n_tiles"), kept.alias("n_kept"), F.try_divide(F.count("*") - kept, F.count("*")).alias("dropped_share"))


def classify_payload(payload: Column) -> Column:
    """`ok`, `retry` (a busy server's page), `missing` (a not-found page) or `broken`."""
    body = F.decode(payload.cast("binary"), "ISO-8859-1")
    return F.when(payload.isNull(), "broken").when(F.substring(payload.cast("binary"), 1, 8) == F.lit(PNG_HEAD), "ok").when(F.contains(body, F.lit("503")), "retry").when(F.contains(body, F.lit("404")), "missing").otherwise("broken")


def empty_tile(size: int = 256) -> bytes:
    """A black RGB tile."""
    from ..functions.codec import encode_png

    return encode_png(np.zeros((size, size, 3), np.uint8))


def repair(tiles: DataFrame, fetched: DataFrame, size: int = 256) -> DataFrame:
    """(tile_id, payload, state): every id stays; ``fetched`` (tile_id, payload) replaces what can be retried."""
    state = tiles.withColumn("state", classify_payload(F.col("payload")))
    got = fetched.select("tile_id", F.col("payload").alias("_new"))
    new = F.when(F.col("state") == "ok", F.col("payload")).when((F.col("state") == "retry") & (classify_payload(F.col("_new")) == "ok"), F.col("_new")).otherwise(F.lit(empty_tile(size)))
    return state.join(got, "tile_id", "left").select("tile_id", new.alias("payload"), "state")


def repair_stats(tiles: DataFrame, payload: str = "payload") -> DataFrame:
    """How many payloads are in each state."""
    return tiles.groupBy(classify_payload(F.col(payload)).alias("state")).agg(F.count("*").alias("n_tiles"))
