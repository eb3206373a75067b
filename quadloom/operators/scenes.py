"""Scene search, filters, spatial joins and greedy cover."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tilemath as tm
from ..functions.polygons import box_ring, covered_area, greedy_cover

BOX = ("west", "south", "east", "north")
#: Degrees of a grid cell of the spatial join.
CELL = 10.0


def sar_filter(scenes: DataFrame) -> DataFrame:
    """C band, interferometric wide mode."""
    return scenes.where("frequency_band = 'C' AND instrument_mode = 'IW'")


def cloud_filter(scenes: DataFrame, most: int = 10) -> DataFrame:
    """At most ``most`` per cent cloud; unknown cover is dropped."""
    return scenes.where(F.col("cloud_cover") <= most)


def window_search(scenes: DataFrame, start: str, weeks: int = 2, searches: int = 1, limit: int = 20, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(window, window_start, ...) of the scenes of ``searches`` windows stepping back from ``start``.

    A window holds its newest ``limit`` scenes (ties: the least scene_id), and
    both its edges, so that neighbours share a scene on their edge.
    """
    windows = F.explode(F.transform(F.sequence(F.lit(0), F.lit(searches - 1)), lambda i: F.struct(i.alias("window"), (F.lit(start).cast("timestamp_ntz") - F.make_dt_interval(i * (7 * weeks))).alias("window_start")))).alias("w")
    span = F.expr(f"INTERVAL {7 * weeks} DAYS")
    low = F.lit(start).cast("timestamp_ntz") - F.expr(f"INTERVAL {7 * weeks * (searches - 1)} DAYS")
    rows = scenes.where((F.col("ts") >= low) & (F.col("ts") <= F.lit(start).cast("timestamp_ntz") + span))
    if box:
        rows = rows.where(tm.bbox_overlaps({k: F.col(k) for k in BOX}, {k: F.lit(v) for k, v in zip(BOX, box, strict=True)}))
    met = rows.select("*", windows).select("w.window", "w.window_start", *scenes.columns).where((F.col("ts") >= F.col("window_start")) & (F.col("ts") <= F.col("window_start") + span))
    newest = Window.partitionBy("window").orderBy(F.desc("ts"), "scene_id")
    return met.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of box ``a`` that box ``b`` covers; not symmetric."""
    wide = F.greatest(F.least(a["east"], b["east"]) - F.greatest(a["west"], b["west"]), F.lit(0.0))
    high = F.greatest(F.least(a["north"], b["north"]) - F.greatest(a["south"], b["south"]), F.lit(0.0))
    return F.least(F.lit(1.0), wide * high / ((a["east"] - a["west"]) * (a["north"] - a["south"])))


def spatial_join(scenes: DataFrame, areas: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of boxes that overlap or touch; the areas' columns are prefixed with ``aoi_``.

    Both sides go to the grid cells they touch and meet by an equi-join; a pair
    is reported in the cell of the lower left corner of its overlap only.
    """
    def cells(df: DataFrame) -> DataFrame:
        x = F.explode(F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell))).alias("cx")
        y = F.explode(F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))).alias("cy")
        return df.select("*", x).select("*", y)

    right = cells(areas).select("cx", "cy", *[F.col(c).alias(c if c.startswith("aoi_") else f"aoi_{c}") for c in areas.columns])
    met = cells(scenes).join(right, ["cx", "cy"])
    mine, theirs = ({k: F.col(p + k) for k in BOX} for p in ("", "aoi_"))
    corner = (F.floor(F.greatest("west", "aoi_west") / cell) == F.col("cx")) & (F.floor(F.greatest("south", "aoi_south") / cell) == F.col("cy"))
    return met.where(tm.bbox_overlaps(mine, theirs) & corner).drop("cx", "cy")


def best_scene(pairs: DataFrame) -> DataFrame:
    """(aoi_id, scene_id, overlap): the scene that covers most of each area; ties go to the least id."""
    share = overlap_ratio({k: F.col("aoi_" + k) for k in BOX}, {k: F.col(k) for k in BOX})
    best = pairs.select("aoi_id", "scene_id", share.alias("overlap")).groupBy("aoi_id").agg(F.max(F.struct("overlap", (-F.col("scene_id")).alias("n"))).alias("b"))
    return best.select("aoi_id", (-F.col("b.n")).alias("scene_id"), F.col("b.overlap").alias("overlap"))


def group_coverage(pairs: DataFrame) -> DataFrame:
    """(aoi_id, coverage): share of each area that the union of its scenes covers.

    Boxes only matter where they are clipped to the area, so distinct clipped
    boxes are what a group holds.
    """
    clip = [F.greatest("west", "aoi_west").alias("west"), F.greatest("south", "aoi_south").alias("south"), F.least("east", "aoi_east").alias("east"), F.least("north", "aoi_north").alias("north")]
    held = pairs.select("aoi_id", *["aoi_" + k for k in BOX], *clip).distinct()

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        target = box_ring(*pdf[["aoi_" + k for k in BOX]].iloc[0])
        rings = [box_ring(*r) for r in pdf[list(BOX)].itertuples(index=False)]
        return pd.DataFrame({"aoi_id": [pdf.aoi_id.iloc[0]], "coverage": [min(1.0, covered_area(target, rings) / covered_area(target, [target]))]})

    return held.groupBy("aoi_id").applyInPandas(cover, "aoi_id long, coverage double")


def cover(pairs: DataFrame, most: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """(aoi_id, step, scene_id, coverage): a greedy choice of scenes for each area.

    It goes on until the area is covered, the scenes end or there are ``most``.

    Of scenes that cover the same part of an area, the least id is a candidate,
    which keeps a group at its distinct clipped boxes.
    """
    clip = [F.greatest("west", "aoi_west").alias("west"), F.greatest("south", "aoi_south").alias("south"), F.least("east", "aoi_east").alias("east"), F.least("north", "aoi_north").alias("north")]
    area_cols = ["aoi_" + k for k in BOX]
    held = pairs.select("aoi_id", "scene_id", *area_cols, *clip).groupBy("aoi_id", *area_cols, *BOX).agg(F.min("scene_id").alias("scene_id"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scene_id")
        target = box_ring(*pdf[area_cols].iloc[0])
        rows = greedy_cover(target, [(int(r.scene_id), box_ring(r.west, r.south, r.east, r.north)) for r in pdf.itertuples()], most, tolerance)
        return pd.DataFrame([(pdf.aoi_id.iloc[0], i, key, share) for i, (key, share) in enumerate(rows)], columns=["aoi_id", "step", "scene_id", "coverage"])

    return held.groupBy("aoi_id").applyInPandas(choose, "aoi_id long, step int, scene_id long, coverage double")


def geojson(pairs: DataFrame) -> DataFrame:
    """(aoi_id, geojson): a FeatureCollection of each area, marked red, and its scenes by id."""
    def feature(key: Column, ring: Column, style: Column) -> Column:
        return F.struct(F.lit("Feature").alias("type"), F.struct(key.cast("string").alias("id"), style.alias("stroke")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")).alias("geometry"))

    area = feature(F.col("aoi_id"), tm.bbox_ring(*[F.col("aoi_" + k) for k in BOX]), F.lit("red"))
    scene = feature(F.col("scene_id"), tm.bbox_ring(*[F.col(k) for k in BOX]), F.lit(None).cast("string"))
    grouped = pairs.groupBy("aoi_id").agg(F.first(area).alias("area"), F.sort_array(F.collect_list(F.struct("scene_id", scene.alias("f")))).alias("scenes"))
    features = F.concat(F.array("area"), F.transform("scenes", lambda s: s["f"]))
    return grouped.select("aoi_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))).alias("geojson"))
