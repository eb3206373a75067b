"""Queries on scenes and areas of interest, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture
from ..functions import tilemath as tm
from ..operators import scenes, shards
from .tile_queries import duck, query

_PAIRS = "pairs AS (SELECT a.aoi_id, a.west AS aw, a.south AS asouth, a.east AS ae, a.north AS an, s.* FROM scenes s JOIN aoi a ON s.west <= a.east AND a.west <= s.east AND s.south <= a.north AND a.south <= s.north)"
_SHARE = "least(1.0, greatest(least(ae, east) - greatest(aw, west), 0) * greatest(least(an, north) - greatest(asouth, south), 0) / ((ae - aw) * (an - asouth)))"
_COLUMNS = "scene_id, ts, frequency_band, instrument_mode, cloud_cover, west, south, east, north"


def _pairs(spark, sf_dir):
    return scenes.spatial_join(fixture(spark, sf_dir, "scenes"), fixture(spark, sf_dir, "aoi"))


def _share():
    return scenes.overlap_ratio({k: F.col("aoi_" + k) for k in scenes.BOX}, {k: F.col(k) for k in scenes.BOX})


@query(duck("scenes", select=f"SELECT {_COLUMNS} FROM scenes WHERE frequency_band = 'C' AND instrument_mode = 'IW'"))
def scene_filter_sar(spark, sf_dir):
    return scenes.sar_filter(fixture(spark, sf_dir, "scenes"))


@query(duck("scenes", select=f"SELECT {_COLUMNS} FROM scenes WHERE cloud_cover <= 10"))
def scene_filter_cloud(spark, sf_dir):
    return scenes.cloud_filter(fixture(spark, sf_dir, "scenes"))


@query(
    duck(
        "scenes",
        ctes="w AS (SELECT CAST(k AS INT) AS win, TIMESTAMP '1998-06-01' - to_days(CAST(14 * k AS INT)) AS window_start FROM range(5) r(k)), "
        "m AS (SELECT win, window_start, s.*, row_number() OVER (PARTITION BY win ORDER BY ts DESC, scene_id) AS rank FROM scenes s JOIN w ON ts BETWEEN window_start AND window_start + INTERVAL 14 DAY)",
        select='SELECT win AS "window", window_start, scene_id, ts, CAST(rank AS INT) AS rank FROM m WHERE rank <= 20',
    )
)
def scene_window_search(spark, sf_dir):
    return scenes.window_search(fixture(spark, sf_dir, "scenes"), "1998-06-01 00:00:00", 2, 5).select("window", "window_start", "scene_id", "ts", "rank")


@query(duck("scenes", "aoi", ctes=_PAIRS, select="SELECT aoi_id, scene_id FROM pairs"))
def spatial_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("aoi_id", "scene_id")


@query(duck("scenes", "aoi", select="SELECT scene_id, west <= 20 AND east >= -20 AND south <= 15 AND north >= -15 AS overlaps FROM scenes"))
def bbox_overlap(spark, sf_dir):
    box = {k: F.lit(v) for k, v in zip(scenes.BOX, (-20.0, -15.0, 20.0, 15.0), strict=True)}
    return fixture(spark, sf_dir, "scenes").select("scene_id", tm.bbox_overlaps({k: F.col(k) for k in scenes.BOX}, box).alias("overlaps"))


@query(duck("scenes", "aoi", ctes=_PAIRS, select=f"SELECT aoi_id, scene_id, round({_SHARE}, 9) AS overlap FROM pairs"))
def overlap_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("aoi_id", "scene_id", F.round(_share(), 9).alias("overlap"))


@query(duck("scenes", "aoi", ctes=f"{_PAIRS}, r AS (SELECT aoi_id, scene_id, {_SHARE} AS o FROM pairs)", select="SELECT aoi_id, scene_id, round(o, 9) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY o DESC, scene_id) AS k FROM r) WHERE k = 1"))
def best_scene(spark, sf_dir):
    return scenes.best_scene(_pairs(spark, sf_dir)).withColumn("overlap", F.round("overlap", 9))


# All corners are whole degrees, so coverage is a count of unit cells.
@query(
    duck(
        "scenes",
        "aoi",
        ctes=_PAIRS,
        select="SELECT aoi_id, round(count(DISTINCT CASE WHEN x < least(ae, east) AND y < least(an, north) AND x >= greatest(aw, west) AND y >= greatest(asouth, south) THEN x * 1000 + y END) / 25.0, 9) AS coverage "
        "FROM (SELECT *, aw + i AS x, asouth + j AS y FROM pairs, range(5) a(i), range(5) b(j)) GROUP BY aoi_id",
    )
)
def group_coverage(spark, sf_dir):
    return scenes.group_coverage(_pairs(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


@query()
def greedy_cover(spark, sf_dir):
    return scenes.cover(_pairs(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


_RING = "'[[[' || {e} || ',' || {n} || '],[' || {e} || ',' || {s} || '],[' || {w} || ',' || {s} || '],[' || {w} || ',' || {n} || '],[' || {e} || ',' || {n} || ']]]'"
_FEATURE = "'{{\"type\":\"Feature\",\"properties\":{{\"id\":\"' || {id} || '\"{style}}},\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":' || {ring} || '}}}}'"


@query(
    duck(
        "scenes",
        "aoi",
        ctes=_PAIRS,
        select="SELECT aoi_id, '{\"type\":\"FeatureCollection\",\"features\":[' || any_value("
        + _FEATURE.format(id="aoi_id", style=',\"stroke\":\"red\"', ring=_RING.format(w="aw", s="asouth", e="ae", n="an"))
        + ") || ',' || string_agg("
        + _FEATURE.format(id="scene_id", style="", ring=_RING.format(w="west", s="south", e="east", n="north"))
        + ", ',' ORDER BY scene_id) || ']}' AS geojson FROM pairs GROUP BY aoi_id",
    )
)
def geojson_collection(spark, sf_dir):
    return scenes.geojson(_pairs(spark, sf_dir))


_STEP = "SELECT scene_id, {n} AS n, '{step}' AS step, 'scene_' || scene_id || '.{ext}' AS output, {command} AS command FROM sel"
_MANIFEST = " UNION ALL ".join(
    [
        _STEP.format(n=0, step="download", ext="tif", command="'fetch scene_' || scene_id || ' scene_' || scene_id || '.tif'"),
        _STEP.format(n=1, step="tile", ext="tiles", command="'tile --zoom 12 scene_' || scene_id || '.tif scene_' || scene_id || '.tiles'"),
        _STEP.format(n=2, step="downsample", ext="pyramid", command="'downsample scene_' || scene_id || '.tiles scene_' || scene_id || '.pyramid'"),
    ]
)


@query(duck("scenes", ctes="sel AS (SELECT scene_id FROM scenes WHERE frequency_band = 'C' AND instrument_mode = 'IW')", select=_MANIFEST))
def job_manifest(spark, sf_dir):
    return shards.job_manifest(scenes.sar_filter(fixture(spark, sf_dir, "scenes")), 12)


@query(duck("scenes", ctes=f"sel AS (SELECT scene_id FROM scenes WHERE cloud_cover <= 10), m AS ({_MANIFEST})", select="SELECT scene_id, string_agg('[ -f ' || output || ' ] || ' || command, chr(10) ORDER BY n) AS script FROM m GROUP BY scene_id"))
def job_script(spark, sf_dir):
    return shards.job_script(shards.job_manifest(scenes.cloud_filter(fixture(spark, sf_dir, "scenes")), 12))
