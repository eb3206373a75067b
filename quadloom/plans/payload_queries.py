"""Queries on encoded tiles, decoded at the end and checked pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture, images
from ..functions import tilemath as tm
from ..operators import align, archives, payloads, pyramid, shards
from .tile_queries import _PLACED, duck, duck_ids, query, tiles


def _encoded(spark, sf_dir):
    """(tile, label, payload): the images as PNG."""
    return payloads.encode_images(images(spark, sf_dir), 4, 4, 4)


def _placed(spark, sf_dir):
    """(tile_id, payload): image n at column n % 32, row n // 32 of zoom 5."""
    rows = _encoded(spark, sf_dir)
    x, y = (F.col("tile") % 32).cast("int"), F.floor(F.col("tile") / 32).cast("int")
    return rows.where(F.col("tile") < 1024).select(tm.tile_id(F.lit(5), x, y).alias("tile_id"), "payload")


def _pixels(spark_df, key: str):
    return payloads.pixels(payloads.decode_images(spark_df.select(F.col(key).alias("tile_id"), "payload"))).select(tm.tile_of(F.col("tile_id")).alias("t"), "row", "col", "ch", "value").select("t.z", "t.x", "t.y", "row", "col", "ch", "value")


_GROUP = "CASE WHEN q.tile % 7 = 0 THEN 1000 + q.tile ELSE e.label END"


@query(
    duck(
        "pixels",
        ctes=f"p AS (SELECT CAST({_GROUP} AS BIGINT) AS tile_id, q.tile, q.row, q.col, q.ch, q.value, a.value AS alpha FROM pixels q JOIN pixels a ON q.tile = a.tile AND q.row = a.row AND q.col = a.col AND a.ch = 3 JOIN embeddings e ON e.vec_id = q.tile), "
        "firsts AS (SELECT tile_id, min(tile) AS f, count(DISTINCT tile) AS n FROM p GROUP BY tile_id), "
        "r AS (SELECT p.*, n, row_number() OVER (PARTITION BY p.tile_id, row, col, ch ORDER BY CASE WHEN alpha = 255 THEN 0 ELSE 1 END, tile DESC) AS k FROM p JOIN firsts USING (tile_id) WHERE alpha = 255 OR tile = f)",
        select="SELECT tile_id, CAST(n AS INT) AS n_sources, row, col, ch, value FROM r WHERE k = 1",
    )
)
def merge_tilesets(spark, sf_dir):
    key = F.when(F.col("tile") % 7 == 0, F.col("tile") + 1000).otherwise(F.col("label")).cast("long")
    merged = archives.merge_tilesets(_encoded(spark, sf_dir).select(key.alias("tile_id"), F.col("tile").alias("ord"), "payload"))
    return payloads.pixels(payloads.decode_images(merged))


@query(
    duck(
        "pixels",
        ctes=f"{_PLACED}, full_ AS (SELECT x // 2 AS px, y // 2 AS py FROM (SELECT DISTINCT x, y FROM p WHERE y < 32) GROUP BY ALL HAVING count(*) = 4)",
        select="SELECT 4 AS z, CAST(px AS INT) AS x, CAST(py AS INT) AS y, CAST(y % 2 * 4 + row AS INT) AS row, CAST(x % 2 * 4 + col AS INT) AS col, ch, value FROM p JOIN full_ ON px = x // 2 AND py = y // 2",
    )
)
def stitch_4x(spark, sf_dir):
    return _pixels(align.stitch_4x(_placed(spark, sf_dir)), "parent_id")


def _up(name: str, below: str, z: int) -> str:
    """Parents by nearest pixels of the relation ``below``; absent children are clear."""
    return (
        f"{name} AS (SELECT CAST({z} AS INT) AS z, px AS x, py AS y, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(ch AS INT) AS ch, CAST(coalesce(b.value, 0) AS INT) AS value "
        f"FROM (SELECT DISTINCT CAST(x // 2 AS INT) AS px, CAST(y // 2 AS INT) AS py FROM {below}) m, range(4) a(r), range(4) g(c), range(4) h(k) "
        f"LEFT JOIN {below} b ON b.x = px * 2 + (2 * c + 1) // 4 AND b.y = py * 2 + (2 * r + 1) // 4 AND b.row = (2 * r + 1) % 4 AND b.col = (2 * c + 1) % 4 AND b.ch = k)"
    ).replace("CAST(ch AS INT) AS ch", "CAST(k AS INT) AS ch")


_BASE = f"{_PLACED}, p5 AS (SELECT * FROM p WHERE y < 32)"


@query(duck("pixels", ctes=f"{_BASE}, {_up('p4', 'p5', 4)}", select="SELECT * FROM p4"))
def downsample_level(spark, sf_dir):
    return _pixels(pyramid.downsample_images(_placed(spark, sf_dir)), "tile_id")


@query(duck("pixels", ctes=f"{_BASE}, {_up('p4', 'p5', 4)}, {_up('p3', 'p4', 3)}", select="SELECT z, x, y, row, col, ch, value FROM p5 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p3"))
def build_pyramid(spark, sf_dir):
    return _pixels(pyramid.build_pyramid(_placed(spark, sf_dir), 5, 3), "tile_id")


@query(
    duck(
        "pixels",
        ctes="s AS (SELECT tile, CAST(sum(value) AS BIGINT) AS total FROM pixels GROUP BY tile)",
        select="SELECT tile AS tile_id, CASE tile % 5 WHEN 3 THEN 'retry' WHEN 4 THEN 'missing' ELSE 'ok' END AS state, CASE WHEN tile % 5 < 3 OR (tile % 5 = 3 AND tile % 2 = 0) THEN total ELSE 0 END AS total, "
        "CASE WHEN tile % 5 < 3 OR (tile % 5 = 3 AND tile % 2 = 0) THEN 4 ELSE 3 END AS channels FROM s",
    )
)
def repair(spark, sf_dir):
    rows = _encoded(spark, sf_dir)
    left = F.col("tile") % 5
    held = rows.select(F.col("tile").alias("tile_id"), F.when(left == 3, F.lit(b"<h1>503 busy</h1>")).when(left == 4, F.lit(b"<h1>404</h1>")).otherwise(F.col("payload")).alias("payload"))
    fetched = rows.where(left == 3).select(F.col("tile").alias("tile_id"), F.when(F.col("tile") % 2 == 0, F.col("payload")).otherwise(F.lit(b"503")).alias("payload"))
    done = payloads.decode_images(archives.repair(held, fetched, 4))
    return done.select("tile_id", "state", F.aggregate("data", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), "channels")


@query(duck("aoi", select="SELECT aoi_id, CAST(z AS INT) AS z, count(*) AS n FROM aoi, range(2, 6) r(z), range(32) a(x), range(32) b(y) WHERE x < (1 << z) AND y < (1 << z) "
            "AND x / (1 << z) * 360.0 - 180 <= east AND (x + 1) / (1 << z) * 360.0 - 180 >= west AND degrees(atan(sinh(pi() * (1 - 2.0 * (y + 1) / (1 << z))))) <= north AND degrees(atan(sinh(pi() * (1 - 2.0 * y / (1 << z))))) >= south GROUP BY aoi_id, z"))
def legacy_schedule(spark, sf_dir):
    return pyramid.legacy_schedule(fixture(spark, sf_dir, "aoi"), 2, 5).where("z >= 2").groupBy("aoi_id", "z").agg(F.count("*").alias("n"))


# Triangles with whole corners: a tile of the plane belongs to one if their overlap has an area.
@query(
    duck(
        "aoi",
        ctes="t AS (SELECT aoi_id, z, x, y, x / (1 << z) * 360.0 - 180 AS w, (x + 1) / (1 << z) * 360.0 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2.0 * (y + 1) / (1 << z))))) AS s, degrees(atan(sinh(pi() * (1 - 2.0 * y / (1 << z))))) AS n, west, south, east, north "
        "FROM aoi, range(4, 7) r(z), range(64) a(x), range(64) b(y) WHERE x < (1 << z) AND y < (1 << z))",
        # Below the falling diagonal of the box: the tile's lower left corner, moved into the box, must be.
        select="SELECT aoi_id, CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM t WHERE w < east AND e > west AND s < north AND n > south AND (greatest(w, west) - west) / (east - west) + (greatest(s, south) - south) / (north - south) < 1",
    )
)
def burn_polygon(spark, sf_dir):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    areas = fixture(spark, sf_dir, "aoi").select("aoi_id", F.array(corner("west", "south"), corner("east", "south"), corner("west", "north")).alias("ring"))
    return pyramid.burn(areas, 4, 7).select("aoi_id", "z", "x", "y")


@query(
    "SELECT CAST(step AS INT) AS step, CAST(place AS INT) AS place, line FROM ("
    "SELECT 0 AS step, c AS place, '[ -f chunk_' || c || '.tiles ] || fetch chunk_' || c || '.list chunk_' || c || '.tiles' AS line FROM range(16) r(c) "
    "UNION ALL SELECT 1, node, '[ -f merged_' || node || '.tiles ] || merge ' || string_agg('chunk_' || c || '.tiles', ' ' ORDER BY c) || ' merged_' || node || '.tiles' FROM (SELECT c, c // 4 AS node FROM range(16) r(c)) GROUP BY node "
    "UNION ALL SELECT 2, 0, '[ -f all.tiles ] || merge merged_0.tiles merged_1.tiles merged_2.tiles merged_3.tiles all.tiles')"
)
def split_download_script(spark, sf_dir):
    return shards.download_script(shards.split(archives.tile_list(tiles(spark, sf_dir)), "tile_id", 16), 4)


@query(duck_ids("SELECT tile_id << 24 AS key, row_number() OVER (ORDER BY tile_id) - 1 AS ordinal FROM (SELECT DISTINCT tile_id FROM keyed)"))
def ordinal_sparse(spark, sf_dir):
    """Keys so far apart that each has a range of its own."""
    return archives.ordinal(archives.tile_list(tiles(spark, sf_dir)).select(F.shiftleft("tile_id", 24).alias("key")), "key").select("key", "ordinal")
