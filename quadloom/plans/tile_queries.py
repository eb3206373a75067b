"""Queries on tile addresses, archives, alignment and pyramids, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import FIXTURES, fixture, images, table
from ..functions import pixels as px
from ..functions import tilemath as tm
from ..operators import align, archives, pyramid, shards

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def duck(*names: str, ids_of: str | None = None, ctes: str = "", select: str) -> str:
    """DuckDB SQL over stand-ins; ``ids_of`` adds ids(z, x, y, tile_id) of a relation of tiles by a
    recursive walk down the curve, one digit of base four a step."""
    parts = [f"{n} AS ({FIXTURES[n][1]})" for n in names]
    if ctes:
        parts.append(ctes)
    if ids_of:
        parts.append(
            "walk(z, x0, y0, i, x, y, d) AS (SELECT DISTINCT CAST(z AS INT), CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(z AS INT) - 1, CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(0 AS BIGINT) "
            f"FROM {ids_of} UNION ALL SELECT z, x0, y0, i - 1, "
            "CASE WHEN (y >> i) & 1 = 1 THEN x WHEN (x >> i) & 1 = 1 THEN (CAST(1 AS BIGINT) << z) - 1 - y ELSE y END, "
            "CASE WHEN (y >> i) & 1 = 1 THEN y WHEN (x >> i) & 1 = 1 THEN (CAST(1 AS BIGINT) << z) - 1 - x ELSE x END, "
            "d * 4 + CASE WHEN (y >> i) & 1 = 1 THEN CASE WHEN (x >> i) & 1 = 1 THEN 2 ELSE 1 END WHEN (x >> i) & 1 = 1 THEN 3 ELSE 0 END FROM walk WHERE i >= 0), "
            "ids AS (SELECT z, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y, CAST(((CAST(1 AS BIGINT) << (2 * z)) - 1) // 3 + d AS BIGINT) AS tile_id FROM walk WHERE i = -1)"
        )
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def tiles(spark: SparkSession, sf_dir: str, name: str = "tiles") -> DataFrame:
    return archives.with_ids(fixture(spark, sf_dir, name))


_JOINED = "keyed AS (SELECT t.archive, i.z, i.x, i.y, i.tile_id FROM tiles t JOIN ids i USING (z, x, y))"


def duck_ids(select: str, more: str = "") -> str:
    """As ``duck`` over ``tiles``, with keyed(archive, z, x, y, tile_id)."""
    text = duck("tiles", ids_of="tiles", select="@")
    return text.replace(" @", f", {_JOINED}{', ' + more if more else ''} {select}")


@query(duck_ids("SELECT archive, z, x, y, tile_id FROM keyed"))
def tile_id(spark, sf_dir):
    return tiles(spark, sf_dir).select("archive", "z", "x", "y", "tile_id")


@query(duck_ids("SELECT DISTINCT tile_id, z, x, y FROM keyed"))
def tile_id_inverse(spark, sf_dir):
    return tiles(spark, sf_dir).select("tile_id").distinct().select("tile_id", tm.tile_of(F.col("tile_id")).alias("t")).select("tile_id", "t.z", "t.x", "t.y")


@query(duck("tiles", ids_of="(SELECT z, x, y FROM tiles UNION SELECT z - 1, x // 2, y // 2 FROM tiles)", select="SELECT c.tile_id, p.tile_id AS parent_id, p.z, p.x, p.y FROM (SELECT DISTINCT z, x, y FROM tiles) t JOIN ids c USING (z, x, y) JOIN ids p ON p.z = t.z - 1 AND p.x = t.x // 2 AND p.y = t.y // 2"))
def tile_parent(spark, sf_dir):
    up = tm.parent_id(F.col("tile_id"))
    keys = archives.tile_list(tiles(spark, sf_dir)).select("tile_id", up.alias("parent_id"), tm.tile_of(up).alias("p"))
    return keys.select("tile_id", "parent_id", "p.z", "p.x", "p.y")


_QUAD = "kids AS (SELECT t.x AS px, t.y AS py, 7 AS z, t.x * 2 + q.dx AS x, t.y * 2 + q.dy AS y, q.k FROM (SELECT DISTINCT x, y FROM tiles) t, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) q(k, dx, dy))"


@query(duck("tiles", ctes=_QUAD, ids_of="kids", select="SELECT CAST(k.px AS INT) AS px, CAST(k.py AS INT) AS py, CAST(k.k AS INT) AS k, k.z, CAST(k.x AS INT) AS x, CAST(k.y AS INT) AS y, i.tile_id FROM kids k JOIN ids i USING (z, x, y)"))
def tile_children(spark, sf_dir):
    keys = fixture(spark, sf_dir, "tiles").select("z", "x", "y").distinct()
    kids = keys.select(F.col("x").alias("px"), F.col("y").alias("py"), F.posexplode(tm.children(F.col("z"), F.col("x"), F.col("y"))).alias("k", "c"))
    return archives.with_ids(kids.select("px", "py", "k", "c.z", "c.x", "c.y"))


_BOUND_Y = "0.5 - ln(tan(radians({})) + 1 / cos(radians({}))) / (2 * pi())"


@query(
    duck(
        "aoi",
        ctes="c AS (SELECT aoi_id, CAST(floor((west + 180) / 360 * 268435456) AS BIGINT) AS x1, CAST(floor((east + 180) / 360 * 268435456) AS BIGINT) AS x2, "
        f"CAST(floor(({_BOUND_Y.format('north', 'north')}) * 268435456) AS BIGINT) AS y1, CAST(floor(({_BOUND_Y.format('south', 'south')}) * 268435456) AS BIGINT) AS y2 FROM aoi)",
        select="SELECT aoi_id, max(z) AS z, CAST(arg_max(x, z) AS INT) AS x, CAST(arg_max(y, z) AS INT) AS y FROM (SELECT aoi_id, CAST(k AS INT) AS z, x1 >> (28 - k) AS x, y1 >> (28 - k) AS y FROM c, range(29) r(k) WHERE x1 >> (28 - k) = x2 >> (28 - k) AND y1 >> (28 - k) = y2 >> (28 - k)) GROUP BY aoi_id",
    )
)
def bounding_tile(spark, sf_dir):
    t = tm.bounding_tile(*[F.col(k) for k in ("west", "south", "east", "north")])
    return fixture(spark, sf_dir, "aoi").select("aoi_id", t.alias("t")).select("aoi_id", "t.z", "t.x", "t.y")


@query(duck("tiles", select="SELECT DISTINCT z || '/' || x || '/' || y AS name, z, x, y FROM tiles"))
def parse_tile(spark, sf_dir):
    named = fixture(spark, sf_dir, "tiles").select(F.concat_ws("/", "z", "x", "y").alias("name")).distinct()
    return named.select("name", tm.parse_tile(F.col("name")).alias("t")).select("name", "t.z", "t.x", "t.y")


@query(duck("tiles", select="SELECT DISTINCT z, x, y, 'https://tiles.test/' || z || '/' || x || '/' || y || '.png' AS url FROM tiles"))
def tile_url(spark, sf_dir):
    return fixture(spark, sf_dir, "tiles").select("z", "x", "y").distinct().withColumn("url", tm.tile_url("https://tiles.test/{z}/{x}/{y}.png", F.col("z"), F.col("x"), F.col("y")))


_BOUNDS = "b AS (SELECT DISTINCT z, x, y, x / 64.0 * 360 - 180 AS west, (x + 1) / 64.0 * 360 - 180 AS east, degrees(2 * atan(exp(pi() * (1 - 2 * y / 64.0))) - pi() / 2) AS north, degrees(2 * atan(exp(pi() * (1 - 2 * (y + 1) / 64.0))) - pi() / 2) AS south FROM tiles)"


@query(duck("tiles", ctes=_BOUNDS, select="SELECT z, x, y, round(west, 9) + 0.0 AS west, round(south, 9) + 0.0 AS south, round(east, 9) + 0.0 AS east, round(north, 9) + 0.0 AS north FROM b"))
def tile_bounds(spark, sf_dir):
    b = tm.bounds(F.col("z"), F.col("x"), F.col("y"))
    return fixture(spark, sf_dir, "tiles").select("z", "x", "y").distinct().select("z", "x", "y", *[(F.round(b[k], 9) + 0.0).alias(k) for k in ("west", "south", "east", "north")])


@query(duck("aoi", select="SELECT aoi_id, CAST(p AS INT) AS p, CASE WHEN p IN (0, 1, 4) THEN east ELSE west END AS x, CASE WHEN p IN (0, 3, 4) THEN north ELSE south END AS y FROM aoi, range(5) r(p)"))
def bbox_polygon(spark, sf_dir):
    ring = tm.bbox_ring(*[F.col(k) for k in ("west", "south", "east", "north")])
    return fixture(spark, sf_dir, "aoi").select("aoi_id", F.posexplode(ring).alias("p", "q")).select("aoi_id", "p", "q.x", "q.y")


@query("SELECT o_orderkey AS scene_id, CAST(trunc((o_totalprice / 1000) * 1e7) AS BIGINT) AS up, CAST(trunc((-o_totalprice / 1000) * 1e7) AS BIGINT) AS down FROM orders")
def e7_encode(spark, sf_dir):
    degrees = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), tm.e7(degrees).alias("up"), tm.e7(-degrees).alias("down"))


_GRID = (
    "grid AS (SELECT CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM range(6, 9) zz(z), LATERAL (SELECT unnest(range(CAST(1 AS BIGINT) << z)) AS x) xx, LATERAL (SELECT unnest(range(CAST(1 AS BIGINT) << z)) AS y) yy), "
    "edges AS (SELECT *, x / pow(2.0, z) * 360 - 180 AS w, (x + 1) / pow(2.0, z) * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) AS s FROM grid), "
    "plan AS (SELECT aoi_id, z, x, y FROM aoi a JOIN edges g ON g.w <= a.east AND a.west <= g.e AND g.s <= a.north AND a.south <= g.n "
    "AND g.x BETWEEN floor((a.west + 180) / 360 * pow(2.0, z)) AND floor((a.east + 180) / 360 * pow(2.0, z)))"
)


def _schedule(spark, sf_dir):
    return pyramid.schedule(fixture(spark, sf_dir, "aoi"), 6, 9).select("aoi_id", "z", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "tile_id")


@query(duck("aoi", ctes=_GRID, ids_of="plan", select="SELECT p.aoi_id, p.z, p.x, p.y, i.tile_id FROM plan p JOIN ids i USING (z, x, y)"))
def tile_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir)


@query(duck("aoi", ctes=_GRID, select="SELECT z, count(*) AS n_tiles FROM plan GROUP BY z"))
def zoom_histogram(spark, sf_dir):
    return archives.zoom_histogram(_schedule(spark, sf_dir))


@query(duck("aoi", ctes=_GRID, ids_of="plan", select="SELECT p.aoi_id, i.tile_id FROM plan p JOIN ids i USING (z, x, y) WHERE p.z = 7"))
def zoom_filter(spark, sf_dir):
    return archives.zoom_filter(_schedule(spark, sf_dir), 7).select("aoi_id", "tile_id")


@query(duck("tiles", ctes="down AS (SELECT DISTINCT CAST(6 + k AS INT) AS z, CAST(x * (1 << k) + dx AS INT) AS x, CAST(y * (1 << k) + dy AS INT) AS y FROM tiles, range(3) r(k), range(4) a(dx), range(4) b(dy) WHERE dx < (1 << k) AND dy < (1 << k))", ids_of="down", select="SELECT tile_id FROM ids"))
def zoom_expand(spark, sf_dir):
    return pyramid.zoom_expand(tiles(spark, sf_dir), 6, [6, 7, 8])


@query(duck_ids("SELECT DISTINCT tile_id FROM keyed"))
def tile_list(spark, sf_dir):
    return archives.tile_list(tiles(spark, sf_dir))


@query(duck_ids("SELECT tile_id FROM keyed WHERE archive = 'radar' INTERSECT SELECT tile_id FROM keyed WHERE archive = 'lores'"))
def tile_intersect(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return align.keys_of(t, "radar").intersect(align.keys_of(t, "lores"))


@query(duck_ids("SELECT archive, tile_id FROM keyed WHERE tile_id IN (SELECT tile_id FROM keyed WHERE archive = 'hires')"))
def tile_membership(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return archives.membership(t, align.keys_of(t, "hires")).select("archive", "tile_id")


@query(duck_ids("SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS ordinal FROM (SELECT DISTINCT tile_id FROM keyed)"))
def ordinal_access(spark, sf_dir):
    return archives.ordinal(archives.tile_list(tiles(spark, sf_dir)), "tile_id", bits=8).select("tile_id", "ordinal")


@query(duck_ids("SELECT archive, z, x, y, tile_id FROM keyed WHERE tile_id = 1365 + 2048"))
def point_lookup(spark, sf_dir):
    return archives.point_lookup(tiles(spark, sf_dir), 1365 + 2048).select("archive", "z", "x", "y", "tile_id")


_IN = "tile_id IN (SELECT tile_id FROM keyed WHERE archive = '{}')"


@query(duck_ids(f"SELECT DISTINCT tile_id, z, x, y FROM keyed WHERE {_IN.format('radar')} AND {_IN.format('lores')} AND {_IN.format('hires')}"))
def align_three(spark, sf_dir):
    t = tiles(spark, sf_dir)
    keys = align.align(*[align.keys_of(t, a) for a in ("radar", "lores", "hires")])
    return keys.select("tile_id", tm.tile_of(F.col("tile_id")).alias("t")).select("tile_id", "t.z", "t.x", "t.y")


@query(duck_ids(f"SELECT DISTINCT tile_id FROM keyed WHERE {_IN.format('radar')} AND {_IN.format('lores')}"))
def align_two(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return align.align(align.keys_of(t, "radar"), align.keys_of(t, "lores"))


@query(duck_ids("SELECT tile_id FROM keyed WHERE archive = 'radar' EXCEPT SELECT tile_id FROM keyed WHERE archive = 'hires'"))
def align_missing(spark, sf_dir):
    return align.missing(tiles(spark, sf_dir), "radar", "hires")


@query(duck_ids("SELECT tile_id, string_agg(DISTINCT archive, ',' ORDER BY archive DESC) AS archives FROM keyed WHERE archive IN ('radar', 'lores', 'hires') GROUP BY tile_id"))
def union_dataset(spark, sf_dir):
    return align.union_dataset(tiles(spark, sf_dir), ["radar", "lores", "hires"]).select("tile_id", F.array_join("archives", ",").alias("archives"))


@query(duck("tiles_z7", select="SELECT 6 AS z, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, count(*) AS n_children FROM tiles_z7 GROUP BY x // 2, y // 2 HAVING count(*) = 4"))
def complete_parents(spark, sf_dir):
    return align.complete_parents(fixture(spark, sf_dir, "tiles_z7"))


_HELD = "held AS (SELECT tile_id, count(DISTINCT archive) AS n, string_agg(DISTINCT archive, ',' ORDER BY archive) AS sources FROM keyed GROUP BY tile_id)"


@query(duck_ids("SELECT tile_id, sources FROM held", _HELD))
def merge_schedule(spark, sf_dir):
    return archives.merge_schedule(tiles(spark, sf_dir)).select("tile_id", F.array_join("sources", ",").alias("sources"))


@query(duck_ids("SELECT count(*) FILTER (n > 1) AS n_merge, count(*) FILTER (n = 1) AS n_copy FROM held", _HELD))
def merge_counts(spark, sf_dir):
    return archives.merge_counts(tiles(spark, sf_dir))


@query(duck("tiles", select="SELECT archive, count(*) AS n_tiles FROM tiles GROUP BY archive"))
def archive_counts(spark, sf_dir):
    return archives.archive_counts(tiles(spark, sf_dir))


_HEADS = (
    "spans AS (SELECT archive, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, count(*) AS n FROM tiles GROUP BY archive), "
    "heads AS (SELECT archive, 6 AS min_zoom, 6 AS max_zoom, CAST(trunc((x1 / 64.0 * 360 - 180) * 1e7) AS BIGINT) AS min_lon_e7, CAST(trunc(degrees(atan(sinh(pi() * (1 - 2 * (y2 + 1) / 64.0)))) * 1e7) AS BIGINT) AS min_lat_e7, "
    "CAST(trunc(((x2 + 1) / 64.0 * 360 - 180) * 1e7) AS BIGINT) AS max_lon_e7, CAST(trunc(degrees(atan(sinh(pi() * (1 - 2 * y1 / 64.0)))) * 1e7) AS BIGINT) AS max_lat_e7, n AS n_tiles FROM spans)"
)


@query(duck("tiles", ctes=_HEADS, select="SELECT * FROM heads"))
def archive_headers(spark, sf_dir):
    return archives.headers(tiles(spark, sf_dir))


@query(
    duck(
        "tiles",
        ctes=_HEADS,
        select="SELECT min(min_zoom) AS min_zoom, max(max_zoom) AS max_zoom, min(min_lon_e7) AS min_lon_e7, min(min_lat_e7) AS min_lat_e7, max(max_lon_e7) AS max_lon_e7, max(max_lat_e7) AS max_lat_e7, "
        "CAST(trunc((min(min_zoom) + max(max_zoom)) / 2) AS BIGINT) AS center_zoom, CAST(trunc((min(min_lon_e7) + max(max_lon_e7)) / 2) AS BIGINT) AS center_lon_e7, CAST(trunc((min(min_lat_e7) + max(max_lat_e7)) / 2) AS BIGINT) AS center_lat_e7 FROM heads",
    )
)
def header_merge(spark, sf_dir):
    return archives.merge_headers(archives.headers(tiles(spark, sf_dir)))


@query(
    duck(
        "pixels",
        ctes="p AS (SELECT e.label, q.tile, q.row, q.col, q.ch, q.value, a.value AS alpha FROM pixels q JOIN pixels a ON q.tile = a.tile AND q.row = a.row AND q.col = a.col AND a.ch = 3 JOIN embeddings e ON e.vec_id = q.tile), "
        "firsts AS (SELECT label, min(tile) AS f FROM p GROUP BY label), "
        "r AS (SELECT p.*, row_number() OVER (PARTITION BY p.label, row, col, ch ORDER BY CASE WHEN alpha = 255 THEN 0 ELSE 1 END, tile DESC) AS k FROM p JOIN firsts USING (label) WHERE alpha = 255 OR tile = f)",
        select="SELECT label, row, col, ch, value FROM r WHERE k = 1",
    )
)
def overlay_fold(spark, sf_dir):
    spots = images(spark, sf_dir).select("label", "tile", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("data", k * 4 + 1, F.lit(4)))).alias("k", "rgba"))
    rows = spots.select("label", "tile", F.floor(F.col("k") / 4).cast("int").alias("row"), (F.col("k") % 4).alias("col"), "rgba")
    return archives.overlay_fold(rows, ["label"], "tile")


@query(duck_ids("SELECT tile_id, n AS n_sources, CASE WHEN n > 1 THEN 'merge' ELSE 'copy' END AS action, sources FROM held", _HELD))
def merge_plan(spark, sf_dir):
    plan = archives.merge_schedule(tiles(spark, sf_dir))
    n = F.size("sources").cast("long")
    return plan.select("tile_id", n.alias("n_sources"), F.when(n > 1, "merge").otherwise("copy").alias("action"), F.array_join("sources", ",").alias("sources"))


_PLACED = "p AS (SELECT CAST(5 AS INT) AS z, CAST(tile % 32 AS INT) AS x, CAST(tile // 32 AS INT) AS y, row, col, ch, value FROM pixels)"


@query(duck("pixels", ctes=_PLACED, select="SELECT 4 AS z, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(r AS INT) AS row, CAST(c AS INT) AS col, ch, value FROM p, range(4) a(r), range(4) b(c) WHERE y % 2 = (2 * r + 1) // 4 AND x % 2 = (2 * c + 1) // 4 AND row = (2 * r + 1) % 4 AND col = (2 * c + 1) % 4"))
def downsample_pixels(spark, sf_dir):
    p = fixture(spark, sf_dir, "pixels").selectExpr("5 AS z", "CAST(tile % 32 AS INT) AS x", "CAST(tile DIV 32 AS INT) AS y", "row", "col", "ch", "value")
    return pyramid.downsample_pixels(p, 4)


_UPS = "ups AS (SELECT DISTINCT CAST(k AS INT) AS z, CAST(x >> (6 - k) AS INT) AS x, CAST(y >> (6 - k) AS INT) AS y FROM tiles, (SELECT CAST(unnest(range(1, 6)) AS INT) AS k))"


@query(duck("tiles", ctes=_UPS, ids_of="ups", select="SELECT z, tile_id FROM ids"))
def pyramid_keys(spark, sf_dir):
    return pyramid.pyramid_keys(tiles(spark, sf_dir), 6, 1)


@query(duck("tiles", ctes=_UPS, select="SELECT z, count(*) AS n_tiles FROM ups GROUP BY z"))
def pyramid_counts(spark, sf_dir):
    return pyramid.pyramid_counts(tiles(spark, sf_dir), 6, 1)


_SHARES = "s AS (SELECT tile, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS share FROM pixels WHERE ch = 3 GROUP BY tile)"


@query(duck("pixels", ctes=_SHARES, select="SELECT tile, share FROM s WHERE share <= 0.05"))
def alpha_filter(spark, sf_dir):
    share = px.zero_alpha_share(F.col("data"))
    return archives.alpha_filter(images(spark, sf_dir), share).select("tile", share.alias("share"))


@query(duck("pixels", ctes=_SHARES, select="SELECT count(*) AS n_tiles, count(*) FILTER (share <= 0.05) AS n_kept, count(*) FILTER (share > 0.05) / count(*) AS dropped_share FROM s"))
def alpha_filter_stats(spark, sf_dir):
    return archives.alpha_filter_stats(images(spark, sf_dir), px.zero_alpha_share(F.col("data")))


@query("SELECT page_id, CASE WHEN html IS NULL THEN 'broken' WHEN html LIKE '%503%' THEN 'retry' WHEN html LIKE '%404%' THEN 'missing' ELSE 'broken' END AS state FROM pages")
def repair_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", archives.classify_payload(F.col("html")).alias("state"))


@query("SELECT state, count(*) AS n_tiles FROM (SELECT CASE WHEN html IS NULL THEN 'broken' WHEN html LIKE '%503%' THEN 'retry' WHEN html LIKE '%404%' THEN 'missing' ELSE 'broken' END AS state FROM pages) GROUP BY state")
def repair_stats(spark, sf_dir):
    return archives.repair_stats(table(spark, sf_dir, "pages"), "html")


@query(duck_ids("SELECT tile_id, CAST(ntile(16) OVER (ORDER BY tile_id) - 1 AS INT) AS chunk FROM (SELECT DISTINCT tile_id FROM keyed)"))
def split_chunks(spark, sf_dir):
    return shards.split(archives.tile_list(tiles(spark, sf_dir)), "tile_id", 16).select("tile_id", "chunk")


@query("SELECT CAST(node AS INT) AS node, string_agg('chunk_' || c || '.tiles', ' ' ORDER BY c) AS inputs FROM (SELECT c, ntile(4) OVER (ORDER BY c) - 1 AS node FROM range(16) r(c)) GROUP BY node")
def split_merge_tree(spark, sf_dir):
    return shards.merge_tree(split_chunks(spark, sf_dir), 4)


_ORDER = "deal AS (SELECT tile_id, row_number() OVER (ORDER BY (tile_id * 7919 + 3 * 104729) % 1000003, tile_id) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT tile_id FROM keyed)), padded AS (SELECT tile_id, o FROM deal UNION ALL SELECT tile_id, o + n FROM deal WHERE o < (4 - n % 4) % 4)"


def _shards(spark, sf_dir):
    return shards.rank_shard(archives.tile_list(tiles(spark, sf_dir)), "tile_id", 4, epoch=3)


@query(duck_ids("SELECT tile_id, o AS ordinal, CAST(o % 4 AS INT) AS shard FROM padded", _ORDER))
def rank_shard(spark, sf_dir):
    return _shards(spark, sf_dir)


@query(duck_ids("SELECT tile_id, CAST(o % 4 AS INT) AS shard, CAST((o // 4) // 32 AS INT) AS batch, CAST((o // 4) % 32 AS INT) AS slot FROM padded", _ORDER))
def batch_assign(spark, sf_dir):
    return shards.batches(_shards(spark, sf_dir), 4, 32).select("tile_id", "shard", "batch", "slot")


@query("SELECT event_id, event_id // 100 AS epoch, event_id % 100 AS batch_idx, value AS loss FROM events WHERE (event_id % 100) % 10 = 0")
def metric_sampling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("epoch"), (F.col("event_id") % 100).alias("batch_idx"), F.col("value").alias("loss"))
    return shards.sample_metrics(rows)
