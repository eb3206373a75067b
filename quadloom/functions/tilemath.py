"""Tile addresses as Spark columns: Hilbert ids, parents, children, bounds.

A tile id numbers the tiles of all zooms: those of zoom z begin at
(4^z - 1) / 3 and follow the Hilbert curve.  Descendants of a tile are one range
of ids, so zoom and subtree predicates are ranges that Parquet can skip by.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .bind import once

MAX_ZOOM = 26
#: Zoom at which the corners of a box are compared.
CORNER_ZOOM = 28


def zoom_base(z: Column | int) -> Column:
    """First id of a zoom."""
    z = F.lit(z) if isinstance(z, int) else z
    return ((F.call_function("shiftleft", F.lit(1).cast("long"), (z * 2).cast("int")) - 1) / 3).cast("long")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Id of tile (z, x, y); null if one of them is."""
    side = F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int")) - 1

    def bit(v: Column, i: Column) -> Column:
        return F.call_function("shiftright", v, i).bitwiseAND(F.lit(1).cast("long"))

    def step(acc: Column, i: Column) -> Column:
        rx, ry = bit(acc["x"], i), bit(acc["y"], i)
        d = acc["d"] + F.call_function("shiftleft", (rx * 3).bitwiseXOR(ry), i * 2)
        fx = F.when(rx == 1, side - acc["x"]).otherwise(acc["x"])
        fy = F.when(rx == 1, side - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(acc["x"]).alias("x"), F.when(ry == 0, fx).otherwise(acc["y"]).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    levels = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).when(z == 0, F.array().cast("array<int>"))
    return zoom_base(z) + F.aggregate(levels, start, step, lambda acc: acc["d"])


def zoom_of(tile: Column) -> Column:
    """Zoom of an id: 3 * id + 1 has two more binary digits for each zoom."""
    return F.floor((F.length(F.bin(tile * 3 + 1)) - 1) / 2).cast("int")


def tile_of(tile: Column) -> Column:
    """struct(z, x, y) of an id."""

    def step(acc: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        rx = F.shiftright(acc["t"], 1).bitwiseAND(F.lit(1).cast("long"))
        ry = acc["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        fx = F.when(rx == 1, side - 1 - acc["x"]).otherwise(acc["x"])
        fy = F.when(rx == 1, side - 1 - acc["y"]).otherwise(acc["y"])
        x = F.when(ry == 0, fy).otherwise(acc["x"]) + side * rx
        y = F.when(ry == 0, fx).otherwise(acc["y"]) + side * ry
        return F.struct(x.alias("x"), y.alias("y"), F.shiftright(acc["t"], 2).alias("t"))

    def walk(key: Column) -> Column:
        z, zero = key["z"], F.lit(0).cast("long")
        start = F.struct(zero.alias("x"), zero.alias("y"), (key["t"] - zoom_base(z)).alias("t"))
        levels = F.when(z > 0, F.sequence(F.lit(0), z - 1)).when(z == 0, F.array().cast("array<int>"))
        return F.aggregate(levels, start, step, lambda acc: F.struct(z.alias("z"), acc["x"].cast("int").alias("x"), acc["y"].cast("int").alias("y")))

    return once(tile, lambda t: once(F.struct(t.alias("t"), zoom_of(t).alias("z")), walk))


def parent_id(tile: Column, levels: int = 1) -> Column:
    """Id of the ancestor ``levels`` up; null above the root."""

    def up(key: Column) -> Column:
        z = key["z"]
        return F.when(z >= levels, zoom_base(z - levels) + F.shiftright(key["t"] - zoom_base(z), 2 * levels))

    return once(F.struct(tile.cast("long").alias("t"), zoom_of(tile).alias("z")), up)


def child_range(tile: Column, levels: int = 1) -> tuple[Column, Column]:
    """First and last id of the descendants ``levels`` down."""
    z = zoom_of(tile)
    first = zoom_base(z + levels) + F.shiftleft(tile - zoom_base(z), 2 * levels)
    return first, first + ((1 << 2 * levels) - 1)


def zoom_range(z: int) -> tuple[int, int]:
    """First and last id of a zoom, for a predicate that prunes row groups."""
    return ((1 << 2 * z) - 1) // 3, ((1 << 2 * (z + 1)) - 1) // 3 - 1


def children(z: Column, x: Column, y: Column) -> Column:
    """The four children, top left, top right, bottom right, bottom left."""
    return F.array(*[F.struct((z + 1).cast("int").alias("z"), (x * 2 + dx).cast("int").alias("x"), (y * 2 + dy).cast("int").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])


def _edge_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def bounds(z: Column, x: Column, y: Column) -> Column:
    """struct(west, south, east, north) in degrees."""
    side = F.pow(F.lit(2.0), z)
    return F.struct((x / side * 360 - 180).alias("west"), _edge_lat(y + 1, z).alias("south"), ((x + 1) / side * 360 - 180).alias("east"), _edge_lat(y, z).alias("north"))


def column_at(lon: Column, z: Column | int) -> Column:
    """Tile column of a longitude, within the zoom."""
    z = F.lit(z) if isinstance(z, int) else z
    side = F.pow(F.lit(2.0), z)
    return F.least(F.greatest(F.floor((lon / 360 + 0.5) * side), F.lit(0)), side.cast("long") - 1).cast("long")


def row_at(lat: Column, z: Column | int) -> Column:
    """Tile row of a latitude, within the zoom."""
    z = F.lit(z) if isinstance(z, int) else z
    side = F.pow(F.lit(2.0), z)
    s = F.sin(F.radians(lat))
    return F.least(F.greatest(F.floor((0.5 - 0.25 * F.log((1 + s) / (1 - s)) / F.pi()) * side), F.lit(0)), side.cast("long") - 1).cast("long")


def bounding_tile(west: Column, south: Column, east: Column, north: Column) -> Column:
    """struct(z, x, y): the smallest tile that holds the box."""
    x1, x2 = column_at(west, CORNER_ZOOM), column_at(east, CORNER_ZOOM)
    y1, y2 = row_at(north, CORNER_ZOOM), row_at(south, CORNER_ZOOM)
    apart = x1.bitwiseXOR(x2).bitwiseOR(y1.bitwiseXOR(y2))
    bits = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart))).cast("int")
    z = F.lit(CORNER_ZOOM) - bits
    return F.struct(z.alias("z"), F.call_function("shiftright", x1, bits).cast("int").alias("x"), F.call_function("shiftright", y1, bits).cast("int").alias("y"))


def parse_tile(text: Column) -> Column:
    """struct(z, x, y) of 'z/x/y'."""
    parts = F.split(text, "/")
    return F.struct(*[F.get(parts, i).try_cast("int").alias(n) for i, n in enumerate("zxy")])


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    """``template`` with {z}, {x} and {y} filled in."""
    out = F.lit(template)
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def e7(degrees: Column) -> Column:
    """Degrees times 10^7 as an integer, cut toward zero."""
    return (degrees * 1e7).cast("long")


def bbox_overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Boxes overlap or touch."""
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def bbox_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed ring from the north-east corner: NE, SE, SW, NW, NE."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((east, north), (east, south), (west, south), (west, north), (east, north))])


def register(spark: SparkSession) -> None:
    """Makes quad_id(z, x, y) and quad_parent(id) callable from SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quad_base(z INT) RETURNS BIGINT RETURN CAST((shiftleft(1L, 2 * z) - 1) / 3 AS BIGINT)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION quad_id(z INT, x BIGINT, y BIGINT) RETURNS BIGINT RETURN CAST((shiftleft(1L, 2 * z) - 1) / 3 AS BIGINT) + "
        "aggregate(CASE WHEN z > 0 THEN sequence(z - 1, 0, -1) WHEN z = 0 THEN CAST(array() AS ARRAY<INT>) END, named_struct('x', x, 'y', y, 'd', 0L), "
        "(a, i) -> named_struct("
        "'x', CASE WHEN shiftright(a.y, i) & 1L = 0 THEN CASE WHEN shiftright(a.x, i) & 1L = 1 THEN shiftleft(1L, z) - 1 - a.y ELSE a.y END ELSE a.x END, "
        "'y', CASE WHEN shiftright(a.y, i) & 1L = 0 THEN CASE WHEN shiftright(a.x, i) & 1L = 1 THEN shiftleft(1L, z) - 1 - a.x ELSE a.x END ELSE a.y END, "
        "'d', a.d + shiftleft((3 * (shiftright(a.x, i) & 1L)) ^ (shiftright(a.y, i) & 1L), 2 * i)), a -> a.d)"
    )
