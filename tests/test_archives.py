"""Payload operators, archive files, tile lists and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.functions import tilemath as tm
from quadloom.functions.codec import decode_png, encode_png
from quadloom.operators import align, archives, pyramid, shards
from quadloom.sources import archives as files
from quadloom.sources import pmtiles
from quadloom.streaming import ingest


def image(value, size=4, alpha=255):
    x = np.full((size, size, 4), value, np.uint8)
    x[..., 3] = alpha
    return encode_png(x)


def tiles(spark, rows):
    return spark.createDataFrame(rows, "z int, x int, y int, archive string, ord int, payload binary").withColumn("tile_id", tm.tile_id(F.col("z"), F.col("x"), F.col("y")))


def test_merge_copies_and_folds(spark):
    df = tiles(spark, [(1, 0, 0, "a", 0, image(10)), (1, 0, 0, "b", 1, image(90, alpha=0)), (1, 1, 0, "a", 0, image(30)), (1, 0, 1, "a", 0, image(10)), (1, 0, 1, "b", 1, image(90))])
    got = {r.tile_id: (r.n_sources, decode_png(r.payload)[0, 0].tolist()) for r in archives.merge_tilesets(df).collect()}
    ids = [r.tile_id for r in df.select("tile_id", "z", "x", "y").distinct().orderBy("x", "y").collect()]
    assert got[ids[0]] == (2, [10, 10, 10, 255]) and got[ids[1]] == (2, [90, 90, 90, 255]) and got[ids[2]] == (1, [30, 30, 30, 255])


def test_pyramid_replaces_and_keeps(spark):
    rows = [(2, x, y, "a", 0, image(10 * (x + 4 * y) + 5)) for x in range(4) for y in range(4)] + [(1, 0, 0, "a", 0, image(255)), (3, 0, 0, "a", 0, image(1))]
    out = pyramid.build_pyramid(tiles(spark, rows), 2, 0).withColumn("t", tm.tile_of(F.col("tile_id")))
    got = {(r.t.z, r.t.x, r.t.y): decode_png(r.payload) for r in out.collect()}
    assert len(got) == 16 + 4 + 1 + 1
    assert got[1, 0, 0][0, 0, 0] == 5 and got[1, 0, 0][3, 3, 0] == 55
    assert got[0, 0, 0][3, 0, 0] == 10 * (0 + 4 * 3) + 5
    with pytest.raises(ValueError):
        pyramid.build_pyramid(tiles(spark, rows), 1, 1)


def test_downsample_pixels_match_images(spark):
    rng = np.random.default_rng(2)
    rows, flat = [], []
    for x in range(2):
        for y in range(2):
            data = rng.integers(0, 255, (4, 4, 4)).astype(np.uint8)
            rows.append((3, x, y, "a", 0, encode_png(data)))
            flat += [(3, x, y, r, c, ch, int(data[r, c, ch])) for r in range(4) for c in range(4) for ch in range(4)]
    made = decode_png(pyramid.downsample_images(tiles(spark, rows)).first().payload)
    table = pyramid.downsample_pixels(spark.createDataFrame(flat, "z int, x int, y int, row int, col int, ch int, value int"), 4).collect()
    assert len(table) == 64 and all(made[r.row, r.col, r.ch] == r.value for r in table)


def test_stitch(spark):
    rows = [(3, 2 + dx, 4 + dy, "a", 0, image(10 * dx + dy)) for dx in (0, 1) for dy in (0, 1)] + [(3, 0, 0, "a", 0, image(3))]
    got = align.stitch_4x(tiles(spark, rows)).collect()
    assert len(got) == 1
    x = decode_png(got[0].payload)
    assert x.shape == (8, 8, 4) and [x[0, 0, 0], x[0, 7, 0], x[7, 7, 0], x[7, 0, 0]] == [0, 10, 11, 1]


def test_repair(spark):
    bad = spark.createDataFrame([(1, image(5)), (2, b"<p>503 busy</p>"), (3, b"<p>404</p>"), (4, None), (5, b"503")], "tile_id long, payload binary")
    fresh = spark.createDataFrame([(2, image(9)), (5, b"still 503")], "tile_id long, payload binary")
    got = {r.tile_id: (r.state, decode_png(r.payload).shape, decode_png(r.payload)[0, 0, 0]) for r in archives.repair(bad, fresh, 8).collect()}
    assert got == {1: ("ok", (4, 4, 4), 5), 2: ("retry", (4, 4, 4), 9), 3: ("missing", (8, 8, 3), 0), 4: ("broken", (8, 8, 3), 0), 5: ("retry", (8, 8, 3), 0)}


def test_align_payloads(spark):
    a, b = (spark.createDataFrame([(i, bytes([i])) for i in r], "tile_id long, payload binary") for r in (range(4), range(2, 9)))
    rows = align.align_payloads({"radar": a, "lores": b}).collect()
    assert sorted((r.tile_id, bytes(r.radar), bytes(r.lores)) for r in rows) == [(2, b"\2", b"\2"), (3, b"\3", b"\3")]


def test_ordinal_and_split(spark):
    keys = spark.createDataFrame([(i * i,) for i in range(103)], "k long")
    got = shards.split(keys, "k", 10).orderBy("k").collect()
    assert [r.ordinal for r in got] == list(range(103))
    assert [[r.chunk for r in got].count(c) for c in range(10)] == [len(c) for c in np.array_split(np.arange(103), 10)]
    few = shards.split(spark.createDataFrame([(5,), (7,)], "k long"), "k", 4).collect()
    assert sorted(r.chunk for r in few) == [0, 1]


def test_rank_shards_pad(spark):
    got = shards.rank_shard(spark.range(10), "id", 4).collect()
    assert [sum(r.shard == s for r in got) for s in range(4)] == [3, 3, 3, 3] and len({r.id for r in got}) == 10


def test_archive_layout(spark, tmp_path):
    df = tiles(spark, [(z, x, 0, a, 0, b"p") for z in (1, 2) for x in (0, 1) for a in ("r", "l")])
    files.write_archive(df, str(tmp_path / "a"))
    assert files.read_archive(spark, str(tmp_path / "a"), "r", 2).count() == 2
    files.write_tile_list(df, str(tmp_path / "l"))
    assert files.read_tile_list(spark, str(tmp_path / "l")).count() == 4
    np.save(tmp_path / "ids.npy", np.array([3, 1, 2]))
    assert sorted(r[0] for r in files.read_tile_list(spark, str(tmp_path / "ids.npy")).collect()) == [1, 2, 3]


def test_cut_tiles(spark):
    plan = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 1), (3, 1, 1, 1)], "tile_id long, z int, x int, y int")

    def read(z, x, y):
        return None if x else (np.full((2, 4, 4), 1500 * y + 500.0), np.full((4, 4), 255))

    got = {r.tile_id: decode_png(r.payload)[0, 0].tolist() for r in files.cut_tiles(plan, read, "sar").collect()}
    assert got == {1: [0, 127, 127, 255], 2: [0, 255, 255, 255]}


@pytest.mark.parametrize("leaf", [4, 4096])
def test_pmtiles(spark, tmp_path, leaf):
    rows = [(i * 3 if i % 5 else i * 3, bytes([i % 4]) * (i % 7 + 1)) for i in range(40)] + [(200 + i, b"same") for i in range(6)]
    path = str(tmp_path / "x.pmtiles")
    assert pmtiles.write_file(path, iter(rows), {"min_zoom": 0, "max_zoom": 3}, {"attribution": "none"}, leaf) == 46
    pmtiles.register(spark)
    got = sorted((r.tile_id, bytes(r.payload)) for r in spark.read.format("quadloom_pmtiles").load(path).collect())
    assert got == rows
    head = pmtiles.read_header(path)
    assert head["n_tiles"] == 46 and head["max_zoom"] == 3 and pmtiles.read_metadata(path) == {"attribution": "none"}
    with pytest.raises(ValueError):
        pmtiles.write_file(path, iter([(2, b"a"), (1, b"b")]))


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(5, b"e"), (1, b"a")], "tile_id long, payload binary")
    assert pmtiles.export(df, str(tmp_path / "e.pmtiles")) == 2


def test_stream(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS archive", "user_id AS tile_id")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = ingest.first_tiles(stream).writeStream.foreachBatch(ingest.append_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == source.select("archive", "tile_id").distinct().count()
    q = ingest.arrivals(stream).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n_tiles) FROM arrivals").first()[0] == source.count()


def test_ranks_of_far_keys(spark):
    """Keys of the deepest zoom neither overflow nor collide, and sparse ones are ranked level by level."""
    from quadloom.operators import shards

    keys = [(4**26 - 1) // 3 + 7 * i for i in range(50)] + [5, 4**20, (1 << 62) + 3]
    df = spark.createDataFrame([(k,) for k in keys], "tile_id long")
    assert {r.tile_id: r.ordinal for r in archives.ordinal(df, "tile_id").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    order = sorted(keys, key=lambda k: ((k * 7919 + 2 * 104729) % 1000003, k))
    got = {r.ordinal: r.tile_id for r in shards.rank_shard(df, "tile_id", 4, epoch=2).collect()}
    assert [got[i] for i in range(len(keys))] == order and [got[len(keys) + i] for i in range(-len(keys) % 4)] == order[: -len(keys) % 4]
    assert archives.ordinal(df.limit(0), "tile_id").count() == 0
