"""Tile math, codecs, polygons and encoders against plain definitions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import codec, nn, polygons
from quadloom.functions import tilemath as tm


def hilbert(z, x, y):
    d, s = 0, 1 << z >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = (1 << z) - 1 - x, (1 << z) - 1 - y
            x, y = y, x
        s >>= 1
    return ((1 << 2 * z) - 1) // 3 + d


def test_ids_are_a_bijection(spark):
    tiles = [(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    df = spark.createDataFrame(tiles, "z int, x int, y int").withColumn("id", tm.tile_id(F.col("z"), F.col("x"), F.col("y")))
    rows = df.select("*", tm.tile_of(F.col("id")).alias("t"), tm.parent_id(F.col("id")).alias("p")).collect()
    assert sorted(r.id for r in rows) == list(range(len(tiles)))
    for r in rows:
        assert r.id == hilbert(r.z, r.x, r.y)
        assert (r.t.z, r.t.x, r.t.y) == (r.z, r.x, r.y)
        assert r.p == (hilbert(r.z - 1, r.x >> 1, r.y >> 1) if r.z else None)


def test_ids_of_deep_and_null_tiles(spark):
    df = spark.createDataFrame([(26, (1 << 26) - 1, 12345), (0, 0, 0), (None, 1, 1)], "z int, x int, y int")
    ids = df.select(tm.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("id")).collect()
    assert [r.id for r in ids] == [hilbert(26, (1 << 26) - 1, 12345), 0, None]


def test_sql_functions(spark):
    tm.register(spark)
    assert spark.sql("SELECT quad_id(6, 17, 42) AS a, quad_id(0, 0, 0) AS b").first() == (hilbert(6, 17, 42), 0)


def test_tile_text(spark):
    row = spark.createDataFrame([("3/4/5",), ("bad",), (None,)], "s string").select(tm.parse_tile(F.col("s")).alias("t")).collect()
    assert [(r.t.z, r.t.x, r.t.y) for r in row] == [(3, 4, 5), (None, None, None), (None, None, None)]


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 2**31))
def test_png_round_trip(h, w, c, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)
    assert (codec.decode_png(codec.encode_png(image)) == image).all()


def test_png_filters():
    """Rows written with each of the five filters read back."""
    import struct
    import zlib

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 6, 3)).astype(np.int32)
    raw = bytearray()
    for r in range(5):
        raw.append(r)
        for i in range(18):
            x = image[r].ravel()[i]
            a = image[r].ravel()[i - 3] if i >= 3 else 0
            b = image[r - 1].ravel()[i] if r else 0
            c = image[r - 1].ravel()[i - 3] if r and i >= 3 else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw.append((x - [0, a, b, (a + b) // 2, best][r]) % 256)
    plain = codec.encode_png(image.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    built = plain[:33] + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")
    assert (codec.decode_png(built) == image).all()


def test_broken_png():
    assert not codec.is_png(b"<html>503</html>") and not codec.is_png(None) and not codec.is_png(b"")
    with pytest.raises(ValueError):
        codec.decode_png(b"nothing")


def test_npy_round_trip():
    x = np.arange(12).reshape(3, 4)
    assert (codec.decode_npy(codec.encode_npy(x)) == x).all()


def test_resize():
    x = np.arange(16, dtype=np.uint8).reshape(4, 4, 1) * 10
    assert codec.resize(x, 2, 2)[..., 0].tolist() == [[50, 70], [130, 150]]
    assert codec.resize(x, 2, 2, "box")[..., 0].tolist() == [[25, 45], [105, 125]]
    assert codec.resize(x, 8, 8).shape == (8, 8, 1)
    assert (codec.resize(np.full((3, 5, 2), 9, np.uint8), 7, 2, "bilinear") == 9).all()


def test_overlay_and_mosaic():
    base, top = np.zeros((2, 2, 4), np.uint8), np.full((2, 2, 4), 200, np.uint8)
    top[..., 3] = [[0, 255], [255, 0]]
    got = codec.overlay([base, top])
    assert got[0, 1].tolist() == [200, 200, 200, 255] and got[0, 0].tolist() == [0, 0, 0, 0]
    m = codec.mosaic({(1, 0): np.full((4, 4, 3), 7, np.uint8)})
    assert m[0, 3].tolist() == [7, 7, 7, 255] and m[3, 0].tolist() == [0, 0, 0, 0]


def test_polygon_areas():
    box = polygons.box_ring
    assert polygons.area(box(0, 0, 4, 3)) == pytest.approx(12)
    assert polygons.area([(0, 0), (4, 0), (0, 3)]) == pytest.approx(6)
    assert polygons.covered_area(box(0, 0, 10, 10), [box(-5, -5, 5, 5), box(3, 3, 20, 6)]) == pytest.approx(25 + 21 - 4)
    assert polygons.overlap(box(0, 0, 2, 2), box(1, 0, 9, 9)) == pytest.approx(0.5)
    assert polygons.covered_area([(0, 0), (4, 0), (0, 4)], [[(0, 0), (4, 4), (0, 4)]]) == pytest.approx(4)
    picked = polygons.greedy_cover(box(0, 0, 10, 10), [(1, box(0, 0, 6, 10)), (2, box(5, 0, 7, 10)), (3, box(4, 0, 10, 10))], 5)
    assert [k for k, _ in picked] == [1, 3] and picked[-1][1] == pytest.approx(1)
    assert polygons.greedy_cover(box(0, 0, 1, 1), [], 3) == []


def test_encoder_shapes_and_masks():
    w = nn.init_vit(3, 2, 16, 2, cross=True)
    x = np.random.default_rng(0).normal(size=(2, 3, 8, 8))
    full, pooled = nn.project(x, w, 2, 4, 2)
    assert full.shape == (2, 16, 16) and pooled.shape == (2, 16)
    kept = nn.encode(x, w, 2, 4, 2, keep=np.array([3, 1, 7]))
    assert kept.shape == (2, 3, 16)
    assert nn.project(x[0], w, 2, 4, 2)[0].shape == (1, 16, 16)
    crossed = nn.transformer(full, w, "vit", nn.grid_bias(4, 16), 4, 2, context=full[:, :4], cross_bias=nn.grid_bias(4, 16)[:, :, :4])
    assert crossed.shape == full.shape


def test_bias():
    b = nn.grid_bias(16, 64, 0.5)
    assert (b <= 0).all() and np.allclose(b, b.transpose(0, 2, 1)) and not b.diagonal(axis1=1, axis2=2).any()
    assert np.allclose(nn.slopes(16), [2 ** (-(i + 1) / 2) for i in range(16)])
    assert len(nn.slopes(12)) == 12 and nn.slopes(12)[8] == pytest.approx(2**-0.5)
    assert nn.gather_bias_rect(b[:, :, ::4], np.arange(16), np.arange(16), flat=True).shape == (16, 16, 16)


def test_losses():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(8, 5))
    assert nn.contrastive_loss(a, a) < nn.contrastive_loss(a, -a)
    t = rng.normal(size=(2, 4, 6))
    norm = (t - t.mean(-1, keepdims=True)) / np.sqrt(t.var(-1, ddof=1, keepdims=True) + 1e-6)
    assert nn.mae_loss(t, norm, np.ones((2, 4))) == pytest.approx(0)
    restore = np.array([[2, 0, 1]])
    assert nn.restore(np.array([[[5.0]]]), np.array([0.0]), restore)[0, :, 0].tolist() == [0.0, 5.0, 0.0]
    assert nn.gelu(np.array([0.0, 1.0]))[1] == pytest.approx(0.5 * (1 + math.erf(1 / math.sqrt(2))), abs=1e-6)


def test_resampling_filters():
    """Flat images stay flat under each filter, and halving keeps the mean of smooth ones."""
    rng = np.random.default_rng(1)
    ramp = np.add.outer(np.arange(16), np.arange(16))[..., None].astype(float) * 7
    for how in codec.FILTERS:
        flat = np.full((8, 8, 3), 77, np.uint8)
        assert (codec.resize(flat, 5, 3, how) == 77).all()
        assert abs(codec.resize(ramp, 8, 8, how).mean() - ramp.mean()) < 1
        noisy = rng.integers(0, 256, (8, 8, 1)).astype(np.uint8)
        if how != "box":
            assert (codec.resize(noisy, 8, 8, how) == noisy).all(), how


def test_forward_of_three_modalities():
    rng = np.random.default_rng(2)
    dim, heads, patch, b = 16, 4, 2, 3
    w = {k: nn.init_vit(c, patch, dim, 1, seed) for seed, (k, c) in enumerate((("radar", 2), ("lores", 3), ("hires", 3)))}
    w |= {"cross": nn.init_vit(1, 1, dim, 1, 5, cross=True), "decoder": nn.init_decoder(dim, 8, 1, 8 * patch * patch)}

    def mask(n, kept, low):
        order = rng.permutation(n)
        pooled = np.zeros((b, low))
        pooled[:, order[kept:] % low] = 1
        return {"keep": order[:kept], "ids_restore": np.tile(np.argsort(order), (b, 1)), "mask": pooled}

    masks = {"radar": mask(16, 9, 16), "lores": mask(16, 9, 16), "hires": mask(64, 30, 16)}
    images = rng.random((b, 2, 8, 8)), rng.random((b, 3, 8, 8)), rng.random((b, 3, 16, 16))
    contrast, rebuilt = nn.forward(*images, w, masks, patch, heads, 1)
    assert np.isfinite([contrast, rebuilt]).all() and contrast > 0 and rebuilt > 0
    # The order of a batch changes neither loss.
    assert np.allclose(nn.forward(*(x[::-1] for x in images), w, masks, patch, heads, 1), (contrast, rebuilt))
    kept = rng.random((b, 9, dim))
    out = nn.decode(kept, w["decoder"], masks["radar"]["ids_restore"], heads, 1)
    assert out.shape == (b, 16, 32)
    bias = nn.grid_bias(4, 16)
    assert nn.resize_bias(bias, 4, 8, 2) is bias and nn.resize_bias(bias, 4, 16, 2).shape == (4, 64, 64)


def test_masked_losses():
    rng = np.random.default_rng(3)
    target, predicted = rng.random((2, 4, 8)), rng.random((2, 4, 8))
    masks = {"a": np.array([[1, 0, 0, 1], [0, 1, 0, 0]]), "b": np.ones((2, 4))}
    got = nn.mae_losses(target, predicted, masks, {"a": 1, "b": 3})
    scaled = (target - target.mean(-1, keepdims=True)) / np.sqrt(target.var(-1, ddof=1, keepdims=True) + 1e-6)
    want = sum(((predicted[i, j, :2] - scaled[i, j, :2]) ** 2).mean() for i, j in ((0, 0), (0, 3), (1, 1))) / 3
    assert np.isclose(got["a"], want)
