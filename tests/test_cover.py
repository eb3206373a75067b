"""Greedy cover against brute force on unit cells: all corners are whole degrees."""

import random

import pytest

from quadloom.operators import scenes
from quadloom.plans.catalog import QUERIES
from quadloom.plans.scene_queries import _pairs


def brute(rows):
    """{aoi_id: [(scene_id, coverage)]}"""
    areas = {}
    for r in rows:
        box = max(r.west, r.aoi_west), max(r.south, r.aoi_south), min(r.east, r.aoi_east), min(r.north, r.aoi_north)
        size = (r.aoi_east - r.aoi_west) * (r.aoi_north - r.aoi_south)
        own = areas.setdefault(r.aoi_id, (size, {}))[1]
        own[box] = min(r.scene_id, own.get(box, r.scene_id))
    out = {}
    for aoi, (size, boxes) in areas.items():
        left = {s: {(x, y) for x in range(int(b[0]), int(b[2])) for y in range(int(b[1]), int(b[3]))} for b, s in boxes.items()}
        done, taken = set(), []
        while left and (len(taken) < 2 or len(done) / size + 0.001 <= 1):
            best = min(left, key=lambda s: (-len(done | left[s]), s))
            done |= left.pop(best)
            taken.append((best, round(len(done) / size, 9)))
        out[aoi] = taken
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.aoi_id, r.step)):
        out.setdefault(r.aoi_id, []).append((r.scene_id, round(r.coverage, 9)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cover_goes_on(spark, seed):
    rng = random.Random(seed)
    rows = []
    for aoi in range(4):
        for k in range(30):
            x, y = rng.randrange(0, 5), rng.randrange(0, 5 - aoi % 2)  # odd areas can't be covered
            rows.append((aoi, 100 * aoi + k, 0.0, 0.0, 5.0, 5.0, float(x), float(y), x + 1.0, y + 1.0))
    df = spark.createDataFrame(rows, "aoi_id long, scene_id long, aoi_west double, aoi_south double, aoi_east double, aoi_north double, west double, south double, east double, north double")
    want = brute(df.collect())
    assert max(map(len, want.values())) > 10
    assert listed(scenes.cover(df)) == want


def test_query(spark, sf_dir):
    assert listed(QUERIES["greedy_cover"](spark, sf_dir)) == brute(_pairs(spark, sf_dir).collect())
