"""Areas of unions of polygons clipped to another, by vertical slabs.

Rings are lists of (x, y); all areas are planar, in degrees.  Between two
neighbouring x of vertices and crossings, edges don't cross, so each polygon is
a set of trapezoids and the union's height is linear.
"""

from __future__ import annotations

Ring = list[tuple[float, float]]


def box_ring(west: float, south: float, east: float, north: float) -> Ring:
    return [(east, north), (east, south), (west, south), (west, north), (east, north)]


def _edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return [(*min(a, b), *max(a, b)) for a, b in zip(closed, closed[1:], strict=False) if a[0] != b[0]]


def _spans(edges: list, x: float) -> list[tuple[float, float]]:
    at = sorted(y1 + (y2 - y1) * (x - x1) / (x2 - x1) for x1, y1, x2, y2 in edges if x1 < x < x2)
    return list(zip(at[::2], at[1::2], strict=False))


def _length(groups: list[list[tuple[float, float]]], clip: list[tuple[float, float]]) -> float:
    total, top = 0.0, float("-inf")
    cut = sorted((max(a, c), min(b, d)) for g in groups for a, b in g for c, d in clip if max(a, c) < min(b, d))
    for a, b in cut:
        if b > top:
            total += b - max(a, top)
            top = b
    return total


def covered_area(target: Ring, rings: list[Ring]) -> float:
    """Area of the part of ``target`` that the union of ``rings`` covers."""
    own, sets = _edges(target), [_edges(r) for r in rings]
    edges = [e for s in (own, *sets) for e in s]
    xs = {v for x1, _, x2, _ in edges for v in (x1, x2)}
    for i, (ax, ay, bx, by) in enumerate(edges):
        for cx, cy, dx, dy in edges[:i]:
            lo, hi = max(ax, cx), min(bx, dx)
            if lo < hi:
                m, n = (by - ay) / (bx - ax), (dy - cy) / (dx - cx)
                if m != n:
                    x = (cy - ay + m * ax - n * cx) / (m - n)
                    if lo < x < hi:
                        xs.add(x)
    order, area = sorted(xs), 0.0
    for a, b in zip(order, order[1:], strict=False):
        mid = (a + b) / 2
        area += _length([_spans(s, mid) for s in sets], _spans(own, mid)) * (b - a)
    return area


def area(ring: Ring) -> float:
    return covered_area(ring, [ring])


def overlap(a: Ring, b: Ring) -> float:
    """Share of ``a`` that ``b`` covers: 0 to 1, not symmetric."""
    whole = area(a)
    return min(1.0, covered_area(a, [b]) / whole) if whole else 0.0


def greedy_cover(aoi: Ring, scenes: list[tuple[object, Ring]], most: int | None = None, tolerance: float = 0.001) -> list[tuple[object, float]]:
    """(scene, share covered so far): the best scene first, then whichever adds most.

    At least a second scene is taken where there is one, even if the first one
    covers all, and at most ``most``.  Ties go to the scene that comes first.
    """
    whole = area(aoi)
    left, taken, rings = list(scenes), [], []
    share = 0.0
    while left and (most is None or len(taken) < most) and (len(taken) < 2 or share + tolerance <= 1):
        scored = [(covered_area(aoi, [*rings, r]) / whole if whole else 0.0, -i) for i, (_, r) in enumerate(left)]
        share, at = max(scored)
        key, ring = left.pop(-at)
        rings.append(ring)
        taken.append((key, min(1.0, share)))
    return taken
