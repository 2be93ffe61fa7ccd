"""Overlay of free polygons against points drawn at random and against areas known beforehand."""

import math
import random

import numpy as np
import pytest

from strataflow.operators import overlay

SCHEMA = "id long, rings array<array<double>>, source string, place int"
box = lambda x, y, w, h: [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for r in rings:
        p = np.array(r).reshape(-1, 2)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0), strict=True):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))
    return odd


def area(rings):
    return sum(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) / 2 for p in (np.array(r).reshape(-1, 2) for r in rings))


def drawn(n, seed=2):
    """Rings around random places, some with holes, some crossing themselves; places come in two clouds."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (r.gauss(0.2, 0.05), r.gauss(0.2, 0.05)) if i % 3 else (r.random(), r.random())
        k, size = r.randrange(3, 9), r.uniform(0.02, 0.3)
        angles = [6.283 * j / k for j in range(k)]
        if i % 5 == 0:
            r.shuffle(angles)
        outer = [v for a in angles for v in (x + size * math.cos(a) * r.uniform(0.5, 1), y + size * math.sin(a))]
        rows.append((i, [outer, [x - size / 4, y, x + size / 4, y + 0.01, x, y + size / 5]] if i % 2 else [outer], f"s{i % 4}", (3, 1, 2, 1)[i % 4]))
    return rows


@pytest.mark.parametrize("most", [4, 256])
def test_areas_are_those_of_points_drawn_at_random(spark, most):
    rows = drawn(30)
    table = spark.createDataFrame(rows, SCHEMA)
    pieces, under = overlay.layer(table, most)
    pieces, under, pairs = pieces.collect(), {(r.id, r.other): r.area for r in under.collect()}, {(r.id, r.other): r.area for r in overlay.pair_areas(table, most).collect()}
    r = np.random.default_rng(5)
    n, low, wide = 400_000, -0.4, 1.8
    x, y = r.uniform(low, low + wide, n), r.uniform(low, low + wide, n)
    cover = np.array([inside(rings, x, y) for _, rings, _, _ in rows])
    share, near = wide**2 / n, lambda m: 5 * wide * np.sqrt(max(m, 1e-4) / n)
    for i in range(30):
        for j in range(30):
            m = (cover[i] & cover[j]).sum() * share
            assert abs(pairs.get((i, j), 0.0) - m) < near(m)
    rank = np.array([(p, s) for _, _, s, p in rows], dtype=[("p", int), ("s", "U4")])
    place = np.argsort(np.argsort(np.unique(rank)))[np.searchsorted(np.unique(rank), rank)]
    best = np.where(cover, place[:, None], 99).min(0)
    stays = cover & (place[:, None] == best)
    for i in range(30):
        own = [p for p in pieces if p.id == i]
        assert sum(p.whole for p in own) == pytest.approx(pairs.get((i, i), 0.0), abs=1e-9)
        m = stays[i].sum() * share
        assert abs(sum(p.area for p in own) - m) < near(m)
        # What is given as rings has that area, and holds the points that stay.
        for p in own:
            assert area(p.rings) == pytest.approx(p.area, abs=1e-7)
        got = np.zeros(n, bool)
        for p in own:
            got |= inside(p.rings, x, y)
        assert (got != stays[i]).sum() <= 3
        for j in range(30):
            if place[i] != place[j]:
                m = (stays[i] & cover[j]).sum() * share
                assert abs(under.get((i, j), 0.0) - m) < near(m)


def pairs_of(spark, *shapes, most=256):
    table = spark.createDataFrame([(i, r) for i, r in enumerate(shapes)], "id long, rings array<array<double>>")
    return {(r.id, r.other): r.area for r in overlay.pair_areas(table, most).collect()}


@pytest.mark.parametrize("most", [2, 256])
def test_touching_nested_and_crossing_rings(spark, most):
    found = pairs_of(spark, [box(0, 0, 1, 1)], [box(1, 0, 1, 1)], [box(0, 0, 1, 1), box(0.25, 0.25, 0.5, 0.5)], [box(0.25, 0.25, 0.5, 0.5)], [[0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0]], [box(0, 0, 1, 1), box(0.2, 0.2, 0.6, 0.6), box(0.4, 0.4, 0.2, 0.2)], most=most)
    near = {k: pytest.approx(v, abs=1e-9) for k, v in {(0, 0): 1, (1, 1): 1, (2, 2): 0.75, (0, 2): 0.75, (3, 3): 0.25, (0, 3): 0.25, (4, 4): 0.5, (0, 4): 0.5, (5, 5): 0.68}.items()}
    assert {k: found.get(k) for k in near} == near
    assert found.get((0, 1), 0) < 1e-12 and found.get((2, 3), 0) < 1e-12


def test_better_maps_stay_and_equal_sources_overlap(spark):
    rows = [(1, [box(0, 0, 0.1, 0.1)], "coarse", 5), (2, [box(0, 0, 0.05, 0.1)], "fine", 1), (3, [box(0, 0, 0.05, 0.05)], "fine", 1), (4, [box(0.01, 0.01, 0.01, 0.01)], "coarse", 5)]
    pieces, under = overlay.layer(spark.createDataFrame(rows, SCHEMA))
    kept: dict = {}
    for p in pieces.where("area > 0").collect():
        kept[p.id] = kept.get(p.id, 0) + p.area
    assert kept == {1: pytest.approx(0.005), 2: pytest.approx(0.005), 3: pytest.approx(0.0025)}
    shared = {(u.id, u.other): u.area for u in under.collect()}
    assert shared == {(2, 1): pytest.approx(0.005), (3, 1): pytest.approx(0.0025), (2, 4): pytest.approx(0.0001), (3, 4): pytest.approx(0.0001)}


def test_rows_without_ground(spark):
    rows = [(None, [box(0, 0, 1, 1)], "a", 1), (1, None, "a", 1), (2, [], "a", 1), (3, [[0.0, 0.0, 1.0, 1.0]], "a", 1), (4, [[0.0, None, 1.0, 1.0, 1.0, 0.0]], "a", 1), (5, [[0.0, 0.0, 1.0, 1.0, 2.0, 2.0]], "a", 1), (6, [[0.0, float("nan"), 1.0, 1.0, 1.0, 0.0]], None, None)]
    pieces, under = overlay.layer(spark.createDataFrame(rows, SCHEMA))
    assert pieces.collect() == [] == under.collect()
    assert overlay.pair_areas(spark.createDataFrame(rows[:0], SCHEMA)).collect() == []
    assert [r.area for r in overlay.pair_areas(spark.createDataFrame([*rows, (7, [box(0, 0, 1, 1)], None, None), (7, [box(0, 0, 1, 0.5)], None, None)], SCHEMA)).collect()] == [pytest.approx(0.5)]
