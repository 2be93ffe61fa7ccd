"""Nearest points, kriging at places and pairs of blocks against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import blocks, geostat, kriging, nearest, surfaces

POINTS = "name long, key string, x double, y double, z double, rank int, near string"


def drawn():
    r = random.Random(6)
    at = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(250)] + [(5 + r.gauss(0, 1e-4), 5 + r.gauss(0, 1e-4)) for _ in range(300)] + [(3.0, 3.0)] * 15 + [(1e5, -7e4)]
    rows = [(i, r.choice(["a", "a", None]), x, y, math.sin(x) + y / 3, 1, "clash") for i, (x, y) in enumerate(at)]
    return [*rows, (9000, "alone", 1.0, 1.0, 2.0, 1, ""), (9001, "a", None, 1.0, 2.0, 1, ""), (9002, "a", float("nan"), 1.0, 2.0, 1, ""), (9003, "a", 1.0, float("inf"), 2.0, 1, "")]


def there(rows):
    return [r for r in rows if r[2] is not None and math.isfinite(r[2]) and math.isfinite(r[3])]


@pytest.mark.parametrize("k", [1, 7])
def test_k_nearest_of_crowded_and_far_points(spark, k):
    rows = drawn()
    table = spark.createDataFrame(rows, POINTS)
    got: dict = {}
    for g in nearest.k_nearest(table, table, k, "name", "key", "x", "y", "name", others=True, carried=("z",)).collect():
        got.setdefault(g.name, {})[g["rank"]] = (g.distance, g.near_name, g.z)
    for i, key, x, y, *_ in there(rows):
        want = sorted((math.hypot(x - q[2], y - q[3]), q[0]) for q in there(rows) if q[1] == key and q[0] != i)[:k]
        own = [got.get(i, {}).get(j + 1) for j in range(len(want))]
        assert [pytest.approx(d, rel=1e-12, abs=1e-12) for d, _ in want] == [o[0] for o in own], i
        assert len(got.get(i, {})) == len(want)
    assert not {9000, 9001, 9002, 9003} & set(got)


def test_no_points(spark):
    table = spark.createDataFrame(drawn(), POINTS)
    assert nearest.k_nearest(table, table.limit(0), 3, "name", "key", "x", "y", "name").collect() == []
    assert nearest.k_nearest(table.limit(0), table, 3, "name", "key", "x", "y", "name").collect() == []


def model(h, kind, nugget, sill, a):
    r = h / a
    rise = (1.0 if r >= 1 else 1.5 * r - 0.5 * r**3) if kind == "spherical" else 1 - math.exp(-3 * r) if kind == "exponential" else 1 - math.exp(-3 * r * r)
    return nugget + sill if h <= 1e-9 else sill * (1 - rise)


def globally(points, x, y, m):
    n = len(points)
    a = np.array([[model(math.hypot(p[2] - q[2], p[3] - q[3]), *m) for q in points] for p in points]) + np.eye(n) * 1e-10 * (m[1] + m[2])
    a = np.block([[a, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    b = np.array([model(math.hypot(p[2] - x, p[3] - y), *m) for p in points] + [1.0])
    w = np.linalg.solve(a, b)
    return float(w[:n] @ [p[4] for p in points]), max(0.0, m[1] + m[2] - float(w @ b))


def test_kriging_of_few_points_is_that_of_all(spark):
    r = random.Random(9)
    rows = [(i, "s" if i < 20 else "e", *(p := (r.uniform(0, 10), r.uniform(0, 10))), math.sin(p[0]) + p[1] / 5, 1, "") for i in range(36)]
    models = {"s": ("spherical", 0.05, 1.2, 6.0), "e": ("exponential", 0.0, 0.8, 4.0)}
    table = spark.createDataFrame(rows, POINTS)
    made = spark.createDataFrame([(k, *m) for k, m in models.items()], "key string, kind string, nugget double, sill double, range double")
    spots = [(j, k, r.uniform(-1, 11), r.uniform(-1, 11)) for j, k in enumerate(["s", "e"] * 6)] + [(50, "s", rows[3][2], rows[3][3]), (51, "none", 1.0, 1.0), (52, None, 1.0, 1.0), (53, "s", None, 1.0)]
    places = spark.createDataFrame(spots, "place long, key string, x double, y double")
    got = {g.place: g for g in kriging.predicted(places, table, made, "place", "key", "x", "y", "name", "z", 24).collect()}
    for j, k, x, y in spots[:-3]:
        value, variance = globally([p for p in rows if p[1] == k], x, y, models[k])
        assert (got[j].value, got[j].variance, got[j].reason) == (pytest.approx(value, abs=1e-6), pytest.approx(variance, abs=1e-6), None)
    assert got[50].value == pytest.approx(rows[3][4], abs=1e-6)
    assert {got[j].reason for j in (51, 52, 53)} == {"no points"}
    assert kriging.predicted(places, table, made.where("key = 's'"), "place", "key", "x", "y", "name", "z").where("reason = 'no model'").count() == 6
    # Without each point: as from one inverse of all.
    errors = {g.name: g for g in kriging.without(table, made, "name", "key", "x", "y", "z", 40).collect()}
    for g in geostat.kriging_loo(table, made, "key", "name", "x", "y", "z").collect():
        assert errors[g.name].error == pytest.approx(g.error, abs=1e-6) and errors[g.name].variance == pytest.approx(g.variance, abs=1e-6)
    # The whole estimate: its limit, its calibration, and whether it lies outside the points.
    whole = {g.place: g for g in kriging.estimates(places, table, made, "place", "key", "x", "y", "name", "z", 40).collect()}
    for k in ("s", "e"):
        own = [p for p in rows if p[1] == k]
        gaps = sorted(min(math.hypot(p[2] - q[2], p[3] - q[3]) for q in own if q is not p) for p in own)
        limit = 3 * gaps[len(gaps) // 2]
        es = [errors[p[0]] for p in own]
        factor = math.sqrt(min(20, max(0.25, sum(e.error**2 / e.variance for e in es) / len(es))))
        for j, key, x, y in spots[:12]:
            if key == k:
                close = min(math.hypot(p[2] - x, p[3] - y) for p in own) <= limit
                assert (whole[j].value is not None) == close and (whole[j].reason is None) == close
                if close:
                    assert whole[j].std == pytest.approx(max(0.3, math.sqrt(got[j].variance) * factor), rel=1e-6)
    assert whole[50].extrapolated is False or rows[3][2] in (min(p[2] for p in rows[:20]), max(p[2] for p in rows[:20]))


def test_singular_systems_have_a_reason(spark):
    rows = [(i, "c", 1.0, 1.0, float(i), 1, "") for i in range(3)] + [(i, "d", float(i), 0.0, 1.0, 1, "") for i in range(10, 13)]
    made = spark.createDataFrame([("c", "gaussian", 0.0, 0.0, 1.0), ("d", "gaussian", 0.0, 1.0, 2.0)], "key string, kind string, nugget double, sill double, range double")
    places = spark.createDataFrame([(1, "c", 0.0, 0.0), (2, "d", 11.5, 0.0)], "place long, key string, x double, y double")
    got = {g.place: g for g in kriging.predicted(places, spark.createDataFrame(rows, POINTS), made, "place", "key", "x", "y", "name", "z").collect()}
    assert got[2].value == pytest.approx(1.0)
    assert (got[1].value is None) == (got[1].reason == "singular")


def test_pairs_of_blocks_are_all_pairs_once(spark):
    rows = [(i, "big" if i < 230 else "small" if i < 235 else None, float(i % 17), float(i % 5), float(i), 1, "") for i in range(240)]
    table = spark.createDataFrame(rows, POINTS)
    found = blocks.pairs(table, "key", "name", {"i": F.col("a.name"), "j": F.col("b.name")}, size=40).collect()
    assert sorted((f.i, f.j) for f in found) == [(i, j) for i in range(235) for j in range(i + 1, 235) if rows[i][1] == rows[j][1]]
    # Sums over them: inverse distances, with points that coincide.
    got = {g.name: g.estimate for g in surfaces.idw_loo(table, "name", "key", "x", "y", "z").collect()}
    for i, key, x, y, *_ in rows[:235]:
        rest = [((x - q[2]) ** 2 + (y - q[3]) ** 2, q[0], q[4]) for q in rows if q[1] == key and q[0] != i]
        same = [q for q in rest if q[0] < 1e-18]
        assert got[i] == pytest.approx(min(same, key=lambda q: q[1])[2] if same else sum(z / d for d, _, z in rest) / sum(1 / d for d, _, _ in rest))
    assert set(got) == set(range(235))
