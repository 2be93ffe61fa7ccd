"""Natural neighbours: shares counted out by points drawn at random, planes, hulls, points that coincide."""

import random

import numpy as np
import pytest

from strataflow.operators import natural

POINTS, PLACES = "name long, key string, x double, y double, z double, n int", "place long, key string, x double, y double, value string"


def estimates(spark, places, points, k=24, others=False):
    if others:
        table = spark.createDataFrame(points, POINTS)
        return {r.name: r for r in natural.estimated(table, table, "name", "key", "x", "y", "name", "z", k, True).collect()}
    return {r.place: r for r in natural.estimated(spark.createDataFrame(places, PLACES), spark.createDataFrame(points, POINTS), "place", "key", "x", "y", "name", "z", k).collect()}


def test_shares_are_those_of_ground_taken_over(spark):
    r = random.Random(4)
    points = [(i, "a", r.gauss(0, 1), r.gauss(0, 1), r.uniform(0, 9), 1) for i in range(80)]
    places = [(100 + j, "a", r.gauss(0, 0.4), r.gauss(0, 0.4), "clash") for j in range(12)]
    few, many = estimates(spark, places, points, 4), estimates(spark, places, points, 80)
    xy, z = np.array([p[2:4] for p in points]), np.array([p[4] for p in points])
    drawn = np.random.default_rng(2).uniform(-2.5, 2.5, (400_000, 2))
    owner = np.concatenate([((part[:, None, :] - xy[None]) ** 2).sum(2).argmin(1) for part in np.array_split(drawn, 80)])
    near = np.sqrt(((drawn - xy[owner]) ** 2).sum(1))
    for j, _, x, y, _ in places:
        # Points asked for in rounds from four on give what all points give.
        assert few[j].value == pytest.approx(many[j].value, abs=1e-7) and few[j].n == many[j].n
        taken = np.hypot(*(drawn - [x, y]).T) < near
        assert few[j].value == pytest.approx(z[owner[taken]].mean(), abs=0.25)


def test_planes_are_kept_and_nothing_is_said_outside(spark):
    r = random.Random(5)
    plane = lambda x, y: 5 + 0.5 * x - 0.25 * y
    points = [(i, "grid", float(i % 6), float(i // 6), plane(i % 6, i // 6), 1) for i in range(36)] + [(50 + i, "b", (x := r.uniform(0, 9)), (y := r.uniform(0, 9)), plane(x, y), 1) for i in range(40)]
    points += [(100, "line", 0.0, 0.0, 1.0, 1), (101, "line", 1.0, 1.0, 1.0, 1), (102, "line", 2.0, 2.0, 1.0, 1), (103, "two", 0.0, 0.0, 1.0, 1), (104, "two", 1.0, 0.0, 1.0, 1), (105, "b", None, 1.0, 1.0, 1), (106, "b", 1.0, 1.0, None, 1), (107, None, 1.0, 1.0, 1.0, 1)]
    places = [(j, k, r.uniform(1, 4), r.uniform(1, 4), "") for j, k in enumerate(["grid", "b"] * 10)] + [(60, "grid", 2.0, 3.0, ""), (61, "grid", -1.0, 2.0, ""), (62, "grid", 9.0, 9.0, ""), (63, "line", 1.0, 1.5, ""), (64, "two", 0.5, 0.0, ""), (65, "none", 1.0, 1.0, ""), (66, None, 1.0, 1.0, ""), (67, "grid", None, 1.0, "")]
    got = estimates(spark, places, points, 8)
    for j, _, x, y, _ in places[:21]:
        assert got[j].value == pytest.approx(plane(x, y), abs=1e-6), j
    assert all((got[j].value, got[j].n) == (None, 0) for j in range(61, 68)) and len(got) == len(places)
    # Without each point: inner points of the grid lie on the plane, corners have no cell.
    loo = estimates(spark, None, points[:36], 8, True)
    assert loo[14].value == pytest.approx(plane(2, 2), abs=1e-6) and loo[0].value is None


def test_points_that_coincide_share(spark):
    square = [(0, "a", 0.0, 0.0, 1.0, 1), (1, "a", 2.0, 0.0, 1.0, 1), (2, "a", 0.0, 2.0, 5.0, 1), (3, "a", 2.0, 2.0, 5.0, 1), (4, "a", 2.0, 2.0, 5.0, 1)]
    got = estimates(spark, [(1, "a", 1.0, 1.0, ""), (2, "a", 2.0, 2.0, "")], square)
    assert got[1].value == pytest.approx(3.0)
    assert estimates(spark, [(1, "a", 1.0, 1.0, "")], square[:0])[1].value is None
