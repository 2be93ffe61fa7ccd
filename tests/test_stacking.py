"""Stacks of surfaces: against plain projections of one place at a time, and by what must hold afterwards."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import stacking

SCHEMA = "place long, unit string, z double, std double, above string, za double"


def plainly(z, w, pairs):
    """Dykstra's projections of one place, to rest."""
    z, steps = dict(z), {p: (0.0, 0.0) for p in pairs}
    for _ in range(20_000):
        before = dict(z)
        for a, b in pairs:
            high, low = z[a] + steps[a, b][0], z[b] + steps[a, b][1]
            to = (high, low) if high >= low else ((w[a] * high + w[b] * low) / (w[a] + w[b]),) * 2
            steps[a, b] = high - to[0], low - to[1]
            z[a], z[b] = to
        if max(abs(z[u] - before[u]) for u in z) < 1e-12:
            break
    return z


def drawn():
    r = random.Random(11)
    units = list("ABCDEFG")
    pairs = [(a, b) for i, a in enumerate(units) for b in units[i + 1 :] if r.random() < 0.5]
    rows = [(p, u, r.gauss(5 - i, 2), r.choice([0.5, 1.0, 3.0, None, 0.0]), "clash", 1.0) for p in range(120) for i, u in enumerate(units) if r.random() < 0.85]
    rows += [(0, "free", 3.0, 1.0, "", 1.0), (1, "A", None, 1.0, "", 1.0), (None, "A", 1.0, 1.0, "", 1.0), (2, None, 1.0, 1.0, "", 1.0), rows[0]]
    return rows, pairs


def test_stacks_are_projections(spark):
    rows, pairs = drawn()
    made = spark.createDataFrame([*pairs, *pairs[:2], ("A", "A"), ("A", "missing")], "a string, b string")
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = stacking.stacked(table, made, "place", "unit", "z", "std")
    got = {(r.place, r.unit): r for r in found.withColumn("why", stacking.reason(F.col("moved"), F.col("above"), F.col("below"))).collect()}
    whole = {(p, u): (z, s) for p, u, z, s, *_ in rows if p is not None and u is not None and z is not None}
    assert set(got) == set(whole)
    for p in range(120):
        own = {u: v for (q, u), v in whole.items() if q == p}
        known = [(a, b) for a, b in pairs if a in own and b in own]
        stds = [s for _, s in own.values() if s]
        w = {u: 1 / (s or max(stds, default=1.0)) ** 2 for u, (_, s) in own.items()}
        want = plainly({u: z for u, (z, _) in own.items()}, w, known)
        for u, (z0, s0) in own.items():
            r = got[p, u]
            assert r.z == pytest.approx(want[u], abs=1e-4) and r.adjusted == (r.moved != 0) and r.moved == pytest.approx(r.z - z0, abs=1e-12)
            if not r.adjusted:
                assert (r.z, r.std, r.why) == (z0, s0, None)
            else:
                assert r.why.startswith("moved down" if r.moved < 0 else "moved up") and (r.above or r.below)
        assert all(got[p, a].z >= got[p, b].z for a, b in known)
    counts = {(c.a, c.b): c for c in stacking.crossings(table.distinct(), made, "place", "unit", "z").collect()}
    for a, b in pairs:
        both = [(z, whole[p, b][0]) for (p, u), (z, _) in whole.items() if u == a and (p, b) in whole]
        assert (counts[a, b].places, counts[a, b].crossed) == (len(both), sum(y - x > 1e-6 for x, y in both))
    assert stacking.crossings(found, made, "place", "unit", "z").agg(F.sum("crossed")).first()[0] == 0


def test_moves_share_by_variance_and_deviations_are_the_largest(spark):
    rows = [(1, "a", 10.0, 1.0, "", 0.0), (1, "b", 13.0, 2.0, "", 0.0), (2, "a", 10.0, 1.0, "", 0.0), (2, "b", 9.0, 2.0, "", 0.0), (3, "a", 1.0, 1.0, "", 0.0), (3, "b", 2.0, 1.0, "", 0.0), (3, "c", 3.0, 4.0, "", 0.0)]
    found = stacking.stacked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"), "place", "unit", "z", "std")
    got = {(r.place, r.unit): r for r in found.collect()}
    # One part in five of the step of three goes to the value of a quarter of the variance.
    assert got[1, "a"].z == pytest.approx(10.6) == got[1, "b"].z and got[1, "a"].std == got[1, "b"].std == 2.0
    assert (got[2, "a"].z, got[2, "b"].z, got[2, "a"].adjusted) == (10.0, 9.0, False)
    level = (1 + 2 + 3 / 16) / (2 + 1 / 16)
    assert [got[3, u].z for u in "abc"] == [pytest.approx(level)] * 3 and {got[3, u].std for u in "abc"} == {4.0}
    assert got[3, "b"].above == ["a"] and got[3, "b"].below == ["c"]
    assert math.isclose(got[1, "a"].moved, 0.6)


def test_nothing_to_stack(spark):
    rows, pairs = drawn()
    table, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "a string, b string")
    same = stacking.stacked(table, none, "place", "unit", "z", "std")
    assert same.where("adjusted").count() == 0 and same.count() == len({r[:2] for r in rows if None not in r[:3]})
    assert stacking.stacked(table.limit(0), spark.createDataFrame(pairs, "a string, b string"), "place", "unit", "z", "std").collect() == []
