"""Operators over all pairs of a key's rows, held against plain loops, and how many rows their plans make."""

import math
import random

import pytest

from strataflow.operators import blocks, geostat, spatial, surfaces
from strataflow.queries import QUERIES


def most_rows(df):
    """Rows of the largest output of any operator of df's plan, once it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        inner = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, inner)])

    return walk(plan)


def test_weights_of_points_make_no_rows_of_pairs(spark):
    r = random.Random(8)
    rows = [(i, f"k{i % 2}", r.random(), r.random(), r.random()) for i in range(1200)]
    df = spark.createDataFrame(rows, "i int, k string, x double, y double, z double")
    found = surfaces.idw_loo(df, "i", "k", "x", "y", "z")
    assert found.count() == 1200 and most_rows(found) <= 4 * len(rows)


@pytest.mark.parametrize("size", [7, 50, 8192])
def test_weights_of_blocks_of_any_size(spark, size):
    r = random.Random(4)
    rows = [(f"n{i:03}", r.choice([1.0, 2.0, float("nan")]), round(r.random(), 1), round(r.random(), 1), r.random()) for i in range(300)]
    rows += [("lone", 9.0, 0.0, 0.0, 1.0), (None, 1.0, 0.0, 0.0, 1.0), ("null", 1.0, None, 0.0, 1.0), ("n000", 1.0, 5.0, 5.0, 2.0), ("odd", 2.0, 3.0, 3.0, float("inf"))]
    df = spark.createDataFrame(rows, "i string, k double, x double, y double, z double")
    made = surfaces.loo(df, "i", "k", "x", "y", "z", size).collect()
    got, nearest = ({g.i: g[c] for g in made} for c in ("estimate", "nearest"))
    there = [p for p in rows if p[0] is not None and p[2] is not None]
    want = {}
    for i in {p[0] for p in there}:
        rest = [((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2, q[0], q[4]) for p in there if p[0] == i for q in there if q[0] != i and (q[1] == p[1] or q[1] != q[1] and p[1] != p[1])]
        same = [q[1:] for q in rest if q[0] < 1e-18]
        if rest:
            assert nearest[i] == min(rest)[2], i
            want[i] = min(same)[1] if same else sum(z / d for d, _, z in rest) / sum(1 / d for d, _, _ in rest)
    assert got.keys() == want.keys() and "lone" not in got
    for i, value in want.items():
        assert got[i] == pytest.approx(value) or math.isnan(got[i]) and math.isnan(value), i


@pytest.mark.parametrize("name", ["idw_loo", "method_choice", "method_table"])
def test_queries_of_all_pairs_make_no_rows_of_them(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.01")  # 500 points, some 25,000 pairs of one surface's points
    assert most_rows(found) <= 5 * 500


@pytest.mark.parametrize("held", [5, 8192])
def test_overlays_against_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(blocks, "HELD", held)
    r = random.Random(3)
    rows = [(i, r.choice("abc"), round(r.uniform(-1, 1), 1), round(r.uniform(-1, 1), 1), r.choice([0.05, 0.2, 0.2, 0.7, 1.6])) for i in range(150)]
    rows += [(3, "b", 0.0, 0.0, 0.2), (3, "c", 0.5, 0.5, 0.7), (500, None, 0.0, 0.0, 0.2), (501, "a", None, 0.0, 0.2), (502, "a", float("nan"), 0.0, 0.2), (503, "a", 9.0, 9.0, 0.2), (504, "b", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, k string, w double, s double, d double").selectExpr("i", "k", "w", "s", "w + d as e", "s + d as n")
    got = {g.i: (g.n, g.sources, round(g.covered, 9), list(g.top)) for g in spatial.overlays(df, "i", "k", ("w", "s", "e", "n"), 0.2).collect()}
    boxes, want = [tuple(b) for b in df.collect() if b.k is not None and b.w is not None], {}
    for i in {b[0] for b in boxes}:
        shares = []
        for _, k, w, s, e, n in (b for b in boxes if b[0] == i and b[4] > b[2]):
            for j, m, p, q, u, v in boxes:
                if k != m and w < u and p < e and s < v and q < n and (min(e, u) - max(w, p)) * (min(n, v) - max(s, q)) / ((e - w) * (n - s)) > 0.01:
                    shares.append(((min(e, u) - max(w, p)) * (min(n, v) - max(s, q)) / ((e - w) * (n - s)), j, m))
        if shares:
            best = sorted((-round(s, 9), j) for s, j, _ in shares)[:5]
            want[i] = (len(shares), len({m for *_, m in shares}), round(sum(s for s, *_ in shares), 9), [j for _, j in best])
    assert {3, 0} <= got.keys() and got == want


def test_overlays_of_crowded_boxes_make_no_rows_of_pairs(spark):
    found = QUERIES["box_overlay"](spark, "/root/testdata/sf0.1")  # 2,000 boxes, some 100,000 pairs
    assert most_rows(found) <= 20 * 2000


def test_lags_make_no_rows_of_pairs(spark):
    r = random.Random(9)
    rows = [(i, f"k{i % 2}", r.choice([round(r.random(), 1), r.random()]), r.random(), r.random()) for i in range(600)]
    rows += [(7, "k1", 0.5, 0.5, 0.5), (None, "k1", 0.1, 0.1, 0.1), (900, None, 0.1, 0.1, 0.1), (901, "k0", 0.1, None, 0.1), (902, "k0", 0.1, 0.1, None), (903, "one", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, k string, x double, y double, z double")
    want = {}
    for k in ("k0", "k1"):
        own = [p for p in rows if p[1] == k and None not in p]
        pairs = [(math.dist(p[2:4], q[2:4]), 0.5 * (p[4] - q[4]) ** 2) for n, p in enumerate(own) for q in own[:n] if p[0] != q[0]]
        most = max(math.dist(p[2:4], q[2:4]) for p in own for q in own) / 2
        for b in range(12):
            inside = [(d, g) for d, g in pairs if 0 < d <= most and min(int(d / (most / 12)), 11) == b]
            want[k, b] = (len(inside), sum(d for d, _ in inside) / len(inside), sum(g for _, g in inside) / len(inside))
    for size in (30, 8192):
        found = geostat.lags(df, "k", "i", "x", "y", "z", size=size)
        got = {(g.k, g.bin): (g.n, g.lag, g.gamma) for g in found.collect()}
        assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b]) for b in want)
    assert most_rows(found) <= 4 * len(rows)
