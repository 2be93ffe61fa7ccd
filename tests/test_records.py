"""Operators on small tables: nulls, ties, repeated rows, empty tables, clashing columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import geodesy
from strataflow.operators import geostat, joins, links, nested, sequences, spatial, upsert
from strataflow.streaming import latest


def test_packets(spark):
    rows = [(1, i, n) for i, n in enumerate([30, 80, 50, 200, None, 100, 1])] + [(2, 0, 500), (None, 0, 60), (None, 1, 60), (3, 0, None)]
    df = spark.createDataFrame(rows, "k int, o int, n int").withColumn("used", F.lit(1))
    got = {(r.k, r.o): r.packet for r in sequences.packets(df, "k", "o", "n", 100).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 3, (1, 3): 4, (1, 4): 5, (1, 5): 5, (1, 6): 6, (2, 0): 1, (None, 0): 1, (None, 1): 2, (3, 0): 1}
    assert sequences.packets(df.limit(0), "k", "o", "n", 100).collect() == []


def test_spans_and_axes(spark):
    for length in (1, 800, 801, 1500, 5000):
        found = [tuple(s) for s in spark.range(1).select(sequences.spans(F.lit(length), 800, 100).alias("s")).first().s]
        assert found[0][0] == 0 and found[-1][1] == length and all(b - a <= 800 for a, b in found)
        assert all(a2 < b1 for (_, b1), (a2, _) in zip(found, found[1:], strict=False))
    axis = lambda a, b: tuple(spark.range(1).select(sequences.axis(F.lit(a), F.lit(b)).alias("x")).first().x)
    assert axis(0.0, 9.3) == (0.0, 10.0, 2.5, 5) and axis(3.0, 3.0)[0] < 3.0 < axis(3.0, 3.0)[1]


def test_distinct_in_order(spark):
    df = spark.createDataFrame([(["Sand", "clay", None, "SAND", " ", "Clay", "marl"],), (None,), ([],)], "v array<string>")
    assert [r.x for r in df.select(sequences.ordered_distinct(F.col("v")).alias("x")).collect()] == [["Sand", "clay", "marl"], None, []]


def test_corrections_in_turn(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None), (1, "a")], "id int, v string").withColumn("was", F.lit(1))
    fixes = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "b", "c"), (3, 2, "b", "c"), (4, 3, "x", "y"), (5, 9, "p", "q"), (6, 4, None, "n")], "seq int, id int, old string, new string")
    fixed, stale = upsert.corrected(df, fixes, "id", "v")
    assert sorted((r.id, r.v, r.applied, r.stale) for r in fixed.collect()) == [(1, "c", 2, 0), (1, "c", 2, 0), (2, "c", 1, 0), (3, "z", 0, 1), (4, "n", 1, 0)]
    assert sorted(r.seq for r in stale.collect()) == [4, 5]
    again, _ = upsert.corrected(fixed.select("id", "v"), fixes.where("id in (2, 4)"), "id", "v")
    assert sorted((r.id, r.v) for r in again.collect()) == [(1, "c"), (1, "c"), (2, "c"), (3, "z"), (4, "n")]


def test_versions_replace_by_key_and_page(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 2, "c"), (3, 3, "d"), (None, 3, "e")], "k int, page int, v string")
    new = spark.createDataFrame([(1, 1, "A"), (1, 1, "B"), (9, 2, "N"), (None, 3, "E")], "k int, page int, v string")
    got = sorted(((r.k or 0, r.page, r.v, r.state) for r in upsert.versioned_merge(old, new, ["k", "page"], "page", new.where("page = 2")).collect()), key=str)
    assert got == sorted([(1, 1, "a", "history"), (1, 1, "b", "history"), (2, 2, "c", "history"), (3, 3, "d", "kept"), (0, 3, "e", "history"), (1, 1, "A", "fresh"), (1, 1, "B", "fresh"), (9, 2, "N", "fresh"), (0, 3, "E", "fresh")], key=str)
    assert upsert.versioned_merge(old.limit(0), new.limit(0), ["k"]).collect() == []


def test_replaced_changes_and_gate(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string"), spark.createDataFrame([(2, "B"), (None, "C")], "k int, v string")
    assert sorted(((r.k, r.v) for r in upsert.replaced(old, new, ["k"]).collect()), key=str) == sorted([(1, "a"), (2, "B"), (None, "C")], key=str)
    assert sorted(((r.k, r.before, r.after) for r in upsert.changes(old, new, ["k"], "v").collect()), key=str) == sorted([(1, "a", None), (2, "b", "B"), (None, "c", "C")], key=str)
    assert {r.k for r in upsert.gated([old, new], "k", F.count("*") > 1).collect()} == {2, None}


def test_two_stage_keeps_rows(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "x")], "k int, name string")
    exact = spark.createDataFrame([(1, 5), (1, 3)], "k int, v int")
    named = spark.createDataFrame([("x", 8), ("y", 9), ("y", 7)], "name string, v int")
    got = joins.two_stage(left, exact, named, ["k"], "name", "v").collect()
    assert sorted(((r.k, r.v) for r in got), key=str) == sorted([(1, 3), (2, 7), (None, 8)], key=str)
    with pytest.raises(ValueError):
        joins.two_stage(left.withColumn("v", F.lit(1)), exact, named, ["k"], "name", "v")


def test_ancestors_and_chains(spark):
    df = spark.createDataFrame([("1-2-3",), ("1-2",), ("1",), ("7-1",), (None,), ("1-2-3",)], "key string")
    named = spark.createDataFrame([("1", "top"), ("1-2", "mid"), ("1-2", "also"), ("1-2-3", "self")], "key string, name string")
    got = sorted(((r.key, r.ancestor) for r in links.prefix_ancestor(df, "key", named, "name").collect()), key=str)
    assert got == sorted([("1-2-3", "also"), ("1-2-3", "also"), ("1-2", "top"), ("1", None), ("7-1", None), (None, None)], key=str)
    entries = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("p", "q"), ("q", "p"), ("t", "p"), ("x", "gone")], "n string, r string")
    got = {r.n: r.current for r in links.follow(entries, "n", "r").collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "p": "p", "q": "q", "t": "p", "x": "x"}


def test_conflicts_against_all_pairs(spark):
    r = random.Random(4)
    rows = [(i % 5, r.gauss(0, 1 + i % 5), r.gauss(0, 1)) for i in range(300)] + [(None, 0.0, 0.0), (7, 1.0, 1.0), (8, None, 1.0)]
    got = {x.k: (x.n, x.apart) for x in links.conflicts(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", 5.0).collect()}
    for k in range(5):
        p = [(x, y) for i, x, y in rows if i == k]
        want = max(math.dist(a, b) for a in p for b in p)
        assert got[k][0] == len(p) and 0.995 * want <= got[k][1] <= want + 1e-12
    assert got[7] == (1, 0.0) and 8 not in got


def test_boxes_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, *(lambda x, y, a, b: (x, y, x + a, y + b))(r.uniform(-2, 2), r.uniform(-2, 2), r.uniform(0.01, 0.9), r.uniform(0.01, 0.9))) for i in range(80)] + [(100, None, 0.0, 1.0, 1.0)]
    left = spark.createDataFrame(rows, "i int, w double, s double, e double, n double")
    right = left.select(*(F.col(c).alias(f"o_{c}") for c in left.columns))
    got = sorted((x.i, x.o_i) for x in spatial.box_pairs(left, right, ("w", "s", "e", "n"), ("o_w", "o_s", "o_e", "o_n"), 0.5).collect())
    assert got == sorted((a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])


def test_grid_and_rings(spark):
    grid = spark.createDataFrame([(i, j, float(2 * i - j)) for i in range(4) for j in range(4) if (i, j) != (3, 3)], "r int, c int, v double")
    points = spark.createDataFrame([(1, 0.5, 2.5), (2, 9.0, 1.0), (3, 2.5, 0.5), (4, 3.0, 3.0), (5, None, 1.0)], "i int, x double, y double")
    got = {r.i: r.shift for r in spatial.bilinear(points, grid, "x", "y", 0.0, 3.0, 1.0, 4, 4).collect()}
    assert got == {1: pytest.approx(0.5), 2: None, 3: None, 4: pytest.approx(-3.0), 5: None}
    ring = geodesy.ring([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])
    r = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (5.0, 1.0)], "x double, y double").select(geodesy.inside(ring, F.col("x"), F.col("y")).alias("i"), geodesy.signed_area(ring).alias("a")).collect()
    assert [x.i for x in r] == [True, False, False] and r[0].a == 10.0


def test_kriging_errors_are_those_of_systems_without_the_point(spark):
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 100, 25), r.uniform(0, 100, 25)
    z = np.sin(x / 20) + y / 50 + r.normal(0, 0.05, 25)
    for drift in ("constant", "linear", "quadratic"):
        errors, variances = geostat.leave_one_out(x, y, z, 0.01, 1.0, 60.0, "spherical", drift)
        f = geostat._terms(x, y, drift)
        for i in range(25):
            on = np.arange(25) != i
            rise = lambda h: np.where(h >= 60, 1.0, 1.5 * h / 60 - 0.5 * (h / 60) ** 3)
            h = np.hypot(x[on][:, None] - x[on], y[on][:, None] - y[on])
            c = np.where(h <= 1e-9, 1.01, 1 - rise(h)) + np.eye(24) * 1.01e-10
            k = np.block([[c, f[on]], [f[on].T, np.zeros((f.shape[1],) * 2)]])
            d = np.append(1 - rise(np.hypot(x[on] - x[i], y[on] - y[i])), f[i])
            w = np.linalg.solve(k, d)
            assert math.isclose(errors[i], z[i] - w[:24] @ z[on], rel_tol=1e-6, abs_tol=1e-6)
            assert math.isclose(variances[i], 1.01 + 1.01e-10 - w @ d, rel_tol=1e-5, abs_tol=1e-6)
    rows = [("s", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))] + [("t", 99, 0.0, 0.0, 1.0), ("u", 98, None, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "k string, i int, x double, y double, z double")
    models = spark.createDataFrame([("s", "spherical", 60.0, 0.01, 1.0)], "k string, kind string, range double, nugget double, sill double")
    got = {q.i: q for q in geostat.kriging_loo(points, models, "k", "i", "x", "y", "z").collect()}
    want, _ = geostat.leave_one_out(x, y, z, 0.01, 1.0, 60.0, "spherical")
    assert all(math.isclose(got[i].error, want[i], rel_tol=1e-9) for i in range(25)) and got[99].reason == "no model" and 98 not in got
    assert {q.reason for q in geostat.kriging_loo(points, models, "k", "i", "x", "y", "z", most=10).collect()} == {"many points", "no model"}


def test_variograms_of_a_known_model(spark):
    h = [5.0 * (i + 1) for i in range(12)]
    rows = [("s", i, x, 2 + 10 * (1.5 * x / 50 - 0.5 * (x / 50) ** 3 if x < 50 else 1.0), 20) for i, x in enumerate(h)] + [("few", 0, 1.0, 1.0, 3)]
    got = geostat.fits(spark.createDataFrame(rows, "k string, bin int, lag double, gamma double, n int"), "k").collect()
    assert [q.k for q in got] == ["s"] and got[0].kind == "spherical" and abs(got[0].range - 50) < 5 and got[0].r2 > 0.99


def test_stacked_surfaces_keep_their_order():
    z = np.array([[3.0, 5.0, 4.0], [9.0, 5.0, 1.0], [1.0, 2.0, 3.0]])
    got = geostat.projected(z, [(0, 1), (1, 2)], np.array([1.0, 1.0, 2.0]))
    assert (got[:, 0] >= got[:, 1]).all() and (got[:, 1] >= got[:, 2]).all()
    assert np.allclose(got[1], z[1]) and np.allclose(got[2], [2.25] * 3, atol=1e-6) and np.allclose(got[0], [4.0, 4.0, 4.0], atol=1e-6)


def test_order_of_units(spark):
    units = spark.createDataFrame([("s", "a", 0.0, 1.0), ("s", "b", 1.0, 2.0), ("s", "c", 0.5, 1.5), ("s", "d", 5.0, 6.0)], "k string, n string, y double, o double")
    above = spark.createDataFrame([("s", "a", "c", 4), ("s", "b", "c", 3), ("s", "c", "b", 1), ("s", "d", "a", 5)], "k string, a string, b string, n int")
    got = {(r.a, r.b): (r.relation, r.basis) for r in geostat.order_constraints(units, above, "k", "n", "y", "o").collect()}
    assert got == {("a", "b"): ("a over b", "age"), ("a", "c"): ("a over b", "superposition"), ("b", "c"): ("unordered", None), ("a", "d"): ("conflict", "age"), ("b", "d"): ("a over b", "age"), ("c", "d"): ("a over b", "age")}


def test_nested_values(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"}]},"d":null}'), (2, "no json"), (3, "5")], "id int, j string")
    got = sorted((r.id, r.path, r.value) for r in nested.explode_values(df, "j").collect())
    assert got == [(1, "$.a.b[0]", "1"), (1, "$.a.b[1].c", '"x"'), (1, "$.d", "null"), (3, "$", "5")]
    deep = spark.createDataFrame([([[[1.0, 2.0], [3.0, 4.0]]],)], "g array<array<array<double>>>")
    moved = deep.select(nested.mapped(F.col("g"), deep.schema["g"].dataType, lambda p: F.array(p[0] + 1, p[1] * 2)).alias("g")).first().g
    assert moved == [[[2.0, 4.0], [4.0, 8.0]]]


def test_latest_of_a_stream_is_that_of_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = latest.latest_stream(stream, ["user_id", "event_type"], "ts", "value")
    q = found.writeStream.outputMode("complete").format("memory").queryName("latest_of_stream").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    keyed = lambda df: {(r.user_id, r.event_type): (r.ts, r.value) for r in df.collect()}
    assert keyed(spark.table("latest_of_stream")) == keyed(latest.latest_stream(events, ["user_id", "event_type"], "ts", "value")) != {}
