"""Operators on small tables, where the queries' data does not reach all of them."""

import datetime
import math

from strataflow.operators import joins, surfaces, upsert, windows
from tests.llm.util import frame
from pyspark.sql import functions as F


def test_trends(spark):
    at = [(i % 5 * 3.0, i // 5 * 2.0) for i in range(25)]
    z = {"constant": lambda x, y: 7.0, "linear": lambda x, y: 2 + 3 * x - y, "quadratic": lambda x, y: 1 - x + x * x - 2 * x * y + y * y}
    for drift, f in z.items():
        got = surfaces.trend(frame(spark, [("k", x, y, f(x, y)) for x, y in at] + [("k", None, 1.0, 1.0), ("one", 1.0, 1.0, 5.0)], "k string, x double, y double, z double"), "k", "x", "y", "z", drift).collect()
        assert len(got) == 27 and all(abs(r.residual) < 1e-6 for r in got if r.k == "k" and r.x is not None)
        assert all((r.fitted is None) == (drift != "constant") for r in got if r.k == "one")
    bowl = surfaces.trend(frame(spark, [("k", x, y, z["quadratic"](x, y)) for x, y in at], "k string, x double, y double, z double"), "k", "x", "y", "z", "linear").collect()
    assert max(abs(r.residual) for r in bowl) > 1 and abs(sum(r.residual for r in bowl)) < 1e-6


def test_versioned_merge_of_pages_and_repeated_keys(spark):
    schema = "k string, page int, v int"
    old = frame(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("a", 1, 4), (None, 5, 5), ("d", None, 6)], schema)
    new = frame(spark, [("a", 1, 10), ("a", 1, 11), (None, 5, 12), ("e", 2, 13)], schema)
    got = upsert.versioned_merge(old, new, ["k"], "page", frame(spark, [(2,), (2,), (None,)], "page int"))
    assert sorted((r.v, r.state) for r in got.collect()) == [(1, "history"), (2, "history"), (3, "kept"), (4, "history"), (5, "history"), (6, "kept"), (10, "fresh"), (11, "fresh"), (12, "fresh"), (13, "fresh")]


def test_source_pairs(spark):
    rows = [("s1", "u", "top", True, 0.0, 0.0), ("s2", "u", "top", False, 1.0, 0.0), ("s2", "w", "top", True, 1.0, 0.0), ("s2", "u", "base", True, 1.0, 0.0), ("s3", "u", "top", False, 1.5, 0.0), ("s1", "u", "top", True, 0.5, 0.0)]
    got = joins.source_pairs(frame(spark, rows, "source string, unit string, boundary string, measured boolean, x double, y double"), 1.0).collect()
    assert sorted((r.source, r.x, r.b_source, r.b_x) for r in got) == [("s1", 0.0, "s2", 1.0), ("s1", 0.5, "s2", 1.0), ("s1", 0.5, "s3", 1.5), ("s2", 1.0, "s1", 0.0), ("s2", 1.0, "s1", 0.5), ("s3", 1.5, "s1", 0.5)]


def test_gaps_break_at_missing_values(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [("k", t(h), v) for h, v in [(0, 1.0), (1, 2.0), (2, None), (3, 3.0), (4, math.nan), (5, 4.0), (6, 5.0), (20, 6.0)]]
    got = windows.gap_segments(frame(spark, rows, "k string, ts timestamp_ntz, v double"), "k", "ts", 3.0, 7200, "v").collect()
    parts = {}
    for r in got:
        parts.setdefault(r.segment, []).append(r.v)
    assert sorted(sorted(p) for p in parts.values()) == [[1.0, 2.0], [3.0], [4.0, 5.0], [6.0]]


def test_error_stats_leave_out_variances_that_are_not_positive(spark):
    got = frame(spark, [(2.0, 4.0), (-1.0, 0.0), (3.0, 1.0), (1.0, -2.0), (1.0, None)], "e double, v double").agg(*surfaces.error_stats(F.col("e"), F.col("v"))).first()
    assert (got.n, got.msse, got.bias, got.mae) == (5, 5.0, 1.2, 1.6)


def test_idw_is_exact_at_data(spark):
    got = surfaces.idw_loo(frame(spark, [(1, "a", 0.0, 0.0, 5.0), (2, "a", 0.0, 0.0, 7.0), (3, "a", 1.0, 0.0, 1.0)], "i int, k string, x double, y double, z double"), "i", "k", "x", "y", "z").collect()
    assert {r.i: r.estimate for r in got} == {1: 7.0, 2: 5.0, 3: 6.0}


def test_legend_counts(spark):
    classes = frame(spark, [("clay", 2), ("sand", 1), ("peat", 3), ("Unknown", 9)], "class string, place int")
    got = surfaces.legend_counts(frame(spark, [("clay",), ("sand",), ("sand",), (None,), ("mud",)], "c string"), "c", classes).collect()
    assert [(r["class"], r.n) for r in got] == [("sand", 2), ("clay", 1), ("Unknown", 2)]
