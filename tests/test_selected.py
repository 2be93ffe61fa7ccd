"""Shapes, hulls, names and selection on small tables: nulls, ties, repeated rows, empty tables."""

import random

from pyspark.sql import functions as F

from strataflow.functions import geodesy, labels, names, shapes
from strataflow.operators import hulls, selection


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def share_by_samples(ring, box, n=200):
    w, s, e, b = box
    hits = 0
    for i in range(n):
        for j in range(n):
            x, y = w + (i + 0.5) * (e - w) / n, s + (j + 0.5) * (b - s) / n
            odd = False
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                    odd = not odd
            hits += odd
    return hits / n / n


def test_share_in_against_samples(spark):
    rng = random.Random(3)
    ring = [(-0.2, -0.2), (0.25, -0.15), (0.2, 0.2), (0.0, 0.02), (-0.15, 0.25)]
    for _ in range(4):
        w, s = rng.uniform(-0.4, 0.1), rng.uniform(-0.4, 0.1)
        box = (w, s, w + rng.uniform(0.1, 0.4), s + rng.uniform(0.1, 0.4))
        got = one(spark, shapes.share_in(geodesy.ring(ring), tuple(map(F.lit, box))).alias("v"))["v"]
        assert abs(got - share_by_samples(ring, box)) < 0.01


def test_shapes_edges(spark):
    square = geodesy.ring([(0, 0), (1, 0), (1, 1), (0, 1)])
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    empty = F.slice(square, 1, 0)
    row = one(
        spark,
        shapes.area_in(empty, lit(0, 0, 1, 1)).alias("empty"),
        shapes.area_in(square, lit(1, 0, 0, 1)).alias("turned"),
        shapes.area_in(square, lit(2, 2, 3, 3)).alias("away"),
        shapes.meets_box(square, lit(0.4, 0.4, 0.6, 0.6)).alias("within"),
        shapes.meets_box(square, lit(-1, 0.4, 2, 0.6)).alias("across"),
        shapes.meets_box(square, lit(2, 2, 3, 3)).alias("apart"),
        shapes.meets_box(F.lit(None).cast("array<struct<x:double,y:double>>"), lit(0, 0, 1, 1)).alias("none"),
        F.size(shapes.rectangles(lit(170, 0, -170, 5))).alias("two"),
        shapes.rectangles(lit(1, 1, 1, 1)).alias("point"),
        shapes.tier(tuple(F.lit(None).cast("double") for _ in range(4)), (0, 0, 1, 1), [(0, 0), (1, 1)]).alias("tier"),
    )
    assert (row.empty, row.turned, row.away) == (0.0, 0.0, 0.0)
    assert (row.within, row.across, row.apart, row.none, row.two, row.tier) == (True, True, False, False, 2, 2)
    assert row.point[0].e - row.point[0].w > 0


def test_hulls(spark):
    rows = [("a", 0.0, 0.0), ("a", 2.0, 0.0), ("a", 2.0, 2.0), ("a", 1.0, 0.0), ("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), (None, 0.0, 0.0), (None, 1.0, 0.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    got = {r.k: [tuple(p) for p in r.hull] for r in hulls.hulls(df, "k", "x", "y").collect()}
    assert got == {"a": [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], "b": [(1.0, 1.0)], None: [(0.0, 0.0), (1.0, 0.0)]}
    assert hulls.hulls(df.where("false"), "k", "x", "y").count() == 0


def test_names(spark):
    cases = {"Cooper Marl": ("cooper", "marl"), "": None, "of": None, "sand": None, "Ashley Formation of Cooper Group": ("ashley", "formation"), "  -  ": None, "Penholoway, Wando Fms": ("wando", "formation")}
    df = spark.createDataFrame([(c,) for c in cases], "name string").select("name", names.name_key(F.col("name")).alias("k"))
    assert {r.name: r.k and tuple(r.k) for r in df.collect()} == cases


def test_queue(spark):
    schema = "k string, pages array<int>"
    notes = spark.createDataFrame([("a", [1, 2]), ("b", []), ("d", [5])], schema)
    manual = spark.createDataFrame([("a", [9]), ("c", [3])], schema)
    covered = spark.createDataFrame([("a", [1], 1), ("a", [2, 7], 2), ("c", [4], 3), ("a", [1], 1), (None, [1], 1)], "k string, pages array<int>, at int")
    rows = {r.k: (r.origin, r.status, r.done_at) for r in selection.queue([("notes", notes), ("manual", manual)], covered, "k", "pages").collect()}
    assert rows == {"a": ("notes", "done", 2), "b": ("notes", "done", None), "c": ("manual", "pending", None), "d": ("notes", "pending", None)}
    assert selection.queue([("notes", notes.where("false"))], covered, "k", "pages").count() == 0


def test_carried_included_judged(spark):
    old, fresh = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), (None, 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")
    seen, gone = spark.createDataFrame([("b",), ("b",)], "k string"), spark.createDataFrame([("c",)], "k string")
    assert sorted(map(tuple, selection.carried(old, seen, fresh, "k", gone).collect()), key=str) == [("a", 1), ("b", 2), (None, 1)]
    extra = spark.createDataFrame([("a", "x"), ("z", "y"), ("z", "x")], "k string, kind string")
    made = selection.included(old, extra, "k", [(F.col("k") == "a", "own")], [(F.col("v").isNull(), F.lit("no record"))])
    assert sorted(map(tuple, made.select("k", "kind", "skip").collect())) == [("a", "own", None), ("z", "x", "no record")]
    kept, dropped = selection.judged(old, [(F.col("k").isNull(), "no key"), (F.col("v") == 1, "one")])
    assert kept.count() == 0 and sorted(r.reason for r in dropped.collect()) == ["no key", "one", "one", "one"]


def test_crossings(spark):
    rows = [(1, "a", 5.0, 5.0), (1, "b", 7.0, 5.0), (2, "a", 5.0, 5.0), (3, "a", 9.0, 8.0), (3, "b", 1.0, 8.5), (3, "b", 1.0, 8.5)]
    df = spark.createDataFrame(rows, "p int, u string, b double, a double")
    assert [tuple(r) for r in selection.crossings(df, ["p"], "u", [("a", "b")], "b", "a").collect()] == [("a", "b", 2, 1, 1, 2.0, 0.5)]
    assert selection.crossings(df.where("false"), ["p"], "u", [("a", "b")], "b", "a").count() == 0


def test_labels_of_nulls(spark):
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    row = one(
        spark,
        labels.symbol_age(text).alias("age"),
        labels.hierarchy_class(text).alias("chain"),
        labels.rock_class(text).alias("rock"),
        labels.line_class(text, text).alias("line"),
        labels.street_name(text).alias("street"),
        labels.depth_text(number, number, text).alias("depth"),
        F.size(labels.qualifier_texts(F.lit(None).cast("array<string>"))).alias("codes"),
        labels.record_link(text, text, text).alias("link"),
        labels.to_datum(number, text, F.lit(None).cast("int"), number).alias("datum"),
        labels.review_problems(text, text, text, F.lit(None).cast("boolean")).alias("problems"),
        labels.confidence_text(number, F.lit(None).cast("int"), number, F.lit(None).cast("boolean")).alias("sure"),
        labels.printed(F.lit(1234.5)).alias("n"),
        labels.printed(F.lit(100.0)).alias("hundred"),
    )
    assert (row.age, row.chain, row.rock, tuple(row.line), row.street, row.depth, row.codes) == (None, "Unknown", "Unknown", ("other", "certain", False), None, "", 0)
    assert (tuple(row.link), row.datum.reason, row.problems, row.sure, row.n, row.hundred) == ((None, False), None, ["unclear_value", "missing_units"], "Confidence unknown", "1,234.5", "100")
