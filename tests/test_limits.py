"""Cases beyond what limits once cut off: long chains, deep texts, many classes, far corners, hot keys, clashing names."""

import json
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.functions import ages, coordinates
from strataflow.operators import joins, links, nested, windows


def test_long_chains_and_circles(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("to"))
    rounds = []
    cut = links.cut
    links.cut = lambda df: rounds.append(1) or cut(df)
    try:
        found = links.follow(chain, "k", "to")
        assert len(rounds) < 22
    finally:
        links.cut = cut
    assert found.where(f"current = {n - 1}").count() == n
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("t1", "t2"), ("t2", "b"), ("self", "self"), ("into", "self"), ("x", None), ("y", "x"), ("z", "gone"), (None, "x")]
    got = {r.n: r.current for r in links.follow(spark.createDataFrame(rows, "n string, r string"), "n", "r").collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "t1": "b", "t2": "b", "self": "self", "into": "self", "x": "x", "y": "x", "z": "z", None: None}
    assert links.follow(chain.limit(0), "k", "to").collect() == []


def test_names_resolve_in_a_lexicon(spark):
    lexicon = spark.createDataFrame([("Oldham", "Newbury or Elsewhere", 1), ("Newbury", "  MARLOW , Other", 1), ("Marlow", None, 1), ("Adrift", "Nowhere", 1), (None, "Marlow", 1)], "name string, replaced_by string, entry0 int")
    units = spark.createDataFrame([(1, "Oldham Formation"), (2, "Marlow Fm."), (3, "Adrift Formation"), (4, "Unlisted Member"), (5, "sandy clay"), (6, None)], "i int, unit string")
    got = {r.i: (r.entry, r.canonical) for r in links.resolved(units, "unit", lexicon).collect()}
    assert got == {1: ("Marlow", "Marlow"), 2: ("Marlow", "Marlow"), 3: ("Adrift", "Adrift"), 4: (None, "unlisted"), 5: (None, None), 6: (None, None)}


def leaves(v, path="$"):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in leaves(w, f"{path}.{k}")]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in leaves(w, f"{path}[{i}]")]
    return [(path, json.dumps(v, ensure_ascii=False))]


def test_deep_texts_keep_their_leaves(spark):
    deep = "leaf"
    for i in range(24):
        deep = {"d": deep, "n": i} if i % 2 else [deep, i]
    texts = [(1, json.dumps(deep)), (2, "[]"), (3, "no json"), (4, None), (5, '"x"'), (6, json.dumps({"a": None, "b": [True, "],[", 1.5]}))]
    df = spark.createDataFrame(texts, "id int, j string")
    got = sorted((r.id, r.path, r.value) for r in nested.explode_values(df, "j").collect())
    assert got == sorted((i, *leaf) for i, t in texts if i in (1, 5, 6) for leaf in leaves(json.loads(t)))
    with pytest.raises(ValueError, match="path"):
        nested.explode_values(df.withColumnRenamed("id", "path"), "j")


def test_values_keep_their_brackets(spark):
    rows = [(1, 1, "a],[b", 1), (1, 2, "[q]", None), (1, 3, None, 3), (1, 4, '"', 4)]
    df = spark.createDataFrame(rows, "k int, o int, t string, n int")
    (got,) = nested.column_once(df, ["k"], ["o"], [F.col("t"), F.col("n")]).collect()
    assert json.loads(got.rows) == [["a],[b", 1], ["[q]", None], [None, 3], ['"', 4]]


def test_classes_of_any_number(spark):
    r = random.Random(3)
    classes = [(f"c{i}", float(i), float(i + 1)) for i in range(1500)] + [(f"wide{i}", (a := r.uniform(0, 1400)), a + r.uniform(0, 60)) for i in range(40)]
    rows = [(i, (a := r.uniform(-5, 1510)), a + r.choice([0.0, 0.3, 2.0, 50.0])) for i in range(300)] + [(900, 1200.2, 1200.9), (901, None, 3.0), (902, 1200.2, 1200.9)]
    df = spark.createDataFrame(rows, "i int, a double, b double").select("i", F.struct(F.col("a").alias("young"), F.col("b").alias("old")).alias("age"))
    got = {x.i: x["class"] for x in ages.with_class(df, "age", spark.createDataFrame(classes, "class string, young double, old double")).collect()}
    for i, a, b in rows:
        held = [(min(b, o) - max(a, y), -y, c) for c, y, o in classes if a is not None and min(b, o) > max(a, y)]
        assert got[i] == (max(held)[2] if held else None), i
    assert got[900] == got[902] and len(got) == len(rows)


def test_every_name_of_the_chart(spark):
    df = spark.createDataFrame([(n,) for n in ages.INTERVALS], "t string").withColumn("a", ages.age_range(F.col("t")))
    assert {r.t: (r.a.young, r.a.old) for r in df.collect()} == {n: pytest.approx(v) for n, v in ages.INTERVALS.items()}
    assert {"chibanian", "calabrian", "gelasian", "piacenzian", "zanclean", "chattian", "rupelian", "priabonian", "bartonian", "lutetian", "ypresian", "miaolingian", "ediacaran", "cryogenian", "tonian"} <= set(ages.INTERVALS)
    # What a coarser name is made of lies inside it.
    assert all(ages.INTERVALS["phanerozoic"][0] <= y < o <= 4567.0 for y, o in ages.INTERVALS.values())


def test_far_corners_are_exact(spark):
    ring = [(1, math.cos(6.2831853 * k / 34) * 805.0, math.sin(6.2831853 * k / 34) * 805.0) for k in range(34)] + [(2, 1.0, 1.0), (3, None, 1.0), (None, 1.0, 1.0)]
    got = {r.k: (r.n, r.apart, r.conflict) for r in links.conflicts(spark.createDataFrame(ring, "k int, x double, y double"), "k", "x", "y", 1609.0).collect()}
    assert got == {1: (34, pytest.approx(1610.0, abs=1e-3), True), 2: (1, 0.0, False)}


def test_places_behind_long_texts(spark):
    df = spark.createDataFrame([("word " * 400 + "33.51234 N, 80.20456 W",)], "t string")
    assert df.select(coordinates.place(F.col("t")).alias("p")).first().p.lat == pytest.approx(33.51234)


def test_hot_keys_of_ordered_operators(spark):
    r = random.Random(5)
    base = 1_700_000_000
    rows = [(i, "hot" if i % 12 else r.choice(["a", "b", None]), base + r.randrange(4_000_000), r.choice([None, float("nan"), 1.0, 2.0, 3.0]), r.randrange(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string, s long, v double, cost long").withColumn("ts", F.timestamp_seconds("s")).withColumn("segments", F.lit("clash")).dropDuplicates(["k", "s"])
    w = Window.partitionBy("k").orderBy("s")
    took = windows.within_budget(df, "k", [F.col("s")], F.col("cost"), 500)
    plain = df.withColumn("n", F.row_number().over(w)).withColumn("c", F.sum("cost").over(w)).where("n = 1 or c <= 500")
    assert sorted(x.id for x in took.collect()) == sorted(x.id for x in plain.collect()) and took.columns == df.columns
    got = sorted((x.id, x.segment) for x in windows.gap_segments(df, "k", "ts", 3.0, 600, "v").collect())
    want = []
    for k in ("hot", "a", "b"):
        own = sorted((x for x in df.collect() if x.k == k), key=lambda x: x.s)
        steps = sorted(b.s - a.s for a, b in zip(own, own[1:], strict=False))
        limit, segment = max(3.0 * steps[len(steps) // 2], 600), 0
        for i, x in enumerate(own):
            there = lambda y: y.v is not None and y.v == y.v
            segment += i > 0 and (x.s - own[i - 1].s > limit or not there(own[i - 1]))
            if there(x):
                want.append((x.id, segment))
    assert got == sorted(want)
    with pytest.raises(ValueError, match="segment"):
        windows.gap_segments(df.withColumn("segment", F.lit(1)), "k", "ts", 3.0, 600)
    left, right = df.where("id % 3 = 0").select("id", "k", "ts", "s"), df.where("id % 3 = 1").select("k", "ts", F.col("id").alias("value"), F.col("s").alias("rs"))
    found = {x.id: (x.nearest_ts, x.nearest_value) for x in joins.nearest_in_time(left, right.drop("rs"), "k", "ts", "value").collect()}
    others = right.collect()
    for x in left.collect():
        near = sorted(((abs(y.rs - x.s), y.rs, y.value, y.ts) for y in others if y.k == x.k and x.k is not None))
        assert found[x.id] == ((near[0][3], near[0][2]) if near else (None, None))
