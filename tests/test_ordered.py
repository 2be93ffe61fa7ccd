"""Values by order in two levels against plain windows, with a key that holds most rows, nulls and ties."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.operators import ordered

SCHEMA = "id long, k string, t int, v long, n int"


def table(spark):
    r = random.Random(7)
    rows = [(i, "hot" if i % 10 else r.choice(["a", "b", None]), r.choice([None, *range(200)]), r.choice([None, None, *range(-9, 9)]), 1) for i in range(4000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_two_levels_give_what_windows_give(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = table(spark)
        w = Window.partitionBy("k").orderBy("t", "id")
        parts = ordered.in_parts(df, ["k"], ["t", "id"])
        shares = [r["count"] for r in parts.groupBy(ordered.PART).count().collect()]
        assert len(shares) > 1 and max(shares) < 0.6 * 4000  # the hot key is spread
        plain = parts.drop(ordered.PART)
        assert plain.columns == df.columns
        same(ordered.running_sum(parts, ["k"], ["t", "id"], F.col("v"), "s").drop(ordered.PART), df.withColumn("s", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))
        same(ordered.previous(parts, ["k"], ["t", "id"], F.col("v"), "p").drop(ordered.PART), df.withColumn("p", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
        same(ordered.following(parts, ["k"], ["t", "id"], F.col("v"), "f").drop(ordered.PART), df.withColumn("f", F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))))
        same(ordered.numbered(df, ["k"], ["t", "id"], "place"), df.withColumn("place", F.row_number().over(w).cast("long")))
        same(ordered.numbered(df, [], ["t", "id"], "place"), df.withColumn("place", F.row_number().over(Window.orderBy("t", "id")).cast("long")))
        middle = df.withColumn("r", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("k"))).where("r = floor(m / 2) + 1").drop("r", "m")
        same(ordered.at_rank(df.drop("n"), ["k"], ["t", "id"], F.floor(F.col("n") / 2) + 1).drop("n"), middle.drop("n"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing(spark):
    df = table(spark).limit(0)
    assert ordered.numbered(df, ["k"], ["t"], "place").collect() == []
