"""Joins beyond plain equality: distance within cells, nearest in time, two-stage lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import ordered
from strataflow.operators.windows import no_clash


def cells(df: DataFrame, x: str, y: str, size: float, around: bool = False) -> DataFrame:
    """df with the integer cell __cx, __cy of each point, or one row for each of the nine cells around it."""
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumn("__cx", cx).withColumn("__cy", cy)
    steps = F.array(*(F.struct((cx + i).alias("__cx"), (cy + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return df.withColumn("__cell", F.explode(steps)).select(*df.columns, "__cell.__cx", "__cell.__cy")


def distance_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, most: float, extra: Column | None = None) -> DataFrame:
    """Pairs within a distance: an equality join on cells of that size, the distance checked within. Column names of
    the sides must differ; distance is added."""
    near = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    on = (F.col("l.__cx") == F.col("r.__cx")) & (F.col("l.__cy") == F.col("r.__cy")) & (near <= most)
    pairs = cells(left, lx, ly, most).alias("l").join(cells(right, rx, ry, most, around=True).alias("r"), on if extra is None else on & extra)
    return pairs.select(*(F.col(f"l.`{c}`") for c in left.columns), *(F.col(f"r.`{c}`") for c in right.columns), near.alias("distance"))


def source_pairs(points: DataFrame, most: float) -> DataFrame:
    """Pairs of points (source, unit, boundary, measured, x, y and others) of different sources on the same unit and
    boundary, at least one of them measured, within a distance; both ways. The other point's columns start with b_."""
    other = points.select(*(F.col(c).alias(f"b_{c}") for c in points.columns))
    fit = (F.col("source") != F.col("b_source")) & (F.col("unit") == F.col("b_unit")) & (F.col("boundary") == F.col("b_boundary")) & (F.col("measured") | F.col("b_measured"))
    return distance_join(points, other, "x", "y", "b_x", "b_y", most, fit)


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the value and time (__rts) of right's nearest row of the same key; of equally near ones the earlier.

    Of right rows at one time the one with the least value counts. The sides are laid one after the other, dealt by
    ranges of time, and carried forward and back, over the parts too: a key of any size is spread over tasks, and no pairs
    are made. Rows of left with a null key or time find nothing; columns nearest_ts and nearest_value must not be there.
    """
    no_clash(left, "nearest_ts", "nearest_value")
    right = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, ts).agg(F.min(value).alias(value))
    both = left.select(*left.columns, F.lit(None).cast(right.schema[ts].dataType).alias("__rts"), F.lit(None).cast(right.schema[value].dataType).alias("__rv"), F.lit(1).alias("__left"))
    other = right.select(*(F.col(c) if c in (key, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(ts).alias("__rts"), F.col(value).alias("__rv"), F.lit(0).alias("__left"))
    order = [ts, "__left"]
    parts = ordered.in_parts(both.unionByName(other), [key], order)
    hit = F.when(F.col("__left") == 0, F.struct("__rts", "__rv"))
    found = ordered.following(ordered.previous(parts, [key], order, hit, "__b"), [key], order, hit, "__a").where("__left = 1")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    before, after = micros(F.col(ts)) - micros(F.col("__b.__rts")), micros(F.col("__a.__rts")) - micros(F.col(ts))
    pick = F.when(F.col("__a").isNull() | (before <= after), F.col("__b")).otherwise(F.col("__a"))
    return found.withColumn("__p", pick).select(*left.columns, F.col("__p.__rts").alias("nearest_ts"), F.col("__p.__rv").alias("nearest_value"))


def two_stage(left: DataFrame, exact: DataFrame, by_name: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """left with value from exact by its keys, else from by_name by its name. Of rows that repeat a key the least value
    counts, so no row of left is multiplied; a column of left with the value's name must not be there."""
    if value in left.columns:
        raise ValueError(f"{value} is a column of left")
    a = exact.groupBy(*keys).agg(F.min(value).alias("__exact"))
    b = by_name.groupBy(name).agg(F.min(value).alias("__named"))
    return left.join(a, keys, "left").join(b, name, "left").select(*left.columns, F.coalesce("__exact", "__named").alias(value))
