"""Convex hulls of groups of points, made in two steps: hulls of each batch, then hulls of those hulls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The hull's corners against the clock, from the least point on; points on its sides are none."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for run in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for x, y in run:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (y - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (x - half[-2][0]):
                half.pop()
            half.append((x, y))
        halves += half[:-1]
    return halves


def hulls(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key and hull (array of structs x, y) of each key's points. Points without a coordinate are left out, and keys
    without points; a key with one or two different points has those. A hot key's points shrink to hulls before the
    shuffle; only corners are shuffled."""
    kind = df.schema[key].dataType.simpleString()
    plain = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")

    def shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *p) for k, g in batch.groupby("k", dropna=False) for p in corners(list(zip(g.x, g.y)))]
            yield pd.DataFrame(rows, columns=["k", "x", "y"]).astype({"k": batch.k.dtype})

    def whole(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": batch.k.iloc[:1], "hull": [[{"x": a, "y": b} for a, b in corners(list(zip(batch.x, batch.y)))]]})

    small = plain.mapInPandas(shrunk, f"k {kind}, x double, y double")
    return small.groupBy("k").applyInPandas(whole, f"k {kind}, hull array<struct<x:double,y:double>>").withColumnRenamed("k", key)


def inside(hull: Column, x: Column, y: Column, slack: float = 1e-9) -> Column:
    """Whether a place lies in a hull of three corners or more, or as near to its sides as the slack (an area); with a
    negative slack, so far within them."""
    turns = F.zip_with(hull, F.concat(F.slice(hull, 2, F.size(hull)), F.slice(hull, 1, 1)), lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return F.coalesce((F.size(hull) > 2) & F.forall(turns, lambda t: t >= -slack), F.lit(False))
