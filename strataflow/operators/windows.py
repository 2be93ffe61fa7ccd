"""Ordered operators: latest row per key, first match by rank, gap segments, islands, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators import ordered
from strataflow.operators.lineage import cut


def no_clash(df: DataFrame, *names: str) -> None:
    """Made columns must not be there before."""
    for name in names:
        if name in df.columns:
            raise ValueError(f"{name} is a column already")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one with the greatest order tuple. A struct maximum is combined before the shuffle."""
    best = F.max(F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("__row")))
    return df.groupBy(*keys).agg(best.alias("__best")).select("__best.__row.*")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one that sorts first."""
    best = F.min(F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("__row")))
    return df.groupBy(*keys).agg(best.alias("__best")).select("__best.__row.*")


def top(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order, with place. Each task keeps only its own first rows before the shuffle, so
    that a hot key sends few."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col("place") <= most)


def upper_median(values: Column) -> Column:
    """The element at size div 2 of the sorted values (not their average)."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def gap_segments(df: DataFrame, key: str, ts: str, factor: float, least_seconds: float, value: str | None = None) -> DataFrame:
    """df with segment: a number that grows where the step in time exceeds max(factor * upper-median step, least).
    With value, rows where it is null or not finite break the line too and are left out; their steps count. Rows are
    dealt by ranges of time, so a key of any size is spread over tasks: the row before, the median step and the running
    number of breaks go over the parts. Rows with a null key or time are left out; a column `segment` must not be there."""
    no_clash(df, "segment")
    there = F.lit(True) if value is None else F.coalesce(F.abs(F.col(value).cast("double")) < float("inf"), F.lit(False))
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__there", there)
    order = ["__t", "__there"]
    parts = ordered.in_parts(rows, [key], order)
    stepped = ordered.previous(parts, [key], order, F.struct("__t", "__there"), "__last").withColumn("__step", F.col("__t") - F.col("__last.__t"))
    stepped = cut(stepped.withColumn("__after", F.coalesce(~F.col("__last.__there"), F.lit(False))).drop("__last"))
    middle = ordered.at_rank(stepped.where("__step is not null").select(F.col(key).alias("__key"), "__step"), ["__key"], ["__step"], F.floor(F.col("n") / 2) + 1)
    limits = middle.select("__key", F.greatest(F.lit(factor) * F.col("__step"), F.lit(least_seconds * 1e6)).alias("__limit"))
    broken = stepped.join(limits, F.col(key) == F.col("__key"), "left").drop("__key")
    breaks = (F.coalesce(F.col("__step") > F.col("__limit"), F.lit(False)) | F.col("__after")).cast("int")
    found = ordered.running_sum(broken, [key], order, breaks, "segment").where("__there")
    return found.select(*df.columns, "segment")


def islands(df: DataFrame, key: str, number: str) -> DataFrame:
    """key, first and last of each run of consecutive numbers."""
    numbers = df.select(key, number).distinct()
    at = F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number))
    return numbers.withColumn("__island", at).groupBy(key, "__island").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("__island")


def within_budget(df: DataFrame, key: str, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows of each key, in ascending order, while their running cost (nulls cost nothing) stays within the budget; the
    first one always. Rows are dealt by ranges of the order, so a key of any size is spread over tasks. order must tell
    the rows of a key apart; null keys are a key."""
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.select(*df.columns, *(o.alias(n) for o, n in zip(order, names, strict=True)), cost.alias("__cost"))
    parts = ordered.in_parts(rows, [key], names)
    spent = ordered.running_sum(parts, [key], names, F.col("__cost"), "__spent")
    found = ordered.running_sum(spent, [key], names, F.lit(1), "__n")
    return found.where((F.col("__n") == 1) | (F.col("__spent") <= budget)).select(*df.columns)
