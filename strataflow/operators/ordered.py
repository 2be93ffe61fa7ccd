"""Values that depend on the order of a key's rows, for keys of any size.

Rows are dealt by ranges of (keys, order), so a key that holds most rows is spread over many tasks. What a row needs from
rows before it is made in two levels: inside its part by a window, and over the parts from one row a key and part (as
many rows a key as there are parts), which is joined back. The parts are written once, so that their numbers hold.

keys and order are names of columns; order must tell rows of a key apart if the result shall not depend on how ties
fall. Nulls in keys make a key of their own; nulls in order come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.lineage import cut

PART = "__part"


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df dealt by ranges, with the number of each row's range as __part."""
    return cut(df.repartitionByRange(*(F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order))).withColumn(PART, F.spark_partition_id()))


def _inside(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(PART, *keys).orderBy(*order)


def _joined(parts: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """parts with the columns of table, which has one row for each key and part and names them __k0, __k1, ... and __p."""
    on = [F.col(PART) == F.col("__p"), *(F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))]
    return parts.join(table, reduce(Column.__and__, on)).drop("__p", *(f"__k{i}" for i in range(len(keys))))


def _table(parts: DataFrame, keys: Sequence[str], *made: Column) -> DataFrame:
    return parts.groupBy(F.col(PART).alias("__p"), *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))).agg(*made)


def _over_parts(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__p")


def running_sum(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """parts with the sum of value (nulls count as 0) over a key's rows up to each row, that row included."""
    parts = parts.withColumn("__v", F.coalesce(value, F.lit(0)))
    before = F.sum("__t").over(_over_parts(keys).rowsBetween(Window.unboundedPreceding, -1))
    table = _table(parts, keys, F.sum("__v").alias("__t")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__t")
    inside = F.sum("__v").over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(parts.withColumn(name, inside), table, keys).withColumn(name, F.col(name) + F.col("__before")).drop("__v", "__before")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the places 1, 2, ... of each key's rows (without keys: of all rows)."""
    parts = in_parts(df, keys, order)
    return running_sum(parts, keys, order, F.lit(1), name).drop(PART)


def previous(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """parts with the last value that is not null of a key's earlier rows."""
    parts = parts.withColumn("__v", value)
    last = F.last("__t", ignorenulls=True).over(_over_parts(keys).rowsBetween(Window.unboundedPreceding, -1))
    at = F.struct(*(F.col(f"`{c}`") for c in order))
    table = _table(parts, keys, F.max_by("__v", F.when(F.col("__v").isNotNull(), at)).alias("__t")).withColumn("__before", last).drop("__t")
    inside = F.last("__v", ignorenulls=True).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return _joined(parts.withColumn(name, inside), table, keys).withColumn(name, F.coalesce(F.col(name), F.col("__before"))).drop("__v", "__before")


def following(parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """parts with the first value that is not null of a key's later rows."""
    parts = parts.withColumn("__v", value)
    first = F.first("__t", ignorenulls=True).over(_over_parts(keys).rowsBetween(1, Window.unboundedFollowing))
    at = F.struct(*(F.col(f"`{c}`") for c in order))
    table = _table(parts, keys, F.min_by("__v", F.when(F.col("__v").isNotNull(), at)).alias("__t")).withColumn("__after", first).drop("__t")
    inside = F.first("__v", ignorenulls=True).over(_inside(keys, order).rowsBetween(1, Window.unboundedFollowing))
    return _joined(parts.withColumn(name, inside), table, keys).withColumn(name, F.coalesce(F.col(name), F.col("__after"))).drop("__v", "__after")


def at_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: Column) -> DataFrame:
    """The row of each key at place rank, an expression over n, the key's number of rows. Only the part that holds the
    place is numbered."""
    parts = in_parts(df, keys, order)
    sums = Window.partitionBy(*(f"__k{i}" for i in range(len(keys))))
    table = _table(parts, keys, F.count("*").alias("__t"))
    table = table.withColumn("n", F.sum("__t").over(sums)).withColumn("__before", F.coalesce(F.sum("__t").over(_over_parts(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = table.withColumn("__want", rank - F.col("__before")).where("__want between 1 and __t").select("__p", *(f"__k{i}" for i in range(len(keys))), "__want")
    found = _joined(parts, table, keys).withColumn("__n", F.row_number().over(_inside(keys, order)))
    return found.where("__n = __want").drop("__n", "__want", PART)
