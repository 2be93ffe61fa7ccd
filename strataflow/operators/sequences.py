"""Sequences: greedy packets, spans, axis ticks, first appearances, ordered distinct values.

Order is by the columns given and must be total, else ties fall as Spark likes. A key's rows come together only where a
function says so, and then as an array of small structs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packets(df: DataFrame, key: str, order: str, size: str, limit: float) -> DataFrame:
    """df with packet (from 1): rows of a key, in order, go into one packet while its sizes stay within the limit; a row
    over the limit has a packet of its own. What a packet holds depends on where the last one ended, so it is a pass
    over each key's rows, in Arrow batches of sorted partitions: a state of two numbers, never a group in memory."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, packet = object(), 0.0, 0
        for batch in batches:
            made = []
            for k, s in zip(batch.column(key).to_pylist(), batch.column(size).to_pylist(), strict=True):
                s = s or 0
                if k != last or packet == 0:
                    last, used, packet = k, 0.0, 1
                    filled = False
                if filled and used + s > limit:
                    packet, used = packet + 1, 0.0
                used, filled = used + s, True
                made.append(packet)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, "packet"])

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{kind}, packet bigint")


def spans(length: Column, most: int, overlap: int) -> Column:
    """As few spans (array of structs first, last) of at most so many as cover a length, neighbours overlapping."""
    n = F.when(length <= most, 1).otherwise(F.ceil((length - overlap) / max(1, most - overlap))).cast("int")
    size = F.least(length, F.ceil((length + (n - 1) * overlap) / n)).cast("int")
    first = lambda i: F.when(n == 1, 0).otherwise(F.round(i * (length - size) / F.greatest(n - 1, F.lit(1)))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(first(i).alias("first"), F.least(length, first(i) + size).cast("int").alias("last")))


def axis(low: Column, high: Column, count: int = 5) -> Column:
    """Struct of lo, hi, step and ticks (how many) of an axis in steps of 1, 2, 2.5, 5 or 10 times a power of ten."""
    pad = F.when(F.abs(low) > 1, F.abs(low) * 0.001 + 0.5).otherwise(0.5)
    flat = high - low < 1e-9
    lo, hi = F.when(flat, low - pad).otherwise(low), F.when(flat, high + pad).otherwise(high)
    raw = (hi - lo) / max(1, count - 1)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.get(F.filter(F.transform(F.array(*map(F.lit, (1.0, 2.0, 2.5, 5.0, 10.0))), lambda m: m * power), lambda s: s >= raw * 0.999), 0)
    start, end = F.floor(lo / step + 1e-9) * step, F.ceil(hi / step - 1e-9) * step
    return F.struct(start.alias("lo"), end.alias("hi"), step.alias("step"), (F.round((end - start) / step) + 1).cast("bigint").alias("ticks"))


def first_appearances(df: DataFrame, key: str, order: list[Column], name: str, depth: str) -> DataFrame:
    """Rows of a key, in order, where a name appears for the first time, below the top (depth over 0) and below another
    name: the contacts down a hole. Rows without a name are left out; a key's first row is no contact at any depth."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.where(F.col(name).isNotNull()).withColumn("__before", F.lag(name).over(w)).withColumn("__n", F.row_number().over(Window.partitionBy(key, name).orderBy(*order)))
    fits = (F.col("__n") == 1) & (F.col(depth) > 0) & (F.col(name) != F.col("__before"))
    return marked.where(fits).drop("__before", "__n")


def ordered_distinct(values: Column) -> Column:
    """Values of an array in order, the first of each spelling (letters in either case), without null and empty ones."""
    seen = lambda acc, v: F.exists(acc, lambda a: F.lower(a) == F.lower(v))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), F.array().cast("array<string>"), lambda acc, v: F.when(seen(acc, v), acc).otherwise(F.array_append(acc, v)))
