"""Surfaces of a stack kept in order at every place.

Values come as rows (place, unit, z, std), constraints as pairs of units of which the first never lies below the second.
Places where no pair crosses stay as they are and are never gathered. At the others, values move as little as they can,
in squares weighted by 1 / std ** 2, until no pair crosses: Dykstra's projections, for all places of an Arrow batch that
have the same units at once. A place gathers its units alone, so surfaces of any extent are dealt over tasks.

A null value takes no part; of the constraints of a place those count whose units are both there. A missing or zero
std weighs as the largest one of its place (1 where none has one). Repeated rows of a place and unit: the least value
counts. Circles of constraints pull their units to one value. Units of no constraint stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL, STILL, SWEEPS = 1e-6, 1e-9, 2000


def projected(z: np.ndarray, w: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Rows of z moved least (weights w) so that z[a] >= z[b] for all pairs (a, b)."""
    z, open_ = z.copy(), np.arange(len(z))
    own, weight, steps = z.copy(), w, np.zeros((len(pairs), 2, len(z)))
    for _ in range(SWEEPS):
        before = own.copy()
        for k, (a, b) in enumerate(pairs):
            high, low = own[:, a] + steps[k, 0], own[:, b] + steps[k, 1]
            level = np.where(high >= low, np.nan, (weight[:, a] * high + weight[:, b] * low) / (weight[:, a] + weight[:, b]))
            to_a, to_b = np.where(np.isnan(level), high, level), np.where(np.isnan(level), low, level)
            steps[k, 0], steps[k, 1] = high - to_a, low - to_b
            own[:, a], own[:, b] = to_a, to_b
        z[open_] = own
        moving = np.abs(own - before).max(1) >= STILL
        if not moving.any():
            break
        own, weight, steps, open_ = own[moving], weight[moving], steps[:, :, moving], open_[moving]
    while True:  # what rounding left
        low = z.copy()
        for a, b in pairs:
            z[:, b] = np.minimum(z[:, b], z[:, a])
        if (z == low).all():
            return z


def widest(z: np.ndarray, std: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The largest std among the units that a unit is level with, through constraints."""
    std = np.where(np.isnan(std), -1.0, std)
    while True:
        before = std.copy()
        for a, b in pairs:
            level = np.abs(z[:, a] - z[:, b]) <= LEVEL
            both = np.maximum(std[:, a], std[:, b])
            std[level, a], std[level, b] = both[level], both[level]
        if (std == before).all():
            return np.where(std < 0, np.nan, std)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike: dict[tuple, list[int]] = {}
        units, pairs = batch.column("units").to_pylist(), batch.column("pairs").to_pylist()
        for i, (us, ps) in enumerate(zip(units, pairs, strict=True)):
            names = tuple(u["unit"] for u in us)
            alike.setdefault((names, tuple((p["a"], p["b"]) for p in ps if p["a"] in names and p["b"] in names)), []).append(i)
        made: list[tuple] = []
        for (names, known), rows in alike.items():
            at = {u: k for k, u in enumerate(names)}
            own = [(at[a], at[b]) for a, b in known]
            z = np.array([[u["z"] for u in units[i]] for i in rows], float)
            std = np.array([[u["std"] for u in units[i]] for i in rows], float)
            some = np.where(std > 0, std, np.nan)
            worst = np.where(np.isnan(some).all(1), 1.0, np.nanmax(np.where(np.isnan(some), -1.0, some), 1))
            after = projected(z, 1 / np.where(np.isnan(some), worst[:, None], some) ** 2, own)
            spread = widest(after, std, own)
            for r, i in enumerate(rows):
                for k, u in enumerate(names):
                    made.append((i, u, after[r, k], None if np.isnan(spread[r, k]) else spread[r, k], [a for a, b in known if b == u and abs(after[r, at[a]] - after[r, k]) <= LEVEL], [b for a, b in known if a == u and abs(after[r, at[b]] - after[r, k]) <= LEVEL]))
        place = batch.column("__place").take(pa.array([m[0] for m in made], pa.int64()))
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([place, *(pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds, 1))], names=["__place", "__unit", "__z", "__std", "above", "below"])


def stacked(values: DataFrame, constraints: DataFrame, place: str, unit: str, z: str, std: str) -> DataFrame:
    """place, unit, z, std, moved, adjusted, and of adjusted values above and below: the units, in order of their names,
    that they came to lie level with and must not lie above, or below. An adjusted value's std is the largest one among
    the units that it is level with. constraints: a, b (a never below b)."""
    rows = values.where(F.col(z).isNotNull() & F.col(place).isNotNull() & F.col(unit).isNotNull())
    rows = rows.groupBy(F.col(place).alias("__p"), F.col(unit).cast("string").alias("__u")).agg(F.min(F.struct(F.col(z).cast("double").alias("z"), F.col(std).cast("double").alias("std"))).alias("v")).select("__p", "__u", "v.z", "v.std")
    known = constraints.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a <> b").distinct()
    every = known.agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("pairs"))
    upper, lower = rows.select("__p", F.col("__u").alias("a"), F.col("z").alias("za")), rows.select("__p", F.col("__u").alias("b"), F.col("z").alias("zb"))
    crossed = upper.join(known, "a").join(lower, ["__p", "b"]).where("za < zb").select("__p").distinct()
    gathered = rows.join(crossed, "__p", "left_semi").groupBy("__p").agg(F.sort_array(F.collect_list(F.struct(F.col("__u").alias("unit"), "z", "std"))).alias("units"))
    table = gathered.withColumnRenamed("__p", "__place").crossJoin(F.broadcast(every))  # one row
    kind = values.schema[place].dataType.simpleString()
    moved = table.mapInArrow(_run, f"__place {kind}, __unit string, __z double, __std double, above array<string>, below array<string>")
    joined = rows.join(moved, (F.col("__p") == F.col("__place")) & (F.col("__u") == F.col("__unit")), "left")
    step = F.coalesce(F.col("__z") - F.col("z"), F.lit(0.0))
    adjusted = F.abs(step) > STILL
    return joined.select(
        F.col("__p").alias(place), F.col("__u").alias(unit), F.when(adjusted, F.col("__z")).otherwise(F.col("z")).alias(z), F.when(adjusted, F.coalesce("__std", "std")).otherwise(F.col("std")).alias(std),
        F.when(adjusted, step).otherwise(0.0).alias("moved"), adjusted.alias("adjusted"), F.when(adjusted, F.col("above")).alias("above"), F.when(adjusted, F.col("below")).alias("below"),
    )


def crossings(values: DataFrame, constraints: DataFrame, place: str, unit: str, z: str) -> DataFrame:
    """a, b, places (where both are; repeated rows count each), crossed (where a lies below b by more than LEVEL) and worst
    (by how much)."""
    side = lambda u, v: values.where(F.col(z).isNotNull()).select(F.col(place).alias("__p"), F.col(unit).alias(u), F.col(z).alias(v))
    pairs = side("a", "za").join(constraints.select("a", "b").distinct(), "a").join(side("b", "zb"), ["__p", "b"])
    deep = F.col("zb") - F.col("za")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("places"), F.count_if(deep > LEVEL).alias("crossed"), F.greatest(F.max(deep), F.lit(0.0)).alias("worst"))


def reason(moved: Column, above: Column, below: Column) -> Column:
    """In words, where an adjusted value went and what it lies level with; null for others."""
    amount = F.when(F.abs(moved) >= 0.05, F.concat(F.format_number(F.abs(moved), 1))).otherwise("less than 0.1")
    parts = F.filter(F.array(F.when(F.size(above) > 0, F.concat(F.lit("at or below "), F.array_join(above, ", "))), F.when(F.size(below) > 0, F.concat(F.lit("at or above "), F.array_join(below, ", ")))), lambda p: p.isNotNull())
    return F.when(F.abs(moved) > STILL, F.concat(F.lit("moved "), F.when(moved < 0, "down ").otherwise("up "), amount, F.lit(" to lie "), F.array_join(parts, " and ")))
