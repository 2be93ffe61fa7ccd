"""Statistics of points and their errors: polynomial trends, inverse distances, error statistics, legend counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import blocks

#: Points closer than this coincide.
SAME = 1e-9
DEGREES = {"constant": 1, "linear": 3, "quadratic": 6}


def _solved(sums: DataFrame, m: int) -> DataFrame:
    """__id and __beta (null where the equations are singular) from rows of __a (m * m sums, row by row) and __b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for a, b in zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist(), strict=True):
                a = np.array(a, float).reshape(m, m)
                made.append(np.linalg.solve(a, np.array(b, float)).tolist() if np.isfinite(a).all() and np.linalg.matrix_rank(a) == m else None)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(made, pa.list_(pa.float64()))], names=["__id", "__beta"])

    return sums.mapInArrow(run, f"__id {sums.schema['__id'].dataType.simpleString()}, __beta array<double>")


def trend(df: DataFrame, key: str, x: str, y: str, z: str, drift: str = "linear") -> DataFrame:
    """df with fitted and residual of the least-squares trend in x and y of each key's points: constant, linear or
    quadratic, from sums alone. Coordinates are centred and scaled by the larger extent (at least 1). Rows with a null
    coordinate or value take no part in the fit; fitted is null where the points do not settle the trend."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()
    on = df.where(whole)
    frame = on.groupBy(F.col(key).alias("__id")).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y), F.lit(1.0)).alias("__s"))
    u, v = (F.col(x) - F.col("__mx")) / F.col("__s"), (F.col(y) - F.col("__my")) / F.col("__s")
    m = DEGREES[drift]
    terms = [F.lit(1.0), u, v, u * u, u * v, v * v][:m]
    sums = on.join(frame, F.col(key).eqNullSafe(F.col("__id"))).groupBy("__id")
    sums = sums.agg(F.array(*(F.sum(a * b) for a in terms for b in terms)).alias("__a"), F.array(*(F.sum(a * F.col(z)) for a in terms)).alias("__b"))
    fits = frame.join(_solved(sums, m).withColumnRenamed("__id", "__id2"), F.col("__id").eqNullSafe(F.col("__id2")))
    fitted = sum((F.get("__beta", i) * t for i, t in enumerate(terms)), F.lit(0.0))
    joined = df.join(fits, F.col(key).eqNullSafe(F.col("__id")), "left").withColumn("fitted", fitted)
    return joined.withColumn("residual", F.col(z) - F.col("fitted")).select(*df.columns, "fitted", "residual")


class _Weights:
    """Sums of inverse squares of distances from a block's points to those that pass by in the order of their names, and
    the nearest of them."""

    def __init__(self, rows: pa.Table) -> None:
        self.names, self.known = rows.column("__name"), blocks.Names(rows.column("__name"))
        self.x, self.y = (rows.column(c).to_numpy() for c in ("__x", "__y"))
        n = rows.num_rows
        self.met, self.sum, self.weight, self.exact = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        self.other: list = [None] * n
        self.least, self.near, self.closest = np.full(n, np.inf), np.zeros(n), np.full(n, None, object)

    def meet(self, others: pa.RecordBatch, own: np.ndarray) -> None:
        names = others.column("__name")
        x, y, z = (others.column(c).to_numpy() for c in ("__x", "__y", "__z"))
        equal = self.known.among(names)
        self.met += len(x) - np.bincount(equal[0], minlength=len(self.x))
        whole, better = bool(np.isfinite(z).all()), np.full(len(self.x), -1)
        with np.errstate(all="ignore"):
            for rows, columns, same in blocks.tiles(len(self.x), len(x), equal):
                d, v = self.x[rows, None] - x[None, columns], self.y[rows, None] - y[None, columns]
                d *= d
                v *= v
                d += v
                d[same] = np.inf
                at = d.argmin(1)
                low = d[np.arange(len(d)), at]
                if np.isnan(low).any():
                    at = np.where(np.isnan(d), np.inf, d).argmin(1)
                    low = d[np.arange(len(d)), at]
                nearer = np.flatnonzero(low < self.least[rows]) + rows.start
                self.least[nearer], better[nearer] = low[nearer - rows.start], at[nearer - rows.start] + columns.start
                if (low < SAME * SAME).any():
                    near = d < SAME * SAME
                    for i in np.flatnonzero(near.any(1)).tolist():
                        if self.other[rows.start + i] is None:
                            j = columns.start + int(near[i].argmax())
                            self.other[rows.start + i], self.exact[rows.start + i] = names[j].as_py(), z[j]
                    d[near] = np.inf
                    same = np.concatenate([same[0], np.nonzero(near)[0]]), np.concatenate([same[1], np.nonzero(near)[1]])
                np.divide(1, d, out=d)
                self.weight[rows] += d.sum(1)
                if whole:
                    self.sum[rows] += np.einsum("ij,j->i", d, z[columns])
                else:  # no weight of 0 makes 0 of these values
                    d *= z[None, columns]
                    d[same] = 0
                    self.sum[rows] += d.sum(1)
        found = np.flatnonzero(better >= 0)
        self.near[found] = z[better[found]]
        self.closest[found] = names.take(pa.array(better[found])).to_pylist()

    def rows(self) -> pa.RecordBatch:
        names = self.names.combine_chunks()
        other = pa.array(self.other, names.type)
        columns = [names, other, pa.array(self.exact, mask=~other.is_valid().to_numpy(zero_copy_only=False)), pa.array(self.sum), pa.array(self.weight)]
        columns += [pa.array(self.least), pa.array(self.closest.tolist(), names.type), pa.array(self.near, mask=~np.isfinite(self.least))]
        return pa.RecordBatch.from_arrays(columns, names=["__name", "__other", "__exact", "__sum", "__weight", "__least", "__closest", "__near"]).filter(pa.array(self.met > 0))


def loo(points: DataFrame, name: str, key: str, x: str, y: str, z: str, size: int = blocks.HELD) -> DataFrame:
    """name, estimate and nearest. estimate: the inverse-square-distance mean of the key's other points; at a point that
    coincides with another one, the value of that one (of the first by name). nearest: the value of the nearest other
    point (of equal distances the first by name; null where no distance is a number). Points without others, or with a
    null, have no row. Both are made while the key's points pass by a block of them, so pairs are never rows."""
    whole = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    whole = whole.select(F.col(key).alias("__at"), F.col(name).alias("__i"), *(F.col(c).cast("double").alias(f"__{a}") for c, a in ((x, "x"), (y, "y"), (z, "z"))))
    kind = points.schema[name].dataType.simpleString()
    sums = blocks.against(whole, "__at", "__i", ["__x", "__y", "__z"], _Weights, f"__name {kind}, __other {kind}, __exact double, __sum double, __weight double, __least double, __closest {kind}, __near double", size=size)
    # Rows that share a name are one point in many places.
    exact = F.min(F.when(F.col("__other").isNotNull(), F.struct("__other", "__exact")))["__exact"]
    nearest = F.min(F.when(F.col("__closest").isNotNull(), F.struct("__least", "__closest", "__near")))["__near"]
    return sums.groupBy(F.col("__name").alias(name)).agg(F.coalesce(exact, F.try_divide(F.sum("__sum"), F.sum("__weight"))).alias("estimate"), nearest.alias("nearest"))


def idw_loo(points: DataFrame, name: str, key: str, x: str, y: str, z: str, size: int = blocks.HELD) -> DataFrame:
    """name and estimate of `loo`."""
    return loo(points, name, key, x, y, z, size).select(name, "estimate")


def error_stats(error: Column, variance: Column | None = None) -> list[Column]:
    """Aggregates n, rmse, mae, bias and, with variances, msse over the positive ones."""
    made = [F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias")]
    return made if variance is None else [*made, F.avg(F.when(variance > 0, error * error / variance)).alias("msse")]


def method_table(errors: DataFrame, key: str, method: str, error: str, first: str | None = None, margin: float = 0.1) -> DataFrame:
    """key, method, n, rmse, mae, bias and chosen of the errors that methods make without each point. The method with the
    smallest rmse is chosen (of equal ones the first by name); `first` stays unless that is better by more than the margin.
    Null errors count for nothing; methods without errors have no row."""
    stats = errors.where(F.col(error).isNotNull()).groupBy(key, method).agg(*error_stats(F.col(error)))
    mark = F.struct("rmse", F.col(method).alias("m"))
    best = stats.groupBy(F.col(key).alias("__k")).agg(F.min(mark).alias("__b"), F.min(F.when(F.col(method) == first, F.col("rmse"))).alias("__first"))
    stays = F.coalesce(F.col("__first") <= (1 + margin) * F.col("__b.rmse"), F.lit(False))
    winner = F.when(stays, F.lit(first)).otherwise(F.col("__b.m"))
    return stats.join(best, F.col(key).eqNullSafe(F.col("__k"))).select(key, method, "n", "rmse", "mae", "bias", (F.col(method) == winner).alias("chosen"))


def legend_counts(df: DataFrame, column: str, classes: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """class, place and n of the classes (class, place) that occur, by place; values of no class, and nulls, count as
    the unknown class, where there is one."""
    known = F.broadcast(classes.select(F.col("class").alias("__class")))
    folded = df.join(known, F.col(column) == F.col("__class"), "left").groupBy(F.coalesce("__class", F.lit(unknown)).alias("class")).agg(F.count("*").alias("n"))
    return folded.join(F.broadcast(classes), "class").select("class", "place", "n").orderBy("place")
