"""Estimates at places by ordinary kriging with the nearest points of a surface.

A place's points come from the tree of cells (operators/nearest.py), K of them however far they are; so every place is
a small system of its own, solved in Arrow batches, and a surface may have any number of points. With K or fewer points
in a surface the estimate is that of all of them. Coinciding points make a system singular; merge them first.

Rows of points with a null key, place or value are left out. A place without a key's points, or whose key has no model,
gets nulls and a reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import blocks, hulls, modelling, nearest, ordered

K = 24
#: A surface's limit of distance is so many times the upper median of its points' distances to the next one.
FACTOR = 3.0


def covariances(h: np.ndarray, kind: np.ndarray, nugget: np.ndarray, sill: np.ndarray, range_: np.ndarray) -> np.ndarray:
    """Covariances at distances h (rows first) for models given by row."""
    shape = (-1,) + (1,) * (h.ndim - 1)
    kind, nugget, sill, r = kind.reshape(shape), nugget.reshape(shape), sill.reshape(shape), h / range_.reshape(shape)
    rise = np.where(kind == "spherical", np.where(r >= 1, 1.0, 1.5 * r - 0.5 * r**3), np.where(kind == "exponential", 1 - np.exp(-3 * r), 1 - np.exp(-3 * r * r)))
    return np.where(h <= 1e-9, nugget + sill, sill * (1 - rise))


def solved(x: np.ndarray, y: np.ndarray, z: np.ndarray, d: np.ndarray, model: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances of places (rows) from their points: x, y, z and distances, as many in each row."""
    n = x.shape[1]
    total = model[1] + model[2]
    matrix = np.ones((len(x), n + 1, n + 1))
    matrix[:, :n, :n] = covariances(np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]), *model)
    matrix[:, range(n), range(n)] += 1e-10 * np.where(total > 0, total, 1.0)[:, None]
    matrix[:, n, n] = 0
    right = np.ones((len(x), n + 1))
    right[:, :n] = covariances(d, *model)
    try:
        w = np.linalg.solve(matrix, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # one of the systems
        w = np.full_like(right, np.nan)
        for i in range(len(x)):
            if np.linalg.matrix_rank(matrix[i]) == n + 1:
                w[i] = np.linalg.solve(matrix[i], right[i])
    return (w[:, :n] * z).sum(1), np.maximum(total - (w * right).sum(1), 0)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near, kind = batch.column("__near"), batch.column("kind")
        value, variance, reason = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan), np.full(batch.num_rows, None, object)
        sizes, flat, starts = np.diff(near.offsets.to_numpy()), near.values, near.offsets.to_numpy()
        modelled = kind.is_valid().to_numpy(zero_copy_only=False)
        reason[~modelled] = "no model"
        columns = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "distance")}
        model = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "nugget", "sill", "range")]
        for n in np.unique(sizes[modelled]).tolist():
            here = np.flatnonzero(modelled & (sizes == n))
            at = starts[here][:, None] + np.arange(n)[None, :]
            own = (model[0][here].astype(str), *(m[here].astype(float) for m in model[1:]))
            value[here], variance[here] = solved(columns["x"][at], columns["y"][at], columns["z"][at], columns["distance"][at], own)
        reason[modelled & np.isnan(value)] = "singular"
        none = np.isnan(value)
        yield pa.RecordBatch.from_arrays([batch.column("__place"), pa.array(value, mask=none), pa.array(variance, mask=none), pa.array(reason, pa.string())], names=["__place", "value", "variance", "__reason"])


def predicted(places: DataFrame, points: DataFrame, models: DataFrame, place: str, key: str, x: str, y: str, name: str, z: str, k: int = K, others: bool = False) -> DataFrame:
    """place, value, variance, n (points used), nearest (distance) and reason. places: place (unique), key, x, y; points:
    name, key, x, y, z; models: key, kind, range, nugget, sill. others: estimates of points without themselves."""
    there = points.where(F.col(z).isNotNull() & F.col(key).isNotNull()).withColumn("__z", F.col(z).cast("double"))
    near = nearest.k_nearest(places, there, k, place, key, x, y, name, others, ("__z",))
    packed = near.groupBy(place).agg(F.sort_array(F.collect_list(F.struct("rank", "distance", F.col("near_x").alias("x"), F.col("near_y").alias("y"), F.col("__z").alias("z")))).alias("__near"))
    model = models.select(F.col(key).alias("__key"), "kind", F.col("range").cast("double").alias("range"), F.col("nugget").cast("double").alias("nugget"), F.col("sill").cast("double").alias("sill"))
    rows = places.select(F.col(place).alias("__place"), F.col(key).alias("__own")).join(packed.withColumnRenamed(place, "__p"), F.col("__place") == F.col("__p"))
    rows = rows.join(model, F.col("__own") == F.col("__key"), "left").select("__place", "__near", "kind", "nugget", "sill", "range")
    made = rows.mapInArrow(_run, f"__place {places.schema[place].dataType.simpleString()}, value double, variance double, __reason string")
    sums = packed.select(F.col(place).alias("__q"), F.size("__near").alias("n"), F.get("__near", 0)["distance"].alias("nearest"))
    found = places.select(place).join(made, F.col(place) == F.col("__place"), "left").join(sums, F.col(place) == F.col("__q"), "left")
    return found.select(place, "value", "variance", F.coalesce("n", F.lit(0)).alias("n"), "nearest", F.when(F.col("n").isNull(), "no points").otherwise(F.col("__reason")).alias("reason"))


def without(points: DataFrame, models: DataFrame, name: str, key: str, x: str, y: str, z: str, k: int = K) -> DataFrame:
    """name, error (value less estimate without the point), variance and reason, for surfaces of any size."""
    found = predicted(points, points, models, name, key, x, y, name, z, k, others=True)
    there = points.select(F.col(name).alias("__n"), F.col(z).cast("double").alias("__z"))
    return found.join(there, F.col(name) == F.col("__n")).select(name, (F.col("__z") - F.col("value")).alias("error"), "variance", "reason")


class _Nearest:
    """The k nearest of the points that pass by a block's points in the order of their names, and kriging from them."""

    def __init__(self, rows: pa.Table, k: int) -> None:
        x, y = rows.column("__x").to_numpy(), rows.column("__y").to_numpy()
        strips = max(1, round((len(x) / blocks.TILE[0]) ** 0.5))
        order = np.lexsort((y, np.argsort(np.argsort(x, kind="stable")) * strips // len(x)))  # pieces of a block lie close
        self.rows_held = rows.take(pa.array(order))
        self.x, self.y = x[order], y[order]
        names = self.rows_held.column("__name")
        self.names = names.unique()
        self.code = pc.index_in(names, value_set=self.names).to_numpy()
        m = len(x)
        self.found = np.full((4, m, k), np.nan)  # squares of distances, x, y, z
        self.found[0] = np.inf
        # How far the k nearest can be at most, from the block's own points around each piece.
        self.bound = np.full(m, np.inf)
        for i in range(0, m, blocks.TILE[0]):
            rows_, around = slice(i, i + blocks.TILE[0]), slice(max(0, i - 2 * blocks.TILE[0]), i + 3 * blocks.TILE[0])
            d = (self.x[rows_, None] - self.x[around]) ** 2 + (self.y[rows_, None] - self.y[around]) ** 2
            d[self.code[rows_, None] == self.code[around]] = np.inf
            if d.shape[1] > k:
                self.bound[rows_] = np.partition(d, k - 1, axis=1)[:, k - 1]

    def meet(self, others: pa.RecordBatch, own: np.ndarray) -> None:
        code = pc.fill_null(pc.index_in(others.column("__name"), value_set=self.names), -1).to_numpy()
        values = np.stack([others.column(c).to_numpy() for c in ("__x", "__y", "__z")])
        x, y = values[:2]
        k = self.found.shape[2]
        for i in range(0, len(self.x), blocks.TILE[0]):
            rows = slice(i, i + blocks.TILE[0])
            px, py, bound = self.x[rows], self.y[rows], self.bound[rows]
            far = np.sqrt(bound.max()) * (1 + 1e-9)
            at = np.flatnonzero((x >= px.min() - far) & (x <= px.max() + far) & (y >= py.min() - far) & (y <= py.max() + far))
            for j in range(0, len(at), blocks.TILE[1]):
                near = at[j : j + blocks.TILE[1]]
                d = (px[:, None] - x[near]) ** 2 + (py[:, None] - y[near]) ** 2
                d[self.code[rows, None] == code[near]] = np.inf
                wanted = (d <= bound[:, None]).any(0)
                near, d = near[wanted], d[:, wanted]
                both = np.concatenate([self.found[0, rows], d], 1)
                order = np.argsort(both, axis=1, kind="stable")[:, :k]
                self.found[0, rows] = np.take_along_axis(both, order, 1)
                for held, passed in zip(self.found[1:], values[:, near], strict=True):
                    held[rows] = np.take_along_axis(np.concatenate([held[rows], np.broadcast_to(passed, d.shape)], 1), order, 1)
                self.bound[rows] = np.minimum(bound, self.found[0, rows, -1])

    def rows(self) -> pa.RecordBatch:
        n = np.isfinite(self.found[0]).sum(1)
        model = [self.rows_held.column(c).to_numpy() for c in ("__kind", "__nugget", "__sill", "__range")]
        value, variance = np.full(len(n), np.nan), np.full(len(n), np.nan)
        for size in np.unique(n[n > 0]).tolist():
            same = np.flatnonzero(n == size)
            for here in np.array_split(same, -(-len(same) // 1024)):
                d, x, y, z = self.found[:, here, :size]
                value[here], variance[here] = solved(x, y, z, np.sqrt(d), (model[0][here].astype(str), *(m[here] for m in model[1:])))
        error = self.rows_held.column("__z").to_numpy() - value
        none = np.isnan(value)
        columns = [self.rows_held.column(c).combine_chunks() for c in ("__key", "__name")]
        made = pa.RecordBatch.from_arrays([*columns, pa.array(error, mask=none), pa.array(variance, mask=none)], names=["__key", "__name", "error", "variance"])
        return made.filter(pa.array(n > 0))


def passed(points: DataFrame, models: DataFrame, name: str, key: str, x: str, y: str, z: str, k: int = K, size: int = blocks.HELD) -> DataFrame:
    """key, name, error and variance of points whose key has a model and others, as `without` has them; the nearest points
    are found while the key's points pass by a block of them, so no row of a place and a cell is written."""
    there = points.where(nearest.finite(x, y) & F.col(z).isNotNull())
    model = models.select(F.col(key).alias("__k"), F.col("kind").alias("__kind"), *(F.col(c).cast("double").alias(f"__{c}") for c in ("nugget", "sill", "range")))
    rows = there.join(model, F.col(key) == F.col("__k")).select(F.col(key).alias("__at"), F.col(name).alias("__i"), *(F.col(c).cast("double").alias(f"__{a}") for c, a in ((x, "x"), (y, "y"), (z, "z"))), "__kind", "__nugget", "__sill", "__range")
    kind = ", ".join(f"{a} {points.schema[c].dataType.simpleString()}" for a, c in (("__key", key), ("__name", name)))
    begin = lambda rows: _Nearest(rows, k)
    made = blocks.against(rows, "__at", "__i", ["__x", "__y", "__z", "__kind", "__nugget", "__sill", "__range"], begin, f"{kind}, error double, variance double", size=size)
    return made.withColumnsRenamed({"__key": key, "__name": name})


def limits(points: DataFrame, key: str, name: str, x: str, y: str, factor: float = FACTOR) -> DataFrame:
    """key and limit: how far from its points a surface may be estimated."""
    there = points.where(F.col(key).isNotNull())
    near = nearest.k_nearest(there, there, 1, name, key, x, y, name, others=True).join(there.select(F.col(name).alias("__n"), F.col(key).alias("__k")), F.col(name) == F.col("__n"))
    middle = ordered.at_rank(near.select("__k", "distance", name), ["__k"], ["distance", name], F.floor(F.col("n") / 2) + 1)
    return middle.select(F.col("__k").alias(key), (factor * F.col("distance")).alias("limit"))


def estimates(places: DataFrame, points: DataFrame, models: DataFrame, place: str, key: str, x: str, y: str, name: str, z: str, k: int = K, least: float = 0.3) -> DataFrame:
    """place, value, std, nearest, extrapolated and reason: kriging at places up to the surface's limit of distance, with
    deviations calibrated by the errors of its points without themselves (never under least). extrapolated tells places
    outside the hull of the points."""
    errors = without(points, models, name, key, x, y, z, k).join(points.select(F.col(name).alias("__n"), F.col(key).alias("__k")), F.col(name) == F.col("__n"))
    msse = errors.where("variance > 0").groupBy("__k").agg(F.avg(F.col("error") * F.col("error") / F.col("variance")).alias("__msse"))
    side = limits(points, key, name, x, y).select(F.col(key).alias("__k2"), "limit")
    shapes = hulls.hulls(points.where(F.col(z).isNotNull()), key, x, y).select(F.col(key).alias("__k3"), "hull")
    found = predicted(places, points, models, place, key, x, y, name, z, k).withColumnRenamed(place, "__p")
    rows = places.select(place, key, x, y).join(found, F.col(place) == F.col("__p")).join(msse, F.col(key) == F.col("__k"), "left").join(side, F.col(key) == F.col("__k2"), "left").join(shapes, F.col(key) == F.col("__k3"), "left")
    inside = hulls.inside(F.col("hull"), F.col(x), F.col(y))
    standing = modelling.standing(F.col("nearest"), inside, F.coalesce("limit", F.lit(0.0)), F.sqrt("variance"), modelling.calibration(F.col("__msse"), 0.25, 20.0), least)
    rows = rows.withColumn("__s", standing)
    allowed = F.col("__s.value_allowed") & F.col("value").isNotNull()
    return rows.select(place, F.when(allowed, F.col("value")).alias("value"), F.when(allowed, F.col("__s.std")).alias("std"), "nearest", F.col("__s.extrapolated").alias("extrapolated"), F.coalesce("reason", "__s.reason").alias("reason"))
