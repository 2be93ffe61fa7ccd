"""Natural neighbour estimates (Sibson's weights) at places.

A place's cell is what lies nearer to it than to any point; each point's weight is the share of that cell which the point
would hold without the place. Both are made from the K nearest points: the plane halved between the place and each point,
then the cell halved between the points whose half touches it, for no others hold a part of it. The cell is sure once no
farther point can reach it: as the farthest point asked for is at least twice as far as the cell's corners. Places that are not sure ask for twice as many points in a next round,
until all points are asked for. So every place is a small job of its own, and no triangulation of a surface is gathered.

Places outside the hull of the points, or on it, have an open cell and no estimate, and ask for nothing; at a point the
estimate is its value. The nearer a place lies to a side of the hull, the farther its cell reaches and the more it asks. Rows of
points with a null or infinite coordinate, a null value or a null key are left out; points that coincide share the
weight of one. Fewer than three points, or points on one line, give no estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import hulls, nearest
from strataflow.operators.lineage import cut

K = 24
#: Half the side of the square, in distances of the farthest point, in which cells are closed; a cell that reaches its
#: sides is open.
FAR = 1e6


def _nearer(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of a convex ring that lies nearer to a than to b."""
    d = (cell - (a + b) / 2) @ (b - a)
    after, beyond = np.roll(cell, -1, 0), np.roll(d, -1)
    crosses = (d <= 0) != (beyond <= 0)
    if not crosses.any():
        return cell if (d <= 0).all() else cell[:0]
    with np.errstate(divide="ignore", invalid="ignore"):
        met = cell + (d / (d - beyond))[:, None] * (after - cell)
    return np.stack([cell, met], 1).reshape(-1, 2)[np.stack([d <= 0, crosses], 1).ravel()]


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) / 2


def weights(q: np.ndarray, points: np.ndarray, whole: bool) -> tuple[np.ndarray | None, bool]:
    """Shares of the nearest points (by distance) and whether they are sure; whole: these are all points there are."""
    away = np.hypot(*(points - q).T)
    if away[0] == 0:
        return (away == 0) / (away == 0).sum(), True
    reach = float(away[-1])
    place, points = np.zeros(2), points - q
    side = FAR * reach
    cell = np.array([[-side, -side], [side, -side], [side, side], [-side, side]])
    corners = np.full(4, np.inf)
    for p, d in zip(points, away, strict=True):  # by distance: from some point on none can reach the cell
        if d > 2 * corners.max():
            break
        cell = _nearer(cell, place, p)
        corners = np.hypot(*cell.T)
    if corners.max() >= side / 2:
        return None, whole
    if not whole and 2 * corners.max() > reach:
        return None, False
    shares = np.zeros(len(points))
    near = [i for i, p in enumerate(points) if away[i] <= 2.1 * corners.max() and np.abs((cell - p / 2) @ p).min() <= 1e-9 * away[i] * max(reach, corners.max())]
    for i in near:
        part = cell
        for j in near:
            if j != i and (points[i] != points[j]).any():
                part = _nearer(part, points[i], points[j])
                if len(part) < 3:
                    break
        if len(part) > 2:
            shares[i] = _area(part) / (points == points[i]).all(1).sum()
    total = shares.sum()
    return (shares / total, True) if total > 0 else (None, whole)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, sure, used = [], [], []
        for x, y, near, n in zip(*(batch.column(c).to_pylist() for c in ("__x", "__y", "__near", "__all")), strict=True):
            if n < 3:
                w, ok = None, True
            else:
                w, ok = weights(np.array([x, y]), np.array([[p["x"], p["y"]] for p in near]), len(near) >= n)
            value.append(float(w @ np.array([p["z"] for p in near])) if ok and w is not None else None)
            used.append(int((w > 0).sum()) if ok and w is not None else 0)
            sure.append(ok)
        yield pa.RecordBatch.from_arrays([batch.column("__place"), pa.array(value, pa.float64()), pa.array(used, pa.int32()), pa.array(sure)], names=["__place", "value", "n", "sure"])


def estimated(places: DataFrame, points: DataFrame, place: str, key: str, x: str, y: str, name: str, z: str, k: int = K, others: bool = False) -> DataFrame:
    """place, value and n (neighbours with a weight) of places (place unique, key, x, y) among the points of their key.
    others: estimates of points without themselves. Places without an estimate have null and 0."""
    there = points.where(F.col(z).isNotNull() & F.col(key).isNotNull() & nearest.finite(x, y)).withColumn("__z", F.col(z).cast("double"))
    counts = there.groupBy(F.col(key).alias("__key")).agg((F.count("*") - int(others)).alias("__all"))
    kind = places.schema[place].dataType.simpleString()
    built = nearest.table(there, key, x, y, name, ("__z",))
    shapes = hulls.hulls(there, key, x, y).withColumnRenamed(key, "__h")
    within = places.where(nearest.finite(x, y)).join(shapes, F.col(key) == F.col("__h")).where(hulls.inside(F.col("hull"), F.col(x), F.col(y), 0.0))
    left, done = cut(within.select(place, key, x, y)), None
    most = counts.agg(F.max("__all")).first()[0] or 0
    while True:
        near = nearest.k_nearest(left, there, k, place, key, x, y, name, others, ("__z",), built)
        packed = near.groupBy(F.col(place).alias("__place")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("near_x").alias("x"), F.col("near_y").alias("y"), F.col("__z").alias("z")))).alias("__near"))
        rows = packed.join(left.select(F.col(place).alias("__p"), F.col(key).alias("__k"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), F.col("__place") == F.col("__p")).join(counts, F.col("__k") == F.col("__key"))
        made = cut(rows.select("__place", "__x", "__y", "__near", "__all").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__place").mapInArrow(_run, f"__place {kind}, value double, n int, sure boolean"))
        settled = made.where("sure").drop("sure")
        done = settled if done is None else done.union(settled)
        open_ = made.where("not sure")
        if k >= most or open_.isEmpty():
            break
        left, k = left.join(open_.select("__place"), F.col(place) == F.col("__place"), "left_semi"), 2 * k
    return places.select(place).join(done, F.col(place) == F.col("__place"), "left").select(place, "value", F.coalesce("n", F.lit(0)).alias("n"))
