"""The k nearest points of places, without a limit of distance, through a tree of cells.

Points lie in a tree: a cell with more than LEAF points is cut in FAN by FAN, so crowded places are deep and empty ones
have no cells. The tree is a table with a row a cell: how many points it holds and the box around them. Places go down
the tree together, a level a round: of a place's cells those stay that can hold one of its k nearest, which the counts
and the boxes tell (the k nearest lie within the smallest distance inside which the cells hold k points for sure). A place
keeps a few cells around it, however far away or crowded the points are. At the leaves distances are taken, and the k
smallest kept.

Rounds grow with the logarithm of the crowding. The tables of a level are broadcast up to MOST_CELLS rows and joined by a
shuffle beyond. Points that coincide stay in one leaf at the last level, so merge large groups of copies first.
Rows with a null or infinite coordinate are no points and have no neighbours; a null key is a key of its own. Ties of
distance go to the smaller name; repeated rows count each. Places whose key has fewer than k points get all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.lineage import cut

LEAF, FAN, LEVELS = 8, 4, 14
MOST_CELLS = 200_000


def finite(*columns: str) -> Column:
    return reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_CELLS + 1).count() <= MOST_CELLS else df


def tree(points: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of cells by level (key, cx, cy, n, leaf and the box x0, y0, x1, y1), and the points with the level and cell
    of their leaf. points: key, name, x, y and others."""
    low_x, low_y, wide, high = points.agg(F.min("x"), F.min("y"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    side = max(wide or 0.0, high or 0.0) * (1 + 1e-12) or 1.0
    levels, leaves, open_ = [], None, points.withColumn("level", F.lit(0)).withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long"))
    for level in range(LEVELS + 1):
        step = side / FAN**level
        placed = open_.withColumns({"level": F.lit(level), "cx": F.floor((F.col("x") - F.lit(low_x)) / step), "cy": F.floor((F.col("y") - F.lit(low_y)) / step)})
        cells = placed.groupBy("key", "cx", "cy").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        same = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
        cells = cut(cells.withColumn("leaf", (F.col("n") <= LEAF) | same | F.lit(level == LEVELS)))
        levels.append(cells)
        marks = _small(cells.select(F.col("key").alias("__key"), F.col("cx").alias("__x"), F.col("cy").alias("__y"), "leaf"))
        marked = cut(placed.join(marks, F.col("key").eqNullSafe(F.col("__key")) & (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y"))).drop("__key", "__x", "__y"))
        done = marked.where("leaf").drop("leaf")
        leaves = done if leaves is None else leaves.union(done)
        open_ = marked.where("not leaf").drop("leaf")
        if cells.where("not leaf").isEmpty():
            break
    return levels, leaves


def _outside(low: str, high: str, at: str) -> Column:
    return F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))


def _further(low: str, high: str, at: str) -> Column:
    return F.greatest(F.abs(F.col(at) - F.col(low)), F.abs(F.col(high) - F.col(at)))


def _kept(frontier: DataFrame, k: int) -> DataFrame:
    """Of each place's cells those that can hold one of its k nearest points."""
    dx, dy, fx, fy = _outside("x0", "x1", "qx"), _outside("y0", "y1", "qy"), _further("x0", "x1", "qx"), _further("y0", "y1", "qy")
    rows = frontier.withColumn("near", dx * dx + dy * dy).withColumn("far", fx * fx + fy * fy)
    place = Window.partitionBy("q")
    sure = F.sum("n").over(place.orderBy("far", "level", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sure", F.when(sure >= k, F.col("far")))
    # A little more than the bound, so that no point is lost by rounding.
    return rows.withColumn("bound", F.min("sure").over(place)).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-9))).drop("near", "far", "sure", "bound")


def table(points: DataFrame, key: str, x: str, y: str, name: str, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The tree of points, for k_nearest to use more than once."""
    return tree(points.where(finite(x, y)).select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *(F.col(c).alias(f"c_{c}") for c in carried)))


def k_nearest(places: DataFrame, points: DataFrame, k: int, place: str, key: str, x: str, y: str, name: str, others: bool = False, carried: tuple[str, ...] = (), built: tuple[list[DataFrame], DataFrame] | None = None) -> DataFrame:
    """place, distance, rank (1 to k) and of the point `name` and the carried columns, for the k nearest points of each
    place's key. places: place (unique), key, x, y; points: name, key, x, y. others: a place is not its own neighbour,
    places being points of the same names. built: what `table` gave for the
    points."""
    ask = k + 1 if others else k
    levels, leaves = built or table(points, key, x, y, name, carried)
    at = places.where(finite(x, y)).select(F.col(place).alias("q"), F.col(key).alias("qkey"), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy"))
    root = levels[0].drop("leaf").withColumn("level", F.lit(0)).join(levels[0].select(F.col("key").alias("__key"), "leaf"), F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
    frontier = at.join(_small(root), F.col("qkey").eqNullSafe(F.col("key"))).drop("key")
    settled = None
    for level, cells in enumerate(levels[1:], 1):
        frontier = cut(_kept(frontier, ask))
        parents = cells.select(F.col("key").alias("__key"), F.floor(F.col("cx") / FAN).alias("__x"), F.floor(F.col("cy") / FAN).alias("__y"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), *(F.col(c).alias(f"__{c}") for c in ("n", "x0", "y0", "x1", "y1", "leaf")))
        down = frontier.where(~F.col("leaf")).join(_small(parents), F.col("qkey").eqNullSafe(F.col("__key")) & (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y")))
        down = down.select("q", "qkey", "qx", "qy", *(F.col(f"__{c}").alias(c) for c in ("cx", "cy", "n", "x0", "y0", "x1", "y1")), F.lit(level).alias("level"), F.col("__leaf").alias("leaf"))
        frontier = frontier.where("leaf").unionByName(down)
    settled = cut(_kept(frontier, ask)).select("q", "qkey", "qx", "qy", "level", "cx", "cy")
    on = F.col("qkey").eqNullSafe(F.col("key")) & (settled["level"] == leaves["level"]) & (settled["cx"] == leaves["cx"]) & (settled["cy"] == leaves["cy"])
    found = settled.join(leaves, on).select("q", "name", F.hypot(F.col("qx") - F.col("x"), F.col("qy") - F.col("y")).alias("distance"), "x", "y", *(F.col(f"c_{c}").alias(c) for c in carried))
    if others:
        found = found.where(~F.col("q").eqNullSafe(F.col("name")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "name"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(place), F.col("name").alias(f"near_{name}"), "distance", "rank", F.col("x").alias("near_x"), F.col("y").alias("near_y"), *carried)
