"""Joins of boxes, points and grids through cells: no side is paired with the whole other one.

Rows with a null coordinate meet nothing. Boxes may repeat; each row stands for itself. Columns made start with two
underscores and go again, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import geodesy
from strataflow.operators import blocks

Box = tuple[str, str, str, str]


def in_cells(df: DataFrame, box: Box, size: float) -> DataFrame:
    """df with a row for each cell __cx, __cy that a box touches."""
    low, high = (lambda c: F.floor(F.col(c) / size)), (lambda c: F.floor(F.col(c) / size))
    rows = df.where(F.col(box[0]).isNotNull() & F.col(box[1]).isNotNull() & F.col(box[2]).isNotNull() & F.col(box[3]).isNotNull())
    return rows.withColumn("__cx", F.explode(F.sequence(low(box[0]), high(box[2])))).withColumn("__cy", F.explode(F.sequence(low(box[1]), high(box[3]))))


def box_pairs(left: DataFrame, right: DataFrame, a: Box, b: Box, size: float, extra: Column | None = None) -> DataFrame:
    """Pairs of overlapping boxes, each once: they are found in all cells that both touch and kept in the one with the
    overlap's lower left corner. Names of the sides must differ."""
    x, y = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / size), F.floor(F.greatest(F.col(a[1]), F.col(b[1])) / size)
    over = (F.col(a[0]) < F.col(b[2])) & (F.col(b[0]) < F.col(a[2])) & (F.col(a[1]) < F.col(b[3])) & (F.col(b[1]) < F.col(a[3]))
    on = (F.col("l.__cx") == F.col("r.__cx")) & (F.col("l.__cy") == F.col("r.__cy")) & (F.col("l.__cx") == x) & (F.col("l.__cy") == y) & over
    pairs = in_cells(left, a, size).alias("l").join(in_cells(right, b, size).alias("r"), on if extra is None else on & extra)
    return pairs.select(*(F.col(f"l.`{c}`") for c in left.columns), *(F.col(f"r.`{c}`") for c in right.columns))


#: A number above those of boxes, for none.
_NONE = np.iinfo(np.int64).max


class _Overlays:
    """What boxes of other labels cover of a block's boxes, while these pass by in the order of their labels."""

    def __init__(self, rows: pa.Table, least: float, first: int, digits: int) -> None:
        self.least, self.scale = least, 10.0**digits
        # By their western edges, so that few of those that pass by meet some rows.
        order = np.argsort(rows.column("__w").to_numpy(), kind="stable")
        self.names = rows.column("__name").take(pa.array(order)).combine_chunks()
        self.w, self.s, self.e, self.n = (rows.column(f"__{c}").to_numpy()[order] for c in "wsen")
        self.labels = rows.column("__label").unique()
        self.label = pc.index_in(rows.column("__label"), value_set=self.labels).to_numpy()[order]
        m = len(order)
        self.area = (self.e - self.w) * (self.n - self.s)
        self.count, self.sources, self.covered, self.run = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.full(m, -1)
        self.top, self.who = np.full((m, first), -1.0), np.full((m, first), _NONE)
        self.runs, self.last = 0, None

    def meet(self, others: pa.RecordBatch, own: np.ndarray) -> None:
        label = others.column("__label")
        code = pc.fill_null(pc.index_in(label, value_set=self.labels), -1).to_numpy()
        run = np.cumsum(np.diff(label.dictionary_encode().indices.to_numpy(), prepend=0) != 0) + self.runs
        if label[0].as_py() != self.last:
            run += 1
        self.runs, self.last = int(run[-1]), label[len(label) - 1].as_py()
        name = pc.fill_null(others.column("__name"), _NONE).to_numpy()
        w, s, e, n = (others.column(f"__{c}").to_numpy() for c in "wsen")
        for i in range(0, len(self.w), blocks.TILE[0]):
            rows = slice(i, i + blocks.TILE[0])
            near = np.flatnonzero((w < self.e[rows].max()) & (e > self.w[rows].min()) & (s < self.n[rows].max()) & (n > self.s[rows].min()))
            for j in range(0, len(near), blocks.TILE[1]):
                at = near[j : j + blocks.TILE[1]]
                self._meet(rows, code[at], run[at], name[at], w[at], s[at], e[at], n[at])

    def _meet(self, rows: slice, code: np.ndarray, run: np.ndarray, name: np.ndarray, w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> None:
        wide = np.minimum(self.e[rows, None], e) - np.maximum(self.w[rows, None], w)
        share = np.minimum(self.n[rows, None], n) - np.maximum(self.s[rows, None], s)
        hit = (wide > 0) & (share > 0) & (self.label[rows, None] != code)
        share *= wide
        with np.errstate(all="ignore"):
            share /= self.area[rows, None]
        hit &= share > self.least
        share[~hit] = 0
        self.count[rows] += np.count_nonzero(hit, axis=1)
        self.covered[rows] += share.sum(1)
        # Rows of one label follow each other, so a label is new to a box where its run is.
        starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        of = np.logical_or.reduceat(hit, starts, axis=1)
        self.sources[rows] += np.count_nonzero(of, axis=1) - (of[:, 0] & (self.run[rows] == run[0]))
        self.run[rows] = np.where(of[:, -1], run[-1], self.run[rows])
        worst = (self.top[rows, -1] - 1) / self.scale
        i, j = np.nonzero(hit & (share >= worst[:, None]))
        if not len(i):
            return
        scaled = share[i, j] * self.scale
        low = np.floor(scaled)
        count, first = self.top[rows].shape
        place = np.concatenate([np.repeat(np.arange(count), first), i])
        value = np.concatenate([self.top[rows].ravel(), low + (scaled - low >= 0.5)])
        who = np.concatenate([self.who[rows].ravel(), name[j]])
        order = np.lexsort((who, -value, place))
        kept = order[np.arange(len(order)) - np.searchsorted(place[order], place[order]) < first]
        self.top[rows], self.who[rows] = value[kept].reshape(count, first), who[kept].reshape(count, first)

    def rows(self) -> pa.RecordBatch:
        there = (self.top >= 0) & (self.who != _NONE)
        tops = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]), pa.int32()), pa.array(self.who[there]))
        columns = [self.names, pa.array(self.count), pa.array(self.sources), pa.array(self.covered), tops]
        return pa.RecordBatch.from_arrays(columns, names=["__name", "n", "sources", "covered", "top"]).filter(pa.array(self.count > 0))


def overlays(boxes: DataFrame, name: str, label: str, box: Box, size: float, least: float = 0.01, first: int = 5, digits: int = 9) -> DataFrame:
    """name (a whole number), n, sources, covered and top: of boxes of other labels that cover more than `least` of a
    box, how many they are and of how many labels, the sum of their shares, and the numbers of the first ones by rounded
    share, then number. Boxes without any have no row; boxes of one number are one box in many places.

    A block of boxes of one cell is held while boxes that can meet them pass by, so pairs are never rows. Cells are as
    large as the boxes held (size or twice, four times ... that). Only boxes whose number repeats are paired as rows."""
    rows = boxes.where(F.col(label).isNotNull()).select(F.col(name).cast("long").alias("__name"), F.col(label).alias("__label"), *(F.col(c).cast("double").alias(f"__{a}") for c, a in zip(box, "wsen", strict=True)))
    rows = rows.where("__w < __e and __s < __n and not isnan(__e) and not isnan(__n)").withColumn("__many", F.count("*").over(Window.partitionBy("__name")) > 1)
    wide = F.greatest(F.col("__e") - F.col("__w"), F.col("__n") - F.col("__s"))
    level = F.when(wide > size, F.ceil(F.log2(wide / size))).otherwise(0).cast("int")
    cell = lambda v, step: F.floor(v / step)
    step = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("__level"))
    held = rows.where("not __many").withColumn("__level", level).withColumns({"__cx": cell(F.col("__w"), step), "__cy": cell(F.col("__s"), step)})
    cells = ["__level", "__cx", "__cy"]
    counts = held.groupBy(*(F.col(c).alias(f"{c}2") for c in cells)).agg(F.ceil(F.count("*") / blocks.HELD).cast("int").alias("__of"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in cells]
    dealt = held.join(counts, same).withColumn("__to", F.pmod(F.xxhash64("__name"), "__of").cast("int")).withColumn("__side", F.lit(1))
    # A box held begins at most a cell before those that it meets; a little more for rounding.
    span = lambda low, high: F.explode(F.sequence(cell(F.col(low) - step * (1 + 1e-6), step), cell(F.col(high), step)))
    passing = rows.crossJoin(F.broadcast(counts.select(F.col("__level2").alias("__level")).distinct())).withColumn("__cx", span("__w", "__e")).withColumn("__cy", span("__s", "__n"))
    passing = passing.join(counts, same).withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__of") - 1))).withColumn("__side", F.lit(2))
    columns = [*cells, "__to", "__side", "__name", "__label", "__w", "__s", "__e", "__n"]
    marks = counts.select(*(F.col(f"{c}2").alias(c) for c in cells), F.explode(F.sequence(F.lit(0), F.col("__of") - 1)).alias("__to"))
    both = dealt.select(*columns).unionByName(passing.select(*columns)).withColumn("__block", F.lit(0))
    begin = lambda rows: _Overlays(rows, least, first, digits)
    made = blocks.streamed(both, marks, [*cells, "__to"], ["__label", "__name", "__w", "__s"], begin, "__name long, n long, sources long, covered double, top array<long>")
    a, b = ("__w", "__s", "__e", "__n"), ("__w2", "__s2", "__e2", "__n2")
    pairs = box_pairs(rows.where("__many").drop("__many"), rows.select(*(F.col(c).alias(f"{c}2") for c in ("__name", "__label", *a))), a, b, size, F.col("__label") != F.col("__label2"))
    pairs = pairs.withColumn("__share", geodesy.box_share(tuple(map(F.col, a)), tuple(map(F.col, b)))).where(F.col("__share") > least)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.round("__share", digits)).alias("k"), F.col("__name2").alias("i")))), 1, first)
    repeated = pairs.groupBy("__name").agg(F.count("*").alias("n"), F.count_distinct("__label2").alias("sources"), F.sum("__share").alias("covered"), F.transform(best, lambda t: t["i"]).alias("top"))
    return made.unionByName(repeated).withColumnRenamed("__name", name)


def covering(points: DataFrame, boxes: DataFrame, x: str, y: str, box: Box, size: float) -> DataFrame:
    """Pairs of points and the boxes (edges included) that hold them."""
    inside = F.col(x).between(F.col(box[0]), F.col(box[2])) & F.col(y).between(F.col(box[1]), F.col(box[3]))
    placed = points.withColumn("__cx", F.floor(F.col(x) / size)).withColumn("__cy", F.floor(F.col(y) / size))
    return placed.join(in_cells(boxes, box, size), ["__cx", "__cy"]).where(inside).drop("__cx", "__cy")


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, west: float, north: float, step: float, columns: int, rows: int, nodata: float | None = None) -> DataFrame:
    """points with shift, the bilinear value of a grid (r, c, v, rows from north to south) at each; null outside and
    beside a missing value. Four equality joins on cells become one, on the cells of the points."""
    fx, fy = (F.col(x) - west) / step, (north - F.col(y)) / step
    within = (fx >= -1e-9) & (fx <= columns - 1 + 1e-9) & (fy >= -1e-9) & (fy <= rows - 1 + 1e-9)
    clipped = lambda f, n: F.greatest(F.lit(0.0), F.least(f, F.lit(float(n - 1))))
    placed = points.withColumn("__id", F.monotonically_increasing_id()).withColumn("__fx", F.when(within, clipped(fx, columns))).withColumn("__fy", F.when(within, clipped(fy, rows)))
    placed = placed.withColumn("__c", F.least(F.floor("__fx"), F.lit(columns - 2))).withColumn("__r", F.least(F.floor("__fy"), F.lit(rows - 2)))
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    asked = placed.where("__c is not null").select("__id", "__fx", "__fy", "__r", "__c", F.explode(corners).alias("k"))
    tx, ty = F.col("__fx") - F.col("__c"), F.col("__fy") - F.col("__r")
    weight = F.when(F.col("k.j") == 1, tx).otherwise(1 - tx) * F.when(F.col("k.i") == 1, ty).otherwise(1 - ty)
    there = grid if nodata is None else grid.where(F.col("v") != nodata)
    found = asked.join(there.where("v is not null and not isnan(v)"), (F.col("r") == F.col("__r") + F.col("k.i")) & (F.col("c") == F.col("__c") + F.col("k.j")))
    sums = found.groupBy("__id").agg(F.sum(F.col("v") * weight).alias("shift"), F.count("*").alias("__n")).where("__n = 4")
    return placed.join(sums.select("__id", "shift"), "__id", "left").select(*points.columns, "shift")


def coincident(points: DataFrame, x: str, y: str, z: str, ref: str, digits: int = 2) -> DataFrame:
    """Points that agree in rounded coordinates as one: rounded x and y, mean z, their references in order, and n."""
    keys = [F.round(F.col(x), digits).alias(x), F.round(F.col(y), digits).alias(y)]
    return points.groupBy(*keys).agg(F.avg(z).alias(z), F.sort_array(F.collect_list(ref)).alias("refs"), F.count("*").alias("n"))


def first_of_tiles(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key over overlapping tiles: the first by order, combined before the shuffle."""
    best = F.min(F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("__row")))
    return df.groupBy(*keys).agg(best.alias("__b")).select("__b.__row.*")
