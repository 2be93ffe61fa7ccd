"""Overlay of free polygons: areas of unions, intersections and differences, and one layer without overlaps.

A polygon is a list of rings, each a flat list x, y, x, y, ...; a point is inside if a ray from it crosses an odd number
of edges, so holes are rings like others, and rings that cross themselves are repaired by the same rule.

Polygons are cut into cells of a grid chosen by their number of points; cells that still hold more than MOST points
inside are cut in four, round by round, so a crowded place is spread over many cells and an empty one is not. Each cell is
swept alone: between neighbouring x of vertices and crossings its edges do not cross, so they bound trapezoids from below
to above, and each trapezoid is covered by a known set of polygons. Areas are added up over cells.

Rows with a null id, null rings or a null coordinate have no part in anything; rings of under three points enclose
nothing. Repeated ids are one polygon (odd coverage of all its rings). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.lineage import cut

#: Points inside a cell up to which it is swept, and how often a cell is cut in four at most.
MOST, DEPTH = 256, 24
CELL = "level int, cx long, cy long"


def flat(coordinates: Column) -> Column:
    """Rings of GeoJSON, points as [x, y] or [x, y, ...], as flat lists."""
    return F.transform(coordinates, lambda ring: F.flatten(F.transform(ring, lambda p: F.slice(p, 1, 2))))


def _half(ring: np.ndarray, axis: int, at: float, low: bool) -> np.ndarray:
    """The part of a ring on one side of a line across an axis; what lies beyond is laid on the line."""
    d = at - ring[:, axis] if low else ring[:, axis] - at
    after, beyond = np.roll(ring, -1, 0), np.roll(d, -1)
    inside, crosses = d >= 0, (d >= 0) != (beyond >= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        met = ring + (d / (d - beyond))[:, None] * (after - ring)
    met[:, axis] = at
    return np.stack([ring, met], 1).reshape(-1, 2)[np.stack([inside, crosses], 1).ravel()]


def _tiles(rings: list[np.ndarray], x: tuple[int, int], y: tuple[int, int], size: float) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Rings cut to each cell of a range of cells, by halving the range."""
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return
    if x[0] == x[1] and y[0] == y[1]:
        yield x[0], y[0], rings
        return
    axis, (a, b) = (0, x) if x[1] - x[0] >= y[1] - y[0] else (1, y)
    m = (a + b) // 2
    for low, part in ((True, (a, m)), (False, (m + 1, b))):
        kept = [_half(r, axis, (m + 1) * size, low) for r in rings]
        yield from _tiles(kept, part if axis == 0 else x, part if axis == 1 else y, size)


def _cutter(size: float, levels: int):  # noqa: ANN202
    """Batches of level, cx, cy, id, rings to rows of cells `levels` levels down (or, without cells yet, of level 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rings = [np.array(r, float).reshape(-1, 2) for r in row["rings"] if len(r) >= 6]
                if not rings:
                    continue
                if levels:
                    level, step = row["level"] + levels, size / 2 ** (row["level"] + levels)
                    x, y = ((row[c] << levels, ((row[c] + 1) << levels) - 1) for c in ("cx", "cy"))
                else:
                    every, level, step = np.concatenate(rings), 0, size
                    x, y = ((int(every[:, i].min() // size), int(every[:, i].max() // size)) for i in (0, 1))
                made = defaultdict(list)
                for cx, cy, parts in _tiles(rings, x, y, step):
                    every = np.concatenate(parts)
                    low = np.array([cx * step, cy * step])
                    inner = int(((every > low) & (every < low + step)).all(1).sum())
                    for name, v in (("level", level), ("cx", cx), ("cy", cy), ("id", row["id"]), ("rings", [p.ravel().tolist() for p in parts]), ("n", inner)):
                        made[name].append(v)
                if made:
                    kinds = {"level": pa.int32(), "cx": pa.int64(), "cy": pa.int64(), "id": pa.int64(), "rings": pa.list_(pa.list_(pa.float64())), "n": pa.int64()}
                    yield pa.RecordBatch.from_arrays([pa.array(made[k], kind) for k, kind in kinds.items()], names=list(kinds))

    return run


def in_cells(polygons: DataFrame, most: int = MOST) -> tuple[DataFrame, float]:
    """level, cx, cy, id, rings of the parts of polygons (id, rings) in cells, and the size of cells of level 0."""
    whole = F.forall("rings", lambda r: r.isNotNull() & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = polygons.select(F.col("id").cast("long").alias("id"), "rings").where(F.col("id").isNotNull() & F.col("rings").isNotNull() & whole)
    points = rows.select(F.explode("rings").alias("r")).select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("r") / 2).cast("int") - 1), lambda i: F.struct(F.get("r", 2 * i).alias("x"), F.get("r", 2 * i + 1).alias("y")))).alias("p"))
    n, wide, high = points.agg(F.count("*"), F.max("p.x") - F.min("p.x"), F.max("p.y") - F.min("p.y")).first()
    size = max(math.sqrt(max(wide or 0, 1e-300) * max(high or 0, 1e-300) * most / (2 * max(n, 1))), (wide or 0) / 2**30, (high or 0) / 2**30) or 1.0
    ddl = f"{CELL}, id long, rings array<array<double>>, n long"
    cells = cut(rows.mapInArrow(_cutter(size, 0), ddl))
    done = None
    for _ in range(DEPTH):
        sums = cells.groupBy("level", "cx", "cy").agg(F.sum("n").alias("all"))
        crowded = cut(sums.where(F.col("all") > most).drop("all"))
        if crowded.isEmpty():
            break
        ready = cells.join(crowded, ["level", "cx", "cy"], "left_anti")
        done = ready if done is None else done.union(ready)
        cells = cut(cells.join(crowded, ["level", "cx", "cy"], "left_semi").mapInArrow(_cutter(size, 1), ddl))
    return (cells if done is None else done.union(cells)).drop("n"), size


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells dealt to as many tasks as shuffles have: sweeping is long work on few bytes, which Spark would put together."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "level", "cx", "cy")


def _crossings(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """x of proper crossings of edges with x1 < x2."""
    found, slope = [], (y2 - y1) / (x2 - x1)
    for i in range(len(x1) - 1):  # one edge against all later ones at a time
        rest = slice(i + 1, None)
        a, b = np.maximum(x1[i], x1[rest]), np.minimum(x2[i], x2[rest])
        at = lambda x: (y1[i] + slope[i] * (x - x1[i])) - (y1[rest] + slope[rest] * (x - x1[rest]))  # noqa: B023, E731
        low, high = at(a), at(b)
        ok = (a < b) & (low * high < 0)
        found.append((a + (b - a) * low / np.where(low == high, 1, low - high))[ok])
    return np.concatenate(found) if found else np.empty(0)


def swept(rings: list[list[list[float]]]) -> Iterator[tuple[float, float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slabs of a cell from left to right: its two x, the y of the edges there, from below to above, which polygons have
    an edge, and for the space above each edge whether they cover it."""
    edges = []
    for k, parts in enumerate(rings):
        for r in parts:
            p = np.array(r).reshape(-1, 2)
            edges.append(np.column_stack([p, np.roll(p, -1, 0), np.full(len(p), k)]))
    e = np.concatenate(edges)
    e = e[e[:, 0] != e[:, 2]]
    turn = e[:, 0] > e[:, 2]
    e[turn] = e[turn][:, [2, 3, 0, 1, 4]]
    x1, y1, x2, y2, owner = e[:, 0], e[:, 1], e[:, 2], e[:, 3], e[:, 4].astype(int)
    slope = (y2 - y1) / (x2 - x1)
    xs = np.unique(np.concatenate([x1, x2, _crossings(x1, y1, x2, y2)])) if len(e) else np.empty(0)
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        here = np.flatnonzero((x1 <= a) & (x2 >= b))
        if len(here):
            here = here[np.argsort(y1[here] + slope[here] * ((a + b) / 2 - x1[here]), kind="stable")]
            who, at = np.unique(owner[here], return_inverse=True)
            toggles = np.zeros((len(here), len(who)), np.int32)
            toggles[np.arange(len(here)), at] = 1
            yield a, b, y1[here] + slope[here] * (a - x1[here]), y1[here] + slope[here] * (b - x1[here]), who, toggles.cumsum(0) & 1 == 1


def _areas(a: float, b: float, ya: np.ndarray, yb: np.ndarray) -> np.ndarray:
    """Areas above each edge of a slab up to the next one."""
    return np.append(np.maximum(np.diff(ya) + np.diff(yb), 0), 0) * (b - a) / 2


def pair_areas(polygons: DataFrame, most: int = MOST) -> DataFrame:
    """id, other, area: the area that two polygons share; with itself, its own area. Pairs that share nothing have no
    row. A union's area is that of both less the shared one, a difference's the own less the shared one."""
    cells, _ = in_cells(polygons, most)

    def run(table: pa.Table) -> pa.Table:
        parts = defaultdict(list)
        for i, r in zip(table["id"].to_pylist(), table["rings"].to_pylist(), strict=True):
            parts[i] += r
        ids = sorted(parts)
        sums = np.zeros((len(ids), len(ids)))
        for a, b, ya, yb, who, covered in swept([parts[i] for i in ids]):
            sums[np.ix_(who, who)] += (covered * _areas(a, b, ya, yb)[:, None]).T @ covered
        i, j = np.nonzero(sums > 0)
        of = np.array(ids, np.int64)
        return pa.table({"id": of[i], "other": of[j], "area": sums[i, j]})

    found = _dealt(cells).groupBy("level", "cx", "cy").applyInArrow(run, "id long, other long, area double")
    return found.groupBy("id", "other").agg(F.sum("area").alias("area"))


def _rings(pieces: list[tuple[float, float, float, float]], upright: dict[float, list[tuple[float, float, int]]]) -> list[list[float]]:
    """Closed rings from directed edges (inside on the left) and, by x, from upright sides (low, high, 1 for an inside on
    the left, -1 on the right) of which those on both sides cancel."""
    after: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
    for x, sides in upright.items():
        change: dict[float, int] = defaultdict(int)
        for low, high, sign in sides:
            change[low] += sign
            change[high] -= sign
        n, ys = 0, sorted(change)
        for low, high in zip(ys[:-1], ys[1:], strict=True):
            n += change[low]
            if n > 0:
                after[x, low].append((x, high))
            elif n < 0:
                after[x, high].append((x, low))
    for a, ya, b, yb in pieces:
        after[a, ya].append((b, yb))
    rings = []
    while after:
        start = at = next(iter(after))
        ring = []
        while at in after:
            ring.append(at)
            to = after[at].pop()
            if not after[at]:
                del after[at]
            at = to
            if at == start:
                break
        turns = [p for o, p, q in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]], strict=True) if abs((p[0] - o[0]) * (q[1] - p[1]) - (p[1] - o[1]) * (q[0] - p[0])) > 1e-15 * (abs(p[0] - o[0]) + abs(p[1] - o[1])) * (abs(q[0] - p[0]) + abs(q[1] - p[1]))]
        if len(turns) > 2:
            rings.append([v for p in turns for v in p])
    return rings


def layer(polygons: DataFrame, most: int = MOST, outlines: bool = True) -> tuple[DataFrame, DataFrame]:
    """One layer of polygons (id, rings, source, place: smaller places win) without overlaps of sources: where polygons of
    several sources lie, those of the source with the smallest place stay (of equal places the smaller source).

    First: id, level, cx, cy, rings, area of what stays of each polygon, and whole, its own area, by cell; outer rings turn
    left, holes right; without outlines rings are null, which is a good deal faster.
    Second: id, other, area: how much of what stays of id a polygon of another source covers too."""
    cells, size = in_cells(polygons.select("id", "rings"), most)
    sources = polygons.select(F.col("id").cast("long").alias("id"), "source", "place").dropDuplicates(["id"])
    ranked = cells.join(sources, "id").select("level", "cx", "cy", "id", "rings", "place", "source")
    kinds = {"id": pa.int64(), "level": pa.int32(), "cx": pa.int64(), "cy": pa.int64(), "rings": pa.list_(pa.list_(pa.float64())), "other": pa.int64(), "area": pa.float64(), "whole": pa.float64()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        level, cx, cy = (k.as_py() for k in key)
        parts, of = defaultdict(list), {}
        for i, r, place, source in zip(*(table[c].to_pylist() for c in ("id", "rings", "place", "source")), strict=True):
            parts[i] += r
            of[i] = (place is None, place or 0, source is None, source or "")
        ids, order = sorted(parts), {o: k for k, o in enumerate(sorted(set(of.values())))}
        rank = np.array([order[of[i]] for i in ids])
        grain = size / 2**level * 2.0**-36
        kept, whole, under = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros((len(ids), len(ids)))
        sides: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        lines: dict[int, list] = defaultdict(list)
        for a, b, ya, yb, who, covered in swept([parts[i] for i in ids]):
            area, own = _areas(a, b, ya, yb), rank[who]
            stays = covered & (own == np.where(covered, own, len(rank)).min(1)[:, None])
            kept[who] += area @ stays
            whole[who] += area @ covered
            under[np.ix_(who, who)] += (stays * area[:, None]).T @ covered
            if not outlines:
                continue
            ya, yb = (np.round(ya / grain) * grain).tolist(), (np.round(yb / grain) * grain).tolist()
            before = np.vstack([np.zeros((1, len(who)), bool), stays[:-1]])
            for k, w in zip(*(i.tolist() for i in np.nonzero(stays != before)), strict=True):
                lines[who[w]].append((a, ya[k], b, yb[k]) if stays[k, w] else (b, yb[k], a, ya[k]))
            for k, w in zip(*(i.tolist() for i in np.nonzero(stays[:-1])), strict=True):
                sides[who[w]][b].append((yb[k], yb[k + 1], 1))
                sides[who[w]][a].append((ya[k], ya[k + 1], -1))
        rows = [(ids[w], _rings(lines[w], sides[w]) if outlines else None, None, kept[w], whole[w]) for w in np.flatnonzero(whole > 0).tolist()]
        apart = rank[:, None] != rank[None, :]
        rows += [(ids[w], None, ids[j], under[w, j], None) for w, j in zip(*(x.tolist() for x in np.nonzero((under > 0) & apart)), strict=True)]
        made = {"id": [r[0] for r in rows], "level": [level] * len(rows), "cx": [cx] * len(rows), "cy": [cy] * len(rows), "rings": [r[1] for r in rows], "other": [r[2] for r in rows], "area": [r[3] for r in rows], "whole": [r[4] for r in rows]}
        return pa.table([pa.array(made[k], kind) for k, kind in kinds.items()], names=list(kinds))

    found = cut(_dealt(ranked).groupBy("level", "cx", "cy").applyInArrow(run, f"id long, {CELL}, rings array<array<double>>, other long, area double, whole double"))
    return found.where("other is null").select("id", "level", "cx", "cy", "rings", "area", "whole"), found.where("other is not null").groupBy("id", "other").agg(F.sum("area").alias("area"))
