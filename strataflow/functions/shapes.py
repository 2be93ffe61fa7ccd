"""Rings against boxes and segments, as Column expressions. A ring is an array of structs x, y; its end meets its start.
A null or empty ring has no area and meets nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions import geodesy

Box = tuple[Column, Column, Column, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _before(ring: Column) -> Column:
    """Each point's predecessor."""
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def _half(axis: str, bound: Column, least: bool) -> Callable[[Column], Column]:
    """The part of a ring on one side of a line along an axis."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] >= bound) if least else (p[axis] <= bound)

    def met(p: Column, q: Column) -> Column:
        along = p[other] + (q[other] - p[other]) * (bound - p[axis]) / (q[axis] - p[axis])
        return _point(bound, along) if axis == "x" else _point(along, bound)

    def step(p: Column, q: Column) -> Column:
        return F.when(inside(q) & inside(p), F.array(q)).when(inside(q), F.array(met(p, q), q)).when(inside(p), F.array(met(p, q))).otherwise(F.slice(F.array(q), 1, 0))

    return lambda ring: F.when(F.size(ring) > 0, F.flatten(F.zip_with(_before(ring), ring, step))).otherwise(ring)


def clipped(ring: Column, box: Box) -> Column:
    """The part of a ring in a box (west, south, east, north), cut side by side."""
    w, s, e, n = box
    found = ring
    for axis, bound, least in (("x", w, True), ("x", e, False), ("y", s, True), ("y", n, False)):
        found = let(found, _half(axis, bound, least))
    return found


def area_in(ring: Column, box: Box) -> Column:
    """The area of the part of a ring in a box."""
    w, s, e, n = box
    return F.when((e <= w) | (n <= s), 0.0).otherwise(F.coalesce(F.abs(let(clipped(ring, box), geodesy.signed_area)), F.lit(0.0)))


def rectangles(box: Box, least: float = 1e-4) -> Column:
    """The rectangles (array of structs w, s, e, n) of a box: two if it crosses the antimeridian; a line or a point gets
    a small width."""
    w, s, e, n = box
    thin, narrow = n - s < least, (e - w < least) & (w <= e)
    low, high = F.when(thin, s - 5 * least).otherwise(s), F.when(thin, n + 5 * least).otherwise(n)
    one = lambda a, b: F.struct(a.alias("w"), low.alias("s"), b.alias("e"), high.alias("n"))
    return F.when(w > e, F.array(one(w, F.lit(180.0)), one(F.lit(-180.0), e))).otherwise(F.array(one(F.when(narrow, w - 5 * least).otherwise(w), F.when(narrow, e + 5 * least).otherwise(e))))


def share_in(ring: Column, box: Box) -> Column:
    """The share of a box's rectangles that lies in a ring."""
    parts = rectangles(box)
    one = lambda r: area_in(ring, (r["w"], r["s"], r["e"], r["n"]))
    total = lambda f: F.aggregate(F.transform(parts, f), F.lit(0.0), lambda a, v: a + v)
    return total(one) / total(lambda r: (r["e"] - r["w"]) * (r["n"] - r["s"]))


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d meet; parallel ones do not."""
    det = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
    t = F.try_divide((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"]), det)
    u = F.try_divide((c["x"] - a["x"]) * (b["y"] - a["y"]) - (c["y"] - a["y"]) * (b["x"] - a["x"]), det)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def meets_box(ring: Column, box: Box) -> Column:
    """Whether a ring and a box overlap: a corner of the box in the ring, a point of the ring in the box, or sides that
    cross."""
    w, s, e, n = box
    corners = [_point(*p) for p in ((w, s), (e, s), (e, n), (w, n))]
    corner = lambda r: F.exists(F.array(*corners), lambda p: geodesy.inside(r, p["x"], p["y"]))
    point = lambda r: F.exists(r, lambda p: p["x"].between(w, e) & p["y"].between(s, n))
    sides = F.array(*(F.struct(corners[i].alias("a"), corners[(i + 1) % 4].alias("b")) for i in range(4)))
    side = lambda r: F.exists(F.zip_with(_before(r), r, lambda p, q: F.exists(sides, lambda k: crosses(p, q, k["a"], k["b"]))), lambda c: c)
    return F.coalesce(let(ring, lambda r: corner(r) | point(r) | side(r)), F.lit(False))


def beyond_line(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    """Whether a point lies below a line of two or more points from west to east, whose ends go on."""
    made = None
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(line, line[1:])):
        at = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        last = i == len(line) - 2
        made = F.when(x <= x1, at) if made is None and not last else at if made is None else made.otherwise(at) if last else made.when(x <= x1, at)
    return y < made


def tier(box: Box, pilot: tuple[float, float, float, float], line: list[tuple[float, float]], ratio: float = 4.0, least: float = 0.5) -> Column:
    """0 for a box that meets a pilot box and is at most ratio times as large or lies in it by a least share; else 1
    for a centre below the line, else 2; 2 without a box."""
    w, s, e, n = box
    width, height = F.least(e, F.lit(pilot[2])) - F.greatest(w, F.lit(pilot[0])), F.least(n, F.lit(pilot[3])) - F.greatest(s, F.lit(pilot[1]))
    common = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    area = F.coalesce(F.nullif((e - w) * (n - s), F.lit(0.0)), F.lit(1e-9))
    near = (common > 0) & ((area <= ratio * (pilot[2] - pilot[0]) * (pilot[3] - pilot[1])) | (common / area >= least))
    return F.when(w.isNull() | s.isNull() | e.isNull() | n.isNull(), 2).when(near, 0).when(beyond_line((w + e) / 2, (s + n) / 2, line), 1).otherwise(2)


def level_with(values: Column, pairs: list[tuple[str, str]], start: str, tolerance: float = 1e-6) -> Column:
    """The names that pairs connect with start where both values (a map by name) are level; sorted."""
    at = lambda name: F.try_element_at(values, F.lit(name))
    level = [F.when(F.abs(at(a) - at(b)) <= tolerance, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs]
    links = F.array_compact(F.array(*level))

    def grow(found: Column, _: Column) -> Column:
        return F.aggregate(links, found, lambda acc, k: F.when(F.array_contains(acc, k["a"]) | F.array_contains(acc, k["b"]), F.array_union(acc, F.array(k["a"], k["b"]))).otherwise(acc))

    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.lit(len(pairs))), F.array(F.lit(start)), grow))
