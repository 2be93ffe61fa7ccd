"""Queries of free polygons: embeddings stand for places, around which lie polygons with a hole or crossing themselves.
Polygons shrink as places get more, as maps do, so that the number of layers at a place does not grow with the table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import overlay
from strataflow.registry import query

#: Corners around a place, in radii; places of label 0 go through them crosswise.
CORNERS, CROSSED, HOLE = [(-1.0, -0.6), (0.9, -1.0), (1.0, 0.7), (-0.8, 1.0)], [0, 1, 3, 2], [(-0.3, -0.3), (0.4, -0.2), (0.1, 0.35)]


def polygons(embeddings: DataFrame) -> DataFrame:
    x, y = (F.get("embedding", i).cast("double") for i in (0, 1))
    r = (0.25 + 3 * F.abs(F.get("embedding", 2).cast("double"))) / F.lit(math.sqrt(max(1, embeddings.count())))
    ring = lambda points: F.array(*(c for px, py in points for c in (x + px * r, y + py * r)))
    outer = F.when(F.col("label") == 0, ring([CORNERS[i] for i in CROSSED])).otherwise(ring(CORNERS))
    return embeddings.select(F.col("vec_id").alias("id"), F.array(outer, ring(HOLE)).alias("rings"), F.col("label").alias("source"), (F.col("label") * 7 % 10).alias("place"))


def _edges() -> str:
    """SQL of the edges of all polygons, from left to right."""
    made = []
    for which, points in (("label <> 0", CORNERS), ("label = 0", [CORNERS[i] for i in CROSSED]), ("true", HOLE)):
        for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
            made.append(f"select id, source, place, x + ({ax}) * r as ax, y + ({ay}) * r as ay, x + ({bx}) * r as bx, y + ({by}) * r as by_ from places where {which}")
    return f"""with places as (select vec_id as id, label, label as source, label * 7 % 10 as place, embedding[1]::double as x, embedding[2]::double as y, (0.25 + 3 * abs(embedding[3]::double)) / (select sqrt(count(*)) from embeddings) as r from embeddings),
    edges as materialized (select row_number() over () as e, id, source, place, least(ax, bx) as x1, case when ax < bx then ay else by_ end as y1, greatest(ax, bx) as x2, case when ax < bx then by_ else ay end as y2
        from ({' union all '.join(made)}) where ax <> bx)"""


#: In slabs between all x of vertices and crossings edges have an order; a face above an edge is covered by the polygons that have an odd number of edges up to there.
FACES = f"""{_edges()},
    pairs as (select a.x1, a.y1, (a.y2 - a.y1) / (a.x2 - a.x1) as m, b.x1 as u1, b.y1 as v1, (b.y2 - b.y1) / (b.x2 - b.x1) as w, greatest(a.x1, b.x1) as lo, least(a.x2, b.x2) as hi
        from edges a join edges b on a.e < b.e and a.x1 < b.x2 and b.x1 < a.x2 and least(a.y1, a.y2) <= greatest(b.y1, b.y2) and least(b.y1, b.y2) <= greatest(a.y1, a.y2)),
    gaps as (select lo, hi, (y1 + m * (lo - x1)) - (v1 + w * (lo - u1)) as low, (y1 + m * (hi - x1)) - (v1 + w * (hi - u1)) as high from pairs),
    xs as (select x1 as x from edges union select x2 from edges union select lo + (hi - lo) * low / (low - high) from gaps where low * high < 0),
    slabs as (select row_number() over (order by x) as slab, x as a, lead(x) over (order by x) as b from xs),
    here as (select slab, b - a as wide, id, source, place, y1 + (y2 - y1) / (x2 - x1) * (a - x1) as ya, y1 + (y2 - y1) / (x2 - x1) * (b - x1) as yb, y1 + (y2 - y1) / (x2 - x1) * ((a + b) / 2 - x1) as ym
        from slabs join edges on x1 <= a and x2 >= b),
    placed as materialized (select *, row_number() over (partition by slab order by ym) as k, row_number() over (partition by slab, id order by ym) as own,
        greatest(0, (lead(ya) over (partition by slab order by ym) - ya) + (lead(yb) over (partition by slab order by ym) - yb)) * wide / 2 as area from here),
    runs as (select slab, id, source, place, k, own, lead(k) over (partition by slab, id order by own) as until from placed),
    covers as materialized (select f.slab, f.k, f.area, r.id, r.source, r.place from placed f join runs r on f.slab = r.slab and r.own % 2 = 1 and f.k >= r.k and f.k < r.until where f.area > 0)"""


@query(
    f"""{FACES}, stays as (select * from covers qualify (place, source) = min((place, source)) over (partition by slab, k)),
    own as (select id, sum(area) as area from covers group by 1), kept as (select id, sum(area) as area from stays group by 1),
    under as (select s.id, c.id as other, sum(s.area) as area from stays s join covers c on s.slab = c.slab and s.k = c.k and s.source <> c.source group by all),
    shares as (select u.id, other, u.area / k.area as share from under u join kept k using (id) where k.area > 1e-10)
    select o.id, round(o.area, 9) as area, round(coalesce(k.area, 0), 9) as kept, count(other) filter (where share > 0.01) as others, round(max(share), 6) as most
    from own o left join kept k using (id) left join shares using (id) group by o.id, o.area, k.area""",
    "embeddings",
)
def polygon_overlay(embeddings: DataFrame) -> DataFrame:
    """One layer of overlapping maps: own area of each polygon, area that stays under better sources, others below it."""
    shapes = polygons(embeddings)
    pieces, under = overlay.layer(shapes, outlines=False)
    kept = pieces.groupBy("id").agg(F.sum("whole").alias("area"), F.sum("area").alias("kept"))
    shares = under.join(kept.drop("area"), "id").where("kept > 1e-10").select("id", (F.col("area") / F.col("kept")).alias("share"))
    best = shares.groupBy("id").agg(F.count_if(F.col("share") > 0.01).alias("others"), F.round(F.max("share"), 6).alias("most"))
    found = kept.join(best, "id", "left")
    return found.select("id", F.round("area", 9).alias("area"), F.round("kept", 9).alias("kept"), F.coalesce("others", F.lit(0).cast("long")).alias("others"), "most")


@query(
    f"""{FACES}, own as (select id, sum(area) as area from covers group by 1), both_ as (select a.id, b.id as other, sum(a.area) as area from covers a join covers b on a.slab = b.slab and a.k = b.k and a.id < b.id group by all)
    select b.id, other, round(b.area, 9) as shared, round(o.area + p.area - b.area, 9) as joined, round(o.area - b.area, 9) as without from both_ b join own o on o.id = b.id join own p on p.id = other where b.area > 1e-9""",
    "embeddings",
)
def polygon_pairs(embeddings: DataFrame) -> DataFrame:
    """Areas of intersection, union and difference of polygons that share some ground."""
    found = overlay.pair_areas(polygons(embeddings))
    own = lambda i, a: found.where("id = other").select(F.col("id").alias(i), F.col("area").alias(a))
    pairs = found.where("id < other and area > 1e-9").join(own("id", "a"), "id").join(own("other", "b"), "other")
    return pairs.select("id", "other", F.round("area", 9).alias("shared"), F.round(F.col("a") + F.col("b") - F.col("area"), 9).alias("joined"), F.round(F.col("a") - F.col("area"), 9).alias("without"))
