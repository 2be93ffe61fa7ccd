"""Queries of rings, boxes, hulls and places at which surfaces are level. Embeddings stand for points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import geodesy, shapes
from strataflow.operators import hulls as hull_operators
from strataflow.plans.space import _POINTS, points
from strataflow.registry import query

#: A triangle and a line, used on both sides.
TRIANGLE = [(-0.3, -0.3), (0.3, -0.3), (-0.3, 0.3)]
LINE = [(-0.2, 0.1), (0.0, -0.05), (0.2, 0.0)]
PILOT = (-0.1, -0.1, 0.05, 0.05)


@query(
    f"""with p as ({_POINTS}),
    e as (select a.label, a.vec_id as i, b.vec_id as j, a.x as x, a.y as y, a.x * b.y - b.x * a.y as part from p a join p b on a.label = b.label and a.vec_id <> b.vec_id),
    h as (select * from e where not exists (select 1 from p c join p a on a.vec_id = e.i join p b on b.vec_id = e.j where c.label = e.label and (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
    select label, count(*)::bigint as corners, round(sum(part) / 2, 6) as area, round(min(x), 6) as least from h group by 1""",
    "embeddings",
)
def group_hulls(embeddings: DataFrame) -> DataFrame:
    """Convex hulls of groups: corners and area."""
    found = hull_operators.hulls(points(embeddings), "label", "x", "y")
    return found.select("label", F.size("hull").cast("long").alias("corners"), F.round(geodesy.signed_area(F.col("hull")), 6).alias("area"), F.round(F.array_min(F.col("hull")["x"]), 6).alias("least"))


@query(
    f"""with b as (select vec_id, x - 0.1 as w, y - 0.08 as s, x + 0.1 as e, y + 0.08 as n from ({_POINTS})),
    k as (select vec_id, greatest(w, -0.3) as w, greatest(s, -0.3) as s, e, n from b), t as (select vec_id, w, s, least(e, 0.3) - w as a, least(n, 0.3) - s as b, -(w + s) as u from k),
    g as (select vec_id, a, b, u, least(a, greatest(u, 0)) as p from t)
    select vec_id, round(case when a <= 0 or b <= 0 or u <= 0 then 0 else (u * u - greatest(u - a, 0) * greatest(u - a, 0) - greatest(u - b, 0) * greatest(u - b, 0) + greatest(u - a - b, 0) * greatest(u - a - b, 0)) / 2 end / (0.2 * 0.16), 6) as share,
      (a >= 0 and b >= 0 and u >= 0) as meets from g""",
    "embeddings",
)
def ring_shares(embeddings: DataFrame) -> DataFrame:
    """The share of boxes inside a triangle, by clipping; SQL takes the area below its long side."""
    x, y = F.col("x"), F.col("y")
    box = (x - 0.1, y - 0.08, x + 0.1, y + 0.08)
    ring = geodesy.ring(TRIANGLE)
    return points(embeddings).select("vec_id", F.round(shapes.share_in(ring, box), 6).alias("share"), shapes.meets_box(ring, box).alias("meets"))


@query(
    f"""with b as (select vec_id, x - z as w, y - 0.05 as s, x + z as e, y + 0.05 as n, x, y from (select vec_id, x, y, case when vec_id % 9 > 0 then abs(z) + 0.01 end as z from ({_POINTS}))),
    o as (select *, greatest(least(e, 0.05) - greatest(w, -0.1), 0) * greatest(least(n, 0.05) - greatest(s, -0.1), 0) as common, (e - w) * (n - s) as area from b)
    select vec_id, case when w is null then 2 when common > 0 and (area <= 4 * 0.15 * 0.15 or common / area >= 0.5) then 0 when (s + n) / 2 < case when (w + e) / 2 <= 0 then 0.1 - 0.15 * ((w + e) / 2 + 0.2) / 0.2 else -0.05 + 0.05 * ((w + e) / 2) / 0.2 end then 1 else 2 end as tier from o""",
    "embeddings",
)
def priority_tiers(embeddings: DataFrame) -> DataFrame:
    """Tiers of boxes: in a pilot area, below a line, or neither."""
    x, y, z = F.col("x"), F.col("y"), F.when(F.col("vec_id") % 9 > 0, F.abs("z") + 0.01)
    return points(embeddings).select("vec_id", shapes.tier((x - z, y - 0.05, x + z, y + 0.05), PILOT, LINE).alias("tier"))


@query(
    """with p as (select p_partkey, p_size // 10 as a, p_size // 15 as b, p_size // 20 as c, p_partkey % 3 as d from part)
    select p_partkey, concat_ws(',', 'a', case when a = b or (a = d and c = d and b = c) then 'b' end, case when (a = b and b = c) or (a = d and d = c) then 'c' end, case when a = d or (a = b and b = c and c = d) then 'd' end) as level from p""",
    "part",
)
def level_units(part: DataFrame) -> DataFrame:
    """Units that are level with the first one through chains of ordered pairs."""
    size = F.col("p_size")
    values = F.create_map(*(c for name, v in (("a", F.floor(size / 10)), ("b", F.floor(size / 15)), ("c", F.floor(size / 20)), ("d", F.col("p_partkey") % 3)) for c in (F.lit(name), v.cast("double"))))
    return part.select("p_partkey", F.array_join(shapes.level_with(values, [("c", "d"), ("b", "c"), ("a", "b"), ("a", "d")], "a"), ",").alias("level"))
