"""Queries of boxes, points, grids, projections and links between records. Embeddings stand for points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import geodesy
from strataflow.operators import links, nearest, spatial
from strataflow.registry import query

#: A ring with a notch, and a conformal conic zone, used on both sides.
RING = [(-0.2, -0.2), (0.25, -0.15), (0.2, 0.2), (0.0, 0.02), (-0.15, 0.25)]
ZONE = (-81.0, 31.5, 32.5, 34.8)
_POINTS = "select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings"
_BOXES = f"select vec_id, label, x - 0.02 as w, y - 0.02 as s, x + 0.02 as e, y + 0.02 as n from ({_POINTS})"


def points(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")))


def boxes(embeddings: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(embeddings).select("vec_id", "label", (x - 0.02).alias("w"), (y - 0.02).alias("s"), (x + 0.02).alias("e"), (y + 0.02).alias("n"))


@query(
    f"""with g as (select label, round(min(x), 5) as w, round(min(y), 5) as s, round(max(x), 5) as e, round(max(y), 5) as n from ({_POINTS}) group by 1)
    select label, w, s, e, n, case when w > 0.35 or e < -0.35 or s > 0.35 or n < -0.35 then 'outside' when w >= -0.35 and s >= -0.35 and e <= 0.35 and n <= 0.35 then 'ok' else 'larger' end as class from g""",
    "embeddings",
)
def extent_check(embeddings: DataFrame) -> DataFrame:
    """Extents of groups against a box with a margin."""
    found = points(embeddings).groupBy("label").agg(*(F.round(f(c), 5).alias(a) for f, c, a in ((F.min, "x", "w"), (F.min, "y", "s"), (F.max, "x", "e"), (F.max, "y", "n"))))
    box = tuple(F.lit(v) for v in (-0.3, -0.3, 0.3, 0.3))
    margin = 0.04999999999999999  # 0.35 - 0.3, so that the sums are those of the SQL
    return found.withColumn("class", geodesy.extent_class(tuple(F.col(c) for c in "wsen"), box, margin))


@query(
    f"""with b as ({_BOXES}), p as (select a.vec_id, c.label as other, c.vec_id as other_id, ((least(a.e, c.e) - greatest(a.w, c.w)) * (least(a.n, c.n) - greatest(a.s, c.s))) / ((a.e - a.w) * (a.n - a.s)) as share
      from b a join b c on a.label <> c.label and a.w < c.e and c.w < a.e and a.s < c.n and c.s < a.n),
    r as (select *, row_number() over (partition by vec_id order by round(share, 9) desc, other_id) as k from p where share > 0.01)
    select vec_id, count(*) as n, count(distinct other) as sources, round(sum(share), 6) as covered, string_agg(other_id::varchar, ',' order by k) filter (where k <= 5) as top from r group by 1""",
    "embeddings",
)
def box_overlay(embeddings: DataFrame) -> DataFrame:
    """Boxes of other sources under each box: shares over one percent, the five largest."""
    found = spatial.overlays(boxes(embeddings), "vec_id", "label", ("w", "s", "e", "n"), 0.08)
    return found.select("vec_id", "n", "sources", F.round("covered", 6).alias("covered"), F.array_join(F.transform("top", lambda i: i.cast("string")), ",").alias("top"))


@query(
    f"""with p as ({_POINTS}), r as (select label as ref, min(x) / 2 as w, min(y) / 2 as s, max(x) / 2 as e, max(y) / 2 as n, count(*) as year from p group by 1),
    j as (select vec_id, ref, row_number() over (partition by vec_id order by case when e - w <= 0.3 then 0 else 1 end, year desc, ref) as k from p join r on x between w and e and y between s and n)
    select vec_id, count(*) as n, string_agg(ref::varchar, ',' order by k) filter (where k <= 4) as refs from j group by 1""",
    "embeddings",
)
def covering_refs(embeddings: DataFrame) -> DataFrame:
    """Boxes that hold a point, ranked, the first four."""
    p = points(embeddings)
    refs = p.groupBy(F.col("label").alias("ref")).agg((F.min("x") / 2).alias("w"), (F.min("y") / 2).alias("s"), (F.max("x") / 2).alias("e"), (F.max("y") / 2).alias("n"), F.count("*").alias("year"))
    rank = F.struct(F.when(F.col("e") - F.col("w") <= 0.3, 0).otherwise(1).alias("wide"), (-F.col("year")).alias("age"), F.col("ref"))
    found = spatial.covering(p.select("vec_id", "x", "y"), refs, "x", "y", ("w", "s", "e", "n"), 0.1)
    first = F.slice(F.sort_array(F.collect_list(rank)), 1, 4)
    return found.groupBy("vec_id").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda r: r["ref"].cast("string")), ",").alias("refs"))


def _edges() -> str:
    made = []
    for (px, py), (qx, qy) in zip(RING, [*RING[1:], RING[0]], strict=True):
        made.append(f"case when ({py} > y) <> ({qy} > y) and x < ({qx}::double - ({px}::double)) * (y - ({py}::double)) / ({qy}::double - ({py}::double)) + ({px}::double) then 1 else 0 end")
    return " + ".join(made)


_AREA = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(RING, [*RING[1:], RING[0]], strict=True)) / 2


@query(f"select vec_id, ({_edges()}) % 2 = 1 as inside, round({_AREA}::double, 9) as area from ({_POINTS})", "embeddings")
def polygon_hof(embeddings: DataFrame) -> DataFrame:
    """Points in a ring by the even-odd rule, and the ring's area."""
    ring = geodesy.ring(RING)
    return points(embeddings).select("vec_id", geodesy.inside(ring, F.col("x"), F.col("y")).alias("inside"), F.round(geodesy.signed_area(ring), 9).alias("area"))


@query(
    f"""with f as (select vec_id, (x + 0.25) / 0.0625 as fx, (0.25 - y) / 0.0625 as fy from ({_POINTS})), g as (select vec_id, fx, fy, least(floor(fx), 7) as c, least(floor(fy), 7) as r from f),
    v as (select vec_id, case when fx between 0 and 8 and fy between 0 and 8 then 1 end as inside, fx - c as tx, fy - r as ty, r * r + 3 * c as a, r * r + 3 * (c + 1) as b, (r + 1) * (r + 1) + 3 * c as d, (r + 1) * (r + 1) + 3 * (c + 1) as e, c, r from g)
    select vec_id, case when inside = 1 and not (c in (1, 2) and r in (4, 5)) then round((a * (1 - tx) + b * tx) * (1 - ty) + (d * (1 - tx) + e * tx) * ty, 6) end as shift from v""",
    "embeddings",
)
def bilinear_lookup(embeddings: DataFrame) -> DataFrame:
    """Bilinear values of a grid at points; none outside and beside a missing value."""
    numbers = embeddings.sparkSession.range(81).select(F.floor(F.col("id") / 9).cast("int").alias("r"), (F.col("id") % 9).cast("int").alias("c"))
    grid = numbers.withColumn("v", F.when((F.col("r") == 5) & (F.col("c") == 2), -9999.0).otherwise((F.col("r") * F.col("r") + 3 * F.col("c")).cast("double")))
    found = spatial.bilinear(points(embeddings).select("vec_id", "x", "y"), grid, "x", "y", -0.25, 0.25, 0.0625, 9, 9, -9999.0)
    return found.select("vec_id", F.round("shift", 6).alias("shift"))


@query(
    f"""with t as (select vec_id, floor((x * 200 + 180) / 360 * 64)::bigint as tx, floor((1 - ln(tan(radians(y * 150)) + 1 / cos(radians(y * 150))) / pi()) / 2 * 64)::bigint as ty from ({_POINTS}))
    select tx, ty, count(*) as n, min(vec_id) as first_id from t group by all""",
    "embeddings",
)
def tile_dedupe(embeddings: DataFrame) -> DataFrame:
    """Features that come with several overlapping tiles, each kept once, counted by web map tile."""
    tx, ty = geodesy.tile(F.col("x") * 200, F.col("y") * 150, 6)
    own = points(embeddings).select("vec_id", tx.alias("tx"), ty.alias("ty"))
    fetched = own.select("vec_id", "tx", "ty", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("tile"))
    once = spatial.first_of_tiles(fetched, ["vec_id"], [F.col("tile")])
    return once.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query(
    f"""with c as (select round(x, 1) as x, round(y, 1) as y, avg(z) as z, count(*) as n, string_agg(vec_id::varchar, ',' order by vec_id) as refs from ({_POINTS}) group by 1, 2)
    select round(x, 1) + 0.0 as x, round(y, 1) + 0.0 as y, round(z, 6) as z, n, refs from c""",
    "embeddings",
)
def merge_coincident(embeddings: DataFrame) -> DataFrame:
    """Points of one place as one, with their mean and references."""
    found = spatial.coincident(points(embeddings), "x", "y", "z", "vec_id", 1)
    return found.select((F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"), F.round("z", 6).alias("z"), "n", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


def _lcc_sql() -> str:
    lon0, lat0, lat1, lat2 = ZONE
    e = math.sqrt(geodesy.E2)
    rad = math.radians
    m = lambda p: math.cos(rad(p)) / math.sqrt(1 - geodesy.E2 * math.sin(rad(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - rad(p) / 2) * ((1 + e * math.sin(rad(p))) / (1 - e * math.sin(rad(p)))) ** (e / 2)
    n = (math.log(m(lat1)) - math.log(m(lat2))) / (math.log(t(lat1)) - math.log(t(lat2)))
    big = geodesy.A * m(lat1) / (n * t(lat1) ** n)
    return f"""with d as (select vec_id, -81 + x * 5 as lon, 33 + y * 4 as lat from ({_POINTS})),
    r as (select vec_id, {big!r} * pow(tan(pi() / 4 - radians(lat) / 2) * pow((1 + {e!r} * sin(radians(lat))) / (1 - {e!r} * sin(radians(lat))), {e / 2!r}), {n!r}) as rho, {n!r} * radians(lon - {lon0}) as theta, lon, lat from d)
    select vec_id, round(609600 + rho * sin(theta), 2) as east, round({big * t(lat0) ** n!r} - rho * cos(theta), 2) as north, true as back from r"""


@query(_lcc_sql(), "embeddings")
def lcc_forward(embeddings: DataFrame) -> DataFrame:
    """A conformal conic projection there and back."""
    lon, lat = F.lit(-81) + F.col("x") * 5, F.lit(33) + F.col("y") * 4
    east, north = geodesy.lcc(lon, lat, *ZONE, east=609600.0)
    rows = points(embeddings).select("vec_id", lon.alias("lon"), lat.alias("lat"), east.alias("east"), north.alias("north"))
    found = geodesy.lcc_inverse(F.col("east"), F.col("north"), *ZONE, east=609600.0)
    back = (F.abs(found[0] - F.col("lon")) < 1e-9) & (F.abs(found[1] - F.col("lat")) < 1e-9)
    rows = rows.withColumn("back", back)  # before other columns take these names
    return rows.select("vec_id", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), "back")


@query(
    f"""with d as (select vec_id, radians(x * 5) as lam, radians(33 + y * 4) as phi from ({_POINTS})), s as (select *, {geodesy.E2!r} as e2, {geodesy.E2 / (1 - geodesy.E2)!r} as ep2, {geodesy.A} / sqrt(1 - {geodesy.E2!r} * sin(phi) ** 2) as nu, tan(phi) ** 2 as t, {geodesy.E2 / (1 - geodesy.E2)!r} * cos(phi) ** 2 as c, lam * cos(phi) as a from d)
    select vec_id, round(500000 + 0.9996 * nu * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a ** 5 / 120), 2) as east,
      round(0.9996 * ({geodesy.A} * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) + nu * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a ** 6 / 720)), 2) as north from s""",
    "embeddings",
)
def transverse_mercator(embeddings: DataFrame) -> DataFrame:
    """A transverse Mercator projection."""
    east, north = geodesy.transverse_mercator(F.col("x") * 5, 33 + F.col("y") * 4, 0.0)
    return points(embeddings).select("vec_id", F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


@query(
    f"""with p as ({_POINTS}) select a.vec_id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) as nearest from p a left join p b on a.label = b.label and a.vec_id <> b.vec_id group by 1""",
    "embeddings",
)
def nearest_neighbour(embeddings: DataFrame) -> DataFrame:
    """The distance to the nearest point of the same surface, through a tree of cells."""
    p = points(embeddings)
    found = nearest.k_nearest(p, p, 1, "vec_id", "label", "x", "y", "vec_id", others=True)
    return p.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.round("distance", 6).alias("nearest"))


@query(
    """with k as (select p_partkey, p_size, p_name, p_partkey::varchar as d from part), x as (select k.p_partkey, n.p_name, length(n.d) as depth from k join k n on n.p_size > 20 and length(n.d) < length(k.d) and k.d[1:length(n.d)] = n.d)
    select k.p_partkey, arg_max(x.p_name, x.depth) as ancestor from k left join x using (p_partkey) group by 1""",
    "part",
)
def prefix_ancestor(part: DataFrame) -> DataFrame:
    """The nearest named ancestor in a hierarchy of keys."""
    keyed = part.select("p_partkey", "p_size", "p_name", F.regexp_replace(F.col("p_partkey").cast("string"), r"(?<=\d)(?=\d)", "-").alias("key"))
    found = links.prefix_ancestor(keyed.select("p_partkey", "key"), "key", keyed.where("p_size > 20").select("key", "p_name"), "p_name")
    return found.select("p_partkey", "ancestor")


@query(
    """with recursive e as (select n_nationkey as k, case when n_nationkey % 5 <> 0 then (n_nationkey * 7 + 3) % 25 end as nxt from nation),
    w as (select k, k as pos, [k] as seen, false as done from e union all select w.k, e2.nxt, list_append(w.seen, e2.nxt), list_contains(w.seen, e2.nxt) from w join e e2 on w.pos = e2.k where not w.done and e2.nxt is not null)
    select k as n_nationkey, arg_max(pos, len(seen)) as "current" from w group by 1""",
    "nation",
)
def alias_closure(nation: DataFrame) -> DataFrame:
    """Replaced names followed to the current one; chains that meet themselves end there."""
    k = F.col("n_nationkey")
    entries = nation.select("n_nationkey", F.when(k % 5 != 0, (k * 7 + 3) % 25).alias("next"))
    return links.follow(entries, "n_nationkey", "next").select("n_nationkey", "current")


@query(
    """with p as (select c_nationkey as k, c_acctbal as x, c_custkey % 100 as y from customer union all select s_nationkey, s_acctbal, s_suppkey % 100 from supplier), d as (select a.k, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as apart from p a join p b on a.k = b.k group by 1)
    select k as nation, (select count(*) from p where p.k = d.k) as n, apart > 9000 as conflict from d""",
    "customer",
    "supplier",
)
def id_link_conflicts(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Places that share a key and lie too far apart, from the extremes of each key alone."""
    places = customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).alias("y")).unionByName(supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 100).alias("y")))
    return links.conflicts(places, "nation", "x", "y", 9000.0).select("nation", "n", "conflict")
