"""Queries of surfaces in a stack. Five components of an embedding stand for the elevations of five units at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import stacking
from strataflow.registry import query

UNITS = 5


def values(embeddings: DataFrame) -> DataFrame:
    units = F.array(*(F.struct(F.lit(f"u{i}").alias("unit"), F.when((F.col("vec_id") + i) % 7 != 0, F.get("embedding", i).cast("double")).alias("z"), (F.abs(F.get("embedding", i + 10).cast("double")) + 0.05).alias("std")) for i in range(UNITS)))
    return embeddings.select("vec_id", F.explode(units).alias("u")).select("vec_id", "u.*")


def chain(embeddings: DataFrame) -> DataFrame:
    return embeddings.sparkSession.createDataFrame([(f"u{i}", f"u{j}") for i in range(UNITS) for j in range(i + 1, UNITS)], "a string, b string")


#: In a chain a value is the least, over starts before it, of the greatest, over ends behind it, of the mean of the run.
_STACKED = f"""with v as (select vec_id, i, 'u' || i as unit, embedding[i + 1]::double as z, abs(embedding[i + 11]::double) + 0.05 as std from embeddings, range({UNITS}) r(i) where (vec_id + i) % 7 <> 0),
    n as (select *, row_number() over (partition by vec_id order by i) as k from v),
    runs as (select a.vec_id, a.k as lo, b.k as hi, sum(c.z / c.std ** 2) / sum(1 / c.std ** 2) as mean from n a join n b on a.vec_id = b.vec_id and a.k <= b.k join n c on c.vec_id = a.vec_id and c.k between a.k and b.k group by all),
    tops as (select n.vec_id, n.k, lo, max(mean) as most from n join runs r on r.vec_id = n.vec_id and lo <= n.k and hi >= n.k group by all),
    s as (select vec_id, k, min(most) as after from tops group by 1, 2),
    g as (select n.*, s.after, sum(case when lag_after - s.after > 1e-6 then 1 else 0 end) over (partition by n.vec_id order by n.k) as run from n join (select *, lag(after) over (partition by vec_id order by k) as lag_after from s) s using (vec_id, k))
    select vec_id, unit, round(after, 6) as z, round(case when abs(after - z) > 1e-9 then max(std) over (partition by vec_id, run) else std end, 6) as std, abs(after - z) > 1e-9 as adjusted from g"""


@query(_STACKED, "embeddings")
def stack_surfaces(embeddings: DataFrame) -> DataFrame:
    """Five surfaces moved least so that none lies above a younger one, with the uncertainty that they share then."""
    found = stacking.stacked(values(embeddings), chain(embeddings), "vec_id", "unit", "z", "std")
    return found.select("vec_id", "unit", F.round("z", 6).alias("z"), F.round("std", 6).alias("std"), "adjusted")


@query(
    f"""with v as (select vec_id, i, embedding[i + 1]::double as z from embeddings, range({UNITS}) r(i) where (vec_id + i) % 7 <> 0)
    select 'u' || a.i as a, 'u' || b.i as b, count(*) as places, count(*) filter (where b.z - a.z > 1e-6) as crossed_before, 0::bigint as crossed_after, round(greatest(max(b.z - a.z), 0), 6) as worst_before from v a join v b on a.vec_id = b.vec_id and a.i < b.i group by 1, 2""",
    "embeddings",
)
def stack_crossings(embeddings: DataFrame) -> DataFrame:
    """How often ordered surfaces cross, before and after they are stacked."""
    rows, pairs = values(embeddings), chain(embeddings)
    before = stacking.crossings(rows, pairs, "vec_id", "unit", "z")
    after = stacking.crossings(stacking.stacked(rows, pairs, "vec_id", "unit", "z", "std"), pairs, "vec_id", "unit", "z").select("a", "b", F.col("crossed").alias("crossed_after"))
    return before.join(after, ["a", "b"]).select("a", "b", "places", F.col("crossed").alias("crossed_before"), "crossed_after", F.round("worst", 6).alias("worst_before"))
