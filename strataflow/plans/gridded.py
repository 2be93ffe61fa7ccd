"""Queries of estimates on grids. Embeddings stand for points of ten surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import kriging, natural
from strataflow.plans.space import _POINTS, points
from strataflow.registry import query

#: Nodes a side of a surface's grid, and points a node is estimated from.
SIDE, NEAR = 5, 6


def nodes(p: DataFrame) -> DataFrame:
    ends = p.groupBy("label").agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))
    rows = ends.withColumn("i", grid).withColumn("row", F.floor(F.col("i") / SIDE)).withColumn("column", F.col("i") % SIDE)
    at = lambda low, high, step: F.col(low) + (F.col(high) - F.col(low)) * F.col(step) / (SIDE - 1)
    return rows.select((F.col("label") * 1000 + F.col("i")).cast("long").alias("node"), "label", at("w", "e", "column").alias("x"), at("s", "n", "row").alias("y"))


def models(p: DataFrame) -> DataFrame:
    """A model of each surface from its extent and variance."""
    v = F.var_pop("z")
    return p.groupBy("label").agg(F.lit("exponential").alias("kind"), ((F.max("x") - F.min("x")) / 2).alias("range"), (v * 0.1).alias("nugget"), (v * 0.9).alias("sill"))


def _oracle() -> str:
    """Elimination of the systems of NEAR points, column by column."""
    m = NEAR + 1
    cov = lambda d: f"case when {d} <= 1e-9 then nugget + sill else sill * exp(-3 * ({d}) / range) end"
    first = []
    for i in range(m):
        for j in range(m):
            v = "0.0" if i == j == NEAR else "1.0" if NEAR in (i, j) else cov(f"sqrt((px[{i + 1}] - px[{j + 1}]) ** 2 + (py[{i + 1}] - py[{j + 1}]) ** 2)") + (" + 1e-10 * (nugget + sill)" if i == j else "")
            first.append(f"({v})::double as a{i}_{j}")
        first.append(f"({'1.0' if i == NEAR else cov(f'pd[{i + 1}]')})::double as a{i}_{m}")
    steps = [f"e0 as (select node, nugget + sill as total, pz, pd, {', '.join(first)}, {', '.join(f'a{i}_{m} as b{i}' for i in range(m))} from packed)"]
    for k in range(m):
        made = [f"a{k}_{j} / a{k}_{k} as a{k}_{j}" for j in range(k + 1, m + 1)]
        made += [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} as a{i}_{j}" for i in range(m) if i != k for j in range(k + 1, m + 1)]
        steps.append(f"e{k + 1} as (select node, total, pz, pd, {', '.join(f'b{i}' for i in range(m))}, {', '.join(made)} from e{k})")
    value, used = " + ".join(f"a{i}_{m} * pz[{i + 1}]" for i in range(NEAR)), " + ".join(f"a{i}_{m} * b{i}" for i in range(m))
    return f"""with p as ({_POINTS}), m as (select label, (max(x) - min(x)) / 2 as range, var_pop(z) * 0.1 as nugget, var_pop(z) * 0.9 as sill, min(x) as w, max(x) as e, min(y) as s, max(y) as n from p group by 1),
    g as (select label * 1000 + i as node, label, range, nugget, sill, w + (e - w) * (i % {SIDE}) / {SIDE - 1} as gx, s + (n - s) * (i // {SIDE}) / {SIDE - 1} as gy from m, range({SIDE * SIDE}) r(i)),
    d as (select g.*, vec_id, x, y, z, sqrt((x - gx) ** 2 + (y - gy) ** 2) as d from g join p using (label)),
    r as (select * from d qualify row_number() over (partition by node order by d, vec_id) <= {NEAR}),
    packed as (select node, any_value(range) as range, any_value(nugget) as nugget, any_value(sill) as sill, list(x order by d, vec_id) as px, list(y order by d, vec_id) as py, list(z order by d, vec_id) as pz, list(d order by d, vec_id) as pd from r group by 1),
    {', '.join(steps)} select node, round({value}, 6) as value, round(greatest(total - ({used}), 0), 6) as variance, round(pd[1], 6) as nearest from e{m}"""


@query(_oracle().replace("b0 as b0", "b0"), "embeddings")
def kriging_grid(embeddings: DataFrame) -> DataFrame:
    """Each surface on a grid by kriging with the nearest points."""
    p = points(embeddings)
    found = kriging.predicted(nodes(p), p, models(p), "node", "label", "x", "y", "vec_id", "z", NEAR)
    return found.select("node", *(F.round(c, 6).alias(c) for c in ("value", "variance", "nearest")))


@query(None, "embeddings")
def natural_neighbours(embeddings: DataFrame) -> DataFrame:
    """Each point from its natural neighbours in its surface; tests hold it against cells counted out point by point."""
    p = points(embeddings)
    found = natural.estimated(p, p, "vec_id", "label", "x", "y", "vec_id", "z", others=True)
    return found.select("vec_id", F.round("value", 6).alias("value"), "n")
