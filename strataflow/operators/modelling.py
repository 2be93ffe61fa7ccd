"""Points of contacts from logged holes, directions of continuity, and estimates with their limits.

Rows with a null key, place or value are left out. Points of a surface that coincide must be merged first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import geostat, sequences
from strataflow.operators.lineage import cut


def contact_points(holes: DataFrame, intervals: DataFrame, hole: str, unit: str, depth: str) -> DataFrame:
    """unit, x, y and z (land less depth) of the tops of buried units, and of the land surface of every hole.

    holes: hole, x, y, land (one elevation a hole) and reference; depths of a hole measured from something other than
    the land surface give no tops. Only the first appearance of a unit below another one counts."""
    placed = holes.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("land").isNotNull()).select(F.col(hole).alias("__h"), "x", "y", F.col("land").cast("double").alias("land"), F.coalesce(F.lower("reference"), F.lit("land surface")).alias("__ref"))
    rows = intervals.where(F.col(hole).isNotNull() & F.col(unit).isNotNull() & F.col(depth).isNotNull()).select(hole, F.lower(F.trim(unit)).alias("unit"), F.col(depth).cast("double").alias("__d"))
    tops = sequences.first_appearances(rows, hole, [F.col("__d"), F.col("unit")], "unit", "__d")
    found = tops.join(placed.where(F.col("__ref") == "land surface"), F.col(hole) == F.col("__h")).select("unit", "x", "y", (F.col("land") - F.col("__d")).alias("z"))
    return found.unionByName(placed.select(F.lit("land surface").alias("unit"), "x", "y", F.col("land").alias("z")))


def stretched(x: Column, y: Column, azimuth: Column, ratio: Column) -> tuple[Column, Column]:
    """Places in which continuity is alike in all directions: along the long axis (clockwise from north) distances are
    divided by ratio."""
    u, v = F.sin(F.radians(azimuth)), F.cos(F.radians(azimuth))
    return (x * u + y * v) / ratio, x * v - y * u


def anisotropy(points: DataFrame, key: str, name: str, x: str, y: str, z: str, azimuths: tuple[float, ...] = (0, 30, 60, 90, 120, 150), ratios: tuple[float, ...] = (1.0, 2.0, 4.0), drift: str = "constant", most: int = geostat.MOST) -> DataFrame:
    """key, azimuth, ratio, kind and rmse: the direction and ratio whose kriging without each point errs least; of equal
    ones the smaller ratio, then azimuth. Candidates are rows, so each surface and direction is a task of its own.
    Points of surfaces of over `most` points are kriged from their nearest ones (with a constant drift; with others such
    surfaces have no row)."""
    from strataflow.operators import kriging  # which needs this module

    tried = [(0.0, r) if r == 1 else (float(a), r) for r in ratios for a in (azimuths if r != 1 else (0,))]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("azimuth"), F.lit(float(r)).alias("ratio")) for a, r in tried)))
    rows = points.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(key, name, x, y, z, each.alias("c"))
    u, v = stretched(F.col(x), F.col(y), F.col("c.azimuth"), F.col("c.ratio"))
    candidate = F.struct(F.col(key).alias("key"), "c.azimuth", "c.ratio")
    parts = rows.select(candidate.alias("k")).schema["k"].dataType
    rows = rows.select(F.to_json(candidate).alias("k"), F.col(name).alias("i"), u.alias("u"), v.alias("v"), F.col(z).cast("double").alias("z"))
    # Arrow carries the names of each candidate's points as text.
    named = F.struct("k", "i")
    kind = rows.select(named.alias("p")).schema["p"].dataType
    rows = rows.withColumn("p", F.to_json(named))
    models = cut(geostat.fits(geostat.lags(rows, "k", "i", "u", "v", "z"), "k"))  # used three times
    many = rows.groupBy(F.col("k").alias("__k")).count().where(F.col("count") > most).select("__k")
    errors = geostat.kriging_loo(rows.join(many, F.col("k") == F.col("__k"), "left_anti"), models, "k", "p", "u", "v", "z", drift, most).where("reason is null")
    errors = errors.select(F.from_json("p", kind)["k"].alias("k"), "error")
    if drift == "constant":
        errors = errors.unionByName(kriging.passed(rows.join(many, F.col("k") == F.col("__k"), "left_semi"), models, "i", "k", "u", "v", "z").where("error is not null").select("k", "error"))
    scored = errors.groupBy("k").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")).join(models.select("k", "kind"), "k").withColumn("k", F.from_json("k", parts))
    best = F.min_by(F.struct("k.azimuth", "k.ratio", "kind", "rmse"), F.struct("rmse", "k.ratio", "k.azimuth"))
    return scored.groupBy(F.col("k.key").alias(key)).agg(best.alias("b")).select(key, "b.*")


def standing(nearest: Column, inside: Column, limit: Column, deviation: Column, factor: Column, least: float = 0.3) -> Column:
    """value_allowed, extrapolated, std and reason of an estimate: none beyond a limit from the nearest point; elsewhere
    the deviation times the factor that cross-validation gives, but never under least."""
    allowed = nearest <= limit + 1e-9
    return F.struct(allowed.alias("value_allowed"), (~inside).alias("extrapolated"), F.when(allowed, F.greatest(deviation * factor, F.lit(least))).alias("std"), F.when(~allowed, F.concat(F.lit("beyond "), F.round(limit).cast("bigint").cast("string"), F.lit(" from the nearest point"))).alias("reason"))


def calibration(msse: Column, low: float = 0.25, high: float = 4.0) -> Column:
    """The factor for standard deviations that a mean standardised squared error asks for, within bounds; 1 without one."""
    return F.when(msse > 0, F.sqrt(F.least(F.lit(high), F.greatest(F.lit(low), msse)))).otherwise(1.0)

