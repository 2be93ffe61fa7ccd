"""Queries of contacts as points, directions of continuity, and limits of estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import modelling
from strataflow.plans.space import points
from strataflow.registry import query


@query(
    """with h as (select user_id, min(value) * 10 as land, case when user_id % 4 = 0 then 'datum' end as ref, user_id % 10 * 1.0::double as x, user_id // 10 * 1.0::double as y from events group by 1),
    i as (select user_id, event_type as unit, value as d, lag(event_type) over (partition by user_id order by value, event_type) as before, row_number() over (partition by user_id, event_type order by value) as n from events)
    select unit, x, y, round(land - d, 6) as z from i join h using (user_id) where n = 1 and d > 0 and before is distinct from unit and ref is null and before is not null union all select 'land surface', x, y, round(land, 6) from h""",
    "events",
)
def contact_tops(events: DataFrame) -> DataFrame:
    """Tops of buried units as points. Users stand for holes, values for depths, types for units."""
    key = F.col("user_id")
    holes = events.groupBy("user_id").agg((F.min("value") * 10).alias("land")).withColumn("reference", F.when(key % 4 == 0, "datum")).withColumn("x", (key % 10).cast("double")).withColumn("y", F.floor(key / 10).cast("double"))
    return modelling.contact_points(holes, events, "user_id", "event_type", "value").withColumn("z", F.round("z", 6))


@query(None, "embeddings")
def anisotropy_search(embeddings: DataFrame) -> DataFrame:
    """The direction and ratio of best continuity of each surface, by kriging without each point; tests hold it against a
    field of a known direction."""
    found = modelling.anisotropy(points(embeddings), "label", "vec_id", "x", "y", "z", (0, 45, 90, 135), (1.0, 2.0))
    return found.select("label", "azimuth", "ratio", F.round("rmse", 6).alias("rmse"))


@query(
    """with e as (select event_id, value / 10 as nearest, event_type = 'click' as inside, 2.0 + user_id % 5 as most, value / 100 as sd, (user_id % 7) * 1.0::double as msse from events)
    select event_id, nearest <= most + 1e-9 as value_allowed, not inside as extrapolated, case when nearest <= most + 1e-9 then greatest(sd * case when msse > 0 then sqrt(least(4, greatest(0.25, msse))) else 1 end, 0.3) end as std, case when nearest > most + 1e-9 then 'beyond ' || most::int || ' from the nearest point' end as reason from e""",
    "events",
)
def estimate_limits(events: DataFrame) -> DataFrame:
    """Where an estimate is allowed, and its calibrated deviation."""
    factor = modelling.calibration((F.col("user_id") % 7).cast("double"))
    found = modelling.standing(F.col("value") / 10, F.col("event_type") == "click", F.col("user_id") % 5 + F.lit(2.0), F.col("value") / 100, factor)
    return events.select("event_id", found.alias("s")).select("event_id", "s.*")
