"""Versioned merges of keyed rows, conditional corrections, and differences."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def versioned_merge(old: DataFrame, new: DataFrame, keys: list[str], page: str | None = None, reread: DataFrame | None = None) -> DataFrame:
    """All rows with state: kept (old), fresh (new), history (old, replaced). Old rows are replaced where new has their
    keys (nulls are equal), or where their page is among those of reread. So no fresh row has the keys of a kept one."""
    columns = [*keys, *(c for c in old.columns if c not in (*keys, "__old"))]
    old, new = old.select(columns), new.select(columns)
    again = new.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct().withColumn("__again", F.lit(True))
    marked = old.join(again, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))), "left")
    gone = F.col("__again").isNotNull()
    if reread is not None:
        marked = marked.join(reread.select(F.col(page).alias("__page")).distinct().where("__page is not null"), F.col(page) == F.col("__page"), "left")
        gone = gone | F.col("__page").isNotNull()
    rows = marked.select(*columns, F.when(gone, "history").otherwise("kept").alias("state"))
    return rows.unionByName(new.withColumn("state", F.lit("fresh")))


def corrected(df: DataFrame, corrections: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """df with column set where corrections (key, old, new, and seq, their order) name the current value, and how many were
    applied (applied, done before included) and stale; and the corrections that are stale: of another value, or of no
    row. Corrections of a key take effect one after the other, so a second one sees the value that the first one left;
    applying all of them again changes nothing. Rows whose key repeats are corrected each."""
    steps = F.sort_array(F.collect_list(F.struct("seq", F.col("old").alias("was"), F.col("new").alias("is"))))
    fixes = corrections.where(F.col(key).isNotNull()).groupBy(key).agg(steps.alias("__steps"))
    start = F.struct(F.col(column).alias("value"), F.lit(0).alias("applied"), F.array().cast("array<int>").alias("stale"))

    def take(a: Column, f: Column) -> Column:
        done, fits = a["value"].eqNullSafe(f["is"]), a["value"].eqNullSafe(f["was"])
        return F.struct(F.when(fits, f["is"]).otherwise(a["value"]).alias("value"), (a["applied"] + (fits | done).cast("int")).alias("applied"), F.when(fits | done, a["stale"]).otherwise(F.array_append(a["stale"], f["seq"].cast("int"))).alias("stale"))

    made = df.join(fixes, key, "left").withColumn("__made", F.when(F.col("__steps").isNull(), start).otherwise(F.aggregate("__steps", start, take)))
    out = made.withColumn(column, F.col("__made.value")).withColumn("applied", F.col("__made.applied")).withColumn("stale", F.size("__made.stale"))
    missed = made.select(F.col(key).alias("__k"), F.explode("__made.stale").alias("__seq")).distinct()
    unknown = corrections.join(df.select(F.col(key)).distinct(), key, "left_anti")
    stale = corrections.join(missed, (F.col(key) == F.col("__k")) & (F.col("seq") == F.col("__seq")), "left_semi").unionByName(unknown)
    return out.select(*df.columns, "applied", "stale"), stale


def replaced(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """New rows, and the old ones whose scope no new row has (nulls are equal): replace by scope, by signature or by id."""
    keys = new.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(scope))).distinct()
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(scope)))
    return old.join(keys, on, "left_anti").unionByName(new)


def progress(done: Column, covered: Column, every: Column) -> tuple[Column, Column]:
    """Of all blocks in order those done before or covered now, and whether none is left."""
    both = F.array_union(F.coalesce(done, F.array().cast("array<string>")), F.coalesce(covered, F.array().cast("array<string>")))
    return F.filter(every, lambda b: F.array_contains(both, b)), F.size(F.array_except(every, both)) == 0


def changes(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, before and after of the values that differ, rows of one side included (keys are unique, nulls equal)."""
    a, b = old.select(*keys, F.col(column).alias("before"), F.lit(True).alias("__a")), new.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(column).alias("after"), F.lit(True).alias("__b"))
    joined = a.join(b, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))), "full_outer")
    differs = ~F.col("before").eqNullSafe(F.col("after")) | F.col("__a").isNull() | F.col("__b").isNull()
    return joined.where(differs).select(*(F.when(F.col("__a").isNull(), F.col(f"__k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)), "before", "after")


def gated(parts: list[DataFrame], key: str, passes: Column) -> DataFrame:
    """The union of several parts of one source (key), all rows or none: passes is an aggregate over the source."""
    rows = reduce(DataFrame.unionByName, parts)
    good = rows.groupBy(F.col(key).alias("__source")).agg(passes.alias("__good")).where("__good").select("__source")
    return rows.join(good, F.col(key).eqNullSafe(F.col("__source")), "left_semi")
