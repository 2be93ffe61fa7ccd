"""Links between records: nearest ancestor by prefix, replaced names, shared identifiers and conflicts between them.

Null keys link nothing. Repeated rows keep a row each, unless a function says that keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.names import name_key
from strataflow.operators import geostat
from strataflow.operators.lineage import cut


def prefix_ancestor(df: DataFrame, key: str, named: DataFrame, name: str, separator: str = "-") -> DataFrame:
    """df with ancestor: the name of the longest proper prefix of key (parts joined by the separator) among named (key,
    name; of repeated keys the least name). Prefixes are made, not compared: one equality join."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    parts = F.split(F.col(key), f"[{separator}]")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    prefixes = rows.select("__row", parts.alias("__parts"), F.explode(depths).alias("__depth")).select("__row", "__depth", F.array_join(F.slice("__parts", 1, F.col("__depth")), separator).alias("__prefix"))
    known = named.groupBy(F.col(key).alias("__prefix")).agg(F.min(name).alias("__name"))
    best = prefixes.join(known, "__prefix").groupBy("__row").agg(F.max_by("__name", "__depth").alias("ancestor"))
    return rows.join(best, "__row", "left").drop("__row")


def _jumped(links: DataFrame) -> DataFrame:
    """__n, __at and __open for links (__n, __at, at most one from each): where the links from __n end; __open: they lead
    round in a circle, and __at lies on it. Each round doubles how far every name has gone, so rounds are the logarithm
    of the longest chain, or, with circles, of the number of links."""
    state, far, links_left = cut(links.withColumn("__open", F.lit(True))), 1, None
    while True:
        there = state.select(F.col("__n").alias("__m"), F.col("__at").alias("__to"), F.col("__open").alias("__more"))
        moved = state.where("__open").join(there, F.col("__at") == F.col("__m"), "left")
        moved = moved.select("__n", F.coalesce("__to", "__at").alias("__at"), F.coalesce("__more", F.lit(False)).alias("__open"))
        state, far = cut(state.where("not __open").unionByName(moved)), 2 * far
        links_left = links_left or state.count()
        if far > links_left or state.where("__open").isEmpty():
            return state


def follow(entries: DataFrame, name: str, replaced_by: str) -> DataFrame:
    """entries with current: where the chain of replacements ends, of any length. A chain that meets itself ends at the
    name met again: the first one on the circle. A replacement that is no entry ends the chain before it. Names are
    unique; a null name has itself as current."""
    known = entries.select(F.col(name).alias("__k")).where("__k is not null").distinct()
    links = cut(entries.select(F.col(name).alias("__n"), F.col(replaced_by).alias("__at")).where("__n is not null").join(known, F.col("__at") == F.col("__k"), "left_semi"))
    ends = _jumped(links)
    circle = cut(ends.where("__open").select(F.col("__at").alias("__c")).distinct())
    if not circle.isEmpty():  # who goes round is where all that never end have come to; chains into a circle end there
        ends = _jumped(links.join(circle, F.col("__n") == F.col("__c"), "left_anti"))
    found = ends.select("__n", F.col("__at").alias("__end"))
    return entries.join(found, F.col(name) == F.col("__n"), "left").withColumn("current", F.coalesce("__end", F.col(name))).drop("__n", "__end")


def resolved(df: DataFrame, unit: str, lexicon: DataFrame) -> DataFrame:
    """df with entry, the current name in a lexicon (name, replaced_by) of the place that a unit's name holds, and
    canonical: the entry, else the place alone, else null. Case does not count in names; of several replacements the
    first counts; of entries alike but for case the least name."""
    first = F.nullif(F.lower(F.trim(F.get(F.split("replaced_by", r"\s+(?:and|or)\s+|,"), 0))), F.lit(""))
    entries = lexicon.where("name is not null").groupBy(F.lower("name").alias("__key")).agg(F.min_by(F.struct("name", first.alias("next")), "name").alias("e")).select("__key", F.col("e.name").alias("__name"), F.col("e.next").alias("__next"))
    ends = follow(entries, "__key", "__next").select(F.col("__key").alias("__from"), F.col("current").alias("__to"))
    names = ends.join(entries.select(F.col("__key").alias("__k"), F.col("__name").alias("entry")), F.col("__to") == F.col("__k")).select("__from", "entry")
    keyed = df.withColumn("__place", name_key(F.col(unit))["name"])
    return keyed.join(names, F.col("__place") == F.col("__from"), "left").withColumn("canonical", F.coalesce("entry", "__place")).drop("__place", "__from")


def shared(left: DataFrame, right: DataFrame, keys: Column, left_id: str, right_id: str) -> DataFrame:
    """Distinct pairs of ids that share one of their keys (an array made from each side's columns)."""
    a = left.select(F.col(left_id).alias("__a"), F.explode(keys).alias("__key"))
    b = right.select(F.col(right_id).alias("__b"), F.explode(keys).alias("__key"))
    return a.join(b, "__key").select(F.col("__a").alias(left_id), F.col("__b").alias(right_id)).distinct()


def conflicts(places: DataFrame, key: str, x: str, y: str, limit: float) -> DataFrame:
    """key, n, apart (the largest distance between places of a key) and conflict (apart is over the limit). The farthest
    two places are corners of the key's hull, which is made in two steps, so a hot key shrinks before the shuffle."""
    there = places.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = there.groupBy(key).agg(F.count("*").alias("n"))
    far = geostat.spread(there, key, x, y).withColumnRenamed(key, "__key")
    found = counts.join(far, F.col(key) == F.col("__key"), "left").withColumn("apart", F.coalesce("apart", F.lit(0.0)))
    return found.select(key, "n", "apart", (F.col("apart") > limit).alias("conflict"))
