"""What to read, read again, carry on or leave out: inclusion with reasons, samples, queues, counters of what is dropped.

Null keys match nothing, unless a function says that nulls are equal. Repeated rows keep a row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def included(df: DataFrame, extra: DataFrame, key: str, kinds: list[tuple[Column, str]], skips: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of which a rule tells a kind, and those of extra (key, kind) whose key has none yet, with the row's columns where
    df has it; and skip, the reason of the first rule that holds. Keys of df are unique; of a key repeated in extra the
    least kind counts."""
    kind = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), kinds[1:], F.when(kinds[0][0], F.lit(kinds[0][1])))
    more = extra.groupBy(key).agg(F.min("kind").alias("__more"))
    rows = df.withColumn("__own", kind).join(more, key, "full_outer").withColumn("kind", F.coalesce("__own", "__more")).where("kind is not null")
    skip = reduce(lambda acc, r: acc.when(*r), skips[1:], F.when(*skips[0]))
    return rows.withColumn("skip", skip).drop("__own", "__more")


def share(key: Column, seed: str, fraction: float) -> Column:
    """Whether a row is in a random share that its key alone decides: the same rows at every run, without a shuffle."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(drawn < int(fraction * (1 << 32)), F.lit(False))


def to_verify(df: DataFrame, must: Column, key: Column, seed: str, fraction: float) -> DataFrame:
    """Rows that must be read a second time, and a share of the others."""
    return df.where(F.coalesce(must, F.lit(False)) | share(key, seed, fraction))


def carried(old: DataFrame, visited: DataFrame, fresh: DataFrame, key: str, excluded: DataFrame | None = None) -> DataFrame:
    """A list after a run: the fresh rows, and the old ones that the run did not visit, unless excluded."""
    kept = old.join(visited.select(key).distinct(), key, "left_anti")
    if excluded is not None:
        kept = kept.join(excluded.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh)


def queue(sources: list[tuple[str, DataFrame]], covered: DataFrame, key: str, pages: str) -> DataFrame:
    """Items (key, pages: an array) of several origins as one queue: key, origin, pages and status. Of an item that
    several origins have the first one's stays. covered (key, pages, at) is what was done since: an item is done, at the
    latest time, once its pages are all covered. Items without pages are done at once."""
    rows = reduce(DataFrame.unionByName, (df.select(key, F.col(pages).alias("pages"), F.lit(i).alias("__i"), F.lit(name).alias("origin")) for i, (name, df) in enumerate(sources)))
    best = rows.groupBy(key).agg(F.min(F.struct("__i", "origin", "pages")).alias("__b")).select(key, "__b.origin", "__b.pages")
    # Pages of an item are distinct before they are gathered, so the set is bounded by the item's document.
    seen = covered.select(key, F.explode(F.col(pages)).alias("__page"), "at").groupBy(key).agg(F.collect_set("__page").alias("__seen"), F.max("at").alias("__at"))
    joined = best.join(seen, key, "left")
    done = F.size(F.array_except("pages", F.coalesce("__seen", F.slice("pages", 1, 0)))) == 0
    return joined.select(key, "origin", "pages", F.when(done, "done").otherwise("pending").alias("status"), F.when(done, F.col("__at")).alias("done_at"))


def judged(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """The rows that no rule drops, and the dropped ones with reason, the first rule that holds."""
    reason = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def crossings(values: DataFrame, place: list[str], unit: str, pairs: list[tuple[str, str]], before: str, after: str, least: float = 1e-6) -> DataFrame:
    """younger, older, nodes and how many places cross, before and after stacking, with the worst crossing. values holds
    a row per place and unit (units are few); a place counts for a pair where it has both values. One aggregation gives
    each place its values; no pairs of rows are made."""
    names = sorted({u for p in pairs for u in p})
    at = lambda c, u: F.max(F.when(F.col(unit) == u, F.col(c)))
    wide = values.groupBy(*place).agg(*(at(c, u).alias(f"__{k}{i}") for i, u in enumerate(names) for k, c in (("b", before), ("a", after))))
    def gap(k: str, younger: str, older: str) -> Column:
        return F.col(f"__{k}{names.index(older)}") - F.col(f"__{k}{names.index(younger)}")

    each = F.explode(F.array(*(F.struct(F.lit(y).alias("younger"), F.lit(o).alias("older"), gap("b", y, o).alias("b"), gap("a", y, o).alias("a")) for y, o in pairs)))
    rows = wide.select(each.alias("p")).select("p.*").where("a is not null and b is not null")
    worst = lambda c: F.greatest(F.max(F.when(F.col(c) > least, F.col(c))), F.lit(0.0))
    return rows.groupBy("younger", "older").agg(F.count("*").alias("nodes"), F.count_if(F.col("b") > least).alias("crossed_before"), F.count_if(F.col("a") > least).alias("crossed_after"), worst("b").alias("worst_before"), worst("a").alias("worst_after"))
