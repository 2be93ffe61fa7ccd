"""Connected components of a graph given as a table of links, by alternating star contraction.

Each round replaces the links of a node by links to the smallest node that it knows; rounds grow with the logarithm
of the longest path. Minima are pre-aggregated before they are joined. Those of hubs (nodes of over HUB links, so at
most one in HUB of the links) are broadcast, so a hub's links stay where they are; the others are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import broadcast_if_small, materialise, small_enough

HUB = 256
#: Minima (24 bytes each) up to which they are broadcast.
MOST_MINIMA = 500_000


def _towards_least(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v), v and the least neighbour of u or u itself, as __m."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("__m"), F.count("*").alias("__n")), "minima")
    if small_enough(least, MOST_MINIMA):
        found = pairs.join(F.broadcast(least.drop("__n")), "u")
    else:
        hubs = broadcast_if_small(least.where(F.col("__n") > HUB).drop("__n"), MOST_MINIMA)
        others = least.where(F.col("__n") <= HUB).drop("__n")
        found = pairs.join(hubs, "u").unionByName(pairs.join(hubs, "u", "left_anti").join(others, "u"))
    return found.select("u", "v", F.least("u", "__m").alias("__m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links have u > v."""
    found = _towards_least(links)
    return found.where("v <> __m").select(F.col("v").alias("u"), F.col("__m").alias("v")).union(found.select("u", F.col("__m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root for each node that has a link: root is the smallest node of its component. Links of a node with
    itself or with null are ignored."""
    stars = links.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars = materialise(stars, "links")
    before = None
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        stars = materialise(_small_star(_large_star(stars)), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
