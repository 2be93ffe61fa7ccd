"""Links between texts whose sets of word shingles have a Jaccard similarity of at least SIMILARITY.

MinHash bands propose, exact sets decide. A pair of similarity 0.8 shares one of BANDS bands of ROWS minima with
probability 1 - (1 - 0.8 ** 6) ** 24 > 0.999. Texts with equal sets are one node, so copies are never paired.

Buckets of at most BUCKET nodes are paired; a larger one never is as a whole. In each round some of its members lead,
and every member in another component is compared with them; links join components, and a bucket is closed once it
lies in one component or each member outside its largest component has led. LEADERS says how many lead in a round. No
bucket is capped. What a round makes are links that join components, so they grow with the members.

A pair is compared by parities before exact sets are made: each node keeps, for MARKS * 64 bins, whether an odd number
of its shingles fall there. Sets that differ in d shingles differ in at most d bins, so the filter loses no pair; it
runs inside the join of a large bucket. Exact sets are made only for texts of pairs that pass.

Words are runs of other characters than space and \\t to \\r, A-Z in lower case. Texts with fewer words than a shingle are
one shingle; texts without words (null, empty) have no bands and no links.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import ascii_lower, broadcast_if_small, materialise
from strataflow.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Nodes of a bucket up to which all its pairs are compared.
BUCKET = 8
#: Leaders of a larger bucket by round; the last number holds on.
LEADERS = (1, 16, 512)
#: Numbers of 64 parities each.
MARKS = 8
#: Leaders, and nodes of pairs (120 bytes each), up to which they are broadcast.
MOST_LEADERS = 100_000
#: Keys of shared buckets (16 bytes each) up to which they are broadcast.
MOST_KEYS = 1_000_000
#: Shingles (8 bytes each) of the texts of a round's pairs up to which their sets are broadcast.
MOST_SHINGLES = 2_000_000
SEED = 7
#: Nodes (40 bytes each) up to which they are broadcast to the scan of the texts.
MOST_NODES = 500_000
_RANDOM = np.random.default_rng(SEED)
MULTIPLY = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32)
PLACES = _RANDOM.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
BAND = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A mixing permutation of 64-bit numbers. Those of the finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(grams: np.ndarray) -> np.ndarray:
    """The sorted different hashes of a text's five-word shingles, from the hashes of its three-word ones in order: the
    first and the third of three neighbours hold the five words. Texts of fewer words have one."""
    if len(grams) < 3:
        return np.full(min(1, len(grams)), _mixed(grams * PLACES[: len(grams)]).sum(dtype=np.uint64))
    return np.unique(_mixed(grams[:-2] * PLACES[0] + grams[2:] * PLACES[1]))


def sketch(grams: np.ndarray) -> tuple[int, int, list[int], list[int]]:
    """A digest of the shingle set, its size, a hash for each band, and the parities of the set's bins, 64 to a number
    (no bands without words)."""
    found = shingle_set(grams)
    digest = xxhash.xxh64_intdigest(found.tobytes())
    odd = np.bincount((found & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    marks = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    if not len(found):
        return digest, 0, [], marks
    high = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 512):  # memory does not follow the longest text
        moved = MULTIPLY[:, None] * high[None, at : at + 512]
        moved += ADD[:, None]
        np.minimum(least, moved.min(1), out=least)
    mixed = _mixed(least.astype(np.uint64))
    bands = _mixed((mixed.reshape(BANDS, ROWS) * BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return digest, len(found), bands.view(np.int64).tolist(), marks


FLAT = [f"h{i}" for i in range(MARKS)]


def plausible(a: str, b: str, least: float = SIMILARITY) -> Column:
    """Whether sizes n and parities of two nodes allow the similarity; true for every pair that reaches it."""
    differing = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.{h}").bitwiseXOR(F.col(f"{b}.{h}"))) for h in FLAT))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) >= least * F.greatest(n, m)) & (differing * (1 + least) <= (1 - least) * (n + m) + 1e-6)


def sets(text: Column, width: int = SHINGLE) -> Column:
    """The different shingles of a text as hashes."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\v\f\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    # Bound once: the lambda's argument keeps the words from being split again for each shingle.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.array_distinct(grams(w))).otherwise(F.array(F.xxhash64(F.array_join(w, " ")))))
    return F.get(made, 0)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts reach the similarity. nodes: s, __id and __digest of one text each.
    Only texts in pairs are read again; their sets, not the texts, are broadcast if they are small and else shuffled."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    chosen = broadcast_if_small(materialise(nodes.join(broadcast_if_small(named, MOST_NODES), "s", "left_semi"), "named"), MOST_NODES)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t"))
    again = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__digest")))
    made = materialise(again.select("s", sets(F.col("text"), width).alias("g")), "shingle-sets")
    texts, different, shingles = made.agg(F.count("*"), F.count_distinct("s"), F.coalesce(F.sum(F.size("g")), F.lit(0))).first()
    if texts > different:  # repeated rows
        made = made.dropDuplicates(["s"])
    side = F.broadcast if shingles <= MOST_SHINGLES else (lambda df: df)
    left, right = (side(made.select(F.col("s").alias(s), F.col("g").alias(g))) for s, g in (("a", "ga"), ("b", "gb")))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(right, "b").join(left, "a").where(both * (1 + least) >= least * (F.size("ga") + F.size("gb")) - 1e-6).select("a", "b")


def compared(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those that sizes and parities allow. Only marks of nodes in pairs are moved."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    chosen = broadcast_if_small(materialise(marks.join(broadcast_if_small(materialise(named, "paired"), MOST_NODES), "s", "left_semi"), "paired-marks"), MOST_LEADERS)
    x, y = chosen.alias("x"), chosen.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.s")).join(y, F.col("b") == F.col("y.s"))
    return both.where(plausible("x", "y", least)).select("a", "b")


def groups(nodes: DataFrame, docs: DataFrame, known: DataFrame, width: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """node and root (the smallest node of its group) for each node that has a link, where links are those known and
    those of nodes whose texts are similar. nodes: s, n (size of the set), bands, marks, __id and __digest, one row
    each; known: links (a, b)."""
    banded = nodes.select("s", F.explode("bands").alias("key"))
    shared = broadcast_if_small(materialise(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared-bands"), MOST_KEYS)
    placed = materialise(banded.join(shared, "key"), "bands")
    marks = nodes.select("s", "n", *(F.get("marks", F.lit(i)).alias(h) for i, h in enumerate(FLAT)))
    texts = nodes.select("s", "__id", "__digest")
    few = placed.where(F.col("m") <= BUCKET).select("key", "s")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.s") < F.col("y.s")))
    pairs = materialise(pairs.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct(), "close-pairs")
    close = verified(materialise(compared(pairs, marks, least), "pairs"), texts, docs, width, least)
    roots, led = components(materialise(known.union(close), "known-links"), "a", "b"), None
    rows = materialise(placed.where(F.col("m") > BUCKET).select("key", "s").join(marks, "s"), "large-bands")
    if rows.isEmpty():
        return roots
    for leaders in chain(LEADERS, repeat(LEADERS[-1])):
        rooted = rows.join(broadcast_if_small(roots.withColumnRenamed("node", "s"), MOST_NODES), "s", "left").withColumn("root", F.coalesce("root", "s"))
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("m", "root")).alias("main"))
        split = broadcast_if_small(materialise(sizes.where("parts > 1").select("key", "main"), "split-bands"), MOST_KEYS)
        rows = materialise(rooted.join(split, "key").select("key", "s", "n", *FLAT, "root", "main"), "open-bands")
        pool = rows.where("root <> main")
        if led is not None:
            pool = pool.join(broadcast_if_small(led, MOST_LEADERS), ["key", "s"], "left_anti")
        # Spark limits each bucket before the shuffle too, so a large bucket is not sorted in one task.
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("s"), "s"))
        lead = materialise(pool.select("key", "s", "n", *FLAT, "root", place.alias("__p")).where(F.col("__p") <= leaders).drop("__p"), "leaders")
        if lead.isEmpty():
            return roots
        x, y = rows.alias("x"), broadcast_if_small(lead, MOST_LEADERS).alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & plausible("x", "y", least))
        pairs = materialise(pairs.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct(), "pairs")
        found = materialise(verified(pairs, texts, docs, width, least), "found-links")
        if not found.isEmpty():
            roots = components(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
        if lead.count() == pool.count():  # all have led
            return roots
        done = lead.select("key", "s")
        led = materialise(done if led is None else led.union(done), "led")
        rows = rows.select("key", "s", "n", *FLAT)
