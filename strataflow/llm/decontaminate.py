"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. Spark functions only.

Words are runs of letters and digits in lower case, shingles five words (a shorter item is one shingle of all its
words). An item leaks into a document if at least CONTAINMENT of its different shingles occur there.

Shingles are ordered by a hash, and an item's MinHash sketch is its smallest ones (bottom-k): of n shingles at most
n - ceil(0.8 n) may be missing from a document that holds the item, so the first n - ceil(0.8 n) + 1 must meet it in
one at least. Items are partitioned by size (powers of two); each partition has one length of signature, that of its
largest item, so no link is lost. Documents get no sketch of
their own: an item of 20 shingles in a document of 2,000 is one hundredth of it, so minima over the whole document
meet the item's too seldom. All of a document's shingles are looked up in the signatures, never in other documents,
and a document with too few shingles for a partition is no candidate there. Candidates are then verified: all their
item's shingles are counted in the document.

Null texts hold no words and give no rows; items without words are never found. Repeated rows of a document or item
give one row for each pair of ids (the largest containment among rows with one id); a null id is an id like any other,
but an item of null id is never found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import broadcast_if_small, materialise

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows of signatures and of item shingles (16 to 24 bytes each), and ids of documents, up to which they are broadcast.
MOST_SHINGLES, MOST_IDS = 2_000_000, 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingles(tokens: Column, width: int) -> Column:
    """Hashes of all runs of so many tokens, in order, with repeats; none if there are fewer tokens."""
    n = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.lit(width), *(F.get(tokens, i + k) for k in range(width))))
    return F.when(n >= width, grams).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, width: int = SHINGLE) -> DataFrame:
    """item_id, width, h (one row a different shingle) and n (how many the item has)."""
    rows = items.select("item_id", words(F.col("text")).alias("w"))
    hashed = shingles(F.col("w"), width)
    for k in range(1, width):
        hashed = F.when(F.size("w") == k, shingles(F.col("w"), k)).otherwise(hashed)
    rows = rows.select("item_id", F.least(F.size("w"), F.lit(width)).alias("width"), F.explode_outer(hashed).alias("h")).where("h is not null").distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    return rows.join(sizes, "item_id")


def _need(n: Column, least: float) -> Column:
    """The fewest of n shingles that make the containment."""
    return F.ceil(n * least - 1e-9)


def signatures(shingled: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """item_id, h and need: the smallest shingles of each item, as many as its size partition takes."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    ranked = shingled.withColumn("__rank", rank).where(F.col("__rank") <= largest - _need(largest, least) + 1)
    return ranked.select("item_id", "h", _need(F.col("n"), least).alias("need"))


def _document_shingles(docs: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """The kept columns, h and n_grams (how many there are, with repeats) for shingles of each width."""
    tokens = docs.select(*keep, words(F.col("text")).alias("w"))
    each = [tokens.select(*keep, shingles(F.col("w"), k).alias("hs")) for k in widths]
    rows = reduce(DataFrame.unionAll, each)
    # The outer form: from the inner one Spark infers a filter that would make the words anew for each shingle.
    return rows.select(*keep, F.size("hs").alias("n_grams"), F.explode_outer("hs").alias("h")).where("h is not null")


def leaking_rows(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, __row (a digest of the text), item_id, n_shingles (of the item) and n_found for each pair that reaches
    the containment."""
    shingled = materialise(item_shingles(items.select("item_id", "text"), width), "item-shingles")
    widths = sorted(x.width for x in shingled.select("width").distinct().collect()) or [width]  # five at most
    source = docs.select("doc_id", "text")
    hits = _document_shingles(source, widths, "doc_id").join(broadcast_if_small(signatures(shingled, least), MOST_SHINGLES), "h")
    candidates = materialise(hits.where("n_grams >= need").select("doc_id", "item_id").distinct(), "candidates")
    ids = broadcast_if_small(candidates.select(F.col("doc_id").alias("__id")).distinct(), MOST_IDS)
    again = source.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").withColumn("__row", F.xxhash64("text"))
    found = _document_shingles(again, widths, "doc_id", "__row").join(broadcast_if_small(shingled.drop("width"), MOST_SHINGLES), "h")
    counted = found.groupBy("doc_id", "__row", "item_id").agg(F.first("n").alias("n_shingles"), F.countDistinct("h").alias("n_found"))
    counted = counted.where(F.col("n_found") >= _need(F.col("n_shingles"), least))
    searched = candidates.select(F.col("doc_id").alias("__d"), F.col("item_id").alias("__i"))
    return counted.join(searched, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("item_id").eqNullSafe(F.col("__i")), "left_semi")


def leaks(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found and containment for each pair that reaches it."""
    best = leaking_rows(docs, items, least, width).groupBy("doc_id", "item_id").agg(F.first("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item. Rows that share an id are judged each by its text."""
    found = leaking_rows(docs, items).select(F.col("doc_id").alias("__leaked"), F.col("__row").alias("__text")).distinct()
    gone = broadcast_if_small(materialise(found, "leaked"), MOST_IDS)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__leaked")) & (F.xxhash64("text") == F.col("__text")), "left_anti")


def query(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    found = leaks(docs, items)
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long"), F.col("n_found").cast("long"), F.round("containment", 6).alias("containment"))
