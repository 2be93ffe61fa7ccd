"""Quality rules whose cutoffs are risk-controlled. Spark functions only.

Each rule compares one measure of a text with a cutoff. Per stratum (lang) and rule, labelled good documents form the
holdout: a candidate cutoff is admissible if the exact binomial (Clopper-Pearson) bound on the share of good documents
that it would reject stays within ALPHA, at level DELTA divided by the number of all tests (Bonferroni over strata,
rules and candidates). The strictest admissible cutoff is taken; a stratum without one, or without labels, has no
cutoff for that rule and rejects nothing by it. With the rules' shares of ALPHA added up, at most ALPHA of the good
documents of a stratum are rejected by the method, with probability 1 - DELTA for all strata together.

Null texts hold no words. A null lang is a stratum like any other. Rows of labels whose document is missing, or with
a null quality, are not used; repeated labels of one document count once. Repeated rows keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import broadcast_if_small, materialise

ALPHA, DELTA = 0.02, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Rows of strata and ids of labels up to which they are broadcast.
MOST_STRATA, MOST_LABELS = 10_000, 1_000_000
#: Rules: measure, and candidate cutoffs from strict to lax. A document is rejected if the measure is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_char": [0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "dup_lines_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "repeated_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "upper_share": [0.1, 0.2, 0.3, 0.5, 0.8],
}


def _windows(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


#: The low bits of a sortable key hold a window's place, the high ones those of its hash.
PLACE = (1 << 21) - 1


def _length_of_runs(places: Column) -> Column:
    """How many words the 3-word windows at these ascending places cover together."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def _covered(windows: Column, repeated: Column) -> Column:
    """How many words lie in windows that occur twice or more. repeated: the keys whose hash bits are not alone."""
    places = F.sort_array(F.transform(repeated, lambda k: k.bitwiseAND(F.lit(PLACE)).cast("int")))
    hashes = F.size(F.array_distinct(F.transform(repeated, lambda k: F.get(windows, k.bitwiseAND(F.lit(PLACE)).cast("int")))))
    prefixes = F.size(F.array_distinct(F.transform(repeated, lambda k: k.bitwiseAND(F.lit(~PLACE)))))
    # Hash bits that two different windows share, or more windows than places: whole hashes are sorted instead.
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(pairs, lambda x: x["h"]))
    after = F.concat(F.transform(F.slice(pairs, F.lit(2), F.size(pairs)), lambda x: x["h"]), F.array(F.lit(None).cast("bigint")))
    around = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    marked = F.zip_with(pairs, around, lambda x, y: F.when((x["h"] == y["b"]) | (x["h"] == y["a"]), x["i"]))
    exact = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    return F.when((F.size(windows) <= PLACE) & (hashes == prefixes), _length_of_runs(places)).otherwise(_length_of_runs(exact))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of each whole text, as bigints in one struct column __m."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Each step's arrays are made once a row; the next step refers to them.
    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    trimmed = F.btrim("__t", F.lit(" \t\n\v\f\r"))
    rows = rows.withColumn("__w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)))
    rows = rows.withColumn("__h", _windows(F.col("__w"))).withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("__s", F.sort_array(F.transform("__h", lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.bitwiseAND(F.lit(PLACE)).cast("bigint")))))
    alike = lambda a, b: F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.lit(~PLACE)) == 0, F.lit(False))
    rows = rows.withColumn("__d", F.filter("__s", lambda k, j: alike(k, F.get("__s", j - 1)) | alike(k, F.get("__s", j + 1))))
    made = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__d") == 0, F.lit(0)).otherwise(_covered(F.col("__h"), F.col("__d"))).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    # As a generator's output the measures are made once a row: filters on them are not pushed below and made anew.
    return rows.select(*columns, F.explode_outer(F.array(made)).alias("__m"))


def measures(m: str = "__m") -> dict[str, Column]:
    of = lambda name: F.col(f"{m}.{name}").cast("double")
    return {
        "symbols_per_char": of("n_symbols") / F.greatest(of("word_chars"), F.lit(1.0)),
        "dup_lines_share": of("n_dup_lines") / F.greatest(of("n_lines"), F.lit(1.0)),
        "repeated_share": of("n_repeat_words") / F.greatest(of("n_words"), F.lit(1.0)),
        "upper_share": of("n_upper") / F.greatest(of("word_chars"), F.lit(1.0)),
    }


def base_failed(m: str = "__m") -> Column:
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 100 * MOST_REPEATED * F.col(f"{m}.n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed from logarithms of the terms."""
    import math

    start = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        log = acc["log"] + F.log((n - j + 1) / j) + math.log(p / (1 - p))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), k.cast("int")), start, add, lambda acc: acc["sum"])
    return F.when(k >= n, F.lit(1.0)).when(k == 0, F.exp(n * math.log1p(-p))).otherwise(F.least(total, F.lit(1.0)))


def thresholds(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] = RULES) -> DataFrame:
    """One row per stratum: lang and a struct cutoffs with one (nullable) double per rule.

    good has lang, __m of labelled good documents that pass the fixed rules. The bound at a cutoff is within the rule's
    share of alpha exactly if P(X <= rejected) under that share is at most the level of one test.
    """
    of = measures()
    counts = [F.count("*").alias("n")] + [F.count_if(of[r] > c).alias(f"{r}__{i}") for r, cs in rules.items() for i, c in enumerate(cs)]
    table = good.groupBy("lang").agg(*counts)
    strata = table.agg(F.count("*").alias("__strata"))
    table = materialise(table, "holdout").crossJoin(F.broadcast(strata))
    tests = F.col("__strata") * sum(len(c) for c in rules.values())

    def cutoff(rule: str) -> Column:
        share = alpha / len(rules)
        ok = [F.when(binomial_tail(F.col(f"{rule}__{i}"), F.col("n"), share) <= delta / tests, F.lit(float(c))) for i, c in enumerate(rules[rule])]
        return F.coalesce(*ok).alias(rule)

    return table.select("lang", F.struct(*(cutoff(r) for r in rules)).alias("cutoffs"))


def cutoffs(marked: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The thresholds for documents with doc_id, lang and __m, from those that labels call good and not toxic.
    The bound holds for good documents that pass the fixed rules; what those reject is not counted."""
    wanted = F.col("quality") == 1
    if "toxic" in labels.columns:
        wanted &= F.coalesce(F.col("toxic"), F.lit(0)) != 1
    good = broadcast_if_small(labels.where(wanted).select(F.col("doc_id").alias("__id")).distinct(), MOST_LABELS)
    holdout = marked.join(good, F.col("doc_id") == F.col("__id"), "left_semi").where(~base_failed())
    return thresholds(holdout.select("lang", "__m"), alpha, delta)


def decided(marked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Documents with lang and __m, and __base_failed and __kept."""
    cuts = broadcast_if_small(cuts.withColumnRenamed("lang", "__lang"), MOST_STRATA)
    joined = marked.join(cuts, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    rejected = F.lit(False)
    for rule, value in measures().items():
        rejected = rejected | F.coalesce(value > F.col(f"cutoffs.{rule}"), F.lit(False))
    return joined.withColumn("__base_failed", base_failed()).withColumn("__kept", ~F.col("__base_failed") & ~rejected)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the rules keep, with the columns of docs. The texts are measured twice and never shuffled."""
    cuts = cutoffs(materialise(measured(docs.select("doc_id", "lang", "text")).drop("text"), "measures"), labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "lang", "text")
    return decided(measured(rows), cuts).where("__kept").select("__row.*")


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    marked = materialise(measured(docs.select("doc_id", "lang", "text")).drop("text"), "measures")
    found = decided(marked, cutoffs(marked, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *(F.col(f"__m.{n}").alias(n) for n in names), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))
