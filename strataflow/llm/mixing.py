"""Mixing sources to target weights: hash-threshold histograms. Spark functions only.

A source's target is its weight's share of SHARE times all words, at most MOST times the source's own words; what is
above goes to the other sources by their weights, until none is above. The part of a target that is a multiple of the
source's words takes every document so often. For the rest (the goal) documents are taken once more by their hashes:
words are summed by source and hash bucket, the bucket in which the running sum passes the goal is split by the next
bits of the hash, and so on until one document is left there; documents below its hash are taken. Its words are more
than what is left of the goal, so in the next of ROUNDS rounds the documents behind it that are not longer than what is
left have a threshold of their own. Last, one document is added if that brings the sum nearer. A larger goal gives a
higher first threshold, so the choices of the first round are nested. Nothing is sorted: the choice is a filter on hash
and words, made from one row a source.

Words are runs of other characters than space and \\t to \\r; null and empty texts have none and are taken 0 words. A
null source is a source, last in order. The hash is of id and text: equal rows stand or fall together, and reruns give
the same rows. Sources without words have a target of 0. An empty table gives no rows. Very long texts are documents
like others. Other columns are kept by `mixture` and not by `query`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialise, small_enough
from strataflow.operators.ordered import numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Thresholds a source may have besides the last single document.
ROUNDS = 3
#: The hash has BITS bits; each histogram resolves STEP of them.
BITS, STEP = 60, 12
#: Rows of sources up to which they are broadcast.
MOST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """The number of words: every word with the white space behind it becomes one character, which are counted."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.char_length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """BITS bits of a digest of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target of rows with source and size."""
    sums = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = numbered(sums.withColumn("__null", F.col("source").isNull()), (), ("__null", "source"), "__n").drop("__null")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("__n") - 1) % len(WEIGHTS)).cast("int"))
    table = materialise(placed.select("source", "source_size", weight.alias("w"), (MOST * F.col("source_size")).alias("most")), "weighed-sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full, share = F.lit(False), F.lit(0.0)
    before = None
    while True:  # each pass gives up the sources that are above, and shares the rest among the others
        held, weights = table.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        if not weights or (held, weights) == before:
            break
        before = held, weights
        share = F.lit(SHARE * total - held) * F.col("w") / F.lit(float(weights))
        full = F.col("most") < share
    return table.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target"))


def _with(rows: DataFrame, state: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of their source in state. few: whether state can be broadcast."""
    named = state.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _threshold(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """source and high, the hash below which the candidates' words stay within rest (null if all do), and sum, these
    words. state: source, rest, low; candidates are documents with a higher hash than low and at most rest words."""
    fits = (F.col("h") > F.col("low")) & (F.col("size") <= F.col("rest")) & (F.col("size") > 0)
    state = state.select("source", "rest", "low", F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("bucket"))
    done = None
    for shift in range(BITS - STEP, -1, -STEP):
        bucket = F.shiftright("h", shift)
        inside = F.shiftright("h", shift + STEP) == F.col("bucket") if shift + STEP < BITS else F.lit(True)
        words = _with(rows, state.select("source", "rest", "low", "bucket"), few).where(fits & inside)
        histogram = words.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most"))
        joined = _with(histogram, state.drop("bucket"), few)
        order = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumn("below", F.col("sum") + F.coalesce(F.sum("words").over(order), F.lit(0)))
        # The first bucket that does not fit whole; without one the largest sum, and no bound.
        over = (F.col("below") <= F.col("rest")) & (F.col("below") + F.col("words") > F.col("rest"))
        found = joined.groupBy("source").agg(
            F.first("rest").alias("rest"), F.first("low").alias("low"), F.min(F.when(over, F.struct("b", "below", "least", "most"))).alias("at"), F.max(F.col("below") + F.col("words")).alias("all")
        )
        found = materialise(found, "thresholds")
        settled = found.where("at is null or at.least = at.most").select("source", F.coalesce("at.below", "all").alias("sum"), F.col("at.least").alias("high"))
        done = settled if done is None else done.union(settled)
        state = found.where("at.least < at.most").select("source", "rest", "low", F.col("at.below").alias("sum"), F.col("at.b").alias("bucket"))
        if state.isEmpty():
            break
    return done


def thresholds(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """One row a source: source_size, target, times (how often all its documents are taken) and a struct for each round:
    documents with a hash above low and below high and at most rest words are taken once more; last, `pick`, the hash of
    one more document. rows: source, size, h; aims: what `targets` gives."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = aims.withColumn("times", times).withColumn("rest", F.floor("target").cast("long") - F.col("times") * F.col("source_size"))
    few = small_enough(aims, MOST_SOURCES)
    state = materialise(state.withColumn("low", F.lit(-1).cast("long")).withColumn("rounds", F.array().cast("array<struct<low:long,high:long,rest:long>>")), "aims")
    for _ in range(ROUNDS):
        open_ = state.where("rest > 0 and low is not null")
        if open_.isEmpty():
            break
        joined = _with(state, _threshold(rows, open_.select("source", "rest", "low"), few).withColumn("__found", F.lit(True)), few, "left")
        one = F.array(F.struct("low", "high", "rest"))
        # Without a candidate, or with all of them taken, no further round can add any.
        state = materialise(
            joined.select(
                "source", "source_size", "target", "times", (F.col("rest") - F.coalesce("sum", F.lit(0))).alias("rest"), F.when(F.col("__found"), F.col("high")).alias("low"), F.when(F.col("__found"), F.concat("rounds", one)).otherwise(F.col("rounds")).alias("rounds")
            ),
            "rounds",
        )
    left = _with(rows, state.where("rest > 0").select("source", "rest", "rounds"), few).where(~_taken(F.col("rounds")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("rest")))
    near = F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), F.col("h"))
    best = materialise(left.groupBy("source").agg(F.min(near).alias("best")), "nearest").select("source", F.col("best.h").alias("pick"))
    # Equal rows have one hash: taking all of them would be more than one document.
    copies = _with(rows.where("size > 0"), best, few).where("h = pick").groupBy("source", "pick").agg(F.count("*").alias("n")).where("n = 1").select("source", "pick")
    return materialise(_with(state, copies, few, "left"), "plan")


def _taken(rounds: Column) -> Column:
    h, size = F.col("h"), F.col("size")
    return F.exists(rounds, lambda r: (h > r["low"]) & (r["high"].isNull() | (h < r["high"])) & (size <= r["rest"]))


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and copies, how often each document is taken: a filter by one row a source."""
    extra = _taken(F.col("rounds")) | F.coalesce(F.col("h") == F.col("pick"), F.lit(False))
    return _with(rows, plan.select("source", "source_size", "target", "times", "rounds", "pick"), small_enough(plan, MOST_SOURCES)).withColumn("copies", F.when(F.col("size") > 0, F.col("times") + extra.cast("long")).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, *kept: Column) -> DataFrame:
    return docs.select(*kept, "source", n_words(F.col("text")).alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("h"))


def mixture(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    plan = _plan(materialise(measured(docs), "sizes"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    return decided(measured(docs, row), plan).where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


def _plan(rows: DataFrame) -> DataFrame:
    return thresholds(rows, materialise(targets(rows), "targets"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = materialise(measured(docs, F.col("doc_id")), "sizes")
    found = decided(rows, _plan(rows))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _levels(n: int = 24) -> str:
    """SQL of n passes of the sharing; a pass that changes nothing repeats the one before."""
    made = ["l0 AS MATERIALIZED (SELECT *, false AS capped FROM weighed)"]
    for i in range(n):
        rest = "(SELECT 1.5::DOUBLE * sum(source_size) - coalesce(sum(most) FILTER (WHERE capped), 0) FROM l{0})".format(i)
        made.append(f"l{i + 1} AS MATERIALIZED (SELECT source, source_size, w, most, {rest} * w / (SELECT sum(w) FILTER (WHERE NOT capped)::DOUBLE FROM l{i}) AS share, most < {rest} * w / (SELECT sum(w) FILTER (WHERE NOT capped)::DOUBLE FROM l{i}) AS capped FROM l{i})")
    return ", ".join(made) + f", aims AS MATERIALIZED (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE share END AS target FROM l{n})"


def _rounds() -> str:
    made = ["""s0 AS MATERIALIZED (SELECT *, floor(target)::BIGINT - times * source_size AS rest, -1::BIGINT AS low
        FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM aims)), t0 AS MATERIALIZED (SELECT *, false AS taken FROM rows_)"""]
    for i in range(ROUNDS):
        made.append(f"""c{i} AS MATERIALIZED (SELECT d.*, s.rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM rows_ d JOIN s{i} s ON d.source IS NOT DISTINCT FROM s.source WHERE d.size > 0 AND s.rest > 0 AND h > s.low AND size <= s.rest),
        f{i} AS MATERIALIZED (SELECT source, coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS got, min(h) FILTER (WHERE upto > rest) AS high FROM c{i} GROUP BY source),
        t{i + 1} AS MATERIALIZED (SELECT t.* EXCLUDE taken, taken OR coalesce(size > 0 AND size <= s.rest AND h > s.low AND f.got IS NOT NULL AND (f.high IS NULL OR h < f.high), false) AS taken
            FROM t{i} t LEFT JOIN s{i} s ON t.source IS NOT DISTINCT FROM s.source AND s.rest > 0 LEFT JOIN f{i} f ON t.source IS NOT DISTINCT FROM f.source),
        s{i + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (rest, low), rest - coalesce(got, 0) AS rest, f.high AS low FROM s{i} s LEFT JOIN f{i} f ON s.source IS NOT DISTINCT FROM f.source)""")
    return ", ".join(made)


ORACLE = rf"""WITH rows_ AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
weighed AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w, {MOST} * sum(size)::BIGINT AS most FROM rows_ GROUP BY source),
{_levels()}, {_rounds()},
picked AS (SELECT s.source, min(struct_pack(off := abs(size - rest), h := h)).h AS pick FROM s{ROUNDS} s JOIN t{ROUNDS} t ON s.source IS NOT DISTINCT FROM t.source
    WHERE NOT taken AND rest > 0 AND size > 0 AND size < 2 * rest GROUP BY s.source)
SELECT t.doc_id, t.size, s.source_size, s.target, (t.size * (times + (taken OR coalesce(t.h = p.pick, false))::INT))::BIGINT AS taken
FROM t{ROUNDS} t JOIN s{ROUNDS} s ON t.source IS NOT DISTINCT FROM s.source LEFT JOIN picked p ON t.source IS NOT DISTINCT FROM p.source"""
