"""Mixing by hash thresholds against SQL and by its promises, on odd tables."""

import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from strataflow.llm import mixing
from tests.llm.util import frame

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, size string"


def rows():
    r = random.Random(3)
    words = lambda n: "\x0b".join(["x"] * (n // 2)) + " \n" + " ".join(["é"] * (n - n // 2)) if n else r.choice(["", " \t\r\n", None])
    made = [(i, words(r.choice([0, 1, 3, 10, 50, 400])), r.choice(["a", "b", "B", "é", "", None, "hot", "hot", "hot"]), 1, "clash") for i in range(400)]
    made += [(None, "no id", "a", None, None), (907, "two words", "a", 1, "c"), (907, "two words", "a", 1, "c"), (900, "w " * 30_000, "long", 1, "c"), (901, None, "empty", 1, "c")]
    return made


def test_mix_is_what_sql_gives(spark):
    docs = frame(spark, rows(), SCHEMA)
    got = [tuple(x) for x in mixing.query(spark, docs).collect()]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(mixing.ORACLE).fetchall()
    plain = lambda rs: sorted(((d, n, s, round(t, 6), k) for d, n, s, t, k in rs), key=str)
    assert plain(got) == plain(want)
    assert plain(tuple(x) for x in mixing.query(spark, docs.repartition(1)).collect()) == plain(got)


def test_mix_keeps_its_promises(spark):
    docs = frame(spark, rows(), SCHEMA)
    found = docs.select("doc_id", "text", "source").join(mixing.query(spark, docs).withColumnRenamed("doc_id", "id"), F.col("id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["doc_id", "text"]).collect()
    taken, target, size = defaultdict(int), {}, {}
    for x in found:
        assert x.size == len((x.text or "").split()) and x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
        target[x.source], size[x.source] = x.target, x.source_size
    total = sum(size.values())
    # By code point, null last; weights repeat.
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    held: set = set()
    while True:
        rest, w = 1.5 * total - sum(2 * size[s] for s in held), sum(weight[s] for s in order if s not in held)
        more = {s for s in order if s not in held and 2 * size[s] < rest * weight[s] / w}
        if not more:
            break
        held |= more
    for s in order:
        assert abs(target[s] - (2 * size[s] if s in held else rest * weight[s] / w)) < 1e-6
        if s != "long":
            assert abs(taken[s] - target[s]) <= max(4, 0.01 * target[s])
    again = mixing.mixture(docs)
    assert again.columns == docs.columns
    assert again.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(x.taken for x in mixing.query(spark, docs).collect())


def test_mix_of_nothing(spark):
    docs = frame(spark, rows(), SCHEMA)
    assert mixing.query(spark, docs.limit(0)).collect() == []
    blank = mixing.query(spark, docs.where("source = 'empty'")).collect()
    assert [(x["size"], x.source_size, x.target, x.taken) for x in blank] == [(0, 0, 0.0, 0)]
    alone = mixing.query(spark, docs.where("doc_id = 900")).collect()
    assert [(x["size"], x.target, x.taken) for x in alone] == [(30_000, 45_000.0, 30_000)]


def test_one_source_of_many_equal_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 2900, "hot").otherwise("b").alias("source"))
    found = mixing.query(spark, docs).collect()
    for source in {(x.source_size, x.target) for x in found}:
        assert abs(sum(x.taken for x in found if x.source_size == source[0]) - source[1]) <= 3
