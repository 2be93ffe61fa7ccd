import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataflow.llm import simhash
from strataflow.llm.components import components
from tests.llm.util import frame


def brute_components(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_words_at_distance_one_share_a_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    mine = simhash.codeword_indices(words)
    assert {len(set(r)) for r in mine.tolist()} == {1, 6}
    for bit in range(23):
        other = simhash.codeword_indices(words ^ (1 << bit))
        assert all(set(a) & set(b) for a, b in zip(mine.tolist(), other.tolist(), strict=True))


def test_fingerprints_within_two_bits_share_a_key():
    r = random.Random(2)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        ka, kb = simhash.golay_keys(np.array([a, b], np.uint64)).tolist()
        assert set(ka) & set(kb)


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_connect_as_brute_force_does(spark, bucket):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(30)}
    for _ in range(250):  # chains and dense groups
        v = r.choice(sorted(values))
        for _ in range(r.choice([1, 2, 2, 3])):
            v ^= 1 << r.choice([0, 1, 2, 3, 20, 21, 22, 41, 42, 43, 63])
        values.add(v)
    values = sorted(values)
    signed = [int(np.array(v, np.uint64).astype(np.int64)) for v in values]
    got = {x.node: x.root for x in components(simhash.links(frame(spark, [(v,) for v in signed], "f bigint"), bucket), "a", "b").collect()}
    want = brute_components(values, near)
    for i, v in enumerate(signed):
        for j in range(i):
            assert (got.get(v, v) == got.get(signed[j], signed[j])) == (want[i] == want[j])


def test_query_against_plain_python(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=r.choice([1, 2, 40, 200]))) for _ in range(60)]
    for t in texts[:30]:
        x = t.split()
        x[r.randrange(len(x))] = "Changed"
        texts += [" ".join(x), t.upper() + "\n"]
    texts += [None, "", " \t\n", "x" * 200_000, "é ü \x00  z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = frame(spark, rows, "doc_id bigint, text string").withColumn("f", F.lit("clash")).withColumn("component_id", F.lit(1))

    def plain(t):
        w = [x for x in (t or "").encode().lower().split()]
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    values = [plain(t) for _, t in rows]
    root = brute_components(values, near)
    least = {}
    for (i, _), c in zip(rows, root, strict=True):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, f"{v:016x}", least[c]) for (i, _), v, c in zip(rows, values, root, strict=True))
    assert sorted(map(tuple, simhash.query(spark, docs).collect())) == want
    # Dropping links more pairs than these (test_similar.py); no group keeps more than one of them.
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} <= set(least.values())


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('abc é')").first()[0] == int(np.array(xxhash.xxh64_intdigest("abc é".encode(), 42), np.uint64).astype(np.int64))


def test_empty_and_null_ids(spark):
    assert simhash.query(spark, frame(spark, [], "doc_id bigint, text string")).collect() == []
    docs = frame(spark, [(None, "a b c d"), (None, "a b c d"), (5, "e f g h i j")], "doc_id bigint, text string")
    assert sorted(x.component_id or 0 for x in simhash.query(spark, docs).collect()) == [0, 0, 5]
    assert simhash.drop_near_duplicates(docs).count() == 2


def test_long_chain(spark):
    chain = frame(spark, [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a bigint, b bigint")
    got = {x.node: x.root for x in components(chain, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
