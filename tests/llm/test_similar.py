import random

from pyspark.sql import functions as F

from strataflow.llm import similar, simhash
from tests.llm.test_simhash import brute_components
from tests.llm.util import frame


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    (f, a), (g, b) = x, y
    return (f ^ g).bit_count() <= 2 or bool(a and b and 5 * len(a & b) >= 4 * len(a | b))


def test_one_of_each_group_stays(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, passage = [], r.choices(vocabulary, k=150)
    for _ in range(12):  # groups of near copies at many distances, chains among them
        text = r.choices(vocabulary, k=r.choice([30, 120, 400]))
        for _ in range(r.choice([1, 4, 40])):
            if r.random() < 0.3:
                text = list(text)
                for _ in range(r.choice([1, len(text) // 40 + 1, len(text) // 8 + 1])):
                    text[r.randrange(len(text))] = "changed"
            rows.append((len(rows), " ".join(text)))
    # Texts that share a long passage, but are no copies.
    rows += [(1000 + i, " ".join(passage + r.choices(vocabulary, k=100))) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "two words"), (2003, "Two\twords"), (2004, "long " * 50_000), (5, rows[40][1]), (5, rows[5][1]), (None, "of no id"), (None, "without any id at all but with words")]
    docs = frame(spark, rows, "doc_id bigint, text string").withColumn("s", F.lit("clash")).withColumn("n", F.lit(1))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    roots = brute_components([(simhash.fingerprint(t), shingles(t)) for _, t in rows], alike)
    least = {}
    for (i, t), k in zip(rows, roots, strict=True):
        least.setdefault(k, []).append((i is None, i or 0, t or ""))
    kept = sorted((x.doc_id is None, x.doc_id or 0) for x in got.select("doc_id").collect())
    assert kept == sorted(min(v)[:2] for v in least.values())
    assert len([i for _, i in kept if 1000 <= i < 2000]) == 30


def test_empty_table(spark):
    assert simhash.drop_near_duplicates(frame(spark, [], "doc_id bigint, text string")).collect() == []


def test_sets_of_both_paths_have_one_size(spark):
    texts = ["a b c d e f a b c d e", "A b", "x " * 100, " lead and trail ", "one two three four five"]
    got = [x.n for x in frame(spark, list(enumerate(texts)), "i int, t string").orderBy("i").select(F.size(similar.sets(F.col("t"))).alias("n")).collect()]
    assert got == [len(shingles(t)) for t in texts] == [similar.sketch(simhash.gram_hashes(t.lower().encode().split()))[1] for t in texts]


def test_parities_lose_no_pair(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [r.choices(words, k=200)]
    for changes in (0, 1, 2, 3, 4, 5, 8, 40, 200):
        other = list(texts[0])
        for i in r.sample(range(200), changes):
            other[i] = "changed"
        texts.append(other)
    made = [similar.sketch(simhash.gram_hashes([w.encode() for w in t])) for t in texts]
    flat = "n bigint, " + ", ".join(f"{h} bigint" for h in similar.FLAT)
    x = frame(spark, [(made[0][1], *made[0][3])], flat).alias("x")
    y = frame(spark, [(i, m[1], *m[3]) for i, m in enumerate(made)], f"i int, {flat}").alias("y")
    got = dict(x.join(y).select("y.i", similar.plausible("x", "y")).collect())
    first = shingles(" ".join(texts[0]))
    for i, t in enumerate(texts):
        other = shingles(" ".join(t))
        if 5 * len(first & other) >= 4 * len(first | other):
            assert got[i]
    assert not got[8] and not got[9]
