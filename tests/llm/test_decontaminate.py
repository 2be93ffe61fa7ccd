import random
import re

from pyspark.sql import functions as F

from strataflow.llm import decontaminate
from tests.llm.util import frame


def grams(text, width=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def test_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 6, 9, 20, 33, 64, 120])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "!!! ..."), (3, items[3][1])]
    docs = []
    for i in range(120):
        w = r.choices(vocabulary, k=r.choice([3, 50, 400]))
        for _ in range(r.choice([0, 1, 2])):
            part = r.choice(items)[1] or ""
            part = part.split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if part:
                    part[r.randrange(len(part))] = "other"
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + r.choice(["", ",", "\n"]) for x in part]
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (5, docs[7][1]), (None, items[20][1] + " " + items[30][1]), (202, "long " * 100_000 + items[30][1])]
    want = {}
    for d, t in docs:
        for i, x in items:
            width = min(5, len(re.findall(r"[^\W_]+", (x or "").lower())))
            if width == 0:
                continue
            mine, there = set(grams(x, width)), set(grams(t, width))
            if len(mine & there) >= 0.8 * len(mine) - 1e-9:
                want[d, i] = max(want.get((d, i), (0, 0)), (len(mine), len(mine & there)))
    frames = frame(spark, docs, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit(2)), frame(spark, items, "item_id bigint, text string").withColumn("n", F.lit(0))
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_found) for x in decontaminate.query(spark, *frames).collect()}
    assert got == want and len(want) > 60
    kept = decontaminate.drop_contaminated(*frames)
    assert kept.columns == frames[0].columns

    def leaks(t):
        for _, x in items:
            width = min(5, len(re.findall(r"[^\W_]+", (x or "").lower())))
            mine = set(grams(x, width)) if width else set()
            if mine and len(mine & set(grams(t, width))) >= 0.8 * len(mine) - 1e-9:
                return True
        return False

    # Rows that share an id stand for themselves.
    assert sorted((x.doc_id or -1, x.text or "") for x in kept.collect()) == sorted((d or -1, t or "") for d, t in docs if not leaks(t))


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b c d e f")], "doc_id bigint, text string"), frame(spark, [], "item_id bigint, text string")
    assert decontaminate.query(spark, docs, items).collect() == []
    assert decontaminate.query(spark, docs.limit(0), frame(spark, [(1, "a b c")], "item_id bigint, text string")).collect() == []
    assert decontaminate.drop_contaminated(docs, items).count() == 1
