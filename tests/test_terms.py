"""Terms found by the automaton against a loop of expressions."""

import random
import re

from pyspark.sql import functions as F

from strataflow.functions import terms


def test_thousands_of_terms_in_one_pass(spark, monkeypatch):
    r = random.Random(9)
    letters = "abcdeé-1 "
    table = {"".join(r.choice(letters) for _ in range(r.randrange(2, 6))).strip() or "x" for _ in range(3000)}
    rows = [(t if i % 3 else t.upper(), f"n{i % 40}", i) for i, t in enumerate(sorted(table))] + [("", "none", 1), (None, "none", 2), ("abc", "later", 99_999), ("ABC", "first", -5)]
    texts = ["".join(r.choice(letters + "ABC.") for _ in range(r.randrange(0, 60))) for _ in range(60)] + [None, "", "abcé", "x abc-1 y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    named = spark.createDataFrame(rows, "term string, name string, place int")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    best: dict = {}
    for t, n, p in rows:
        if t:
            best[low(t)] = min(best.get(low(t), (p, n)), (p, n))
    for most in (200_000, 700):
        monkeypatch.setattr(terms, "MOST", most)
        for words in (True, False):
            f = terms.found(df, "t", named, "f", words)
            got = {x.i: x for x in f.select("i", "f", terms.longest(F.col("f")).alias("l"), terms.first_name(F.col("f")).alias("a"), terms.only_name(F.col("f")).alias("o")).collect()}
            for i, text in enumerate(texts):
                if text is None:
                    assert got[i].f is None and got[i].l is None and got[i].a is None
                    continue
                want = set()
                for t, (p, n) in best.items():
                    before = r"(?<![^\W_])" if words and t[0].isalnum() else ""
                    after = r"(?![^\W_])" if words and t[-1].isalnum() else ""
                    want |= {(m.start(), m.start() + len(t), t, n, p) for m in re.finditer(f"(?={before}{re.escape(t)}{after})", low(text))}
                assert [tuple(h) for h in got[i].f] == sorted(want), text
                kept: list = []
                for h in sorted(want, key=lambda h: (h[0], -h[1])):
                    if not kept or kept[-1][1] <= h[0]:
                        kept.append(h)
                assert [tuple(h) for h in got[i].l] == kept
                assert got[i].a == (min((h[4], h[3]) for h in want)[1] if want else None)
                assert got[i].o == (kept[0][3] if len({h[3] for h in kept}) == 1 else None)
    assert terms.found(df, "t", named.limit(0), "f").where("size(f) > 0").count() == 0
