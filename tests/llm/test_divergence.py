"""Prices of sources against a table of all groups by all terms."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from strataflow.llm import divergence
from tests.llm.util import frame

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int"


def rows():
    r = random.Random(8)
    words = [f"w{c}" for c in "abcdefghij"] + ["Été", "日本語", "\U0001f600", "rare", "B_c", "it's"]
    made = []
    for i in range(420):
        text = r.choice([" ", "1", "\n", "-"]).join(r.choices(words, weights=[2 ** (k % 7) for k in range(len(words))], k=r.choice([0, 3, 20, 90])))
        made.append((i, r.choice([text, text, text, None, ""]) if i % 5 == 0 else text, r.choice(["en", "de", None, ""]), r.choice(["s1", "s1", "s1", "é", "S", None]), "x", 1))
    return [*made, *made[:3], (1000, "wa " * 500_000 + "x" * 100, "en", "long", "x", 1), (1001, "12 ,.", "en", "no terms", "x", 1), (1002, "few terms", "xx", "s1", "x", 1), (1003, None, "xx", "s2", "x", 1)]


def plainly(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, k in within.items() if k >= 30]
        groups: dict = defaultdict(Counter)
        for _, s, ts in own:
            groups[s].update(t for t in ts if t in set(kept))
        total = sum(groups.values(), Counter())
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: price(c) for s, c in groups.items()}, price(total)
        for s in groups:
            by = lambda x: (-x[1], x[0].encode())
            for part, items in (("pair", sorted(((h, sum(abs(p[s][t] - p[h][t]) for t in kept)) for h in groups if h != s), key=by)), ("term", sorted(((t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]), key=by)[:50])):
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items)}
    return out


def test_divergence_is_that_of_the_whole_table(spark):
    got = [tuple(x) for x in divergence.query(spark, frame(spark, rows(), SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == plainly(rows())


def test_divergence_of_nothing(spark):
    docs = frame(spark, rows(), SCHEMA)
    assert divergence.query(spark, docs.limit(0)).collect() == []
    assert sorted(tuple(x) for x in divergence.query(spark, docs.where("lang = 'xx'")).collect()) == [("xx", "s1", "pair", "s2", 0, 1), ("xx", "s2", "pair", "s1", 0, 1)]


def test_prices_are_exact_beyond_bigints(spark):
    row = spark.range(1).select(divergence.price(F.lit(9 * 10**17), F.lit(10**18), F.lit(3)).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 15)


def test_pieces_end_between_terms():
    text = ("ab é" * 700_000 + "x" * 3_000_000 + " tail").encode()
    parts = list(divergence.pieces(text))
    assert b"".join(parts) == text and len(parts) > 2
    assert Counter(t for x in parts for t in divergence._TERM.findall(x)) == Counter(divergence._TERM.findall(text))


def batch(rows):
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("lang", "source", "text"))})


def test_a_task_adds_up_many_different_terms():
    letters = "abcdefghijklmnopqrst"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:8])
    got = list(divergence._counted(iter([batch([("en", "s", text)] * 3)])))
    assert sum(x.num_rows for x in got) == 64_000  # each term once, not once a text
    assert {(n, d) for x in got for n, d in zip(x["n"].to_pylist(), x["d"].to_pylist(), strict=True)} == {(3, 3)}


def test_counts_are_the_same_held_or_handed_on(monkeypatch):
    made = [(x or "", y or "", t or "") for _, t, x, y, *_ in rows()]
    want: dict = defaultdict(Counter)
    for lang, source, t in made:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        for term, k in Counter(terms).items():
            want[lang, source, term].update(n=k, d=1)
    for held, long in ((16 << 20, 8 << 20), (500, 8 << 20), (16 << 20, 100)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "LONG", long)
        got: dict = defaultdict(Counter)
        for x in divergence._counted(iter([batch(made[:200]), batch(made[200:]), batch([])])):
            for r in x.to_pylist():
                got[r["lang"], r["source"], r["term"]].update(n=r["n"], d=r["d"])
        assert got == want
