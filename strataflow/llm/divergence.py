"""How far the sources of a language differ in their words: inclusion-exclusion over supports.

Each (lang, source) group gives every kept term of the language the price p = 1 + floor(SCALE (count + SMOOTH) / (N +
SMOOTH V)), so p depends on the count alone, and all terms that a group lacks have one price, z. The sum of |p - q| over
the terms of two groups g and h is made without a table of groups by terms:

* V |z_g - z_h|, as if no group had any term;
* for every count of a group's histogram (count, number of terms), |p - z| - |z_g - z_h| by the number of terms, as if
  the other group had none of them: one-sided prices, from a few rows a group instead of its terms;
* for every term that both have, from the join of their postings, |p - q| - |p - z_h| - |z_g - q| + |z_g - z_h|.

The postings are sparse; pairs of one term are added up before they are shuffled. All arithmetic is exact: products are
decimals, prices and sums bigints.

Null text, lang and source are ''. Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case.
Very long texts are cut into pieces between terms, so memory does not follow them. Repeated rows count as often as they
occur, ties of value go by the item's bytes, and an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialise, slices, small_enough, split_words

LEAST_DOCUMENTS, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of terms that a task holds before it hands their counts on, rows that it hands on at once; bytes of a part over
#: which it is split by pieces, and those of a piece.
HELD, ROWS, LONG, PIECE = 16 << 20, 10_000, 8 << 20, 1 << 20
#: Rows of groups up to which they are broadcast.
MOST_GROUPS = 20_000
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_OTHER = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Bytes between terms.
GAPS = bytes(b for b in range(128) if not chr(b).isalpha())


def pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces that end between terms."""
    start = 0
    while start < len(text):
        gap = _OTHER.search(text, start + PIECE)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end


def _added(words: list[pa.Array], texts: list[np.ndarray], groups: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and texts of each term in each group. words: of all texts in order; texts: how many words
    each has; groups: the group of each text."""
    coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    sizes, of = np.concatenate(texts), np.concatenate(groups)
    keys, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(), return_counts=True)
    keys = of[keys // kinds] * kinds + keys % kinds
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    n = np.add.reduceat(n[order], first) if len(first) else n
    return keys[first] // kinds, coded.dictionary.take(pa.array(keys[first] % kinds)), n, np.diff(np.append(first, len(keys)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, added up over many documents."""
    names = ["lang", "source", "term", "n", "d"]
    number: dict[tuple[str, str], int] = {}
    words, texts, groups, size = [], [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        group, term, n, d = _added(words, texts, groups)
        langs, sources = (pa.array([g[i] for g in number], pa.string()) for i in range(2))
        at = pa.array(group)
        made = pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=names)
        yield from (made.slice(k, ROWS) for k in range(0, made.num_rows, ROWS))
        for held in (number, words, texts, groups):
            held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            lang, source = (part.column(i).to_pylist() for i in range(2))
            if part.column("text").nbytes > LONG:  # a text of its own: counted by pieces
                for i, text in enumerate(part.column("text")):
                    found: Counter = Counter()
                    for piece in pieces(text.as_buffer().to_pybytes()):
                        found.update(_TERM.findall(piece.lower()))
                    terms = list(found)
                    for k in range(0, len(terms), ROWS):
                        some = terms[k : k + ROWS]
                        made = [pa.array([lang[i]] * len(some)), pa.array([source[i]] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([found[t] for t in some], pa.int64()), pa.array([1] * len(some), pa.int64())]
                        yield pa.RecordBatch.from_arrays(made, names=names)
                continue
            found_words, sizes = split_words(part.column("text"), GAPS)
            words.append(found_words)
            texts.append(sizes)
            groups.append(np.array([number.setdefault(g, len(number)) for g in zip(lang, source, strict=True)], np.int64))
            size += found_words.nbytes + 16 * part.num_rows
            if size > HELD:
                yield from out()
                size = 0
    if words:
        yield from out()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents) of each group. Terms lie together by (lang, term)."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = named.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH kept)), exactly; kept is over 0."""
    top = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTH * kept).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, below)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    postings, groups = audited(docs)
    return ranked(pairs(postings, groups), "pair", None).unionByName(ranked(terms(postings, groups), "term", RANKS))


def audited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of kept terms (lang, source, term, n, all: the term's occurrences in the language, p, q: its prices in
    the group and the language) and groups (lang, source, v: kept terms, zero: the price of absence, null if v is 0)."""
    every = materialise(counts(docs), "term-counts")
    kept = every.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all")).where(F.col("d") >= LEAST_DOCUMENTS).drop("d")
    kept = materialise(kept, "kept-terms")
    postings = materialise(every.drop("d").join(kept, ["lang", "term"]), "kept-postings")
    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total_all"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = found.join(languages, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "total", "total_all"])
    groups = materialise(groups.withColumn("zero", F.when(F.col("v") > 0, price(F.lit(0).cast("long"), F.col("total"), F.col("v")))), "groups")
    side = F.broadcast if small_enough(groups, MOST_GROUPS) else (lambda df: df)
    priced = postings.join(side(groups), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n", "zero", price(F.col("n"), F.col("total"), F.col("v")).alias("p"), price(F.col("all"), F.col("total_all"), F.col("v")).alias("q"))
    return materialise(priced, "priced"), groups.select("lang", "source", "v", "zero")


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of |p - q| over all kept terms."""
    side = F.broadcast if small_enough(groups, MOST_GROUPS) else (lambda df: df)
    other = groups.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("zero").alias("z"))
    apart = F.abs(F.col("zero") - F.col("z"))
    both = lambda df: df.join(side(other), (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item")))
    none = both(groups).select("lang", "source", "item", F.coalesce(F.col("v") * apart, F.lit(0)).alias("value"))
    histogram = materialise(postings.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("m")), "histograms")
    one = both(histogram).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("z")) - apart)).alias("value"))
    one = materialise(one, "one-sided")
    a = postings.select("lang", "term", "source", "p", "zero")
    b = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("zero").alias("z"))
    corrected = F.abs(F.col("p") - F.col("r")) - F.abs(F.col("p") - F.col("z")) - F.abs(F.col("zero") - F.col("r")) + apart
    # Each pair of sources once; the correction is the same for both orders.
    shared = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(corrected).alias("value"))
    shared = materialise(shared, "overlaps")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = none.union(one).union(turned(one)).union(shared).union(turned(shared))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term that the group uses more than its language), value: |p - q|."""
    return postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def ranked(found: DataFrame, part: str, most: int | None) -> DataFrame:
    """With ranks by value and item. Spark cuts each group to `most` before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = found.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return found.where(F.col("rank") <= most) if most else found


ORACLE = rf"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS MATERIALIZED (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCUMENTS}),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grps AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
prices AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.total, 0) + {SMOOTH} * l.v) AS p, 1 + ({SCALE} * (k.n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS q
    FROM grps g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM grps g JOIN grps h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM prices WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM both_ QUALIFY part = 'pair' OR rank <= {RANKS}"""
