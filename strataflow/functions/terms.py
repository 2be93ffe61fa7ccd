"""Texts against a table of terms, any number of them, in one pass over each text.

The terms make an automaton (Aho and Corasick's) that finds all of them at once; it is built on the driver and sent to the
tasks, which run it in Arrow batches. A table of more than MOST terms is taken in blocks of so many, one automaton a block,
and what the blocks find is put together.

Letters A to Z are alike in either case. With words, a term counts only where no letter or digit goes on at its ends. Empty
terms find nothing; of equal terms the one with the smaller place, then name, counts. A null text has null for an answer,
an empty one no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200_000
FOUND = "array<struct<begin:int,stop:int,term:string,name:string,place:long>>"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _blocks(terms: DataFrame) -> Iterator[list[tuple[str, str, int]]]:
    """term, name and place of all terms, MOST at a time."""
    lowered = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = terms.where("term <> ''").groupBy(lowered.alias("term")).agg(F.min(F.struct(F.col("place").cast("long").alias("place"), "name")).alias("b"))
    block: list[tuple[str, str, int]] = []
    for r in best.select("term", "b.name", "b.place").toLocalIterator():
        block.append((r.term, r.name, r.place))
        if len(block) == MOST:
            yield block
            block = []
    yield block


def _finder(block: list[tuple[str, str, int]], words: bool):  # noqa: ANN202
    automaton = ahocorasick.Automaton()
    for term, name, place in block:
        automaton.add_word(term, (term, name, place))
    automaton.make_automaton()

    def hits(text: str) -> list[tuple]:
        low = text.translate(_LOWER)
        found = [(end - len(v[0]) + 1, end + 1, *v) for end, v in automaton.iter(low)]
        if words:
            apart = lambda i: not (0 <= i < len(low) and low[i].isalnum())
            found = [h for h in found if (apart(h[0] - 1) or not low[h[0]].isalnum()) and (apart(h[1]) or not low[h[1] - 1].isalnum())]
        return found

    @F.pandas_udf(FOUND)
    def every(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(("begin", "stop", "term", "name", "place"), h, strict=True)) for h in (hits(t) if block else ())])

    return every


def found(df: DataFrame, text: str, terms: DataFrame, made: str, words: bool = True) -> DataFrame:
    """df with made: all places of terms (term, name, place) in a text, also such that overlap, by begin and stop."""
    columns = []
    for i, block in enumerate(_blocks(terms)):
        df = df.withColumn(f"__found{i}", _finder(block, words)(F.col(text)))
        columns.append(f"__found{i}")
    return df.withColumn(made, F.array_sort(F.concat(*columns))).drop(*columns)


def longest(every: Column) -> Column:
    """Of places by begin those that do not overlap: the first, of those that begin together the longest, and so on."""
    def add(kept: Column, h: Column) -> Column:
        last = F.element_at(kept, -1)
        same = (F.size(kept) > 0) & (last["begin"] == h["begin"])
        return F.when(same, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(h))).when((F.size(kept) == 0) | (last["stop"] <= h["begin"]), F.concat(kept, F.array(h))).otherwise(kept)

    return F.when(every.isNotNull(), F.aggregate(every, F.slice(every, 1, 0), add))


def first_name(every: Column) -> Column:
    """The name of the term with the smallest place that occurs at all; null if none does."""
    return F.array_min(F.transform(every, lambda h: F.struct(h["place"], h["name"])))["name"]


def only_name(every: Column) -> Column:
    """The name that all terms have which do not overlap; null if there is none or they differ."""
    names = F.array_distinct(F.transform(longest(every), lambda h: h["name"]))
    return F.when(F.size(names) == 1, F.get(names, 0))
