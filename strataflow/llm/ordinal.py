"""A quality classifier by ordinal (cumulative-link) logistic regression on graded ratings.

Grades: 0 toxic, 1 of low quality, 2 good. All thresholds share one weight vector over hashed words and a few measures
of form: P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2. Every document gets its expected grade and the tail
probabilities; it is kept if P(grade >= 1) and P(grade >= 2) reach their cutoffs.

The weights are fitted on at most SAMPLE labelled rows, those with the smallest hashes of their ids; scoring reads
every whole text. Null texts hold no words. Labels with null quality and toxic, or without a document, are not used;
of repeated labels the lowest grade counts. Without any usable label all documents get the grade's middle and stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import slices

SAMPLE, BITS, GRADES = 12_000, 18, 3
#: Buckets in fewer documents of the sample get no weight.
LEAST_DOCS = 5
ROUNDS, RATE, RIDGE = 300, 0.5, 2e-4
CUTOFFS = (0.5, 0.25)
FORM = 7


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the different words (letters in lower case) and of their beginnings, and measures of form."""
    text = text or ""
    words = re.findall(r"[^\W\d_]+", text.lower())
    different = set(words)
    terms = different | {f"{w[:4]}-" for w in different} | {f"{w[:5]}-" for w in different}
    buckets = np.array([xxhash.xxh32_intdigest(w) & ((1 << BITS) - 1) for w in terms], np.int64)
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, text))
    form = [
        1.0,
        min(np.log1p(n), 10) / 5,
        letters / chars,
        upper / letters,
        1 - len(set(lines)) / max(1, len(lines)),
        len(different) / max(1, n),
        min(1.0, 10 * len(re.findall(r"[#*$%&|<>!]", text)) / chars),
    ]
    return np.unique(buckets), np.array(form)


@dataclass
class Model:
    weights: np.ndarray
    form: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        buckets, form = features(text)
        return 1 / (1 + np.exp(-np.clip(self.weights[buckets].sum() + form @ self.form - self.thresholds, -30, 30)))


def fit(flat: np.ndarray, sizes: np.ndarray, form: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, min_df: int = LEAST_DOCS) -> Model:
    """Cumulative-link regression by adaptive gradient steps. The gaps between thresholds are exponentials, so their
    order holds; rows are weighted so that grades count alike. flat holds the buckets of all rows, sizes how many each
    row has."""
    model = Model(np.zeros(1 << BITS, np.float32), np.zeros(FORM), np.array([-0.5, 0.5]))
    if not len(y):
        return model
    # Words of few documents would only be learnt by heart.
    often = np.bincount(flat, minlength=1 << BITS) >= min_df
    common = often[flat]
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)[common]
    used = np.flatnonzero(often)
    at = (np.cumsum(often, dtype=np.int32) - 1)[flat[common]]
    del flat, common
    weight = len(y) / (GRADES * np.bincount(y, minlength=GRADES)[y])
    w, f, first, gap = np.zeros(len(used)), np.zeros(FORM), 0.0, 0.0
    past = [np.full(len(used), 1e-2), np.full(FORM, 1e-2), 1e-2, 1e-2]
    for _ in range(rounds):
        score = np.bincount(row, w[at], len(y)) + form @ f
        cuts = np.array([first, first + np.exp(gap)])
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
        full = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], 1)
        p = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = full * (1 - full)
        upper, lower = slope[np.arange(len(y)), y] * (y > 0), slope[np.arange(len(y)), y + 1] * (y < GRADES - 1)
        g = weight * (upper - lower) / p / len(y)
        at_cut = lambda k: weight * (np.where(y == k, upper, 0) - np.where(y == k - 1, lower, 0)) / p / len(y)
        d1, d2 = -at_cut(1).sum(), -at_cut(2).sum()
        steps = [np.bincount(at, g[row], len(used)) - RIDGE * w, form.T @ g - RIDGE * f, d1 + d2, d2 * np.exp(gap)]
        past = [a + b * b for a, b in zip(past, steps, strict=True)]
        w, f, first, gap = (x + RATE * s / np.sqrt(a) for x, s, a in zip((w, f, first, gap), steps, past, strict=True))
    model.weights[used] = w
    return Model(model.weights, f, np.array([first, first + np.exp(gap)]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """grade, buckets (packed 32-bit integers) and form of at most so many labelled documents, those with the smallest
    hashes of their ids. Features are made where the texts are; texts are neither moved nor collected."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.select(F.col("doc_id").alias("__id"), grade.alias("grade")).where("grade is not null and __id is not null")
    chosen = graded.groupBy("__id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("__id"), "__id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = [features(t) for t in part.column("text").to_pylist()]
                columns = [part.column("h"), part.column("grade"), pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[1].tolist() for m in made], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "grade", "buckets", "form"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(F.xxhash64("doc_id", "text").alias("h"), "grade", "text")
    return rows.mapInArrow(run, "h bigint, grade int, buckets binary, form array<double>").orderBy("h", "grade").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows = sample(docs, labels, most).drop("h").toArrow()
    packed = rows.column("buckets").to_pylist()
    form = np.array(rows.column("form").to_pylist(), np.float64).reshape(-1, FORM)
    return fit(np.frombuffer(b"".join(packed), np.int32), np.array([len(x) // 4 for x in packed], np.int64), form, np.array(rows.column("grade").to_pylist(), np.int64))


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1 and p_at_least_2 of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tails = np.array([shared.value.tails(t) for t in part.column("text").to_pylist()]).reshape(-1, GRADES - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])], names=["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_at_least_1 double, p_at_least_2 double")


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = graded(docs, train(docs, labels))
    toxic = F.col("p_at_least_1") < CUTOFFS[0]
    return found.withColumn("toxic", toxic).withColumn("kept", ~toxic & (F.col("p_at_least_2") >= CUTOFFS[1]))
