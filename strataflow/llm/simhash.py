"""Near-duplicates by SimHash fingerprints, searched with keys from the binary Golay code.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most two bits, then by the
pigeonhole principle some segment is equal and the next one (cyclically) differs in at most one bit. Each segment,
padded to 23 bits, is decoded to the Golay codewords within distance 4: one, or six where the nearest is at distance
3. Two words at distance 1 always share one of these, so keys of (equal segment, codeword index of the next) find
every such pair; a join on the keys is verified by counting bits.

Buckets of more than BUCKET different fingerprints are not paired: each of their fingerprints is linked through the
65 words within distance 1 of it. Two fingerprints share such a word exactly if they differ in at most two bits, and
no word belongs to more than 65 fingerprints, so links stay linear in the bucket and none is lost.

Null and empty texts have fingerprint zero, which is linked like any other. Equal fingerprints are one node: copies
are never paired. Repeated rows keep a row each; a group of null ids only has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import similar
from strataflow.llm.common import broadcast_if_small, materialise, slices, with_made_column
from strataflow.llm.components import components

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))
BUCKET = 32
#: Ids (16 bytes each) up to which those to drop are broadcast.
MOST_BROADCAST = 1_000_000
#: Fixed value: the generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0xC75


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial: 11 bits."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    """By syndrome, the patterns of at most 4 bits that lead to a codeword; rows of 6, the nearest repeated."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)])
    of, table = syndrome(patterns), [[] for _ in range(2048)]
    for s, p in zip(of.tolist(), patterns.tolist(), strict=True):
        table[s].append(p)
    return np.array([row + row[:1] * (6 - len(row)) for row in table])


ERRORS = _error_table()


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices (12 bits) of the codewords within distance 4, as rows of 6 with repeats."""
    return (words[:, None] ^ ERRORS[syndrome(words)]) >> 11


def golay_keys(fingerprints: np.ndarray) -> np.ndarray:
    """Rows of 18 keys (with repeats) for unsigned fingerprints."""
    parts = [(fingerprints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys = [(i << 34 | parts[i] << 12)[:, None] | codeword_indices(parts[(i + 1) % 3]) for i in range(3)]
    return np.concatenate(keys, axis=1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(gram_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle))


def gram_hashes(words: list[bytes], shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that memory does not follow the longest text
        bits = np.unpackbits(hashes[at : at + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text as a bigint of the same bits."""

    def each(column: pa.Array) -> pa.Array:
        made = np.array([fingerprint(t, shingle) for t in column.to_pylist()], np.uint64)
        return pa.array(made.view(np.int64))

    return with_made_column(docs, name, "bigint", text, each)


def _keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").to_numpy()
            rows = np.sort(golay_keys(f.view(np.uint64)), axis=1)
            first = np.ones(rows.shape, bool)
            first[:, 1:] = rows[:, 1:] != rows[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[first]), pa.array(np.repeat(f, first.sum(1)))], names=["key", "f"])

    return distinct.select("f").mapInArrow(run, "key bigint, f bigint")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints f of a table of different ones which differ in at most two bits."""
    keys = _keys(distinct)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.join(shared, "key"), "golay-keys")
    few = shared.where(F.col("n") <= bucket)
    near = F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) <= 2
    found = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.f") < F.col("y.f")) & near)
    found = found.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))
    many = shared.where(F.col("n") > bucket).select("f").distinct()
    if many.isEmpty():
        return found
    bits = F.expr("array_append(transform(sequence(0, 63), i -> shiftleft(1L, i)), 0L)")
    words = materialise(many.select("f", F.explode(F.transform(bits, lambda b: b.bitwiseXOR(F.col("f")))).alias("w")), "near-words")
    least = words.groupBy("w").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.union(words.join(least, "w").where("a <> f").select("a", F.col("f").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, f (the fingerprint as bigint) and component_id for each row of docs."""
    rows = materialise(fingerprints(docs.select("doc_id", "text"), shingle, name="f").select("doc_id", "f"), "fingerprints")
    distinct = materialise(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct), "a", "b").withColumnRenamed("node", "f")
    of = distinct.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("f", "component_id"), "f")


def similar_groups(docs: DataFrame) -> DataFrame:
    """__id, __digest (of the text) and component for each row of docs, where texts are linked if their fingerprints
    differ in at most two bits or their five-word shingles reach the similarity of similar.SIMILARITY.

    Fingerprints of 64 bits differ in about ten bits at that similarity, which Golay keys cannot search selectively;
    bands of MinHash find those pairs, see similar.py. Nodes are different shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                for t in part.column("text").to_pylist():
                    hashes = gram_hashes((t or "").encode("utf-8", "surrogatepass").lower().split())
                    made.append((majority(hashes), *similar.sketch(hashes)))
                f, s = (pa.array(np.array([m[i] for m in made], np.uint64).view(np.int64)) for i in (0, 1))
                bands, marks = (pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in (3, 4))
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__digest"), f, s, pa.array([m[2] for m in made], pa.int64()), bands, marks], names=["__id", "__digest", "f", "s", "n", "bands", "marks"])

    source = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__digest"), "text")
    kind = source.schema["__id"].dataType.simpleString()
    rows = materialise(source.mapInArrow(run, f"__id {kind}, __digest bigint, f bigint, s bigint, n bigint, bands array<bigint>, marks array<bigint>"), "sketches")
    one = rows.groupBy("s").agg(F.min(F.struct("__id", "__digest", "n", "bands", "marks")).alias("r"))
    nodes = materialise(one.select("s", "r.*"), "nodes")
    owners = materialise(rows.groupBy("f").agg(F.min("s").alias("owner")), "fingerprint-owners")
    same = rows.select("f", "s").distinct().join(owners, "f").where("s <> owner").select(F.col("s").alias("a"), F.col("owner").alias("b"))
    close = links(owners.select("f")).join(owners.select(F.col("f").alias("a"), F.col("owner").alias("__a")), "a").join(owners.select(F.col("f").alias("b"), F.col("owner").alias("__b")), "b")
    roots = similar.groups(nodes, docs, same.union(close.select(F.col("__a").alias("a"), F.col("__b").alias("b"))))
    return rows.select("__id", "__digest", "s").join(roots.withColumnRenamed("node", "s"), "s", "left").select("__id", "__digest", F.coalesce("root", "s").alias("component"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar_groups left: the one with the smallest doc_id (nulls last; of rows
    that share it the one with the smallest digest of its text), with all its columns."""
    found = materialise(similar_groups(docs), "near-duplicates")
    order = F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__digest"))
    kept = found.groupBy("component").agg(F.min(order).alias("__first"), F.count("*").alias("__n"))
    groups = materialise(kept.where("__n > 1").select("component", "__first"), "groups")
    marked = found.join(groups, "component").where(order != F.col("__first")).select(F.col("__id").alias("__i"), F.col("__digest").alias("__d")).distinct()
    gone = broadcast_if_small(materialise(marked, "duplicates"), MOST_BROADCAST)
    keyed = docs.withColumn("__digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")), "left_anti")
    if not found.groupBy("__id", "__digest").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "__digest"])  # repeated rows: one of them stays
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
