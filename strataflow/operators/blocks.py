"""All pairs of a key's rows without gathering a key: pairs of blocks of rows, and blocks that meet a stream of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block on the average; a task pairs two blocks at a time.
SIZE = 512
#: Rows of a block that meets a stream, on the average; a key's rows are dealt once for each of its blocks.
HELD = 8192
#: Rows of a block and of a stream that are paired at once.
TILE = (32, 2048)


def pairs(df: DataFrame, key: str, name: str, made: dict[str, Column], a: str = "a", b: str = "b", size: int = SIZE) -> DataFrame:
    """key and the made columns of each pair of a key's rows with name of `a` below name of `b`, each once. made may refer
    to columns of both as a.x and b.x. Rows go to blocks by a hash of their name, and to every pair of blocks that theirs
    is in; so a key of n rows is n / size times n / size groups of equal size. Rows with a null key or name, and pairs of
    equal names, have no pairs."""
    rows = df.where(F.col(key).isNotNull() & F.col(name).isNotNull())
    blocks = rows.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    placed = rows.join(blocks, F.col(key) == F.col("__key")).withColumn("__at", F.pmod(F.xxhash64(name), F.col("__n")).cast("int"))
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    placed = placed.withColumn("__low", F.least("__at", "__other")).withColumn("__high", F.greatest("__at", "__other"))
    left, right = placed.alias(a), placed.alias(b)
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("__key", "__low", "__high")]
    apart = (F.col(f"{a}.__low") == F.col(f"{a}.__high")) | (F.col(f"{a}.__at") != F.col(f"{b}.__at"))
    on = same[0] & same[1] & same[2] & apart & (F.col(f"{a}.{name}") < F.col(f"{b}.{name}"))
    return left.join(right, on).select(F.col(f"{a}.{key}").alias(key), *(c.alias(k) for k, c in made.items()))


class Meeting(Protocol):
    """What becomes of the rows of a block while the rows of its key pass by."""

    def meet(self, others: pa.RecordBatch, own: np.ndarray) -> None: ...

    def rows(self) -> pa.RecordBatch: ...


def against(df: DataFrame, key: str, name: str, columns: list[str], begin: Callable[[pa.Table], Meeting], kind: str, half: bool = False, size: int = HELD) -> DataFrame:
    """What begin(rows of a block) makes once all rows of the block's key have met it, in the order of their names; of
    type kind. Rows are __key, __name (of a type that Arrow can look up), the columns, and __block (equal numbers: the
    same block). half: a block meets itself and later blocks alone, so each pair of blocks meets once. A task holds one
    block and a batch of the stream at a time, and makes no rows of pairs. Rows with a null key or name are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("__key"), F.col(name).alias("__name"), *columns)
    counts = rows.groupBy(F.col("__key").alias("__k")).agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    placed = rows.join(counts, F.col("__key") == F.col("__k")).withColumn("__at", F.pmod(F.xxhash64("__name"), F.col("__n")).cast("int"))
    place = lambda block, side: F.struct(block.alias("to"), F.lit(side).alias("side"))
    met = F.transform(F.sequence(F.lit(0), F.col("__at") if half else F.col("__n") - 1), lambda b: place(b, 2))
    placed = placed.withColumn("__p", F.explode(F.concat(F.array(place(F.col("__at"), 1)), met)))
    dealt = placed.select("__key", F.col("__at").alias("__block"), F.col("__p.to").alias("__to"), F.col("__p.side").alias("__side"), "__name", *columns)
    marks = counts.select(F.col("__k").alias("__key"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__to"))
    return streamed(dealt, marks, ["__key", "__to"], ["__name", *columns], begin, kind)


def streamed(dealt: DataFrame, marks: DataFrame, keys: list[str], order: list[str], begin: Callable[[pa.Table], Meeting], kind: str) -> DataFrame:
    """What begin(held rows of keys) makes once the rows that pass by, in order, have met it. dealt: held rows have
    __side 1, those that pass by 2; own (in `meet`) tells those whose __block is that of the held rows. marks: a row for
    each value of the keys, which stands where a group begins, so keys are told apart by Spark alone."""
    dealt = dealt.unionByName(marks.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, block = [], None, None
        for batch in batches:
            side = batch.column("__side").to_numpy()
            own = batch.column("__block").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)]
            for start, end in zip([0, *ends], ends):
                if start == end:
                    continue
                piece = batch.slice(start, end - start)
                if side[start] == 0:
                    if state is not None:
                        yield state.rows()
                    held, state = [], None
                elif side[start] == 1:
                    held.append(piece)
                    block = own[start]
                else:
                    if held:
                        held, state = [], begin(pa.Table.from_batches(held))
                    if state is not None:
                        state.meet(piece, own[start:end] == block)
        if state is not None:
            yield state.rows()

    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "__side", *order).mapInArrow(run, kind)


class Names:
    """The names of a block's rows, which must be in order, to find those of others among them."""

    def __init__(self, names: pa.ChunkedArray) -> None:
        self.known = names.unique()
        at = pc.index_in(names, value_set=self.known).to_numpy()
        self.starts = np.searchsorted(at, np.arange(len(self.known) + 1))

    def among(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (in the block, in names) with equal names, by their place in the block."""
        at = pc.index_in(names, value_set=self.known)
        j = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        code = at.drop_null().to_numpy()
        n = self.starts[code + 1] - self.starts[code]
        i = np.repeat(self.starts[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(i, kind="stable")
        return i[order], np.repeat(j, n)[order]


def tiles(n: int, others: int, equal: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[slice, slice, tuple[np.ndarray, np.ndarray]]]:
    """Pieces of a block of n rows and of others that fit the cache, and which places in each are those of equal pairs
    (the places in the block in order)."""
    for j in range(0, others, TILE[1]):
        inside = (equal[1] >= j) & (equal[1] < j + TILE[1])
        rows, columns = equal[0][inside], equal[1][inside] - j
        ends = np.searchsorted(rows, range(0, n + TILE[0], TILE[0])).tolist()
        for k, i in enumerate(range(0, n, TILE[0])):
            here = slice(ends[k], ends[k + 1])
            yield slice(i, min(i + TILE[0], n)), slice(j, min(j + TILE[1], others)), (rows[here] - i, columns[here])
