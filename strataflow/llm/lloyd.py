"""Centroid clustering by delta Lloyd, in exact integers.

A component x becomes floor(SCALE x). Vectors lie in a bucketed table and never move again; each round reads it beside
the bucketed table of the assignments of the round before (row, cluster, distance), so the two are joined without a
shuffle. Only what can change is compared: vectors whose own centroid moved with all centroids, the others with the
centroids that moved. The round writes the new assignments; vectors with a new owner are written with them. From these
alone come the signed transfers, minus the vector for the old owner and plus for the new one, added up in each task and
then over tasks to one number a cluster and component, by which the sums held at the driver (K times DIM numbers) change.
When no centroid moves, further rounds would change nothing and are left out.

Vectors count whose components are exactly DIM, none null, NaN or infinite; others have no row. The first centroids are
the K vectors with the smallest digests of "SEED:id" (equal digests by the vector; a null id is written as nothing);
fewer vectors give fewer centroids, and none give no rows. Repeated rows are vectors each; ties of distance go to the
smaller number; empty clusters keep their centroid. Components of any finite size are exact: rows beyond SMALL are
computed with Python's whole numbers. A squared distance beyond a bigint is given as the largest bigint, and sums count
it so. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import discard, materialise, new_path

K, ROUNDS, DIM, SEED, SCALE = 8, 10, 64, 3, 1024
#: Whole components below this have exact squares and sums of squares as doubles.
SMALL = 1 << 22
#: A number of a transfer is cut into limbs of so many bits, so that sums fit at any size.
LIMB = 60
#: The largest bigint.
LARGEST = (1 << 63) - 1
#: Spark's own limit of buckets.
MOST_BUCKETS = 100_000
STATE = "row long, cluster int, distance long, owner int, small array<int>, raw array<double>"


def vectors(table: DataFrame, id_: str, values: str) -> DataFrame:
    """id, and the kept vectors: `small` as whole numbers, or `raw` where a component is not small."""
    x = F.col(f"`{values}`").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.where((F.size(x) == DIM) & whole).select(F.col(f"`{id_}`").alias("id"), x.alias("raw"))
    small = F.forall("raw", lambda v: F.abs(v) < SMALL // SCALE)
    rows = rows.withColumn("small", F.when(small, F.transform("raw", lambda v: F.floor(v * SCALE).cast("int"))))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), "small", F.when(F.col("small").isNull(), F.col("raw")).alias("raw"))


def whole(raw: list[float]) -> list[int]:
    """floor(SCALE x) of each x, exactly."""
    return [SCALE * a // b for a, b in (x.as_integer_ratio() for x in raw)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length, none null."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, exact: every number here is whole and below 2 ** 53."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def assigned(centroids: list[list[int]], changed: list[int], first: bool, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of row, small, raw and (unless first) cluster, distance to batches of STATE. keep: whether vectors with a
    new owner are given with it."""
    plain = all(abs(v) < SMALL for c in centroids for v in c)
    table, some = np.array(centroids if plain else [[0] * DIM], np.float64), np.array(changed)

    def slow(x: list[int], owner: int | None, distance: int) -> tuple[int, int]:
        again = owner is None or owner in changed or distance == LARGEST
        known = (distance, owner) if not again else None
        best = min((sum((a - b) ** 2 for a, b in zip(x, centroids[j], strict=True)), j) for j in (range(len(centroids)) if again else changed))
        return min(best, known) if known else best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small, raw, n = batch.column("small"), batch.column("raw"), batch.num_rows
            owner = np.full(n, -1, np.int64) if first else batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            distance = np.full(n, LARGEST, np.int64) if first else batch.column("distance").to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, now = owner.copy(), distance.copy()
            fast = np.flatnonzero(small.is_valid().to_numpy(zero_copy_only=False)) if plain else np.empty(0, np.int64)
            if len(fast):
                x = _matrix(small.take(pa.array(fast)))
                again = np.isin(owner[fast], some) | (owner[fast] < 0)
                d = _squared(x[again], table)
                cluster[fast[again]], now[fast[again]] = d.argmin(1), d.min(1)
                rest = fast[~again]
                if len(rest) and len(some):
                    d = _squared(x[~again], table[some])
                    at, least = some[d.argmin(1)], d.min(1).astype(np.int64)
                    better = (least < distance[rest]) | ((least == distance[rest]) & (at < owner[rest]))
                    cluster[rest[better]], now[rest[better]] = at[better], least[better]
            for i in np.setdiff1d(np.arange(n), fast).tolist():
                x = small[i].as_py() or whole(raw[i].as_py())
                d, at = slow(x, None if owner[i] < 0 else int(owner[i]), int(distance[i]))
                cluster[i], now[i] = at, min(d, LARGEST)
            moved = cluster != owner
            given = pa.array(np.arange(n), mask=~(moved & keep))
            columns = [batch.column("row"), pa.array(cluster, pa.int32()), pa.array(now), pa.array(owner, pa.int32(), mask=~moved), small.take(given), raw.take(given)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "cluster", "distance", "owner", "small", "raw"])

    return run


def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows with a new owner: cluster, place (DIM for the number of vectors), limb and value, added up in the task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        owner, cluster, small, raw = (batch.column(c) for c in ("owner", "cluster", "small", "raw"))
        fast = np.flatnonzero(small.is_valid().to_numpy(zero_copy_only=False))
        slow = [(i, np.array([*whole(raw[i].as_py()), 1], object)) for i in range(batch.num_rows) if not small[i].is_valid]
        x = np.ones((len(fast), DIM + 1), np.int64)
        x[:, :DIM] = _matrix(small.take(pa.array(fast)))
        for sign, side in ((-1, owner), (1, cluster)):
            side = side.to_numpy(zero_copy_only=False)
            for c in np.unique(side[fast]).tolist():
                sums[c] = sums.get(c, 0) + sign * x[side[fast] == c].sum(0).astype(object)
            for i, v in slow:
                sums[int(side[i])] = sums.get(int(side[i]), 0) + sign * v
    rows = []
    for c, row in sums.items():
        for at, v in enumerate(row.tolist() if c >= 0 else ()):
            limb, left, sign = 0, abs(v), -1 if v < 0 else 1
            while left:
                rows.append((c, at, limb, sign * (left & ((1 << LIMB) - 1))))
                limb, left = limb + 1, left >> LIMB
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "limb", "value"])


class _Tables:
    """Bucketed tables by row in the shared folder, dropped at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names = spark, []
        self.buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"{label}_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.option("path", new_path(self.spark, label)).bucketBy(self.buckets, "row").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.names):
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")
            self.names.remove(name)


def clustered(table: DataFrame, id_: str, values: str, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster and distance of each kept vector, and the final centroids as whole numbers."""
    spark = table.sparkSession
    tables = _Tables(spark)
    try:
        held = tables.write(vectors(table, id_, values).repartition(tables.buckets, "row"), "vectors")
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        centroids = [r.small if r.small is not None else whole(r.raw) for r in held.select("small", "raw", digest.alias("d")).orderBy("d", "small", "raw").limit(k).collect()]
        if not centroids:
            return materialise(held.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "clusters"), []
        sums, changed, state = [[0] * (DIM + 1) for _ in centroids], list(range(len(centroids))), None
        for i in range(rounds + 1):
            beside = held.select("row", "small", "raw")
            if state is not None:
                beside = beside.join(state.select("row", "cluster", "distance").hint("shuffle_hash"), "row")
            new = tables.write(beside.mapInArrow(assigned(centroids, changed, state is None, i < rounds), STATE), "assignments")
            if state is not None:
                tables.drop(tables.names[-2])
            state = new
            if i == rounds:
                break
            moves = state.where("owner is not null").select("owner", "cluster", "small", "raw").mapInArrow(transfers, "cluster int, place int, limb int, value long")
            for m in moves.groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
                sums[m.cluster][m.place] += int(m.value) << (LIMB * m.limb)
            after = [[v // s[DIM] for v in s[:DIM]] if s[DIM] else c for s, c in zip(sums, centroids, strict=True)]
            changed = [j for j, (a, b) in enumerate(zip(centroids, after, strict=True)) if a != b]
            centroids = after
            if not changed:
                break
        found = held.select("row", "id").join(state.select("row", "cluster", "distance").hint("shuffle_hash"), "row")
        return materialise(found.select("id", "cluster", "distance"), "clusters"), centroids
    finally:
        tables.drop()


def query(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    found, centroids = clustered(embeddings, "vec_id", "embedding")
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    by_cluster = lambda made: F.get(F.array(*made), F.col("cluster"))
    capped = lambda v: F.lit(min(int(v), LARGEST)).cast("long")
    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids] or [F.lit("")]
    each = by_cluster([capped(inertia.get(j, 0)) for j in range(max(1, len(centroids)))])
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", each.alias("cluster_inertia"), capped(sum(inertia.values())).alias("inertia"), by_cluster(digests).alias("centroid_sha256"))


def _oracle() -> str:
    made = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
    WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS n, q FROM kept QUALIFY n < {K})""",
    ]
    for i in range(ROUNDS + 1):
        made.append(f"""a{i} AS MATERIALIZED (SELECT k, any_value(vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)])::BIGINT, n := c.n)) AS best FROM kept v, c{i} c GROUP BY k)""")
        if i < ROUNDS:
            made.append(f"""u{i} AS (SELECT n, i, (s - ((s % m) + m) % m) // m AS x FROM (SELECT n, i, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT best.n AS n, unnest(range({DIM})) AS i, unnest(q) AS x FROM a{i}) GROUP BY n, i)),
c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(l.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT n, list(x::BIGINT ORDER BY i) AS q FROM u{i} GROUP BY n) l USING (n))""")
    return "WITH " + ",\n".join(made) + f"""
SELECT vec_id, best.n::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.n))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.n = a.best.n"""


ORACLE = _oracle()
