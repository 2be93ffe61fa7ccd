"""Geostatistics of the points of a surface: variograms from pair sums, kriging, and orders between stacked surfaces.

A surface is a key; its points are (x, y, z). Pair sums are made from pairs of blocks of points, so no surface is
gathered in one task. `kriging_loo` inverts one matrix of a surface's points, so it gathers each surface: it leaves
surfaces of more than MOST points (their rows get null estimates and the reason) to kriging.without, which takes the
nearest points alone. Null coordinates and values are left out; points that coincide must be merged first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import blocks, hulls

#: Rows of surfaces up to which they are broadcast.
MOST_KEYS = 100_000
#: Points of a surface that are solved together: one matrix of 8 * MOST ** 2 bytes.
MOST = 3000
KINDS = ("spherical", "exponential", "gaussian")


def shape(kind: str, h: Column, a: Column) -> Column:
    """The rise of a variogram model of range a at distance h, from 0 to 1."""
    r = h / a
    if kind == "spherical":
        return F.when(r >= 1, 1.0).otherwise(1.5 * r - 0.5 * r * r * r)
    return 1 - F.exp(-3 * r) if kind == "exponential" else 1 - F.exp(-3 * r * r)


def spread(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key and apart, the largest distance between two of a key's points: between two corners of their hull."""
    corners = hulls.hulls(points, key, x, y).select(key, F.explode("hull").alias("p")).select(F.col(key).alias("__h"), "p.x", "p.y")
    corners = corners.withColumn("__i", F.struct("x", "y"))
    far = blocks.pairs(corners, "__h", "__i", {"d": F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))})
    return far.groupBy(F.col("__h").alias(key)).agg(F.max("d").alias("apart"))


class _Lags:
    """Sums by bin of the pairs of a block's points with themselves and with those of later blocks."""

    def __init__(self, rows: pa.Table, bins: int) -> None:
        self.key, self.known = rows.column("__key").combine_chunks().slice(0, 1), blocks.Names(rows.column("__name"))
        self.x, self.y, self.z = (rows.column(c).to_numpy() for c in ("__x", "__y", "__z"))
        self.most, self.bins = rows.column("__most")[0].as_py(), bins
        self.sums = {inside: np.zeros((3, bins + 1)) for inside in (True, False)}

    def meet(self, others: pa.RecordBatch, own: np.ndarray) -> None:
        x, y, z = (others.column(c).to_numpy() for c in ("__x", "__y", "__z"))
        if own.any():
            self._meet(x[own], y[own], z[own], self.known.among(others.column("__name").filter(pa.array(own))), self.sums[True])
        if not own.all():  # equal names are of one block
            none = np.zeros(0, np.int64)
            self._meet(x[~own], y[~own], z[~own], (none, none), self.sums[False])

    def _meet(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, equal: tuple[np.ndarray, np.ndarray], sums: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            for rows, columns, same in blocks.tiles(len(self.x), len(x), equal):
                d, v = self.x[rows, None] - x[None, columns], self.y[rows, None] - y[None, columns]
                d *= d
                v *= v
                d += v
                np.sqrt(d, out=d)
                d[same] = 0
                out = ~((d > 0) & (d <= self.most))
                bin_of = np.minimum(d / (self.most / self.bins), self.bins - 1)
                d[out] = bin_of[out] = 0
                bin_of = bin_of.astype(np.intp)
                bin_of[out] = self.bins
                np.subtract(self.z[rows, None], z[None, columns], out=v)
                v *= v
                bin_of = bin_of.ravel()
                for total, weights in zip(sums, (None, d.ravel(), v.ravel()), strict=True):
                    total += np.bincount(bin_of, weights, self.bins + 1)

    def rows(self) -> pa.RecordBatch:
        # Pairs inside the block were met from both sides.
        n, d, g = (self.sums[True] / 2 + self.sums[False])[:, : self.bins]
        key = self.key.take(pa.array(np.zeros(self.bins, np.int64)))
        made = pa.RecordBatch.from_arrays([key, pa.array(np.arange(self.bins, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(d), pa.array(g / 2)], names=["__key", "bin", "__n", "__d", "__g"])
        return made.filter(pa.array(n > 0))


def lags(points: DataFrame, key: str, name: str, x: str, y: str, z: str, bins: int = 12, size: int = blocks.HELD) -> DataFrame:
    """key, bin, lag, gamma and n: pairs of a surface's points up to half the largest distance, in bins of equal width
    with three pairs or more. Sums are made while points pass by a block of them, so pairs are never rows."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(key, name, x, y, z)
    longest = spread(p, key, x, y).select(F.col(key).alias("__k"), (F.col("apart") / 2).alias("__most"))
    longest = F.broadcast(longest) if longest.limit(MOST_KEYS + 1).count() <= MOST_KEYS else longest
    rows = p.join(longest, F.col(key) == F.col("__k")).select(F.col(key).alias("__at"), F.col(name).alias("__i"), *(F.col(c).cast("double").alias(f"__{a}") for c, a in ((x, "x"), (y, "y"), (z, "z"))), "__most")
    begin = lambda rows: _Lags(rows, bins)
    sums = blocks.against(rows, "__at", "__i", ["__x", "__y", "__z", "__most"], begin, f"__key {points.schema[key].dataType.simpleString()}, bin int, __n long, __d double, __g double", True, size)
    n = F.sum("__n")
    return sums.groupBy(F.col("__key").alias(key), "bin").agg((F.sum("__d") / n).alias("lag"), (F.sum("__g") / n).alias("gamma"), n.alias("n")).where("n >= 3")


def fits(binned: DataFrame, key: str, candidates: int = 60) -> DataFrame:
    """The best variogram of each surface with three bins or more: kind, range, nugget, sill (partial), sse and r2, by
    weighted least squares over candidate ranges from half the shortest lag to three times the longest."""
    name, key, binned = key, "__key", binned.withColumnRenamed(key, "__key")
    ends = binned.groupBy(key).agg((F.min("lag") * 0.5).alias("lo"), (F.max("lag") * 3.0).alias("hi"), F.count("*").alias("m"), (F.sum(F.col("n") * F.col("gamma")) / F.sum("n")).alias("mean")).where("m >= 3")
    steps = F.transform(F.sequence(F.lit(0), F.lit(candidates - 1)), lambda i: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), i / (candidates - 1)))
    tried = ends.select(key, "mean", F.explode(steps).alias("range")).join(binned, key)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), shape(k, F.col("lag"), F.col("range")).alias("f")) for k in KINDS))
    rows = tried.select(key, "mean", "range", "gamma", "n", F.explode(kinds).alias("k")).select(key, "mean", "range", "gamma", "n", "k.*")
    f, g, n = F.col("f"), F.col("gamma"), F.col("n")
    sums = rows.groupBy(key, "mean", "range", "kind").agg(F.sum(n).alias("w"), F.sum(n * f).alias("wf"), F.sum(n * f * f).alias("wff"), F.sum(n * g).alias("wg"), F.sum(n * f * g).alias("wfg"), F.sum(n * g * g).alias("wgg"))
    det = F.col("w") * F.col("wff") - F.col("wf") * F.col("wf")
    free = F.when(F.abs(det) > 1e-12, F.struct(((F.col("wff") * F.col("wg") - F.col("wf") * F.col("wfg")) / det).alias("c0"), ((F.col("w") * F.col("wfg") - F.col("wf") * F.col("wg")) / det).alias("c"))).otherwise(F.struct(F.lit(-1.0).alias("c0"), F.lit(0.0).alias("c")))
    rows = sums.withColumn("u", free)
    rows = rows.withColumn("u", F.when(F.col("u.c0") < 0, F.struct(F.lit(0.0).alias("c0"), F.coalesce(F.try_divide("wfg", "wff"), F.lit(0.0)).alias("c"))).otherwise(F.col("u")))
    rows = rows.withColumn("u", F.when(F.col("u.c") < 0, F.struct((F.col("wg") / F.col("w")).alias("c0"), F.lit(0.0).alias("c"))).otherwise(F.col("u")))
    c0, c = F.col("u.c0"), F.col("u.c")
    sse = F.col("wgg") + c0 * c0 * F.col("w") + c * c * F.col("wff") - 2 * c0 * F.col("wg") - 2 * c * F.col("wfg") + 2 * c0 * c * F.col("wf")
    sst = F.col("wgg") - F.col("mean") * F.col("mean") * F.col("w")
    made = rows.select(key, "kind", "range", c0.alias("nugget"), c.alias("sill"), sse.alias("sse"), F.coalesce(1 - F.try_divide(sse, sst), F.lit(0.0)).alias("r2"))
    return made.groupBy(key).agg(F.min_by(F.struct("kind", "range", "nugget", "sill", "sse", "r2"), F.struct("sse", "kind", "range")).alias("b")).select(F.col(key).alias(name), "b.*")


def _terms(x: np.ndarray, y: np.ndarray, drift: str) -> np.ndarray:
    s = max(np.ptp(x), np.ptp(y), 1.0)
    u, v = (x - x.mean()) / s, (y - y.mean()) / s
    one = np.ones(len(x))
    return np.stack([one] if drift == "constant" else [one, u, v] if drift == "linear" else [one, u, v, u * u, u * v, v * v], 1)


def leave_one_out(x: np.ndarray, y: np.ndarray, z: np.ndarray, nugget: float, sill: float, range_: float, kind: str, drift: str = "constant") -> tuple[np.ndarray, np.ndarray]:
    """Errors (z minus the estimate without the point) and kriging variances of all points, from one inverse."""
    h = np.hypot(x[:, None] - x, y[:, None] - y)
    r = h / range_
    rise = np.where(r >= 1, 1.0, 1.5 * r - 0.5 * r**3) if kind == "spherical" else 1 - np.exp(-3 * r) if kind == "exponential" else 1 - np.exp(-3 * r * r)
    cov = np.where(h <= 1e-9, nugget + sill, sill * (1 - rise)) + np.eye(len(x)) * 1e-10 * ((nugget + sill) or 1.0)
    f = _terms(x, y, drift)
    k = np.block([[cov, f], [f.T, np.zeros((f.shape[1],) * 2)]])
    inverse = np.linalg.inv(k)
    diagonal = np.diag(inverse)[: len(x)]
    return (inverse[: len(x), : len(x)] @ z) / diagonal, 1 / diagonal


def kriging_loo(points: DataFrame, models: DataFrame, key: str, name: str, x: str, y: str, z: str, drift: str = "constant", most: int = MOST) -> DataFrame:
    """name, error, variance and reason of each point: kriging without it (constant drift: ordinary, linear and quadratic:
    universal) with its surface's model. Surfaces without a model, of one point or over most points have a reason."""
    schema = f"`{name}` {points.schema[name].dataType.simpleString()}, error double, variance double, reason string"

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        n = rows.num_rows
        none = [None] * n
        reason = "no model" if not model.num_rows else "few points" if n < 2 else "many points" if n > most else None
        error, variance = none, none
        if n and reason is None:
            m = model.slice(0, 1).to_pylist()[0]
            try:
                e, v = leave_one_out(*(rows.column(c).to_numpy().astype(float) for c in (x, y, z)), m["nugget"], m["sill"], m["range"], m["kind"], drift)
                error, variance = e.tolist(), v.tolist()
            except np.linalg.LinAlgError:
                reason = "singular"
        return pa.table({name: rows.column(name), "error": pa.array(error, pa.float64()), "variance": pa.array(variance, pa.float64()), "reason": pa.array([reason] * n, pa.string())})

    there = points.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(key, name, x, y, z)
    return there.groupBy(key).cogroup(models.select(key, "kind", "range", "nugget", "sill").groupBy(key)).applyInArrow(run, schema)


def order_constraints(units: DataFrame, above: DataFrame, key: str, name: str, young: str, old: str, least: int = 3) -> DataFrame:
    """key, a, b (a < b by name), relation (a over b, b over a, unordered or conflict) and basis (age or superposition) of
    all pairs of a key's units (name, young, old). above (key, a, b, n) counts places that show a over b. Ages that do
    not overlap decide, unless places contradict them; else least or more places, none of them the other way."""
    u = units.select(key, name, young, old)
    pairs = u.alias("p").join(u.alias("q"), (F.col(f"p.{key}") == F.col(f"q.{key}")) & (F.col(f"p.{name}") < F.col(f"q.{name}")))
    rows = pairs.select(F.col(f"p.{key}").alias(key), F.col(f"p.{name}").alias("a"), F.col(f"q.{name}").alias("b"), F.col(f"p.{young}").alias("__ya"), F.col(f"p.{old}").alias("__oa"), F.col(f"q.{young}").alias("__yb"), F.col(f"q.{old}").alias("__ob"))
    ab = above.select(key, "a", "b", F.col("n").alias("__ab"))
    ba = above.select(key, F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("__ba"))
    rows = rows.join(ab, [key, "a", "b"], "left").join(ba, [key, "a", "b"], "left")
    up, down = F.coalesce("__ab", F.lit(0)), F.coalesce("__ba", F.lit(0))
    by_age = F.when(F.col("__oa") <= F.col("__yb"), "a over b").when(F.col("__ob") <= F.col("__ya"), "b over a")
    against = F.when(by_age == "a over b", (down >= least) & (down > up)).otherwise((up >= least) & (up > down))
    seen = F.when((up >= least) & (down == 0), "a over b").when((down >= least) & (up == 0), "b over a")
    relation = F.when(by_age.isNotNull(), F.when(against, "conflict").otherwise(by_age)).otherwise(F.coalesce(seen, F.lit("unordered")))
    basis = F.when(by_age.isNotNull(), "age").when(seen.isNotNull(), "superposition")
    return rows.select(key, "a", "b", relation.alias("relation"), basis.alias("basis"))


def stacked_pair(upper: Column, lower: Column, upper_variance: Column, lower_variance: Column) -> tuple[Column, Column, Column]:
    """Two surfaces kept in order: where upper lies below lower both move to the mean weighted by the inverse variances.
    Their elevations and the larger standard deviation where they were moved (else null)."""
    wa, wb = 1 / upper_variance, 1 / lower_variance
    mean = (wa * upper + wb * lower) / (wa + wb)
    crossed = upper < lower
    return F.when(crossed, mean).otherwise(upper), F.when(crossed, mean).otherwise(lower), F.when(crossed, F.sqrt(F.greatest(upper_variance, lower_variance)))


def projected(z: np.ndarray, pairs: list[tuple[int, int]], weights: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """The nearest elevations (weighted squares) to each row of z with z[a] >= z[b] for all pairs, by Dykstra's sweeps
    over all rows at once."""
    z, steps = z.astype(float).copy(), np.zeros((len(pairs), len(z), 2))
    for _ in range(sweeps):
        before = z.copy()
        for k, (a, b) in enumerate(pairs):
            up, low = z[:, a] + steps[k, :, 0], z[:, b] + steps[k, :, 1]
            mean = (weights[a] * up + weights[b] * low) / (weights[a] + weights[b])
            na, nb = np.where(up >= low, up, mean), np.where(up >= low, low, mean)
            steps[k, :, 0], steps[k, :, 1] = up - na, low - nb
            z[:, a], z[:, b] = na, nb
        if np.abs(z - before).max(initial=0.0) < 1e-9:
            break
    for _ in range(len(pairs)):  # what rounding left
        for a, b in pairs:
            z[:, b] = np.minimum(z[:, b], z[:, a])
    return z
