"""Profiles of vectors: standardising, k-means and Gaussian mixtures with restarts, principal components, labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, key: str, values: str) -> DataFrame:
    """Key and vector of rows without missing or non-finite values; all are of the commonest length."""
    d = df.where(F.col(values).isNotNull()).select(key, F.col(values).cast("array<double>").alias("_v"))
    d = d.where(F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    sizes = d.groupBy(F.size("_v").alias("s")).count().agg(F.max(F.struct("count", "s")).alias("m")).select(F.col("m.s").alias("s"))
    d = d.crossJoin(F.broadcast(sizes)).where(F.size("_v") == F.col("s"))  # sizes: one row
    return d.select(key, array_to_vector("_v").alias("features"))


def standardised(v: DataFrame) -> DataFrame:
    """Each component less its mean, over its sample deviation (a constant factor off the population one; see Scaler)."""
    model = StandardScaler(inputCol="features", outputCol="_z", withMean=True).fit(v)
    return model.transform(v).drop("features").withColumnRenamed("_z", "features")


def _summed(rows: DataFrame, zero: np.ndarray, each) -> np.ndarray:
    """Sum of each(matrix of a batch) over the batches of the array column x; tasks hand on one array each."""

    def run(batches):
        total = zero.copy()
        for batch in batches:
            x = batch.column("x")
            if len(x):
                total += each(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.select("x").mapInArrow(run, "part binary").rdd
    return parts.treeAggregate(zero, lambda t, r: t + np.frombuffer(r.part).reshape(zero.shape), lambda t, u: t + u)


def _drawn(rows: DataFrame, seed: int, most: int = 2_000) -> np.ndarray:
    """`most` rows at the most, by a hash of their values: the same in any order and number of tasks."""
    return np.array([r.x for r in rows.orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(most).collect()], float)


def _spread_out(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance from those before."""
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(1, k):
        d = np.min([np.square(sample - c).sum(1) for c in centres], axis=0)
        centres.append(sample[rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))])
    return np.array(centres)


@dataclass
class Profiles:
    """Centres of k-means, in order; they can be applied to any rows with as many values, in this order."""

    centres: np.ndarray
    cost: float

    @classmethod
    def fit(cls, rows: DataFrame, values: Column, k: int = 2, starts: int = 100, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> Profiles:
        """The cheapest of `starts` fits. A round is one pass over the rows for all starts that still move; starting
        centres are spread out among 2,000 rows. Rows with a missing value take no part."""
        d = rows.select(values.cast("array<double>").alias("x")).where(~F.exists("x", lambda c: c.isNull() | F.isnan(c))).persist()
        sample = _drawn(d, seed)
        if not len(sample):
            raise ValueError("no complete rows")
        p = sample.shape[1]
        centres = np.array([_spread_out(sample, k, np.random.default_rng(seed + s)) for s in range(starts)])
        least = tolerance * sample.var(0).mean()
        cost, open_ = np.full(starts, np.inf), np.arange(starts)
        for i in range(rounds + 1):
            now = centres[open_]

            def each(x, now=now):
                far = (np.square(now).sum(2).reshape(-1) - 2 * x @ now.reshape(-1, p).T).reshape(len(x), len(now), k) + np.square(x).sum(1)[:, None, None]
                mine = (far.argmin(2)[:, :, None] == np.arange(k)).astype(float)
                one = np.concatenate([x, np.ones((len(x), 1))], 1)
                sums = np.einsum("nsk,np->skp", mine, one, optimize=True)
                return np.concatenate([sums, (mine * far).sum(0)[:, :, None]], 2)

            got = _summed(d, np.zeros((len(now), k, p + 2)), each)
            cost[open_] = got[:, :, -1].sum(1)
            if i == rounds:
                break
            count = got[:, :, p]
            moved = np.where(count[:, :, None] > 0, got[:, :, :p] / np.maximum(count, 1)[:, :, None], now)
            still = np.square(moved - now).sum((1, 2)) > least
            centres[open_] = np.where(still[:, None, None], moved, now)
            open_ = open_[still]
            if not len(open_):
                break
        d.unpersist()
        best = int(cost.argmin())
        order = sorted(range(k), key=lambda j: tuple(centres[best][j]))
        return cls(centres[best][order], float(cost[best]))

    def nearest(self, values: Column) -> Column:
        """Number of the nearest centre (from 0, the first of equal ones); null where a value is missing."""
        far = lambda centre: sum((F.pow(F.get(values, F.lit(q)) - float(c), F.lit(2.0)) for q, c in enumerate(centre)), F.lit(0.0))
        d = F.array(*[far(c) for c in self.centres])
        return F.when(~F.exists(values, lambda c: c.isNull() | F.isnan(c)), F.array_position(d, F.array_min(d)).cast("int") - 1)


@dataclass
class Axes:
    """Principal axes of a table, by falling variance; each axis' largest weight is positive."""

    mean: np.ndarray
    axes: np.ndarray  # a row each
    share: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, values: Column) -> Axes:
        """From the means and the covariance of the complete rows, a pass each."""
        d = rows.select(values.cast("array<double>").alias("x")).where(~F.exists("x", lambda c: c.isNull() | F.isnan(c)))
        first = d.first()
        if first is None:
            raise ValueError("no complete rows")
        p = len(first.x)
        total = _summed(d, np.zeros(p + 1), lambda x: np.append(x.sum(0), len(x)))
        mean = total[:p] / total[p]
        values_, axes = np.linalg.eigh(_summed(d, np.zeros((p, p)), lambda x: (x - mean).T @ (x - mean)) / total[p])
        axes = axes[:, ::-1].T
        # Of weights that are equal but for rounding the first decides.
        largest = axes[np.arange(p), np.abs(axes).round(9).argmax(1)]
        return cls(mean, axes * np.where(largest < 0, -1.0, 1.0)[:, None], np.maximum(values_[::-1], 0) / max(values_.sum(), 1e-300))

    def scores(self, values: Column, k: int = 2) -> list[Column]:
        """The first k scores of rows of as many values, pc1 and on."""
        score = lambda axis: sum(((F.get(values, F.lit(q)) - float(m)) * float(w) for q, (m, w) in enumerate(zip(self.mean, axis))), F.lit(0.0))
        return [score(a).alias(f"pc{i + 1}") for i, a in enumerate(self.axes[:k])]


def kmeans(v: DataFrame, key: str, k: int = 2, starts: int = 100, seed: int = 42) -> DataFrame:
    """Profile of each row from the cheapest of `starts` fits; profiles are numbered by their centroids' order."""
    x = vector_to_array("features")
    return v.select(key, Profiles.fit(v, x, k, starts, seed).nearest(x).alias("profile"))


def explained_variance(v: DataFrame, k: int) -> DataFrame:
    """Share of the variance and running share of the first k principal components."""
    share = PCA(k=k, inputCol="features", outputCol="_p").fit(v).explainedVariance.toArray()
    rows = [(i + 1, float(s), float(share[: i + 1].sum())) for i, s in enumerate(share)]
    return v.sparkSession.createDataFrame(rows, "component int, share double, running double")


@dataclass
class Scaler:
    """Column means and population deviations of a table of profiles; constant columns are only centred."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, rows: DataFrame, columns: list[str]) -> Scaler:
        got = rows.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        n = len(columns)
        return cls(columns, [float(m or 0.0) for m in got[:n]], [float(s or 1.0) for s in got[n:]])

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.scale)})


@dataclass
class Mixture:
    """Gaussian mixture with diagonal covariances; components in order of their means."""

    columns: list[str]
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    likelihood: float

    def log_densities(self) -> list[Column]:
        out = []
        for w, mean, var in zip(self.weights, self.means, self.variances):
            base = float(np.log(w) - 0.5 * np.log(2 * np.pi * var).sum())
            out.append(F.lit(base) - sum((F.pow(F.col(c) - float(m), F.lit(2.0)) / float(2 * v) for c, m, v in zip(self.columns, mean, var)), F.lit(0.0)))
        return out

    def predict(self, rows: DataFrame, profile: str = "profile", membership: str = "membership") -> DataFrame:
        """rows with their likeliest component and its probability."""
        logs = self.log_densities()
        d = rows.withColumn("_l", F.array(*logs)).withColumn("_x", F.array_max("_l"))
        total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_x")))
        return d.withColumn(profile, F.array_position("_l", F.col("_x")).cast("int") - 1).withColumn(membership, 1 / total).drop("_l", "_x")


def mixture(rows: DataFrame, columns: list[str], k: int = 2, starts: int = 100, seed: int = 42, ridge: float = 0.10, rounds: int = 100, tolerance: float = 1e-3) -> Mixture:
    """The likeliest of `starts` fits by expectation maximisation; `ridge` is added to every variance.

    A round is one pass over the complete rows for all starts that still gain; starting means are spread out among 2,000
    rows drawn by a hash of the values."""
    d = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).persist()
    sample, p = _drawn(d, seed), len(columns)
    if len(sample) < k:
        raise ValueError("fewer complete rows than components")
    base = sample.mean(0)  # near the middle, so that squares lose no digits
    total = _summed(d, np.zeros((3, p)), lambda x: np.array([(x - base).sum(0), np.square(x - base).sum(0), np.full(p, float(len(x)))]))
    n = total[2, 0]
    spread = np.maximum(total[1] / n - np.square(total[0] / n), 0) + ridge
    means = np.array([_spread_out(sample, k, np.random.default_rng(seed + s)) for s in range(starts)]) - base
    variances, weights = np.tile(spread, (starts, k, 1)), np.full((starts, k), 1 / k)
    likelihood, open_ = np.full(starts, -np.inf), np.arange(starts)
    for _ in range(rounds):
        m, v, w = means[open_], variances[open_], weights[open_]
        flat = (np.log(w) - 0.5 * (np.log(2 * np.pi * v) + m * m / v).sum(2)).reshape(-1)

        def each(x, m=m, v=v, flat=flat):
            y = x - base
            logs = (flat + y @ (m / v).reshape(-1, p).T - 0.5 * (y * y) @ (1 / v).reshape(-1, p).T).reshape(len(y), len(m), k)
            top = logs.max(2, keepdims=True)
            part = np.exp(logs - top)
            mass = part.sum(2, keepdims=True)
            seen = np.concatenate([y, y * y, np.ones((len(y), 1))], 1)
            sums = np.einsum("nsk,np->skp", part / mass, seen, optimize=True)
            gain = np.zeros((len(m), k, 1))
            gain[:, 0, 0] = (top + np.log(mass)).sum((0, 2))
            return np.concatenate([sums, gain], 2)

        got = _summed(d, np.zeros((len(open_), k, 2 * p + 2)), each)
        mass = np.maximum(got[:, :, 2 * p], 1e-12)[:, :, None]
        means[open_] = got[:, :, :p] / mass
        variances[open_] = np.maximum(got[:, :, p : 2 * p] / mass - np.square(means[open_]), 0) + ridge
        weights[open_] = mass[:, :, 0] / mass[:, :, 0].sum(1, keepdims=True)
        now = got[:, 0, -1] / n
        still = now - likelihood[open_] > tolerance
        likelihood[open_] = now
        open_ = open_[still]
        if not len(open_):
            break
    d.unpersist()
    best = int(likelihood.argmax())
    order = sorted(range(k), key=lambda j: tuple(means[best][j]))
    return Mixture(columns, weights[best][order], means[best][order] + base, variances[best][order], float(likelihood[best]))


def agreement(rows: DataFrame, profile: str, label: str, labels: list) -> tuple[dict, float | None]:
    """The alignment of profiles to labels, and the percentage of labelled rows whose profile stands for their label."""
    names = aligned(rows, profile, label, labels)
    known = rows.where(F.col(profile).isNotNull() & F.col(label).isin(labels))
    hit = reduce(lambda a, b: a | b, [(F.col(profile) == i) & (F.col(label) == v) for i, v in names.items()])
    return names, known.agg(100 * F.avg(hit.cast("int"))).first()[0]


def aligned(rows: DataFrame, profile: str, label: str, labels: list) -> dict:
    """Which label each profile stands for: of all assignments of profiles 0 .. k - 1 to the labels the one that agrees
    with most rows, the first of equal ones."""
    got = {(r[0], r[1]): r[2] for r in rows.where(F.col(profile).isNotNull() & F.col(label).isin(labels)).groupBy(profile, label).count().collect()}  # k * k rows
    best = max(permutations(labels), key=lambda p: sum(got.get((i, v), 0) for i, v in enumerate(p)))
    return dict(enumerate(best))


def components_for(variance: DataFrame, shares: tuple = (0.80, 0.90, 0.95)) -> DataFrame:
    """How many components reach each share of the variance, from explained_variance."""
    every = variance.sparkSession.createDataFrame([(float(s),) for s in shares], "share_of double")
    return variance.select("component", "running").join(F.broadcast(every), F.col("running") >= F.col("share_of") - 1e-12).groupBy("share_of").agg(F.min("component").alias("n_components"))
