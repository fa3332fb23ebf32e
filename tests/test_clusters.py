"""Profiles of vectors against direct computations."""

import numpy as np
from pyspark.sql import functions as F

from stridelake.operators import clusters


def table(spark, x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 3), (903, [1.0])]
    return clusters.vectors(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v")


def test_profiles(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(5, 0.3, (20, 3)), rng.normal(-5, 0.3, (30, 3))])
    got = {r.id: r.profile for r in clusters.kmeans(clusters.standardised(table(spark, x)), "id", 2, 3).collect()}
    assert got == {i: int(i < 20) for i in range(50)}


def test_components(spark):
    x = np.random.default_rng(2).normal(size=(60, 3)) * [3, 2, 1]
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = clusters.explained_variance(table(spark, x), 3).orderBy("component").collect()
    assert np.allclose([r.share for r in got], want / want.sum()) and abs(got[-1].running - 1) < 1e-9


def test_mixture(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal([0, 0], [0.5, 2.0], (150, 2)), rng.normal([6, 1], [1.0, 0.4], (100, 2))
    rows = [(float(u), float(v), k) for k, x in ((0, a), (1, b)) for u, v in x] + [(None, 1.0, 0)]
    df = spark.createDataFrame(rows, "x double, y double, truth int")
    m = clusters.mixture(df, ["x", "y"], starts=4, ridge=0.01)
    assert np.allclose(m.means, [a.mean(0), b.mean(0)], atol=0.15) and np.allclose(m.variances, [a.var(0) + 0.01, b.var(0) + 0.01], rtol=0.15)
    p = m.predict(df.where("x is not null"))
    assert p.where("profile = truth").count() >= 247 and p.where("membership < 0.5 or membership > 1").count() == 0
    named = p.selectExpr("1 - profile as profile", "if(truth = 0, 'a', 'b') as label")
    assert clusters.aligned(named, "profile", "label", ["a", "b"]) == {0: "b", 1: "a"}


def test_components_for(spark):
    v = spark.createDataFrame([(1, 0.7, 0.7), (2, 0.15, 0.85), (3, 0.15, 1.0)], "component int, share double, running double")
    assert {r.share_of: r.n_components for r in clusters.components_for(v).collect()} == {0.8: 2, 0.9: 3, 0.95: 3}


def test_profiles_transfer(spark):
    """Centres and axes fitted on one table, applied to another, against NumPy."""
    rng = np.random.default_rng(5)
    lab = np.concatenate([rng.normal([0, 0, 0], 1, (80, 3)), rng.normal([6, -4, 2], 1, (50, 3)), rng.normal([-5, 5, 5], 1, (30, 3))])
    home = rng.normal(0, 5, (70, 3))
    frame = lambda x: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(999, [1.0, None, 2.0])], "id int, v array<double>").repartition(3)
    fitted = clusters.Profiles.fit(frame(lab), F.col("v"), k=3, starts=20)
    means = sorted((lab[s].mean(0) for s in (slice(0, 80), slice(80, 130), slice(130, 160))), key=tuple)
    assert np.allclose(fitted.centres, means) and np.isclose(fitted.cost, sum(np.square(lab[s] - lab[s].mean(0)).sum() for s in (slice(0, 80), slice(80, 130), slice(130, 160))))
    got = {r.id: r.p for r in frame(home).select("id", fitted.nearest(F.col("v")).alias("p")).collect()}
    assert got.pop(999) is None
    assert got == dict(enumerate(np.square(home[:, None] - fitted.centres).sum(2).argmin(1).tolist()))
    axes = clusters.Axes.fit(frame(lab), F.col("v"))
    values, vectors = np.linalg.eigh(np.cov(lab.T, bias=True))
    assert np.allclose(axes.share, values[::-1] / values.sum()) and np.allclose(np.abs(axes.axes @ vectors[:, ::-1]), np.eye(3), atol=1e-9)
    scores = {r.id: (r.pc1, r.pc2) for r in frame(home).select("id", *axes.scores(F.col("v"))).collect()}
    assert np.allclose([scores[i] for i in range(70)], (home - lab.mean(0)) @ axes.axes[:2].T)


def test_agreement(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "a"), (0, None), (None, "b"), (1, "c")], "profile int, label string")
    assert clusters.agreement(rows, "profile", "label", ["b", "a"]) == ({0: "a", 1: "b"}, 75.0)
