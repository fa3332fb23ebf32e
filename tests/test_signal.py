"""Filters, peaks and spectra, which SQL does not express, against direct computations."""

import numpy as np

from stridelake.operators import signal


def frame(spark, *series):
    rows = [(k, i, None if v is None else float(v)) for k, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "k int, i int, v double")


def test_low_pass(spark):
    t = np.arange(500) / 25
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 11 * t)
    cut = np.sin(2 * np.pi * 5 * t)
    got = signal.low_pass(frame(spark, slow + fast, cut, [1, 2, 3], [4] * 30 + [None, 4]), "k", "i", "v", 5.0, 25.0).toPandas()
    of = lambda k: got[got.k == k].sort_values("i").filtered.to_numpy(float)
    assert np.abs(of(0) - slow)[25:-25].max() < 0.01
    assert np.allclose(of(1)[100:-100], cut[100:-100] / 2, atol=1e-6)  # each pass takes 3 dB at the cutoff
    assert of(2).tolist() == [1, 2, 3]
    assert np.isnan(of(3)[30]) and np.allclose(np.delete(of(3), 30), 4)


def brute_peaks(x, distance):
    found = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1]]
    kept = []
    for i in sorted(found, key=lambda i: (-x[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return sorted(kept)


def test_peaks(spark):
    rng = np.random.default_rng(3)
    x = rng.permutation(200)
    got = signal.peaks(frame(spark, x, [0, 2, 2, 2, 0], [1], [3, 3]), "k", "i", "v", distance=5).collect()
    assert sorted(r.i for r in got if r.k == 0) == brute_peaks(x, 5)
    assert [(r.k, r.i) for r in got if r.k > 0] == [(1, 2)]
    assert not signal.peaks(frame(spark), "k", "i", "v").collect()


def test_spectral_entropy(spark):
    rng = np.random.default_rng(4)
    tone = np.sin(2 * np.pi * np.arange(1024) / 8)
    got = {r.k: r.spectral_entropy for r in signal.spectral_entropy(frame(spark, tone, rng.normal(size=4096), [5] * 20, [1]), "k", "i", "v").collect()}
    assert got[0] < 0.25 and got[1] > 0.95 and got[2] is None and got[3] is None
