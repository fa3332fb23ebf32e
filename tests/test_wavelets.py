"""Wavelet power of known chirps against a direct transform in time; ridges and their continuity against plain loops."""

import numpy as np

from stridelake.operators import wavelets


def direct(x, fs, hz, size):
    """The transform by its definition: the inverse Fourier integral of the wavelet at each lag, summed over samples."""
    peak = (90 / 3) ** (1 / 3)
    scale = peak * fs / (2 * np.pi * hz)
    grid = np.arange(size) * 2 * np.pi / size
    grid = np.where(grid > np.pi, 0, grid) * scale
    gain = np.where(grid > 0, 2 * (np.maximum(grid, 1e-300) / peak) ** 90 * np.exp(-(grid**3) + peak**3), 0)
    kernel = np.array([(gain * np.exp(2j * np.pi * np.arange(size) * lag / size)).sum() / size for lag in range(size)])
    n = len(x)
    return np.array([sum(x[j] * kernel[(i - j) % size] for j in range(n)) for i in range(n)])


def test_power_of_chirp(spark):
    fs, n = 10, 300
    t = np.arange(n) / fs
    x = np.sin(2 * np.pi * (1.0 * t + 0.02 * t * t))  # 1.0 to 2.2 Hz
    quiet = np.zeros(50)
    long = np.concatenate([quiet, x * wavelets.tapered(n), quiet])
    size = 2 << int(np.ceil(np.log2(len(long))))
    before = (size - len(long)) // 2
    padded = np.pad(long, (before, size - len(long) - before), "reflect")
    power = wavelets.bout_power(x, fs)
    for b in (5, 20, 40):
        want = np.abs(direct(padded, fs, wavelets.FREQUENCIES[b], size)[before + 50 : before + 50 + n]) ** 2
        assert np.allclose(power[b], want, rtol=1e-6, atol=1e-9)
    rows = [(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 1.0)] + [(3, i, 0.0) for i in range(25)]
    table = spark.createDataFrame(rows, "k int, i int, v double")
    got = wavelets.wavelet_power(table, "k", "i", "v").toPandas()
    assert set(got.k) == {1, 3} and len(got[got.k == 1]) == 80 * 30 and got[got.k == 3].power.max() == 0
    mine = got[got.k == 1].pivot(index="bin", columns="second", values="power").to_numpy()
    assert np.allclose(mine, power.reshape(80, 30, 10).sum(2))
    top = wavelets.FREQUENCIES[mine.argmax(0)][4:-4]
    assert np.abs(top - (1.0 + 0.04 * (np.arange(30)[4:-4] + 0.5))).max() < 0.11
    squeezed = wavelets.bout_power(x, fs, True).reshape(80, 30, 10).sum(2)
    near = np.array([squeezed[max(0, b - 2) : b + 3, s].sum() / squeezed[:, s].sum() for s, b in enumerate(mine.argmax(0))])
    wide = np.array([mine[max(0, b - 2) : b + 3, s].sum() / mine[:, s].sum() for s, b in enumerate(mine.argmax(0))])
    assert (near[4:-4] > 0.9).all() and near[4:-4].mean() > wide[4:-4].mean() + 0.1


def test_bouts(spark):
    make = lambda k, n, step: [(k, i * step, float(i)) for i in range(n)]
    rows = make(1, 28, 0.1) + make(2, 26, 0.1) + make(3, 5, 0.1) + make(4, 1, 0.1) + make(5, 41, 0.05) + [(6, None, 1.0), (6, 1.0, None)]
    got = wavelets.even_bout(spark.createDataFrame(rows, "rec int, t double, v double"), "rec", "t", "v").toPandas()
    assert dict(got.groupby("rec").size()) == {1: 30, 2: 20, 5: 20}
    one = got[got.rec == 1].sort_values("k").value.to_numpy()
    assert np.allclose(one[:27], np.arange(27)) and np.allclose(one[27:], 26)


def test_steps(spark):
    """30 s of steps at 1.8 Hz amid rest; a recording of rest only; one of a tone out of the range of steps."""
    t = np.arange(0, 60, 0.04)
    walk = np.where((t >= 15) & (t < 45), np.sin(2 * np.pi * 1.8 * t), 0.0)
    rows = [(1, float(a), float(v)) for a, v in zip(t, walk)] + [(2, float(a), 0.0) for a in t[:200]] + [(3, float(a), float(np.sin(2 * np.pi * 3.6 * a))) for a in t]
    got = {r.rec: r for r in wavelets.wavelet_steps(spark.createDataFrame(rows, "rec int, t double, v double"), "rec", "t", "v").collect()}
    assert abs(got[1].start - 15) <= 1 and abs(got[1].end - 45) <= 1.1 and abs(got[1].cadence - 108) < 3 and abs(got[1].step_count - 54) < 4
    assert got[2].step_count == got[3].step_count == 0 and got[2].cadence is None


def brute_lasting(bins, least, delta):
    """Every slice of `least` seconds in which all have a ridge and neighbours are close, by its seconds."""
    keep = set()
    for s in range(len(bins) - least + 1):
        part = bins[s : s + least]
        if all(b is not None for b in part) and all(abs(a - b) <= delta for a, b in zip(part, part[1:])):
            keep |= set(range(s, s + least))
    return keep


def test_lasting(spark):
    rng = np.random.default_rng(1)
    series = {k: [None if rng.random() < 0.15 else int(rng.integers(0, 12)) for _ in range(80)] for k in range(4)}
    rows = [(k, s, b) for k, bins in series.items() for s, b in enumerate(bins) if b is not None]
    table = spark.createDataFrame(rows, "k int, second long, bin int")
    for least, delta in ((2, 3), (3, 5), (4, 20)):
        got = {(r.k, r.second) for r in wavelets.lasting(table, "k", least, delta).collect()}
        assert got == {(k, s) for k, bins in series.items() for s in brute_lasting(bins, least, delta)}
