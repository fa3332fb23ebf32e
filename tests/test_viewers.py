"""Viewers' turns and walks against direct computations with loops."""

import numpy as np

from stridelake.operators import segments, signal, viewers
from stridelake.sources.cuts import written

FS = 50.0


def recording(seed, seconds=24, until=20):
    """A turn of one or two strong bursts with a weak one before, and steps up to a time."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * FS)) / FS
    v = sum(h * np.exp(-((t - at) ** 2) / w) for at, h, w in ((4, 0.12, 0.2), (10 + seed, 3.0, 1.5), (15, 2.0 * (seed % 2), 0.6)))
    acc = 1 + 0.4 * np.sin(2 * np.pi * 1.8 * t + seed) * ((t > 3) & (t < until)) + rng.normal(0, 0.03, len(t))
    return t, v * np.where(np.arange(len(t)) % 7, 1, -1) + rng.normal(0, 0.005, len(t)), acc


def table(spark, found):
    rows = [(k, i, float(t[i]), float(v[i]), float(a[i])) for k, (t, v, a) in found.items() for i in range(len(t))]
    return spark.createDataFrame(rows, "k int, i int, t double, v double, a double").repartition(3)


def edges(smooth, at, limit):
    """First and last place of the steps: direct, by loops."""
    a, b = at[0], at[-1]
    while a > 0 and smooth[a - 1] >= limit:
        a -= 1
    while b < len(smooth) - 1 and smooth[b] >= limit:
        b += 1
    return a, b


def strong_runs(v, limit, fs):
    on = v >= limit
    n, hits, runs = len(v), np.flatnonzero(v >= limit), []
    for i in hits:
        if runs and i - runs[-1][1] - 1 <= max(1, round(0.15 * fs)):
            runs[-1][1] = i
        else:
            runs.append([i, i])
    top = v[on].max()
    runs = [r for r in runs if r[1] - r[0] + 1 >= max(1, round(0.2 * fs)) and v[r[0] : r[1] + 1].max() >= max(limit, 0.15 * top)]
    pad = max(1, round(0.15 * fs))
    return max(0, runs[0][0] - pad), min(n - 1, runs[-1][1] + pad)


def test_viewed_turn(spark):
    found = {k: recording(k) for k in (0, 1, 3)}
    df = table(spark, found)
    broad = {r.k: r for r in segments.turn_span(df.selectExpr("k", "i", "t", "abs(v) AS v"), "k", "i", "t", "v").collect()}
    got = {r.k: r for r in viewers.viewed_turn(df, "k", "a", "v", cut=written).collect()}
    assert set(got) == set(found)
    for k, (t, v, acc) in found.items():
        v, r = np.abs(v), got[k]
        a, b = strong_runs(v, broad[k].threshold, FS)
        smooth = signal.gaussian(acc[a : b + 1], 1.0)
        at = signal.found_peaks(smooth, max(1, round(0.37 * FS)), smooth.mean())
        first, last = edges(smooth, at, smooth.mean())
        assert len(at) > 2 and r.step_count == len(at) and abs(r.step_threshold - smooth.mean()) < 1e-9
        assert (r.start, r.end) == (t[a + first], t[a + last]) and abs(r.steps_per_second - len(at) / (r.end - r.start)) < 1e-9
        inner = v[a + first : a + last + 1]
        assert abs(r.peak_angular_velocity - inner.max()) < 1e-9 and abs(r.mean_angular_velocity - inner.mean()) < 1e-9


def test_viewed_turn_cases(spark):
    """Still recordings, those of two samples, nulls, and an acceleration without peaks."""
    n = 500
    t = np.arange(n) / FS
    v = 2 * np.exp(-((t - 5) ** 2))
    rows = [(1, i, float(t[i]), 0.0, 1.0) for i in range(n)] + [(2, i, float(t[i]), 1.0, 1.0) for i in range(2)]
    rows += [(3, i, float(t[i]), float(v[i]), float(t[i])) for i in range(n)] + [(4, i, float(t[i]), float(v[i]), None) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, t double, v double, a double")
    got = {r.k: r for r in viewers.viewed_turn(df, "k", "a", "v", cut=written).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3].step_count == 0 and got[4].step_count is None
    assert 2 < got[3].start < 5 < got[3].end < 8 and (got[3].start, got[3].end) == (got[4].start, got[4].end)
    assert abs(got[3].peak_angular_velocity - 2) < 1e-6 and got[1].peak_angular_velocity == 0
    report = {r.k: r for r in viewers.reported_turn(df, "k", "a", "v", cut=written).collect()}
    assert report[3].step_count == 0 and report[3].pause_time >= 0 and report[4].step_count is None
    assert viewers.viewed_turn(df.where("false"), "k", "a", "v", cut=written).count() == 0
    assert {r.k for r in viewers.viewed_walk(df, "k", "a", cut=written).collect()} == {1, 2, 3}


def test_reported_turn(spark):
    found = {k: recording(k) for k in (0, 1)}
    df = table(spark, found)
    got = {r.k: r for r in viewers.reported_turn(df, "k", "a", "v", cut=written).collect()}
    for k, (t, v, acc) in found.items():
        v, r = np.abs(v), got[k]
        inside = (t >= r.start) & (t <= r.end)
        smooth = signal.gaussian(acc[inside], 1.0)
        assert r.step_count == len(signal.found_peaks(smooth, int(0.45 * FS), smooth.mean())) > 0
        quiet, at, spans = v[inside] < r.threshold, t[inside], []
        edge = np.flatnonzero(np.diff(np.r_[0, quiet.astype(int), 0]))
        spans = [at[e - 1] - at[s] for s, e in zip(edge[::2], edge[1::2]) if e - s >= 2]
        assert abs(r.pause_time - sum(s for s in spans if s >= 0.6 * np.median(spans))) < 1e-9


def test_viewed_walk(spark):
    found = {k: recording(k, until=6 + 3 * k) for k in (0, 1, 2)}
    df = table(spark, found)
    span = {r.k: r for r in segments.active_span(df, "k", "t", "a", cap=None, least=1.0).collect()}
    got = {r.k: r for r in viewers.viewed_walk(df, "k", "a", cut=written).collect()}
    for k, (t, _, acc) in found.items():
        r, limit = got[k], span[k].threshold
        at_span = np.flatnonzero((t >= span[k].start) & (t <= span[k].end))
        x = acc[at_span]
        smooth = signal.gaussian(x, 2.0)
        at = signal.found_peaks(smooth, max(1, round(0.37 * FS)), limit, limit)
        a, b = edges(smooth, at, limit) if len(at) else (0, len(x) - 1)
        gaps = np.diff(t[at_span][at])
        assert r.step_count == len(at)
        if len(at) > 1:
            assert (r.start, r.end) == (t[at_span[a]], t[at_span[b]]) and abs(r.cadence - 60 * len(at) / (r.end - r.start)) < 1e-9
            assert abs(r.mean_step_time - gaps.mean()) < 1e-9 and abs(r.step_time_cv - gaps.std() / gaps.mean()) < 1e-9
            lag, c = int(round(gaps.mean() * FS)), x - x.mean()
            assert abs(r.step_regularity - (c[lag:] * c[:-lag]).sum() / (c * c).sum()) < 1e-9
    assert any(r.step_count > 5 for r in got.values())


def test_activity_score(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=40), np.r_[np.zeros(38), 5.0, 9.0]  # y: no MAD, so its deviation counts
    rows = [("a", i, float(x[i]), float(y[i]), 1.0) for i in range(40)] + [("b", 0, 1.0, 1.0, 1.0), ("b", 1, 1.0, None, 1.0), ("c", 0, None, None, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double, flat double")
    got = {(r.k, r.i): r.score for r in viewers.activity_score(df, "k", ["x", "y", "flat"]).collect()}
    d = np.abs(x - np.median(x))
    want = np.maximum(d / (1.4826 * np.median(d)), y / y.std())
    assert all(abs(got["a", i] - want[i]) < 1e-9 for i in range(40)) and got["b", 0] is None and got["c", 0] is None
