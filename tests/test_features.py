"""The feature table and its kernels against the blocks that SQL holds, and turns against a direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import features, pairs, signal
from stridelake.plans import recordings as plans
from stridelake.sources.cuts import written

FOLDER = "/root/testdata/sf0.001"
AXES = ["gyro_x", "gyro_y", "gyro_z"]


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 1e-6 * max(1, abs(a))


def test_nonlinear_kernel(spark):
    """All measures from one matrix equal those of the pair joins, for a walk, noise, ties, short and constant series."""
    rng = np.random.default_rng(4)
    series = {1: np.sin(np.arange(160) / 3) + rng.normal(0, 0.1, 160), 2: rng.normal(size=120), 3: rng.integers(0, 4, 90), 4: [1, 2, 3, 5, 4], 5: [2.0] * 30, 6: [1, 2]}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    e = written(pairs.embedded(spark.createDataFrame(rows, "who int, t int, v double"), "who", "t", "v"))
    got = {r.who: r.asDict() for r in pairs.nonlinear(e, "who").collect()}
    singles = {
        "apen": pairs.approximate_entropy(e, "who"), "sampen": pairs.sample_entropy(e, "who").select("who", "sampen"), "symbolic_entropy": pairs.symbolic_entropy(e, "who", "i", "x"),
        "perm_entropy": pairs.permutation_entropy(e, "who"), "rosenstein": pairs.rosenstein(e, "who"), "wolf": pairs.wolf(e, "who"),
    }
    for name, df in singles.items():
        want = {r[0]: r[1] for r in df.collect()}
        for k in (1, 2, 3):
            assert close(got[k][name], want.get(k)), (name, k)
    want = {r.who: r.asDict() for r in pairs.recurrence(e, "who").collect()}
    assert all(close(got[k][c], want[k][c]) for k in (1, 2, 3) for c in pairs.RECURRENCE)
    assert all(got[k][c] is None for k in (5, 6) for c in pairs.NONLINEAR)


@pytest.fixture(scope="module")
def motion(spark):
    kinds = F.array(*[F.lit(a) for a in ("walk", "left_turn", "right_turn", "sit_to_stand", "stand_to_sit")])
    m = plans.motion(spark, FOLDER).withColumns({"patient": F.expr("rec div 5"), "date": F.lit("d"), "activity": F.element_at(kinds, (F.col("rec") % 5 + 1).cast("int"))})
    return written(m)


def test_table_equals_blocks(spark, motion):
    """Unfiltered, each column of the table equals its block's, and the rest follows from them."""
    table = features.table(motion, "patient", "date", "activity", AXES, motion="useracc", free="useracc", gyro="gyro", cutoff=None, cut=written)
    assert table.columns == ["patient", "date", *features.feature_names()] and len(features.feature_names()) == 92
    got = {r.patient: r.asDict() for r in table.collect()}
    of = lambda a: motion.where(F.col("activity") == a)
    blocks = {"": features.walk(of("walk"), "patient", "useracc", "gyro")}
    blocks |= {f"{s}_": features.turn(of(s), "patient", "useracc", "gyro", "gyro_x", cutoff=None) for s in ("left_turn", "right_turn")}
    blocks |= {f"{s}_": features.transition(of(s), "patient", "useracc", "gyro", AXES) for s in ("sit_to_stand", "stand_to_sit")}
    for prefix, block in blocks.items():
        rows = block.collect()
        assert rows
        for r in rows:
            assert all(close(got[r.patient][prefix + n], r[n]) for n in block.columns if n != "patient")
    for r in got.values():
        a, b = r["left_turn_duration"], r["right_turn_duration"]
        assert close(r["turn_duration_difference"], None if a is None or b is None else a - b)
        score, peak = r["sitstand_standsit_xcorr_symmetry_score"], r["sitstand_standsit_xcorr_peak_correlation"]
        assert score is None or close(score, abs(peak))


def test_turn_filters(spark):
    """The magnitude and |axis| are low-passed once more before the span, the velocities and the jerk are taken."""
    fs, n = 50.0, 500
    t = np.arange(n) / fs
    swell = np.exp(-(((t - 5) / 1.5) ** 2))
    rng = np.random.default_rng(6)
    gx, gm = 2 * swell * np.sin(1.3 * t) + rng.normal(0, 0.05, n), 2 * swell + 0.1 * np.abs(rng.normal(0, 1, n))
    df = spark.createDataFrame([(1, i, float(t[i]), 0.1, float(gm[i]), float(gx[i])) for i in range(n)], "k int, i int, t double, acc double, gyro double, gyro_x double")
    got = features.turn(df, "k", "acc", "gyro", "gyro_x").first()
    b, a = signal.butter(4, 5.0, fs)
    mag, vel = signal.both_ways(b, a, gm), signal.both_ways(b, a, np.abs(gx))
    on = np.flatnonzero(mag >= 0.25 * mag.max())
    lo, hi = max(0, on[0] - 5), min(n - 1, on[-1] + 5)
    part = slice(lo, hi + 1)
    assert close(got.duration, t[hi] - t[lo]) and close(got.mean_angular_velocity, vel[part].mean()) and close(got.peak_angular_velocity, vel[part].max())
    assert close(got.ang_vel_std, vel[part].std()) and close(got.jerk_std, np.gradient(vel[part], t[part]).std())


def test_few_steps(spark):
    """Walks with no, one and two steps: intervals, and the lag that regularity takes without them."""
    t = np.arange(0, 8, 0.04)
    bump = lambda *at: sum((3 * np.exp(-(((t - c) / 0.15) ** 2)) for c in at), np.zeros(len(t)))
    series = {0: 0.05 * np.sin(2 * np.pi * 1.5 * t), 1: bump(4.0), 2: bump(3.0, 4.2)}
    rows = [(k, i, float(t[i]), float(v), 1.0) for k, x in series.items() for i, v in enumerate(x)]
    got = {r.k: r for r in features.walk(spark.createDataFrame(rows, "k int, i int, t double, acc double, gyro double"), "k", "acc", "gyro").collect()}
    assert [got[k].step_count for k in (1, 2)] == [1.0, 2.0]
    assert (got[1].mean_step_time, got[1].step_time_std, got[1].step_time_cv) == (1.0, 0.0, 0.0) and abs(got[2].mean_step_time - 1.2) < 0.05
    # No peak reaches the threshold of the quiet walk as such; where there is none, the lag is that of 1.5 Hz.
    if got[0].step_count == 0:
        x = series[0] - series[0].mean()
        lag = round(25 / 1.5)
        assert abs(got[0].step_regularity - (x[lag:] * x[:-lag]).sum() / (x * x).sum()) < 0.05
