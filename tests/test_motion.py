"""Motion capture and lab summaries against direct computations on trials that the tests make."""

import numpy as np
from pyspark.sql import functions as F

from stridelake.operators import lab, mocap, signal
from stridelake.sources import mocap as exports
from stridelake.sources.cuts import written

FS = 100.0


def export(markers, xyz):
    """A CSV export of trajectories."""
    lines = ["Trajectories", str(FS), ",," + ",".join(f"s1:{m},," for m in markers), "Frame,Sub Frame," + ",".join("X,Y,Z" for _ in markers), ",," + ",".join("mm,mm,mm" for _ in markers)]
    for i in range(len(xyz)):
        lines.append(f"{i + 1},0," + ",".join("" if np.isnan(v) else f"{v:.6f}" for v in xyz[i].ravel()))
    return "Devices\n1,2\n\n" + "\n".join(lines) + "\n\n"


def walker(n=1200):
    """Feet that swing, with each marker's speed rising at every step."""
    t = np.arange(n) / FS
    out = []
    for k, m in enumerate(mocap.FEET):
        phase = 2 * np.pi * 0.9 * t + (np.pi if m.startswith("L") else 0) + 0.05 * k
        out.append(np.stack([300 * t + 80 * np.sin(phase), 5 * np.cos(phase), 40 * np.maximum(0, np.sin(phase))], 1))
    return t, np.stack(out, 1)


def direct_peaks(xyz, distance):
    v = np.linalg.norm(np.gradient(xyz, 1 / FS, axis=0), axis=1)
    s = signal.gaussian(v, max(FS * 0.035, 1))
    mad = 1.4826 * np.median(np.abs(s - np.median(s)))
    return signal.found_peaks(s, int(round(distance * FS)), np.median(s) + 1.5 * mad, max(mad, 0.15 * s.std()))


def test_export():
    t, xyz = walker(30)
    xyz[3, 1] = np.nan
    rows = list(exports.trajectories("p", export(mocap.FEET, xyz)))
    assert len(rows) == 30 * 4 and rows[0][:6] == ("p", FS, "mm", 1, 0, "RHEE") and rows[13][6:] == (None, None, None)
    assert np.allclose([r[6:] for r in rows if r[5] == "RMT2"], xyz[:, 2], atol=1e-6)
    assert not list(exports.trajectories("p", "a,b\n1,2\n")) and not list(exports.trajectories("p", ""))


def test_direct_steps():
    t, xyz = walker()
    at = t[direct_peaks(xyz[:, 0], 0.35)]
    assert len(at) in (10, 11) and np.abs(np.diff(at) - 1 / 0.9).max() < 0.1


def test_ten_steps(spark):
    times = [0.1, 0.2, 0.9, 1.0, *[1.5 + 0.5 * i for i in range(9)]]
    rows = [("a", "RHEE" if i % 2 else "LHEE", x) for i, x in enumerate(times)] + [("a", "RMT2", None), ("b", "RHEE", 1.0)]
    peaks = spark.createDataFrame(rows, "k string, marker string, t double")
    got = mocap.ten_steps(peaks, "k").collect()
    assert [(r.k, round(r.start, 6), round(r.end, 6), r.step_count) for r in got] == [("a", 0.15, 5.0, 10.0)]
    assert {r.k: r.step_count for r in mocap.step_count(peaks, "k").collect()} == {"a": round(2 * 13 / 3), "b": 2.0}
    names = spark.createDataFrame([("NW 1",), ("sts2",), ("TurnL1",), ("TURNR",), ("other",)], "n string")
    assert [r[0] for r in names.select(exports.activity(F.col("n"))).collect()] == ["walk", "sit_to_stand", "left_turn", "right_turn", None]


def test_lab_tables(spark):
    rng = np.random.default_rng(5)
    times = {k: np.cumsum(rng.uniform(0.4, 0.7, 20)) for k in ("long", "mid")}
    rows = [(k, float(x), 8 if k == "long" else 12, "longest" if k == "long" else "regular_middle") for k, v in times.items() for x in v] + [("few", 1.0, 8, "longest")]
    got = {r.k: (r.start, r.end) for r in lab.peak_window(spark.createDataFrame(rows, "k string, t double, peaks int, mode string"), "k").collect()}
    w = [times["long"][i : i + 8] for i in range(13)]
    best = max(w, key=lambda x: x[-1] - x[0])
    w = [times["mid"][i : i + 12] for i in range(9)]
    cv = np.array([np.diff(x).std() / np.diff(x).mean() for x in w])
    middle = (times["mid"][0] + times["mid"][-1]) / 2
    near = min((abs((w[i][0] + w[i][-1]) / 2 - middle), i) for i in range(9) if cv[i] <= np.percentile(cv, 40) + 1e-12)[1]
    assert set(got) == {"long", "mid"} and np.allclose(got["long"], (best[0], best[-1])) and np.allclose(got["mid"], (w[near][0], w[near][-1]))
    trials = spark.createDataFrame([(30.0, 60.0, 20.0, None), (30.0, 40.0, 20.0, 21.0), (None, 40.0, None, 20.0), (None, None, None, None)], "sacrum_step_count double, trunk_step_count double, sacrum_duration_s double, trunk_duration_s double")
    checked = [(r.sacrum_qc_step_count, r.sacrum_qc_source) for r in lab.sacrum_check(trials).collect()]
    assert checked == [(63.5, "trunk"), (33.5, "sacrum"), (43.5, "trunk"), (None, "")]
    rises = spark.createDataFrame([(1, "left", 2.0, 3.0, 0.5, 0.7), (1, "sacrum", 2.0, 3.0, 0.5, 0.7), (1, "right", 2.0, 3.0, 0.5, None)], "trial int, sensor string, duration_s double, end_time_s double, first_extreme_s double, time_to_peak_acc_s double")
    moved = {r.sensor: (round(r.duration_s, 6), round(r.end_time_s, 6), r.time_to_peak_acc_s and round(r.time_to_peak_acc_s, 6)) for r in lab.with_offsets(rises).collect()}
    assert moved == {"left": (2.83, 3.83, 1.39), "sacrum": (2.02, 3.02, 0.7), "right": (2.0, 3.0, None)}
    wide = lab.trial_table(lab.generic(rises, ["trial", "sensor"]), ["trial"], ["right", "left", "trunk", "sacrum"]).collect()
    assert len(wide) == 1 and len(wide[0]) == 1 + 4 * 19 and wide[0].left_duration_s == 2.0 and wide[0].trunk_duration_s is None


def test_lab_walking(spark):
    """Two rates and a fifth sensor, against a direct computation with each recording's own rate."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for key, (sensor, fs) in enumerate([("right", 25.0), ("right", 50.0), ("thigh", 40.0), ("left", 25.0), ("trunk", 50.0), ("sacrum", 50.0), ("sacrum", 25.0)]):
        n = int(40 * fs)
        t = np.arange(n) / fs
        x = {c: np.sin(2 * np.pi * f * t + p) + rng.normal(0, 0.1, n) for c, f, p in (("gyro_x", 0.9, 0), ("gyro_z", 0.9, 1), ("gyro_mag", 1.7, 0), ("acc_free", 1.8, 2))}
        rows += [(key, sensor, i, float(t[i]), fs, *(float(x[c][i]) for c in x)) for i in range(n)]
        v = {"right": x["gyro_x"], "left": np.abs(x["gyro_x"]), "trunk": x["gyro_mag"], "sacrum": x["gyro_z"]}.get(sensor, x["acc_free"])
        sigma, share, mad, apart, count, mode = next((p[1:] for p in lab.SENSORS if p[0] == sensor), lab.OTHERS)
        smooth = signal.gaussian(v - np.median(v), sigma)
        m = np.median(smooth)
        limit = m + mad * np.median(np.abs(smooth - m)) if mad else np.percentile(smooth, 100 * share)
        at = t[signal.found_peaks(smooth, max(1, round(apart * fs)), limit)]
        if sensor == "sacrum":
            b, a = signal.band(0.5, min(3.0, 0.9 * fs / 2), fs)
            y = signal.gaussian(signal.both_ways(b, a, x["acc_free"] - np.median(x["acc_free"])), max(1, round(0.15 * fs)))
            c = np.median(y)
            events = t[signal.found_peaks(y, max(1, round(0.35 * fs)), c + 0.75 * np.median(np.abs(y - c)))][:9]
            ten = events[-1] - events[0]
        elif mode == "longest":
            ten = max(at[i + count - 1] - at[i] for i in range(len(at) - count + 1))
        else:
            ten = None
        want[key] = (len(at), ten)
    df = spark.createDataFrame(rows, "k int, sensor string, i int, t double, fs double, gyro_x double, gyro_z double, gyro_mag double, acc_free double")
    got = {r.k: r for r in lab.walking(df, "k").collect()}
    assert set(got) == set(want)
    for key, (steps, ten) in want.items():
        assert got[key].step_count == steps > 5
        assert ten is None or abs(got[key].ten_step_duration_s - ten) < 1e-9


def test_lab_turning(spark):
    fs, n = 40.0, 400
    t = np.arange(n) / fs
    y = 3 * np.exp(-(((t - 5) / 1.2) ** 2))
    push = np.abs(np.sin(2 * np.pi * 0.7 * t))
    df = spark.createDataFrame([(1, i, float(t[i]), float(-y[i]), float(push[i])) for i in range(n)], "k int, i int, t double, gyro_y double, acc_free double")
    r = lab.turning(df, "k").first()
    on = np.flatnonzero(y >= 0.75)
    a, b = on[0] - 4, on[-1] + 4
    part = slice(a, b + 1)
    smooth = signal.gaussian(push[part], max(1, round(0.04 * fs)))
    steps = len(signal.found_peaks(smooth, round(0.5 * fs), np.percentile(smooth, 50)))
    assert (r.start_time_s, r.end_time_s, r.step_count) == (t[a], t[b], steps) and steps > 0
    assert abs(r.peak_angular_velocity - y.max()) < 1e-9 and abs(r.mean_angular_velocity - y[part].mean()) < 1e-9


def marker_rows(key, markers, xyz):
    return [(key, FS, f + 1, m, *(None if np.isnan(v) else float(v) for v in xyz[f, k])) for f in range(len(xyz)) for k, m in enumerate(markers)]


ROWS = "trial string, fs_hz double, frame int, marker string, x double, y double, z double"


def test_centre_and_speed(spark):
    """The mean of the markers that are there, gaps by position, and the length of the gradient."""
    rng = np.random.default_rng(2)
    xyz = np.cumsum(rng.normal(size=(40, 3, 3)), 0)
    xyz[5, 1], xyz[10:12], xyz[0] = np.nan, np.nan, np.nan
    rows = marker_rows("a", mocap.PELVIS[:3], xyz) + [("a", FS, 1, "OTHER", 9.0, 9.0, 9.0)]
    got = mocap.speed(mocap.centre(spark.createDataFrame(rows, ROWS), "trial", mocap.PELVIS), "trial").orderBy("i").toPandas()
    mean = np.array([np.nanmean(f, 0) if np.isfinite(f).any() else [np.nan] * 3 for f in xyz])
    at, known = np.arange(40), np.isfinite(mean[:, 0])
    want = np.stack([np.interp(at, at[known], mean[known, c]) for c in range(3)], 1)
    assert np.allclose(got[["x", "y", "z"]], want)
    assert np.allclose(got.t, at / FS) and np.allclose(got.speed, np.linalg.norm(np.gradient(want, 1 / FS, axis=0), axis=1))


def test_mocap_walk(spark):
    """Steps of all foot markers, and the summary of the whole trial, against the direct peaks."""
    t, xyz = walker()
    df = spark.createDataFrame(marker_rows("a", mocap.FEET, xyz), ROWS)
    direct = {m: t[direct_peaks(xyz[:, k], 0.35)] for k, m in enumerate(mocap.FEET)}
    got = mocap.foot_peaks(df, "trial", 0.35, cut=written).collect()
    assert {m: sorted(r.t for r in got if r.marker == m) for m in mocap.FEET} == {m: sorted(v.tolist()) for m, v in direct.items()}
    r = mocap.walk(df, "trial", full=True, cut=written).first()
    steps = round(2 * np.mean([len(v) for v in direct.values()]))
    assert (r.start, r.end, r.step_count) == (0.0, round(t[-1], 3), steps) and r.cadence == round(60 * steps / t[-1], 3) and r.mean_step_time == round(t[-1] / steps, 3)


def widened(v, fs, k, least, pad):
    """First and last sample of the region of motion: direct, by loops."""
    a = np.abs(v - np.median(v))
    m = np.median(a)
    d = 1.4826 * np.median(np.abs(a - m))
    on, out = a > m + k * d, max(0.35 * (m + k * d), m + 0.5 * d)
    edge = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0]))
    runs = [(s, e) for s, e in zip(edge[::2], edge[1::2]) if e - s >= max(1, round(least * fs))]
    s, e = max(runs, key=lambda r: (round(a[r[0] : r[1]].max() * (r[1] - r[0]), 9), -r[0]))
    before, behind = [i for i in range(s + 1) if a[i] <= out], [i for i in range(e, len(a)) if a[i] <= out]
    p = round(pad * fs)
    return max(0, (before[-1] if before else 0) - p), min(len(a) - 1, (behind[0] if behind else len(a) - 1) + p)


def test_mocap_rise_and_turn(spark):
    n = 600
    t = np.arange(n) / FS
    up = 500 + 400 / (1 + np.exp(-(t - 3) * 5))
    body = mocap.PELVIS + mocap.SHOULDERS
    rise = np.stack([np.stack([0 * t + k, 0 * t, up + k], 1) for k in range(len(body))], 1)
    r = mocap.rise(spark.createDataFrame(marker_rows("a", body, rise), ROWS), "trial", written).first()
    z = signal.gaussian(up + np.mean(range(len(body))), max(1, 0.06 * FS))
    v = np.gradient(z, t)
    first, last = widened(signal.gaussian(v, max(1, 0.04 * FS)), FS, 2.5, 0.30, 0.05)
    assert (r.start, r.end) == (round(t[first], 3), round(t[last], 3)) and abs(r.start - 1.9) < 1 and abs(r.end - 4.1) < 1
    assert r.time_to_peak == round(t[first + np.abs(v[first : last + 1]).argmax()] - t[first], 3)

    angle = 2 * np.pi / (1 + np.exp(-(t - 3) * 3))
    pelvis = np.stack([np.stack([100 * np.cos(angle) + k, 100 * np.sin(angle), 0 * t], 1) for k in range(4)], 1)
    feet = np.stack([np.stack([100 * np.cos(angle), 100 * np.sin(angle), 30 * np.maximum(0, np.sin(2 * np.pi * t + k))], 1) for k in range(4)], 1)
    df = spark.createDataFrame(marker_rows("a", mocap.PELVIS + mocap.FEET, np.concatenate([pelvis, feet], 1)), ROWS)
    r = mocap.turn(df, "trial", written).first()
    c = np.stack([100 * np.cos(angle), 100 * np.sin(angle)], 1)
    v = signal.gaussian(np.linalg.norm(np.gradient(c, t, axis=0), axis=1), max(1, 0.08 * FS))
    a = np.abs(v - np.median(v))
    on = a > np.median(a) + 0.5 * 1.4826 * np.median(np.abs(a - np.median(a)))
    edge = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0]))
    runs = [(s, e) for s, e in zip(edge[::2], edge[1::2]) if e - s >= 20]
    first, last = max(0, runs[0][0] - 15), min(n - 1, runs[-1][1] + 15)
    assert abs(r.start - t[first]) <= 0.011 and abs(r.end - t[last]) <= 0.011 and r.step_count > 0


def test_mocap_trials(spark):
    paths = ["d/SRS01/Visit 1/NW1/a.csv", "d/SRS01/Visit 1/NW2_x/a.csv", "d/SRS02/visit2/deep/TurnL/b.csv", "d/P1/Visit 1/NW1/a.csv", "d/SRS01/other/NW1/a.csv"]
    got = exports.trials(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {(r.subject, r.visit, r.trial) for r in got} == {("SRS01", "Visit 1", "NW1"), ("SRS02", "visit2", "TurnL")}
