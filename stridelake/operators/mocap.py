"""Marker trajectories: centres, speeds, foot steps and the summaries of walks, turns and rises.

Rows are (key, fs_hz, frame, marker, x, y, z), as sources.mocap gives them; a key is one trial. Times are
(frame - first frame) / fs_hz, or the row's number where there is no rate. `cut` is what is done with a table that is read
several times, before it is read (see features).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators import segments, series, signal, windows
from stridelake.operators.features import same
from stridelake.operators.series import ordered, whole

# Marker names of the body model.
PELVIS = ["LASIS", "RASIS", "LPSIS", "RPSIS"]
SHOULDERS = ["LSHO", "RSHO"]
FEET = ["RHEE", "LHEE", "RMT2", "LMT2"]


def timed(rows: DataFrame, key: str) -> DataFrame:
    """One row per frame of each series (key), numbered i, with time t."""
    d = segments.numbered(rows, key, "frame")
    return d.withColumn("t", F.coalesce((F.col("frame") - F.min("frame").over(whole(key))) / F.col("fs_hz"), F.col("i").cast("double")))


def centre(rows: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """Mean of the markers that are there in each frame, gaps filled by position."""
    d = rows.where(F.col("marker").isin(markers)).groupBy(key, "frame").agg(F.first("fs_hz").alias("fs_hz"), *[F.avg(c).alias(c) for c in "xyz"])
    return series.interpolate_columns(timed(d, key), key, "frame", {c: c for c in "xyz"})


def speed(df: DataFrame, key: str, axes: str = "xyz", out: str = "speed") -> DataFrame:
    """Length of the gradient of the axes over time."""
    df = series.gradients(df, key, "t", {c: f"_d{c}" for c in axes})
    size = F.sqrt(sum((F.col(f"_d{c}") * F.col(f"_d{c}") for c in axes), F.lit(0.0)))
    return df.withColumn(out, size).drop(*[f"_d{c}" for c in axes])


def smooth(df: DataFrame, key: str, value: str, seconds: float, out: str) -> DataFrame:
    """Gaussian smoothing with a deviation of `seconds`, one sample at least."""
    d = df.withColumn("_sigma", F.greatest(seconds * F.col("fs_hz"), F.lit(1.0)))
    s = signal.smoothed(d, key, "i", value, "_sigma").withColumnRenamed("smooth", out)
    return df.join(s, [key, "i"])


def foot_peaks(rows: DataFrame, key: str, apart: float, span: DataFrame | None = None, cut=same) -> DataFrame:
    """Steps of each foot marker (key, marker, t): peaks of its smoothed speed above median + 1.5 * 1.4826 MAD, within the
    span where that is given. Markers without a step have one row with t null."""
    d = rows.where(F.col("marker").isin(FEET)).withColumn("_km", F.concat_ws("\u0001", F.col(key).cast("string"), "marker"))
    d = timed(d, "_km")
    if span is not None:
        d = segments.numbered(segments.inside(d, key, "t", span).drop("i"), "_km", "frame")
    d = series.interpolate_columns(segments_of(d, "_km", 5), "_km", "i", {c: c for c in "xyz"})
    d = cut(smooth(cut(speed(d, "_km")), "_km", "speed", 0.035, "_v"))
    w = whole("_km")
    d = d.withColumn("_m", F.median("_v").over(w))
    d = d.withColumn("_mad", 1.4826 * F.median(F.abs(F.col("_v") - F.col("_m"))).over(w))
    d = d.withColumns({"_h": F.col("_m") + 1.5 * F.col("_mad"), "_p": F.greatest("_mad", 0.15 * F.stddev_pop("_v").over(w)), "_d": segments.samples(apart, F.col("fs_hz"))})
    d = cut(d)
    p = signal.peaks(d, "_km", "i", "_v", distance="_d", height="_h", prominence="_p").select("_km", "i")
    times = p.join(d.select("_km", "i", "t"), ["_km", "i"]).select("_km", F.col("t").alias("step"))
    return d.select("_km", key, "marker").distinct().join(times, "_km", "left").select(key, "marker", F.col("step").alias("t"))


def segments_of(df: DataFrame, key: str, least: int) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(whole(key))).where(F.col("_n") >= least).drop("_n")


def step_count(peaks: DataFrame, key: str) -> DataFrame:
    """Steps of both feet: twice the mean over the markers that are there, rounded (halves to even)."""
    n = peaks.groupBy(key, "marker").agg(F.count("t").alias("n"))
    return n.groupBy(key).agg(F.rint(2 * F.avg("n")).alias("step_count"))


def ten_steps(peaks: DataFrame, key: str, count: int = 10, gap: float = 0.18) -> DataFrame:
    """The first `count` steps after steps not more than `gap` seconds apart are one."""
    events = windows.clusters(peaks.where("t is not null").select(key, "t"), key, "t", gap)
    d = events.withColumn("_r", F.row_number().over(ordered(key, "mean_time"))).where(F.col("_r") <= count)
    s = d.groupBy(key).agg(F.min("mean_time").alias("start"), F.max("mean_time").alias("end"), F.count("*").alias("_n")).where(F.col("_n") == count)
    d = s.withColumn("duration", F.col("end") - F.col("start"))
    return d.select(key, "start", "end", "duration", F.lit(float(count)).alias("step_count"), F.try_divide(F.lit(60.0 * count), "duration").alias("cadence"), (F.col("duration") / count).alias("mean_step_time"))


SUMMARY = ["start", "end", "duration", "step_count", "cadence", "mean_step_time", "time_to_peak"]


def walk(rows: DataFrame, key: str, full: bool = False, cut=same) -> DataFrame:
    """Summary of the ten-step window, or of the whole trial."""
    peaks = cut(foot_peaks(rows, key, 0.35, cut=cut))
    ten = ten_steps(peaks, key)
    if full:
        whole_ = timed(rows.select(key, "fs_hz", "frame").distinct(), key).groupBy(key).agg(F.min("t").alias("start"), F.max("t").alias("end"))
        d = whole_.join(step_count(peaks, key), key, "left").withColumn("duration", F.col("end") - F.col("start")).withColumn("step_count", F.coalesce("step_count", F.lit(0.0)))
        d = d.withColumns({"cadence": F.try_divide(60 * F.col("step_count"), "duration"), "mean_step_time": F.try_divide("duration", "step_count")})
    else:
        d = rows.select(key).distinct().join(ten, key, "left")
    return rounded(d.withColumn("time_to_peak", F.lit(None).cast("double")), key)


def turn(rows: DataFrame, key: str, cut=same) -> DataFrame:
    """The turn by the pelvis' speed in the plane: from the first to the last region (0.2 s at least) whose distance from
    the median speed is above median + 0.5 * 1.4826 MAD, with 0.15 s on both sides; without one, the motion window."""
    d = cut(smooth(cut(speed(centre(rows, key, PELVIS), key, "xy")), key, "speed", 0.08, "_v"))
    w = whole(key)
    d = d.withColumn("_a", F.abs(F.col("_v") - F.median("_v").over(w))).withColumn("_m", F.median("_a").over(w))
    d = d.withColumn("_t", F.col("_m") + 0.5 * 1.4826 * F.median(F.abs(F.col("_a") - F.col("_m"))).over(w))
    fs = F.col("fs_hz")
    hits = d.where("_a > _t").withColumn("_g", F.col("i") - F.row_number().over(ordered(key, "i"))).withColumns({"_l": segments.samples(0.20, fs), "_p": segments.samples(0.15, fs)})
    runs = hits.groupBy(key, "_g").agg(F.min("i").alias("_s"), (F.max("i") + 1).alias("_e"), F.count("*").alias("_c"), F.first("_l").alias("_l"), F.first("_p").alias("_p")).where("_c >= _l")
    n = d.groupBy(key).agg(F.count("*").alias("_n"))
    span = runs.groupBy(key).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.first("_p").alias("_p")).join(n, key)
    span = span.select(key, F.greatest(F.lit(0), F.col("_s") - F.col("_p")).cast("long").alias("first"), F.least(F.col("_n") - 1, F.col("_e") + F.col("_p")).cast("long").alias("last"))
    d, span = cut(d), cut(span)
    rest = segments.motion_window(smooth(d.drop("_v"), key, "speed", 0.04, "_v"), key, "i", "t", "_v", 2.0, 0.40, 0.15).select(key, "first", "last").join(span, key, "left_anti")
    s = cut(segments.with_times(d, key, "i", "t", span.unionByName(rest)))
    top = segments.inside(d, key, "t", s).groupBy(key).agg(F.min(F.struct((-F.round("_v", 9)).alias("v"), "t")).alias("_top"))
    s = s.join(top, key).withColumn("time_to_peak", F.col("_top.t") - F.col("start"))
    s = s.join(step_count(foot_peaks(rows, key, 0.30, s, cut), key), key, "left")
    return rounded(s.withColumns({"step_count": F.coalesce("step_count", F.lit(0.0)), "cadence": F.lit(None).cast("double"), "mean_step_time": F.lit(None).cast("double")}), key)


def rise(rows: DataFrame, key: str, cut=same) -> DataFrame:
    """The motion window of the vertical velocity of pelvis and shoulders."""
    d = cut(smooth(cut(centre(rows, key, PELVIS + SHOULDERS)), key, "z", 0.06, "_z"))
    d = cut(series.gradient(d, key, "t", "_z", "_v"))
    s = segments.motion_window(smooth(d, key, "_v", 0.04, "_s"), key, "i", "t", "_s", 2.5, 0.30, 0.05)
    s = cut(s)
    top = segments.inside(d, key, "t", s).groupBy(key).agg(F.min(F.struct((-F.round(F.abs("_v"), 9)).alias("v"), "t")).alias("_top"))
    s = s.join(top, key).withColumn("time_to_peak", F.col("_top.t") - F.col("start"))
    return rounded(s.withColumns({c: F.lit(None).cast("double") for c in ("step_count", "cadence", "mean_step_time")}), key)


def rounded(d: DataFrame, key: str) -> DataFrame:
    return d.select(key, *[(F.round(c, 3) if c != "step_count" else F.col(c)).alias(c) for c in SUMMARY])


def summaries(rows: DataFrame, key: str, activity: str, full: bool = False, cut=same) -> DataFrame:
    """A summary of each trial by its activity (a column); a trial that a summary cannot be made of has nulls."""
    of = lambda a: rows.where(F.col(activity) == a)
    parts = [("walk", walk(of("walk"), key, full, cut)), ("left_turn", turn(of("left_turn"), key, cut)), ("right_turn", turn(of("right_turn"), key, cut)), ("sit_to_stand", rise(of("sit_to_stand"), key, cut))]
    out = None
    for name, part in parts:
        part = part.withColumn("activity", F.lit(name))
        out = part if out is None else out.unionByName(part)
    every = rows.select(key, F.col(activity).alias("activity")).where("activity is not null").distinct()
    return every.join(out, [key, "activity"], "left")
