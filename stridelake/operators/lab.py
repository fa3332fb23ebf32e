"""Summaries of laboratory sensors: walks, turns and rises, and the wide trial table.

Samples are (key, i, t, fs, sensor and channels) of preprocessed recordings; a key is one sensor of one trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators import features, segments, signal
from stridelake.operators.series import ordered, whole
from stridelake.sources.recordings import sensor_signal

# Fixed values by sensor: smoothing, threshold (a percentile, or median + value * MAD), step distance, and which window of
# how many peaks stands for ten steps.
SENSORS = [
    ("right", 12.0, 0.55, None, 0.35, 9, "longest"),
    ("left", 8.0, 0.75, None, 0.30, 12, "regular_middle"),
    ("trunk", 12.0, 0.65, None, 0.45, 8, "longest"),
    ("sacrum", 4.0, None, 1.25, 0.35, 8, "longest"),
]
OTHERS = (8.0, 0.75, None, 0.40, 10, "longest")  # all other sensors
GENERIC = [
    "start_time_s", "end_time_s", "duration_s", "step_count", "cadence_steps_min", "mean_step_time_s", "ten_step_start_time_s", "ten_step_end_time_s", "ten_step_duration_s", "ten_step_count",
    "ten_step_cadence_steps_min", "ten_step_mean_step_time_s", "peak_angular_velocity", "mean_angular_velocity", "flexion_peak", "extension_peak", "time_to_peak_acc_s", "peak_acc", "peak_gyro",
]


PARAMETERS = ["sigma", "percentile", "mad", "apart", "peaks", "mode"]


def with_parameters(samples: DataFrame) -> DataFrame:
    """samples with the values of their sensor as columns."""
    kinds = ("double", "double", "double", "double", "int", "string")

    def of(i: int) -> Column:
        value = F.lit(OTHERS[i]).cast(kinds[i])
        for sensor, *values in SENSORS:
            value = F.when(F.col("sensor") == sensor, F.lit(values[i]).cast(kinds[i])).otherwise(value)
        return value

    return samples.withColumns({n: of(i) for i, n in enumerate(PARAMETERS)})


def peak_window(peaks: DataFrame, key: str) -> DataFrame:
    """key, start, end of the window of `peaks` peaks: the longest, or (regular_middle) of those whose variation is in the
    lowest 40 % the one nearest the middle of all peaks. peaks: key, t and the columns peaks and mode."""
    w = ordered(key, "t")
    d = peaks.withColumns({"_at": F.row_number().over(w), "_all": F.collect_list("t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    cut = F.slice("_all", F.col("_at"), F.col("peaks"))
    d = d.where("_at + peaks - 1 <= size(_all) and peaks >= 2").withColumn("_w", cut)
    start, end = F.col("_w")[0], F.element_at("_w", -1)
    gaps = F.zip_with(F.slice("_w", F.lit(2), F.size("_w") - 1), F.slice("_w", F.lit(1), F.size("_w") - 1), lambda a, b: a - b)
    mean = (end - start) / (F.col("peaks") - 1)
    d = d.withColumns({"start": start, "end": end, "_m": mean, "_g": gaps}).where("end > start")
    spread = F.aggregate("_g", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_m"), F.lit(2.0)))
    d = d.withColumn("_cv", F.sqrt(spread / (F.col("peaks") - 1)) / F.col("_m"))
    d = d.withColumn("_cut", F.percentile("_cv", 0.4).over(whole(key))).withColumn("_mid", (F.col("_all")[0] + F.element_at("_all", -1)) / 2)
    longest = F.col("mode") == "longest"
    d = d.where(longest | (F.col("_cv") <= F.col("_cut")))
    rank = F.when(longest, -F.round(F.col("end") - F.col("start"), 9)).otherwise(F.round(F.abs((F.col("start") + F.col("end")) / 2 - F.col("_mid")), 9))
    d = d.withColumn("_rank", rank)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_rank", "_at"))).where("_r = 1").select(key, "start", "end")


def sacrum_events(samples: DataFrame, key: str, value: str = "acc_free", first: int = 9) -> DataFrame:
    """key, start, end of the first nine events of the band-passed acceleration, at each recording's own rate (fs)."""
    rates = samples.groupBy(key).agg(F.first("fs", True).alias("_fs"))
    b = signal.band_pass(samples, key, "i", value, "fs").join(rates, key).withColumn("_sigma", segments.samples(0.15, F.col("_fs")))
    b = signal.smoothed(b, key, "i", "filtered", "_sigma")
    limit = segments.spread_threshold(b, key, "smooth", 0.75, None).join(rates, key).withColumn("_d", segments.samples(0.35, F.col("_fs")))
    p = signal.peaks(b.join(limit, key), key, "i", "smooth", distance="_d", height="threshold").join(samples.select(key, "i", "t"), [key, "i"])
    d = p.withColumn("_r", F.row_number().over(ordered(key, "t"))).where(F.col("_r") <= first)
    return d.groupBy(key).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("_n")).where(F.col("_n") == first).drop("_n")


def walking(samples: DataFrame, key: str, seconds: float | None = 60.0, cut=features.same) -> DataFrame:
    """Summary of each walk: steps of the first `seconds` (None: all) by the sensor's own signal, and its ten-step window.
    Distances follow each recording's own rate (fs); sensors without values of their own take OTHERS. For `cut` see
    features."""
    d = samples.withColumn("_end", F.least(F.max("t").over(whole(key)), F.lit(seconds if seconds is not None else float("inf"))))
    d = with_parameters(d.where("t <= _end")).withColumn("_x", sensor_signal(F.col("sensor")))
    d = d.withColumn("_x", F.col("_x") - F.median("_x").over(whole(key)))
    s = signal.smoothed(d, key, "i", "_x", "sigma", keep=("t", "fs", "sensor", *[n for n in PARAMETERS if n != "sigma"]))
    w = whole(key)
    s = s.withColumn("_m", F.median("smooth").over(w)).withColumn("_mad", F.median(F.abs(F.col("smooth") - F.col("_m"))).over(w))
    by_share = F.coalesce(*[F.when(F.col("percentile") == p, F.percentile("smooth", p).over(w)) for p in sorted({p for _, p, *_ in [OTHERS, *(v[1:] for v in SENSORS)] if p})])
    s = s.withColumn("_h", F.when(F.col("mad").isNotNull(), F.col("_m") + F.col("mad") * F.col("_mad")).otherwise(by_share)).withColumn("_d", F.greatest(F.lit(1.0), F.rint(F.col("apart") * F.coalesce("fs", F.lit(0.0)))))
    p = signal.peaks(s, key, "i", "smooth", distance="_d", height="_h", keep=("t", "sensor", "peaks", "mode"))
    p = cut(p)
    base = d.groupBy(key).agg(F.first("sensor").alias("sensor"), F.min("t").alias("start_time_s"), F.first("_end").alias("end_time_s"), F.count("*").alias("_n")).where("_n >= 3")
    base = base.join(p.groupBy(key).agg(F.count("*").cast("double").alias("step_count")), key, "left").withColumn("step_count", F.coalesce("step_count", F.lit(0.0)))
    base = base.withColumn("duration_s", F.col("end_time_s") - F.col("start_time_s"))
    ten = peak_window(p.where("sensor <> 'sacrum'"), key).unionByName(sacrum_events(d.where("sensor = 'sacrum'").select(key, "i", "t", "acc_free", "fs"), key))
    out = base.join(ten, key, "left").withColumn("_t", F.col("end") - F.col("start"))
    return out.select(
        key, "sensor", "start_time_s", "end_time_s", "duration_s", "step_count", F.try_divide(60 * F.col("step_count"), "duration_s").alias("cadence_steps_min"), F.try_divide("duration_s", "step_count").alias("mean_step_time_s"),
        F.col("start").alias("ten_step_start_time_s"), F.col("end").alias("ten_step_end_time_s"), F.col("_t").alias("ten_step_duration_s"), F.when(F.col("_t").isNotNull(), 10.0).alias("ten_step_count"),
        F.try_divide(F.lit(600.0), "_t").alias("ten_step_cadence_steps_min"), (F.col("_t") / 10).alias("ten_step_mean_step_time_s"),
    )


def turning(samples: DataFrame, key: str, axis: str = "gyro_y") -> DataFrame:
    """Summary of each turn by the magnitude of one axis."""
    d = samples.withColumns({"_vel": F.abs(axis), "_push": F.abs("acc_free")})
    span = segments.peak_span(d, key, "i", "t", "_vel")
    within = segments.with_rate(segments.numbered(segments.inside(d, key, "t", span), key, "i", "_at"), key, "_at", "t")
    within = within.withColumns({"_sigma": F.greatest(F.lit(1.0), F.rint(0.04 * F.col("fs"))), "_apart": segments.samples(0.5, F.col("fs"))})
    s = signal.smoothed(within, key, "_at", "_push", "_sigma").join(within.select(key, "_at", "_apart"), [key, "_at"]).withColumn("_h", F.percentile("smooth", 0.5).over(whole(key)))
    steps = signal.peaks(s, key, "_at", "smooth", distance="_apart", height="_h").groupBy(key).agg(F.count("*").cast("double").alias("step_count"))
    speed = within.groupBy(key).agg(F.max("_vel").alias("peak_angular_velocity"), F.avg("_vel").alias("mean_angular_velocity"))
    out = span.join(speed, key, "left").join(steps, key, "left")
    return out.select(key, F.col("start").alias("start_time_s"), F.col("end").alias("end_time_s"), F.col("duration").alias("duration_s"), F.coalesce("step_count", F.when(F.col("start").isNotNull(), 0.0)).alias("step_count"), "peak_angular_velocity", "mean_angular_velocity")


def rising(samples: DataFrame, key: str, motion: str = "motion", cut=features.same) -> DataFrame:
    """Summary of each rise, its window anchored at the extremes of the dominant axis. For `cut` see features."""
    d, found = features.transition_details(samples, key, "gyro_mag", ["gyro_x", "gyro_y", "gyro_z"], anchored=True, cut=cut)
    within = segments.inside(d, key, "t", found)
    top = F.min(F.struct((-F.round(motion, 9)).alias("x"), F.col("t").alias("t"), F.col(motion).alias("v")))
    s = within.groupBy(key).agg(top.alias("_top"), F.min("t").alias("_t0"), F.max("gyro_mag").alias("peak_gyro"))
    out = found.join(s, key, "left")
    first = F.least("flexion_time", "extension_time") - F.col("start")
    return out.select(key, F.col("start").alias("start_time_s"), F.col("end").alias("end_time_s"), F.col("duration").alias("duration_s"), "flexion_peak", "extension_peak", (F.col("_top.t") - F.col("_t0")).alias("time_to_peak_acc_s"), F.col("_top.v").alias("peak_acc"), "peak_gyro", first.alias("first_extreme_s"))


def with_offsets(rises: DataFrame, sensor: str = "sensor") -> DataFrame:
    """The older table's offsets: left +0.83 s with the time to peak from the first extreme +0.89 s, sacrum +0.02 s."""
    more = F.when(F.col(sensor) == "left", 0.83).when(F.col(sensor) == "sacrum", 0.02).otherwise(0.0)
    peak = F.when((F.col(sensor) == "left") & F.col("first_extreme_s").isNotNull(), F.col("first_extreme_s") + 0.89).otherwise(F.col("time_to_peak_acc_s"))
    return rises.withColumns({"duration_s": F.col("duration_s") + more, "end_time_s": F.col("end_time_s") + more, "time_to_peak_acc_s": peak})


def sacrum_check(trials: DataFrame, apart: float = 22.0, bias: float = 3.5) -> DataFrame:
    """Checked sacrum steps of wide trial rows: the trunk's where both differ by more than `apart` (or only it is there),
    plus the bias; cadence and step time over the sacrum's (else the trunk's) duration; and the source."""
    s, t = F.col("sacrum_step_count"), F.col("trunk_step_count")
    trunk = (s.isNull() & t.isNotNull()) | (F.abs(s - t) > apart)
    steps = F.when(trunk, t).otherwise(s) + bias
    d = trials.withColumns({"sacrum_qc_step_count": steps, "sacrum_qc_source": F.when(trunk, "trunk").when(s.isNotNull(), "sacrum").otherwise("")})
    length = F.coalesce("sacrum_duration_s", "trunk_duration_s")
    return d.withColumns({"sacrum_qc_cadence": F.try_divide(60 * F.col("sacrum_qc_step_count"), length), "sacrum_qc_mean_step_time": F.try_divide(length, F.col("sacrum_qc_step_count"))})


def generic(summary: DataFrame, keys: list[str], ten_step: bool = False) -> DataFrame:
    """A summary's GENERIC features, null where it has none; in ten-step mode the main ones are those of the ten steps."""
    there = set(summary.columns)
    pick = lambda n: F.col(f"ten_step_{n}" if ten_step and f"ten_step_{n}" in there else n) if n in there else F.lit(None).cast("double")
    return summary.select(*keys, *[pick(n).alias(n) for n in GENERIC])


def trial_table(rows: DataFrame, keys: list[str], sensors: list[str], sensor: str = "sensor") -> DataFrame:
    """One row per trial with {sensor}_{feature} columns for all sensors; sensors that failed are null."""
    return rows.groupBy(*keys).agg(*[F.first(F.when(F.col(sensor) == s, F.col(f)), True).alias(f"{s}_{f}") for s in sensors for f in GENERIC])
