"""The walk, turn and transition blocks of the feature table, as plans over many recordings at once.

A recording is the rows of one key: order i from 0, time t in seconds, and channels. Each block gives one row per key;
what cannot be computed is null. Recordings of fewer than LEAST samples have nulls throughout.

Blocks read their samples, spans and peaks several times. `cut` is what is done with such a table before it is read; the
feature table gives one that writes it to the shared folder, so that each is computed once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators import pairs, segments, series, signal
from stridelake.operators.series import ordered, whole

LEAST = 5
WALK = [
    "walk_duration", "step_count", "cadence", "walk_task_duration", "walk_task_cadence", "walk_task_mean_step_time", "walk_protocol_duration", "walk_protocol_cadence", "walk_protocol_mean_step_time", "walking_speed",
    "mean_step_time", "step_time_std", "step_time_cv", "walk_10_step_start_time", "walk_10_step_end_time", "walk_10_step_duration", "walk_10_step_count", "walk_10_step_cadence", "walk_10_step_mean_step_time", "walk_10_step_time_cv",
    "step_regularity", "stride_regularity", "walk_acc_mag_mean", "walk_acc_mag_std", "walk_acc_mag_rms", "walk_gyro_mag_std", "walk_dominant_frequency", "walk_spectral_entropy", "walk_jerk_mean", "walk_jerk_std",
]
COUNTED = ["step_count", "cadence", "walk_task_cadence", "walk_task_mean_step_time", "walk_protocol_cadence", "walk_protocol_mean_step_time", "mean_step_time", "step_time_std", "step_time_cv"]  # from the steps' number and times
NONLINEAR = [
    "approximate_entropy", "sample_entropy", "symbolic_entropy", "permutation_entropy", "rosenstein_lyapunov_exponent", "wolf_lyapunov_exponent",
    "rqa_REC", "rqa_DET", "rqa_LAM", "rqa_MeanL", "rqa_MaxL", "rqa_EntrL", "rqa_EntrV", "rqa_EntrW",
]
TURN = ["duration", "mean_angular_velocity", "peak_angular_velocity", "ang_vel_std", "step_count", "pause_time", "jerk_std", "entropy"]
ASYMMETRY = [f"{p}turn_{w}_difference" for p in ("", "abs_") for w in ("duration", "velocity", "pause")]
TRANSITION = ["duration", "time_to_peak_acc", "peak_acc", "flexion_peak", "extension_peak", "peak_gyro", "acc_rms", "jerk_mean", "jerk_std", "peak_count", "entropy"]
XCORR = ["xcorr_symmetry_score", "xcorr_peak_correlation"]


def feature_names() -> list[str]:
    """All features in the order of the table."""
    turn = lambda side: [f"{side}_turn_{n}" for n in TURN]
    move = lambda kind: [f"{kind}_{n}" for n in TRANSITION]
    return [
        *WALK, *NONLINEAR, *turn("left"), *turn("right"), *ASYMMETRY, *[f"turn_left_right_{n}" for n in XCORR],
        *move("sit_to_stand"), *move("stand_to_sit"), *[f"sitstand_standsit_{n}" for n in XCORR],
    ]


def same(df: DataFrame) -> DataFrame:
    return df


def enough(df: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """The samples of recordings with `least` samples or more."""
    return df.withColumn("_n", F.count("*").over(whole(key))).where(F.col("_n") >= least).drop("_n")


def rate(df: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """key, fs."""
    return segments.with_rate(df, key, order, time).groupBy(key).agg(F.first("fs", True).alias("fs"))


def steps(df: DataFrame, key: str, order: str, time: str, value: str, span: DataFrame, sigma: float = 3.0, apart: float = 0.3, scale: float | None = None) -> DataFrame:
    """Peaks of the smoothed signal within the span (key, threshold, start, end): key, order, time, height.

    Peaks reach the threshold and stand `apart` seconds off; with a scale their prominence is scale * threshold."""
    within = df.join(span.where("start is not null").select(key, "threshold", "start", "end"), key).where(F.col(time).between(F.col("start"), F.col("end")) & F.col(value).isNotNull())
    within = segments.with_rate(segments.numbered(within, key, order, "_at"), key, order, time)
    within = within.withColumn("_apart", segments.samples(apart, F.col("fs"))).withColumn("_rise", F.lit(scale).cast("double") * F.col("threshold"))
    got = signal.peaks(within, key, "_at", value, distance="_apart", height="threshold", prominence="_rise" if scale else None, sigma=sigma, keep=(order, time))
    return got.select(key, order, time, "height")


def step_times(peaks: DataFrame, key: str, time: str, width: float = 1.0) -> DataFrame:
    """Mean, population deviation and variation of the intervals between peaks; of a single peak, which is one step in its
    window of `width` seconds, the width."""
    gap = peaks.withColumn("_g", F.col(time) - F.lag(time).over(ordered(key, time)))
    s = gap.groupBy(key).agg(F.count("*").cast("double").alias("step_count"), F.coalesce(F.avg("_g"), F.lit(width)).alias("mean_step_time"), F.coalesce(F.stddev_pop("_g"), F.lit(0.0)).alias("step_time_std"))
    return s.withColumn("step_time_cv", F.try_divide("step_time_std", "mean_step_time"))


def ten_steps(peaks: DataFrame, key: str, time: str, span: DataFrame, count: int = 10, slow: float = 30.0, fast: float = 180.0, short: float = 0.25, long: float = 2.5) -> DataFrame:
    """The window of count + 1 peaks with the steadiest plausible steps, then the one nearest the span's middle; the first
    window where none is plausible."""
    w = ordered(key, time)
    inner = w.rowsBetween(0, count - 1)
    d = peaks.select(key, F.col(time).alias("a")).withColumn("_n", F.row_number().over(ordered(key, "a")))
    w, inner = ordered(key, "a"), ordered(key, "a").rowsBetween(0, count - 1)
    d = d.withColumn("b", F.lead("a", count).over(w)).withColumn("_g", F.lead("a").over(w) - F.col("a"))
    d = d.withColumn("_sd", F.stddev_pop("_g").over(inner)).withColumn("_lo", F.min("_g").over(inner)).withColumn("_hi", F.max("_g").over(inner)).where("b is not null")
    d = d.join(span.select(key, ((F.col("start") + F.col("end")) / 2).alias("_mid")), key, "left")
    d = d.withColumn("_d", F.col("b") - F.col("a")).withColumn("cadence", F.try_divide(F.lit(60.0 * count), "_d")).withColumn("cv", F.try_divide("_sd", F.col("_d") / count))
    fine = F.col("cadence").between(slow, fast) & (F.col("_lo") >= short) & (F.col("_hi") <= long)
    far = F.coalesce(F.abs((F.col("a") + F.col("b")) / 2 - F.col("_mid")), F.lit(0.0))
    pick = Window.partitionBy(key).orderBy(F.desc(F.coalesce(fine, F.lit(False))), F.when(fine, F.round("cv", 9)), F.when(fine, F.round(far, 6)), "_n")
    d = d.withColumn("_r", F.row_number().over(pick)).where("_r = 1")
    out = {"start_time": F.col("a"), "end_time": F.col("b"), "duration": F.col("_d"), "count": F.lit(float(count)), "cadence": F.col("cadence"), "mean_step_time": F.col("_d") / count, "time_cv": F.col("cv")}
    return d.select(key, *[v.alias(f"walk_10_step_{k}") for k, v in out.items()])


def regularity(df: DataFrame, key: str, order: str, value: str, lags: DataFrame) -> DataFrame:
    """Autocorrelation of each key's signal at its own lag (column lag, samples) and at twice that lag."""
    d = series.centre(segments.numbered(df.where(F.col(value).isNotNull()), key, order, "_i"), key, value, out="_x").join(lags.select(key, "lag"), key)
    base = d.select(key, "_i", "_x", "lag")
    out = base.groupBy(key).agg(F.sum(F.col("_x") * F.col("_x")).alias("_v"), F.count("*").alias("_n"), F.first("lag").alias("lag"))
    for name, times in (("step_regularity", 1), ("stride_regularity", 2)):
        shifted = base.select(key, (F.col("_i") + times * F.col("lag")).alias("_i"), F.col("_x").alias("_y"))
        acf = base.join(shifted, [key, "_i"]).groupBy(key).agg(F.sum(F.col("_x") * F.col("_y")).alias(f"_{name}"))
        out = out.join(acf, key, "left").withColumn(name, F.when((times * F.col("lag") > 0) & (times * F.col("lag") < F.col("_n")), F.try_divide(f"_{name}", "_v")))
    return out.select(key, "step_regularity", "stride_regularity")


def statistics(df: DataFrame, key: str, **columns: Column) -> DataFrame:
    return df.groupBy(key).agg(*[c.alias(n) for n, c in columns.items()])


def rms(value: str) -> Column:
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


def walk(df: DataFrame, key: str, acc: str, gyro: str, order: str = "i", time: str = "t", metres: float = 10.0, protocol: float = 30.0, cut=same, only: list[str] | None = None) -> DataFrame:
    """key and the WALK features, or those named by `only`: what none of these needs is not computed."""
    names = [n for n in WALK if only is None or n in only]
    asked = lambda *some: bool(set(some) & set(names))
    d = cut(enough(df.select(key, order, time, acc, gyro), key))
    span = cut(segments.active_span(d, key, time, acc, cap=None, least=1.0))
    task = statistics(d, key, walk_task_duration=F.max(time) - F.min(time))
    out = task.join(span.select(key, "start", F.col("duration").alias("walk_duration")), key, "left")
    within = segments.inside(d, key, time, span)
    lagged, counted = asked("step_regularity", "stride_regularity", "walk_dominant_frequency"), asked(*COUNTED)
    if asked("walk_spectral_entropy") or lagged:
        within = cut(within)
    if asked("walk_acc_mag_mean", "walk_acc_mag_std", "walk_acc_mag_rms", "walk_gyro_mag_std"):
        motion = statistics(within, key, walk_acc_mag_mean=F.avg(acc), walk_acc_mag_std=F.stddev_pop(acc), walk_acc_mag_rms=rms(acc), walk_gyro_mag_std=F.stddev_pop(gyro))
        out = out.join(motion, key, "left")
    if asked("walk_jerk_mean", "walk_jerk_std"):
        jerk = segments.inside(series.gradient(d, key, time, acc, "_jerk"), key, time, span)
        out = out.join(statistics(jerk, key, walk_jerk_mean=F.avg(F.abs("_jerk")), walk_jerk_std=F.stddev_pop("_jerk")), key, "left")
    if asked("walk_spectral_entropy"):
        out = out.join(signal.spectral_entropy(within, key, order, acc).withColumnRenamed("spectral_entropy", "walk_spectral_entropy"), key, "left")
    ten = [n for n in names if "10_step" in n]
    if lagged or counted or ten:
        peaks = cut(steps(d, key, order, time, acc, span))
    if ten:
        out = out.join(ten_steps(peaks, key, time, span), key, "left")
    if lagged or counted:
        count = cut(step_times(peaks, key, time))
        # A span without peaks has no steps; without a span the count is zero as well.
        out = out.join(count, key, "left").withColumn("step_count", F.coalesce("step_count", F.lit(0.0)))
    if lagged:
        lag = cut(step_lags(d, within, count, key, order, time, acc))
        out = out.join(lag.drop("lag"), key, "left").withColumn("walk_dominant_frequency", F.col("_hz") * F.col("fs"))
        out = out.join(regularity(within, key, order, acc, lag.where("lag is not null")), key, "left")
    n = F.col("step_count")
    more = {
        "cadence": F.try_divide(60 * n, "walk_duration"), "walk_task_cadence": F.try_divide(60 * n, "walk_task_duration"), "walk_task_mean_step_time": F.try_divide("walk_task_duration", n),
        "walk_protocol_cadence": 60 * n / protocol, "walk_protocol_mean_step_time": F.try_divide(F.lit(protocol), n),
    }
    out = out.withColumns({"walk_protocol_duration": F.lit(protocol), "walking_speed": F.try_divide(F.lit(metres), "walk_duration")} | (more if lagged or counted else {}))
    return out.select(key, *names)


def step_lags(d: DataFrame, within: DataFrame, count: DataFrame, key: str, order: str, time: str, acc: str) -> DataFrame:
    """key, fs, _hz of the span (a sample), and the lag of a step in samples."""
    fs = rate(d, key, order, time)
    hz = signal.dominant_frequency(within, key, order, acc).select(key, F.col("hz").alias("_hz"))
    # Without steps the lag follows from the frequency of the whole recording.
    other = signal.dominant_frequency(d.join(count.select(key), key, "left_anti"), key, order, acc).select(key, F.col("hz").alias("_all"))
    lag = fs.join(count.select(key, "mean_step_time"), key, "left").join(hz, key, "left").join(other, key, "left")
    return lag.select(key, "fs", "_hz", F.coalesce(F.rint(F.col("mean_step_time") * F.col("fs")), F.rint(F.try_divide(F.lit(1.0), "_all"))).cast("long").alias("lag"))


def nonlinear(df: DataFrame, key: str, acc: str, order: str = "i", time: str = "t", most: int = 900, cut=same) -> DataFrame:
    """key and the NONLINEAR features of the walk span, of keys with ten samples or more in it."""
    d = cut(enough(df, key))
    within = enough(segments.inside(d, key, time, segments.active_span(d, key, time, acc, cap=None, least=1.0)), key, 10)
    # The rate of the whole recording, as for the other features.
    out = pairs.nonlinear(pairs.embedded(within, key, order, acc, most), key).join(rate(d, key, order, time), key)
    scaled = out.withColumns({"rosenstein": F.col("rosenstein") * F.col("fs"), "wolf": F.col("wolf") * F.col("fs")})
    return scaled.select(key, *[F.col(c).alias(n) for c, n in zip(pairs.NONLINEAR, NONLINEAR)])


def filtered(df: DataFrame, key: str, order: str, time: str, columns: list[str], cutoff: float | None, degree: int = 4) -> DataFrame:
    """df with the columns low-passed at each recording's own rate; as it is without a cutoff."""
    return signal.low_pass_columns(segments.with_rate(df, key, order, time), key, order, columns, cutoff, "fs", degree).drop("fs") if cutoff else df


def turn(df: DataFrame, key: str, acc: str, gyro: str, axis: str, order: str = "i", time: str = "t", beta: float = 0.6, height: float = 0.55, cutoff: float | None = 5.0, cut=same) -> DataFrame:
    """key and the TURN features: the span by the gyro magnitude, velocities of |axis|, steps by |acc|, pauses under the
    span's threshold. The magnitude (which the preprocess has filtered already) and |axis| are low-passed at `cutoff`."""
    d = enough(df, key).withColumn("_vel", F.abs(axis)).withColumn("_push", F.abs(acc))
    d = cut(filtered(d, key, order, time, [gyro, "_vel"], cutoff))
    span = cut(segments.peak_span(d, key, order, time, gyro))
    within = cut(segments.inside(d, key, time, span))
    velocity = statistics(within, key, mean_angular_velocity=F.avg("_vel"), peak_angular_velocity=F.max("_vel"), ang_vel_std=F.stddev_pop("_vel"))
    jerk = statistics(series.gradient(within, key, time, "_vel", "_j"), key, jerk_std=F.stddev_pop("_j"))
    smooth = segments.with_rate(segments.numbered(within, key, order, "_at"), key, order, time)
    smooth = signal.smoothed(smooth, key, "_at", "_push", 2.0, keep=("fs",))
    smooth = smooth.withColumn("_h", F.percentile("smooth", height).over(whole(key))).withColumn("_apart", segments.samples(0.5, F.col("fs"), False))
    counted = smooth.withColumn("_c", F.count("*").over(whole(key))).where("_c >= 3 and fs is not null")
    stepped = signal.peaks(counted, key, "_at", "smooth", distance="_apart", height="_h").groupBy(key).agg(F.count("*").cast("double").alias("_p"))
    stepped = counted.select(key).distinct().join(stepped, key, "left").select(key, F.coalesce("_p", F.lit(0.0)).alias("step_count"))
    quiet = within.join(span.select(key, "threshold"), key).withColumn("_q", F.abs(gyro) < F.col("threshold"))
    pause = pauses(quiet, key, order, time, "_q", beta)
    out = span.select(key, "duration").join(velocity, key, "left").join(stepped, key, "left").join(pause, key, "left").join(jerk, key, "left")
    return out.join(signal.spectral_entropy(within, key, order, "_vel").withColumnRenamed("spectral_entropy", "entropy"), key, "left").select(key, *TURN)


def pauses(df: DataFrame, key: str, order: str, time: str, quiet: str, beta: float = 0.6) -> DataFrame:
    """key, pause_time: the total of quiet runs of two samples and more that last beta * their median or longer."""
    w = ordered(key, order)
    d = df.withColumn("_new", F.coalesce((F.col(quiet) != F.lag(quiet).over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    runs = d.where(F.col(quiet)).groupBy(key, "_run").agg((F.max(time) - F.min(time)).alias("_s"), F.count("*").alias("_n")).where("_n >= 2")
    runs = runs.withColumn("_least", beta * F.median(F.when(F.col("_s") > 0, F.col("_s"))).over(whole(key)))
    total = runs.where(F.col("_s") >= F.coalesce("_least", F.lit(0.0))).groupBy(key).agg(F.sum("_s").alias("_t"))
    return df.select(key).distinct().join(total, key, "left").select(key, F.coalesce("_t", F.lit(0.0)).alias("pause_time"))


def widest_axis(df: DataFrame, key: str, time: str, axes: list[str], span: DataFrame, out: str = "axis") -> DataFrame:
    """df with the axis of the largest range within the span as column `out`; the first of equal ones."""
    ranges = [F.struct((-F.round(F.max(a) - F.min(a), 9)).alias("w"), F.lit(i).alias("i")) for i, a in enumerate(axes)]
    best = segments.inside(df, key, time, span).groupBy(key).agg(F.least(*ranges).alias("_b")).select(key, F.col("_b.i").alias("_axis"))
    return df.join(best, key).withColumn(out, F.element_at(F.array(*axes), F.col("_axis") + 1)).drop("_axis")


def transition_details(df: DataFrame, key: str, gyro: str, axes: list[str], order: str = "i", time: str = "t", anchored: bool = False, cut=same) -> tuple[DataFrame, DataFrame]:
    """The recordings with their dominant axis, and per key threshold, start, end, duration and both extremes."""
    d = cut(enough(df, key))
    broad = cut(segments.active_span(d, key, time, gyro, k=3.0, least=0.5, fallback=0.1))
    d = cut(widest_axis(d, key, time, axes, broad))
    span = cut(segments.refined_span(d, key, order, time, "axis", broad))
    if anchored:
        rated = segments.with_rate(d, key, order, time).join(span.select(key, "threshold", "start", "end"), key)
        on = F.col(time).between(F.col("start"), F.col("end")) & (F.abs("axis") >= F.col("threshold"))
        region = segments.strongest_region(rated.select(key, order, time, "axis", "fs", on.alias("_hit")), key, order, time, "axis", F.col("_hit"), segments.samples(0.75, F.col("fs")), segments.samples(0.5, F.col("fs")))
        region = region.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
        span = span.join(region, key, "left").select(key, "threshold", F.coalesce("_s", "start").alias("start"), F.coalesce("_e", "end").alias("end"))
    return d, cut(segments.motion_end(d, key, order, time, "axis", span, anchored))


def transition(df: DataFrame, key: str, acc: str, gyro: str, axes: list[str], order: str = "i", time: str = "t", anchored: bool = False, cut=same) -> DataFrame:
    """key and the TRANSITION features."""
    return transition_block(*transition_details(df, key, gyro, axes, order, time, anchored, cut), key, acc, gyro, order, time, cut)


def transition_block(d: DataFrame, found: DataFrame, key: str, acc: str, gyro: str, order: str = "i", time: str = "t", cut=same) -> DataFrame:
    """The features from what transition_details gives."""
    within = cut(segments.inside(d, key, time, found))
    top = F.min(F.struct((-F.round(acc, 9)).alias("x"), F.col(time).alias("t"), F.col(acc).alias("v")))
    stats = within.groupBy(key).agg(top.alias("_top"), F.min(time).alias("_t0"), F.max(gyro).alias("peak_gyro"), rms(acc).alias("acc_rms"))
    stats = stats.select(key, (F.col("_top.t") - F.col("_t0")).alias("time_to_peak_acc"), F.col("_top.v").alias("peak_acc"), "peak_gyro", "acc_rms")
    jerk = statistics(series.gradient(within, key, time, acc, "_j"), key, jerk_mean=F.avg(F.abs("_j")), jerk_std=F.stddev_pop("_j"))
    rated = within.join(cut(rate(d, key, order, time)), key).withColumn("_apart", segments.samples(0.15, F.col("fs")))
    rated = segments.numbered(rated.where(F.col(acc).isNotNull()), key, order, "_at")
    counted = signal.peaks(rated, key, "_at", acc, distance="_apart").groupBy(key).agg(F.count("*").cast("double").alias("_p"))
    out = found.select(key, "duration", "flexion_peak", "extension_peak").join(stats, key, "left").join(jerk, key, "left").join(counted, key, "left")
    out = out.withColumn("peak_count", F.coalesce("_p", F.lit(0.0))).join(signal.spectral_entropy(within, key, order, acc).withColumnRenamed("spectral_entropy", "entropy"), key, "left")
    return out.select(key, *TRANSITION)


def asymmetry(both: DataFrame) -> list[Column]:
    """Left less right and their magnitudes, from a row that holds both turns."""
    pairs_ = {"duration": "duration", "velocity": "mean_angular_velocity", "pause": "pause_time"}
    signed = {f"turn_{n}_difference": F.col(f"left_turn_{c}") - F.col(f"right_turn_{c}") for n, c in pairs_.items()}
    return [*[c.alias(n) for n, c in signed.items()], *[F.abs(c).alias(f"abs_{n}") for n, c in signed.items()]]


def cycle_correlation(a: DataFrame, b: DataFrame, key: str, time: str, value: str, prefix: str, points: int = 101) -> DataFrame:
    """Largest magnitude of the cross-correlation of two cycles per key, each resampled to `points` and standardised.
    a, b: the samples of the cycles, three at least."""
    fine = [signal.resample(enough(x.where(F.col(value).isNotNull()), key, 3), key, time, value, points).withColumnRenamed("value", n) for x, n in ((a, "_a"), (b, "_b"))]
    c = signal.cross_correlation(fine[0].join(fine[1], [key, "k"]), key, "k", "_a", "_b")
    return c.select(key, F.abs("peak").alias(f"{prefix}_xcorr_symmetry_score"), F.col("peak").alias(f"{prefix}_xcorr_peak_correlation"))


def widest_turn(df: DataFrame, key: str, axes: list[str], gyro: str, order: str = "i", time: str = "t", cutoff: float | None = 5.0) -> DataFrame:
    """The samples with |axis| of the axis of the largest mean magnitude, low-passed; the magnitude where no axis is known."""
    d = enough(df, key)
    best = d.groupBy(key).agg(F.array_min(F.array_compact(F.array(*[F.when(F.avg(F.abs(a)).isNotNull(), F.struct((-F.round(F.avg(F.abs(a)), 9)).alias("m"), F.lit(i).alias("i"))) for i, a in enumerate(axes)]))).alias("_b"))
    d = d.join(best, key).withColumn("axis", F.coalesce(F.abs(F.try_element_at(F.array(*axes), F.col("_b.i") + 1)), F.col(gyro))).drop("_b")
    return filtered(d, key, order, time, ["axis"], cutoff)


def table(samples: DataFrame, patient: str, date: str, activity: str, axes: list[str], motion: str = "motion", free: str = "acc_free", gyro: str = "gyro_mag", cutoff: float | None = 5.0, cut=same) -> DataFrame:
    """One row per patient and date: patient, date and all features in their fixed order. samples: preprocessed and
    truncated samples (i, t, the motion channel, the acceleration without its mean, the gyro magnitude and axes) of the
    activities walk, left_turn, right_turn, sit_to_stand and stand_to_sit; what is missing is null.

    Turn steps come from the acceleration without its mean, or from the motion channel where it is constant; all other
    features of acceleration are of the motion channel. The blocks do not depend on each other and run side by side."""
    keyed = samples.select(F.concat_ws("\u0001", F.col(patient).cast("string"), F.col(date).cast("string")).alias("_key"), F.col(patient).alias("_patient"), F.col(date).alias("_date"), F.col(activity).alias("_activity"), "i", "t", F.col(motion).alias("_motion"), F.col(free).alias("_free"), F.col(gyro).alias("_gyro"), *axes)
    keyed = cut(keyed)
    flat = F.coalesce(F.stddev_pop("_free").over(Window.partitionBy("_key", "_activity")) <= 1e-8, F.lit(True))
    of = lambda a: keyed.where(F.col("_activity") == a).select("_key", "i", "t", "_motion", "_gyro", F.when(flat, F.col("_motion")).otherwise(F.col("_free")).alias("_push0"), *axes)

    def one_turn(side):
        t = turn(of(side), "_key", "_push0", "_gyro", axes[0], cutoff=cutoff, cut=cut)
        return cut(t.select("_key", *[F.col(n).alias(f"{side}_{n}") for n in TURN]))

    def turn_cycle(side):
        d = cut(widest_turn(of(side), "_key", axes, "_gyro", cutoff=cutoff))
        return cut(segments.inside(d, "_key", "t", segments.turn_span(d, "_key", "i", "t", "axis").where("start is not null")))

    def one_move(kind):
        d, found = transition_details(of(kind), "_key", "_gyro", axes, cut=cut)
        t = transition_block(d, found, "_key", "_motion", "_gyro", cut=cut)
        return cut(t.select("_key", *[F.col(n).alias(f"{kind}_{n}") for n in TRANSITION])), cut(segments.inside(d, "_key", "t", found))

    sides, kinds = ("left_turn", "right_turn"), ("sit_to_stand", "stand_to_sit")
    with ThreadPoolExecutor(8) as pool:
        walked = pool.submit(lambda: cut(walk(of("walk"), "_key", "_motion", "_gyro", cut=cut)))
        bent = pool.submit(lambda: cut(nonlinear(of("walk"), "_key", "_motion", cut=cut)))
        turned, cycles, moved = ([pool.submit(f, x) for x in of_] for f, of_ in ((one_turn, sides), (turn_cycle, sides), (one_move, kinds)))
        moves = [m.result() for m in moved]
        blocks = [walked.result(), bent.result(), *[t.result() for t in turned], *[m[0] for m in moves]]
        blocks.append(cycle_correlation(*[c.result() for c in cycles], "_key", "t", "axis", "turn_left_right"))
        blocks.append(cycle_correlation(*[m[1] for m in moves], "_key", "t", "axis", "sitstand_standsit"))
    out = keyed.select("_key", F.col("_patient").alias(patient), F.col("_date").alias(date)).distinct()
    for b in blocks:
        out = out.join(b, "_key", "left")
    return out.select("*", *asymmetry(out)).select(patient, date, *feature_names())
