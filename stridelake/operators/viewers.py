"""Turns and walks as the interactive viewers and the validation report count them, and the activity score.

These share the spans of `segments` and differ from `features` in how a span is narrowed and steps are found. Rows whose
value or time is null are never part of a span or of a step; recordings without any have no row. For `cut` see features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.operators import features, segments, signal
from stridelake.operators.series import ordered, whole


def activity_score(df: DataFrame, key: str, channels: list[str], out: str = "score") -> DataFrame:
    """df with the largest robust z-score of the channels: distance from the median over 1.4826 MAD, or over the
    population deviation where that is 0. Channels without spread do not count; without any the score is null."""
    w = whole(key)
    d = df.withColumns({f"_m{i}": F.median(c).over(w) for i, c in enumerate(channels)})
    d = d.withColumns({f"_a{i}": F.abs(F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(channels)})
    scales = [F.coalesce(F.nullif(1.4826 * F.median(f"_a{i}").over(w), F.lit(0.0)), F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))) for i, c in enumerate(channels)]
    d = d.withColumns({f"_z{i}": F.col(f"_a{i}") / s for i, s in enumerate(scales)})
    best = F.array_max(F.array(*[f"_z{i}" for i in range(len(channels))]))
    return d.withColumn(out, best).drop(*[f"_{p}{i}" for p in "maz" for i in range(len(channels))])


def strong_span(df: DataFrame, key: str, order: str, time: str, value: str, broad: DataFrame, share: float = 0.15, gap: float = 0.15, run: float = 0.20, pad: float = 0.15) -> DataFrame:
    """key, threshold, start, end, duration, found: from the first to the last strong run of values that reach the broad
    span's threshold, padded. Gaps of `gap` seconds are closed; a run is strong if it lasts `run` seconds and its top
    reaches `share` of the recording's. The broad span where no run is strong; `found` tells whether any value reached
    the threshold."""
    d = segments.with_rate(df.where(F.col(value).isNotNull()), key, order, time).join(broad.select(key, "threshold"), key)
    d = d.withColumn("_n", F.max(order).over(whole(key)))
    hits = d.where(F.col(value) >= F.col("threshold"))
    prior = F.lag(order).over(ordered(key, order))
    hits = hits.withColumn("_new", F.when(F.col(order) - prior - 1 <= segments.samples(gap, F.col("fs")), 0).otherwise(1))
    hits = hits.withColumn("_island", F.sum("_new").over(ordered(key, order))).withColumn("_floor", share * F.max(value).over(whole(key)))
    runs = hits.groupBy(key, "_island").agg(F.min(order).alias("_a"), F.max(order).alias("_b"), F.max(value).alias("_top"), *[F.first(c).alias(c) for c in ("_floor", "_n", "fs")])
    strong = (F.col("_b") - F.col("_a") + 1 >= segments.samples(run, F.col("fs"))) & (F.col("_top") >= F.col("_floor"))
    side = segments.samples(pad, F.first("fs"))
    edge = runs.groupBy(key).agg(F.greatest(F.lit(0), F.min(F.when(strong, F.col("_a"))) - side).alias("first"), F.least(F.first("_n"), F.max(F.when(strong, F.col("_b"))) + side).alias("last"), F.max(strong).alias("_strong"))
    times = segments.with_times(df, key, order, time, edge.where("_strong").select(key, "first", "last")).select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    out = broad.join(edge.select(key, F.lit(True).alias("_hit")), key, "left").join(times, key, "left")
    out = out.select(key, "threshold", F.coalesce("_s", "start").alias("start"), F.coalesce("_e", "end").alias("end"), F.coalesce("_hit", F.lit(False)).alias("found"))
    return out.withColumn("duration", F.col("end") - F.col("start"))


def within(df: DataFrame, key: str, order: str, time: str, value: str, span: DataFrame) -> DataFrame:
    """The known samples of a span (none without one), numbered from 0 as `_at`, with their rate."""
    s = span.where("start is not null and end is not null").select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    d = df.join(s, key).where(F.col(time).between(F.col("_s"), F.col("_e")) & F.col(value).isNotNull()).drop("_s", "_e")
    return segments.with_rate(segments.numbered(d, key, order, "_at"), key, order, time)


def mean_steps(d: DataFrame, key: str, time: str, value: str, sigma: float, apart: float, k: float, rounded: bool, cut=features.same) -> tuple[DataFrame, DataFrame]:
    """The smoothed samples (key, _at, time, smooth, limit) of spans of three samples or more, and the peaks that reach
    limit = k * the mean of the smoothed samples, `apart` seconds off."""
    d = d.withColumn("_c", F.count("*").over(whole(key))).where("_c >= 3 and fs is not null")
    s = signal.smoothed(d.withColumn("_apart", segments.samples(apart, F.col("fs"), rounded)), key, "_at", value, sigma, keep=(time, "_apart"))
    s = cut(s.withColumn("limit", k * F.avg("smooth").over(whole(key))))
    return s, cut(signal.peaks(s, key, "_at", "smooth", distance="_apart", height="limit"))


def crossings(smooth: DataFrame, peaks: DataFrame, key: str, time: str, limit: str = "limit") -> DataFrame:
    """key, start, end, duration, n: from the sample after the last one under the limit before the first peak (the first
    sample where none is) to the first one under it behind the last peak (or the last sample)."""
    p = peaks.groupBy(key).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").cast("double").alias("n"))
    under = F.col("smooth") < F.col(limit)
    j = smooth.join(p, key)
    before, behind = F.max(F.when(under & (F.col("_at") <= F.col("_first")), F.col("_at"))), F.min(F.when(under & (F.col("_at") >= F.col("_last")), F.col("_at")))
    edge = j.groupBy(key).agg(F.coalesce(before + 1, F.lit(0)).alias("_a"), F.coalesce(behind, F.max("_at")).alias("_b"), F.first("n").alias("n"))
    at = smooth.join(edge, key).groupBy(key).agg(F.max(F.when(F.col("_at") == F.col("_a"), F.col(time))).alias("start"), F.max(F.when(F.col("_at") == F.col("_b"), F.col(time))).alias("end"), F.first("n").alias("n"))
    return at.withColumn("duration", F.col("end") - F.col("start"))


def per(n: Column, seconds: Column, unit: float = 1.0) -> Column:
    return F.when(seconds > 0, unit * n / seconds)


def viewed_turn(df: DataFrame, key: str, acc: str, velocity: str, order: str = "i", time: str = "t", sigma: float = 1.0, k: float = 1.0, apart: float = 0.37, cut=features.same) -> DataFrame:
    """Turns of the turn viewer: the turn's span narrowed to its strong runs, steps in it, then its edges moved to where
    the steps' signal crosses its threshold. Velocities are those of the final span, or of all samples without one."""
    d = cut(df.select(key, order, time, acc, F.abs(velocity).alias("_vel")))
    broad = cut(segments.turn_span(d, key, order, time, "_vel"))
    span = cut(strong_span(d, key, order, time, "_vel", broad))
    inner = cut(within(d, key, order, time, acc, span))
    smooth, peaks = mean_steps(inner, key, time, acc, sigma, apart, k, True, cut)
    moved = cut(crossings(smooth, peaks, key, time)).select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), "n")
    limit = smooth.groupBy(key).agg(F.first("limit").alias("step_threshold"))
    held = inner.groupBy(key).agg(F.lit(0.0).alias("_none"))  # a span with samples and no peak has no steps
    shown = lambda c: F.coalesce(f"_{c[0]}", F.when(F.col("found"), F.col(c)))
    final = cut(span.join(moved, key, "left").join(held, key, "left").join(limit, key, "left").select(
        key, "threshold", "step_threshold", F.coalesce("n", "_none").alias("step_count"), shown("start").alias("start"), shown("end").alias("end"), F.coalesce("_s", "start").alias("_from"), F.coalesce("_e", "end").alias("_to")))
    speed = segments.inside(d, key, time, final.select(key, F.col("_from").alias("start"), F.col("_to").alias("end"))).groupBy(key).agg(F.max("_vel").alias("peak_angular_velocity"), F.avg("_vel").alias("mean_angular_velocity"))
    out = final.join(speed, key, "left").withColumn("duration", F.col("end") - F.col("start"))
    return out.select(key, "threshold", "step_threshold", "start", "end", "duration", "step_count", per(F.col("step_count"), F.col("duration")).alias("steps_per_second"), "peak_angular_velocity", "mean_angular_velocity")


def reported_turn(df: DataFrame, key: str, acc: str, velocity: str, order: str = "i", time: str = "t", width: float = 1.0, sigma: float = 1.0, k: float = 1.0, apart: float = 0.45, beta: float = 0.6, cut=features.same) -> DataFrame:
    """Turns of the validation report: the turn's span over windows of `width` seconds, steps in it, and its pauses under
    the same threshold; these stand for duration, steps and pause time of the turn features there."""
    d = cut(df.select(key, order, time, acc, F.abs(velocity).alias("_vel")))
    span = cut(segments.turn_span(d, key, order, time, "_vel", width))
    inner = cut(within(d, key, order, time, acc, span))
    _, peaks = mean_steps(inner, key, time, acc, sigma, apart, k, False, cut)
    counted = inner.select(key).distinct().join(peaks.groupBy(key).agg(F.count("*").cast("double").alias("_p")), key, "left").select(key, F.coalesce("_p", F.lit(0.0)).alias("step_count"))
    quiet = within(d, key, order, time, "_vel", span).join(span.select(key, "threshold"), key).withColumn("_q", F.col("_vel") < F.col("threshold"))
    pause = features.pauses(quiet, key, order, time, "_q", beta)
    return span.join(counted, key, "left").join(pause, key, "left").select(key, "threshold", "start", "end", "duration", "step_count", "pause_time")


def viewed_walk(df: DataFrame, key: str, acc: str, order: str = "i", time: str = "t", sigma: float = 2.0, apart: float = 0.37, scale: float = 1.0, cut=features.same) -> DataFrame:
    """Walks of the walk viewer: peaks of a prominence of scale * threshold in the active span, whose edges then move to
    where the smoothed signal crosses the threshold. Frequency and regularity are those of the active span (of all
    samples without one), at the recording's own rate."""
    d = cut(df.select(key, order, time, acc).where(F.col(acc).isNotNull()))
    span = cut(segments.active_span(d, key, time, acc, cap=None, least=1.0))
    inner = within(d, key, order, time, acc, span).join(span.select(key, F.col("threshold").alias("limit")), key)
    inner = cut(inner.withColumns({"_apart": segments.samples(apart, F.col("fs")), "_rise": scale * F.col("limit")}))
    smooth = cut(signal.smoothed(inner, key, "_at", acc, sigma, keep=(time, "limit", "_apart", "_rise")))
    peaks = cut(signal.peaks(smooth, key, "_at", "smooth", distance="_apart", height="limit", prominence="_rise", keep=(time,)))
    moved = crossings(smooth, peaks, key, time).where("duration > 0").select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    count = cut(features.step_times(peaks, key, time))
    active = cut(segments.inside(d, key, time, span))
    hz = signal.dominant_frequency(active, key, order, acc).select(key, F.col("hz").alias("_hz"))
    out = cut(span.select(key, "threshold", "start", "end").join(features.rate(d, key, order, time), key, "left").join(count, key, "left").join(hz, key, "left").join(moved, key, "left"))
    lag = F.coalesce(F.rint(F.col("mean_step_time") * F.col("fs")), F.rint(F.try_divide(F.lit(1.0), "_hz"))).cast("long")
    regular = features.regularity(active, key, order, acc, out.select(key, lag.alias("lag")).where("lag is not null"))
    out = out.join(regular, key, "left").withColumns({"start": F.coalesce("_s", "start"), "end": F.coalesce("_e", "end"), "step_count": F.coalesce("step_count", F.lit(0.0))})
    out = out.withColumn("duration", F.col("end") - F.col("start"))
    return out.select(
        key, "threshold", "start", "end", "duration", "step_count", per(F.col("step_count"), F.col("duration"), 60.0).alias("cadence"), "mean_step_time", "step_time_std", "step_time_cv",
        (F.col("_hz") * F.col("fs")).alias("dominant_frequency"), "step_regularity", "stride_regularity",
    )
