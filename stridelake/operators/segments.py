"""Segments of recordings: thresholds, active spans, turn windows, refinements and extremes, as window plans.

A recording is the rows of one key; `order` numbers its samples from 0 without gaps (see `numbered`), `time` is in
seconds. A span is one row per key: start, end, duration and, where samples are meant, first and last sample. Keys
without a span have nulls. Rows whose value or time is null are never part of a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.series import ordered, whole

SPAN = ("start", "end", "duration")


def numbered(df: DataFrame, key: str, order, out: str = "i") -> DataFrame:
    """Samples numbered from 0."""
    return df.withColumn(out, F.row_number().over(ordered(key, order)) - 1)


def capped(limit: Column, top: Column, cap: float | None) -> Column:
    """A threshold that is at most cap * top; without a cap, or where top is not positive, the threshold itself."""
    return F.when(top > 0, F.least(limit, cap * top)).otherwise(limit) if cap else limit


def window_ranges(df: DataFrame, key: str, time: str, value: str, width: float = 1.0) -> DataFrame:
    """Windows of `width` seconds from the first sample: win, start, low, high, mid, p2p, n. Windows without samples are
    there with nulls; the last window holds its right edge."""
    d = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    d = d.withColumn("_t0", F.min(time).over(whole(key))).withColumn("_n", F.floor((F.max(time).over(whole(key)) - F.col("_t0")) / width))
    d = d.withColumn("win", F.least(F.floor((F.col(time) - F.col("_t0")) / width), "_n"))
    got = d.groupBy(key, "win").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"), F.first("_t0").alias("_t0"), F.first("_n").alias("_n"))
    # Each window that has samples makes itself and the empty ones before the next.
    after = F.coalesce(F.lead("win").over(ordered(key, "win")) - 1, F.col("_n"))
    got = got.withColumn("_after", after).withColumn("_w", F.explode(F.sequence("win", "_after")))
    here = F.col("_w") == F.col("win")
    out = got.select(key, F.col("_w").alias("win"), (F.col("_t0") + F.col("_w") * width).alias("start"), *[F.when(here, F.col(c)).alias(c) for c in ("low", "high")], F.when(here, F.col("n")).otherwise(0).alias("n"))
    return out.withColumn("mid", (F.col("low") + F.col("high")) / 2).withColumn("p2p", F.col("high") - F.col("low"))


def spread_threshold(df: DataFrame, key: str, value: str, k: float, cap: float | None = 0.3, fallback: float | None = None) -> DataFrame:
    """key, threshold: median + k * MAD of the values, at most cap * the largest; `fallback` where there is no value."""
    d = df.withColumn("_m", F.median(value).over(whole(key)))
    d = d.groupBy(key).agg((F.first("_m", True) + k * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_t"), F.max(value).alias("_x"))
    return d.select(key, F.coalesce(capped(F.col("_t"), F.col("_x"), cap), F.lit(fallback).cast("double")).alias("threshold"))


def active_span(df: DataFrame, key: str, time: str, value: str, width: float = 1.0, k: float = 0.25, cap: float | None = 0.3, least: float = 0.8, fallback: float = 0.3, fixed: bool = False) -> DataFrame:
    """From the first to the last window whose range reaches the threshold; shorter ones than `least` seconds are none.

    The threshold is median + k * MAD of the windows' ranges (with fixed: `fallback` itself). The end is not beyond the
    last sample. Also n_active windows."""
    w = window_ranges(df, key, time, value, width)
    if fixed:
        t = w.select(key).distinct().withColumn("threshold", F.lit(float(fallback)))
    else:
        t = spread_threshold(w, key, "p2p", k, cap, fallback)
    last = df.where(F.col(time).isNotNull()).groupBy(key).agg(F.max(time).alias("_last"))
    on = F.col("p2p") >= F.col("threshold")
    s = w.join(t, key).groupBy(key).agg(F.first("threshold").alias("threshold"), F.min(F.when(on, F.col("start"))).alias("start"), F.max(F.when(on, F.col("start"))).alias("_e"), F.count_if(on).alias("n_active"))
    s = s.join(last, key).withColumn("end", F.least(F.col("_last"), F.col("_e") + width)).withColumn("duration", F.col("end") - F.col("start"))
    ok = F.col("duration") >= least
    return s.select(key, "threshold", "n_active", *[F.when(ok, F.col(c)).alias(c) for c in SPAN])


def mask_span(df: DataFrame, key: str, order: str, time: str, on: Column, gap: Column, run: Column, pad: Column) -> DataFrame:
    """From the first to the last sample of a mask, after inner gaps of at most `gap` samples are closed and runs of
    fewer than `run` samples are dropped, with `pad` samples on both sides: first, last, start, end, duration."""
    w = ordered(key, order)
    d = df.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("_n", F.count("*").over(whole(key)))
    d = d.withColumn("_gap", gap).withColumn("_run", run).withColumn("_pad", pad)
    hits = d.where("_on").select(key, order, "_n", "_gap", "_run", "_pad")
    prior = F.lag(order).over(w)
    hits = hits.withColumn("_new", F.when(prior.isNull() | (F.col(order) - prior - 1 > F.col("_gap")), 1).otherwise(0))
    hits = hits.withColumn("_island", F.sum("_new").over(w))
    islands = hits.groupBy(key, "_island").agg(F.min(order).alias("_a"), F.max(order).alias("_b"), *[F.first(c).alias(c) for c in ("_n", "_run", "_pad")])
    islands = islands.where(F.col("_b") - F.col("_a") + 1 >= F.col("_run"))
    span = islands.groupBy(key).agg(F.greatest(F.lit(0), F.min("_a") - F.first("_pad")).cast("long").alias("first"), F.least(F.first("_n") - 1, F.max("_b") + F.first("_pad")).cast("long").alias("last"))
    return with_times(df, key, order, time, span)


def with_times(df: DataFrame, key: str, order: str, time: str, span: DataFrame) -> DataFrame:
    """Start, end and duration of spans of samples."""
    at = df.join(span, key).groupBy(key).agg(F.first("first").alias("first"), F.first("last").alias("last"), F.max(F.when(F.col(order) == F.col("first"), F.col(time))).alias("start"), F.max(F.when(F.col(order) == F.col("last"), F.col(time))).alias("end"))
    return at.withColumn("duration", F.col("end") - F.col("start"))


def samples(seconds: float, fs: Column, rounded: bool = True, least: int = 1) -> Column:
    """A number of samples for a time at the rate fs, `least` at least and where there is no rate."""
    n = F.rint(seconds * fs) if rounded else F.floor(seconds * fs)
    return F.greatest(F.lit(least), F.coalesce(n, F.lit(least))).cast("long")


def with_rate(df: DataFrame, key: str, order: str, time: str, out: str = "fs") -> DataFrame:
    """Rate from the median positive step of time."""
    step = F.col(time) - F.lag(time).over(ordered(key, order))
    d = df.withColumn("_step", step)
    return d.withColumn(out, F.try_divide(F.lit(1.0), F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(whole(key)))).drop("_step")


def turn_span(df: DataFrame, key: str, order: str, time: str, value: str, width: float = 0.4, k: float = 5.0, cap: float | None = 0.3, least: float = 0.8, fallback: float = 0.1) -> DataFrame:
    """The turn by a threshold on the samples: gaps of 0.6 s closed, runs of 0.25 s kept, 0.15 s added on both sides;
    where nothing is left, the active span at the fixed threshold 0.3."""
    limit = spread_threshold(window_ranges(df, key, time, value, width), key, "p2p", k, cap, fallback)
    d = with_rate(df.join(limit, key), key, order, time)
    fs = F.col("fs")
    found = mask_span(d, key, order, time, F.col(value) >= F.col("threshold"), samples(0.60, fs, False), samples(0.25, fs, False), F.coalesce(F.floor(0.15 * fs), F.lit(1)).cast("long"))
    rest = active_span(df, key, time, value, width, least=least, fixed=True).select(key, *[F.col(c).alias(f"_{c}") for c in SPAN])
    every = limit.join(found.select(key, F.lit(True).alias("_found"), *SPAN), key, "left").join(rest, key, "left")
    return every.select(key, "threshold", *[F.when(F.col("_found"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in SPAN])


def peak_span(df: DataFrame, key: str, order: str, time: str, value: str, share: float = 0.25, gap: float = 0.20, pad: float = 0.10) -> DataFrame:
    """From the first to the last sample of `share` of the largest value or more, gaps of `gap` seconds closed."""
    d = with_rate(df, key, order, time).withColumn("_top", share * F.max(value).over(whole(key)))
    span = mask_span(d, key, order, time, F.col(value) >= F.col("_top"), samples(gap, F.col("fs")), F.lit(1), samples(pad, F.col("fs")))
    limit = df.groupBy(key).agg((share * F.max(value)).alias("threshold"))
    return limit.join(span, key, "left")


def inside(df: DataFrame, key: str, time: str, span: DataFrame) -> DataFrame:
    """The samples within the span (closed at both ends); of keys without a span all samples."""
    s = span.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    d = df.join(s, key, "left").where(F.col("_s").isNull() | F.col("_e").isNull() | F.col(time).between(F.col("_s"), F.col("_e")))
    return d.drop("_s", "_e")


def refined_span(df: DataFrame, key: str, order: str, time: str, value: str, broad: DataFrame, k: float = 3.0, cap: float | None = 0.3, fallback: float = 0.1, least: float = 0.5) -> DataFrame:
    """From the first to the last sample within the broad span whose magnitude reaches median + k * MAD there; the broad
    span itself where that is shorter than `least` seconds."""
    d = inside(df.where(F.col(value).isNotNull()), key, time, broad).withColumn("_a", F.abs(value))
    d = d.join(spread_threshold(d, key, "_a", k, cap, fallback), key)
    on = F.col("_a") >= F.col("threshold")
    s = d.groupBy(key).agg(F.first("threshold").alias("threshold"), F.min(time).alias("_s"), F.max(time).alias("_e"), F.min(F.when(on, F.col(time))).alias("start"), F.max(F.when(on, F.col(time))).alias("end"))
    kept = (F.col("end") - F.col("start")) >= least
    s = s.select(key, "threshold", F.when(kept, F.col("start")).otherwise(F.col("_s")).alias("start"), F.when(kept, F.col("end")).otherwise(F.col("_e")).alias("end"))
    return s.withColumn("duration", F.col("end") - F.col("start"))


def strongest_region(df: DataFrame, key: str, order: str, time: str, value: str, on: Column, gap: Column, run: Column) -> DataFrame:
    """Of the runs of a mask (gaps of at most `gap` samples closed, `run` samples at least) the one with the largest
    range of values, the first of equals: first, last, start, end, duration."""
    d = df.where(F.col(key).isNotNull()).select(key, F.col(order).alias("_o"), F.col(time).alias("_t"), F.col(value).alias("_v"), F.coalesce(on, F.lit(False)).alias("_on"), gap.alias("_gap"), run.alias("_run"))
    # Every sample is of the run that began last, and counts up to that run's last hit.
    w, hit = ordered(key, "_o"), F.when(F.col("_on"), F.col("_o"))
    prior = F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(F.col("_on") & (prior.isNull() | (F.col("_o") - prior - 1 > F.col("_gap"))), 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(w)).where("_island > 0").withColumn("_z", F.max(hit).over(Window.partitionBy(key, "_island"))).where("_o <= _z")
    s = d.groupBy(key, "_island").agg(
        F.min("_o").cast("long").alias("first"), F.max("_o").cast("long").alias("last"), F.min_by("_t", "_o").alias("start"), F.max_by("_t", "_o").alias("end"),
        F.min_by("_run", "_o").alias("_run"), F.round(F.max("_v") - F.min("_v"), 9).alias("_score"),
    )
    best = Window.partitionBy(key).orderBy(F.desc("_score"), "first")
    s = s.where(F.col("last") - F.col("first") + 1 >= F.col("_run")).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return s.select(key, "first", "last", "start", "end").withColumn("duration", F.col("end") - F.col("start"))


def extremes(df: DataFrame, key: str, order: str, time: str, value: str) -> DataFrame:
    """Largest and smallest value with their samples and times; the first of equals."""
    v = F.round(value, 9)
    hi, lo = F.min(F.struct((-v).alias("x"), F.col(order).alias("o"), F.col(time).alias("t"), F.col(value).alias("v"))), F.min(F.struct(v.alias("x"), F.col(order).alias("o"), F.col(time).alias("t"), F.col(value).alias("v")))
    e = df.where(F.col(value).isNotNull()).groupBy(key).agg(hi.alias("h"), lo.alias("l"))
    return e.select(key, F.col("h.v").alias("flexion_peak"), F.col("h.t").alias("flexion_time"), F.col("h.o").alias("flexion_at"), F.col("l.v").alias("extension_peak"), F.col("l.t").alias("extension_time"), F.col("l.o").alias("extension_at"))


def motion_end(df: DataFrame, key: str, order: str, time: str, value: str, span: DataFrame, anchored: bool = False) -> DataFrame:
    """Flexion and extension within the span, and the span's end moved to the first later sample in it that falls under
    the threshold (span has threshold, start, end).

    Anchored: the start moves too, to the last sample under the threshold before the first extreme (or the first
    sample), and the end is sought in the whole recording (or is its last sample)."""
    d = df.where(F.col(value).isNotNull())
    e = extremes(inside(d, key, time, span), key, order, time, value).join(span.select(key, "threshold", "start", "end"), key)
    e = e.withColumn("_a", F.least("flexion_at", "extension_at")).withColumn("_b", F.greatest("flexion_at", "extension_at"))
    j = d.select(key, F.col(order).alias("_o"), F.col(time).alias("_t"), F.abs(value).alias("_v")).join(e, key)
    under = F.col("_v") < F.col("threshold")
    if anchored:
        ends = j.groupBy(key).agg(
            F.coalesce(F.max(F.when(under & (F.col("_o") <= F.col("_a")), F.col("_t"))), F.min("_t")).alias("start"),
            F.coalesce(F.min(F.when(under & (F.col("_o") >= F.col("_b")), F.col("_t"))), F.max("_t")).alias("end"),
        )
    else:
        within = F.col("_t").between(F.col("start"), F.col("end"))
        ends = j.groupBy(key).agg(F.first("start").alias("start"), F.coalesce(F.min(F.when(under & within & (F.col("_o") > F.col("_b")), F.col("_t"))), F.first("end")).alias("end"))
    return e.drop("start", "end", "_a", "_b").join(ends, key).withColumn("duration", F.col("end") - F.col("start"))


def crossing_span(df: DataFrame, key: str, order: str, time: str, value: str, peaks: DataFrame, threshold: str) -> DataFrame:
    """A walk cut to its steps: from the last sample under the threshold before the first peak to the first one behind
    the last peak (or the recording's ends). peaks: key, first, last (samples) and the threshold's column."""
    j = df.where(F.col(value).isNotNull()).join(peaks, key)
    under = F.col(value) < F.col(threshold)
    s = j.groupBy(key).agg(
        F.coalesce(F.max(F.when(under & (F.col(order) <= F.col("first")), F.col(time))), F.min(time)).alias("start"),
        F.coalesce(F.min(F.when(under & (F.col(order) >= F.col("last")), F.col(time))), F.max(time)).alias("end"),
    )
    return s.withColumn("duration", F.col("end") - F.col("start"))


def main_motion(df: DataFrame, key: str, order: str, time: str, value: str, broad: DataFrame, share: float = 0.15) -> DataFrame:
    """Within the broad span from the first to the last sample of at least the larger of its threshold and `share` of
    the largest value; the broad span where there is none."""
    d = inside(df.where(F.col(value).isNotNull()), key, time, broad).join(broad.select(key, "threshold"), key)
    d = d.withColumn("_limit", F.greatest("threshold", share * F.max(value).over(whole(key))))
    on = F.col(value) >= F.col("_limit")
    s = d.groupBy(key).agg(F.coalesce(F.min(F.when(on, F.col(time))), F.min(time)).alias("start"), F.coalesce(F.max(F.when(on, F.col(time))), F.max(time)).alias("end"))
    return s.withColumn("duration", F.col("end") - F.col("start"))


def motion_window(df: DataFrame, key: str, order: str, time: str, smooth: str, k: float = 3.0, least: float = 0.25, pad: float = 0.0) -> DataFrame:
    """The region of motion with the largest peak times length: the magnitude of the (smoothed) signal around its median
    above median + k * 1.4826 MAD for `least` seconds, widened to where it falls to the exit threshold; around the largest
    magnitude where there is no such region."""
    d = with_rate(df.where(F.col(smooth).isNotNull()).select(key, order, time, F.col(smooth).alias("_x")), key, order, time)
    d = d.withColumn("_a", F.abs(F.col("_x") - F.median("_x").over(whole(key)))).withColumn("_m", F.median("_a").over(whole(key)))
    d = d.withColumn("_d", 1.4826 * F.median(F.abs(F.col("_a") - F.col("_m"))).over(whole(key))).withColumn("_thr", F.col("_m") + k * F.col("_d"))
    d = d.withColumn("_exit", F.greatest(0.35 * F.col("_thr"), F.col("_m") + 0.5 * F.col("_d"))).withColumn("_n", F.count("*").over(whole(key)))
    d = d.withColumn("_len", samples(least, F.col("fs"))).withColumn("_pad", F.rint(pad * F.coalesce("fs", F.lit(0.0))).cast("long"))
    w = ordered(key, order)
    hits = d.where("_a > _thr")
    hits = hits.withColumn("_island", F.col(order) - F.row_number().over(w))
    regions = hits.groupBy(key, "_island").agg(F.min(order).alias("_s"), F.max(order).alias("_e"), F.max("_a").alias("_p"), F.count("*").alias("_c"), F.first("_len").alias("_l")).where("_c >= _l")
    best = Window.partitionBy(key).orderBy(F.desc(F.round(F.col("_p") * F.col("_c"), 9)), "_s")
    regions = regions.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "_s", F.col("_e") + 1)
    regions = regions.toDF(key, "_s", "_e")
    j = d.join(regions, key, "left")
    quiet = F.col("_a") <= F.col("_exit")
    top = F.min(F.struct((-F.round("_a", 9)).alias("x"), F.col(order).alias("o")))
    s = j.groupBy(key).agg(
        F.first("_s").alias("_s"), F.first("_n").alias("_n"), F.first("_len").alias("_l"), F.first("_pad").alias("_pad"), top.alias("_top"),
        F.max(F.when(quiet & (F.col(order) <= F.col("_s")), F.col(order))).alias("_from"), F.min(F.when(quiet & (F.col(order) >= F.col("_e")), F.col(order))).alias("_to"),
    )
    found = F.col("_s").isNotNull()
    first = F.when(found, F.coalesce("_from", F.lit(0)) - F.col("_pad")).otherwise(F.col("_top.o") - F.col("_l"))
    last = F.when(found, F.coalesce("_to", F.col("_n") - 1) + F.col("_pad")).otherwise(F.col("_top.o") + F.col("_l"))
    span = s.select(key, F.greatest(F.lit(0), first).cast("long").alias("first"), F.least(F.col("_n") - 1, last).cast("long").alias("last"))
    return with_times(df, key, order, time, span)
