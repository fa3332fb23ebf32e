"""Operators on keyed, ordered series: every function takes the key, order and value columns by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key, order):
    key = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*key).orderBy(*([order] if isinstance(order, str) else order))


def whole(key):
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def after(key, order):
    """The rows from the end of the series to the current one: what a following frame would hold, at linear cost."""
    order = [order] if isinstance(order, str) else list(order)
    key = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)


def number(c: str) -> Column:
    """Lenient double; NaN is null."""
    return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))


def sampling_meta(df: DataFrame, key: str, time: str) -> DataFrame:
    """n, median positive step, rate and duration of each series."""
    step = F.col(time) - F.lag(time).over(ordered(key, time))
    d = df.where(F.col(time).isNotNull()).withColumn("step", step)
    out = d.groupBy(key).agg(F.count("*").alias("n_samples"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("dt_s"), (F.max(time) - F.min(time)).alias("duration_s"))
    return out.withColumn("fs_hz", F.try_divide(F.lit(1.0), F.col("dt_s")))


def unwrap_clock(df: DataFrame, key: str, order: str, time: str, jump: float = 1.0, out: str = "unwrapped") -> DataFrame:
    """A clock that falls back by more than `jump` goes on from where it was plus the median positive step."""
    w = ordered(key, order)
    d = df.withColumn("_step", F.col(time) - F.lag(time).over(w))
    d = d.withColumn("_dt", F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(whole(key)))
    add = F.when(F.col("_step") < -jump, F.coalesce("_dt", F.lit(0.0)) - F.col("_step")).otherwise(0.0)
    return d.withColumn("_add", add).withColumn(out, F.col(time) + F.sum("_add").over(w)).drop("_step", "_dt", "_add")


def collapse_duplicates(df: DataFrame, key: str, time: str, *channels: str) -> DataFrame:
    return df.groupBy(key, time).agg(*[F.avg(c).alias(c) for c in channels])


def interpolate_columns(df: DataFrame, key: str, order: str, values: dict[str, str], axis: str | None = None) -> DataFrame:
    """df with each value (a key of `values`) filled under its new name: linear between known values by position, or along
    the column `axis`; the ends take the nearest known value. All values share one window."""
    w, names = ordered(key, order), lambda of: ", ".join(f"`{c}`" for c in ([of] if isinstance(of, str) else of))
    d = df.withColumn("_i", F.row_number().over(w))
    x = F.col(axis) if axis else F.col("_i")
    d = d.withColumns({f"_k{j}": F.when(F.col(v).isNotNull(), F.struct(x.alias("i"), F.col(v).alias("v"))) for j, v in enumerate(values)})
    # Known values on both sides come from one sort.
    forth = {f"_a{j}": F.last(f"_k{j}", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for j in range(len(values))}
    back = {f"_b{j}": F.expr(f"lead(_k{j}, 1) IGNORE NULLS OVER (PARTITION BY {names(key)} ORDER BY {names(order)})") for j in range(len(values))}
    d = d.withColumns(forth | back).withColumns({f"_b{j}": F.coalesce(f"_k{j}", f"_b{j}") for j in range(len(values))})

    def filled(j: int) -> Column:
        a, b = F.col(f"_a{j}"), F.col(f"_b{j}")
        inner = a["v"] + (b["v"] - a["v"]) * (x - a["i"]) / (b["i"] - a["i"])
        return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["i"] == b["i"]), a["v"]).otherwise(inner)

    return d.withColumns({out: filled(j) for j, out in enumerate(values.values())}).drop("_i", *[f"_{s}{j}" for s in "kab" for j in range(len(values))])


def interpolate(df: DataFrame, key: str, order: str, value: str, out: str = "filled", axis: str | None = None) -> DataFrame:
    """interpolate_columns for one value."""
    return interpolate_columns(df, key, order, {value: out}, axis)


def gradients(df: DataFrame, key: str, time: str, slopes: dict[str, str]) -> DataFrame:
    """Second-order differences of each value (a key of `slopes`) on an uneven grid, first-order ones at the ends; missing
    values are bridged along the time for their neighbours and stay missing."""
    d = interpolate_columns(df, key, time, {v: f"_f{j}" for j, v in enumerate(slopes)}, axis=time)
    w = ordered(key, time)
    near = {"_t0": F.lag(time).over(w), "_t1": F.lead(time).over(w)}
    for j in range(len(slopes)):
        near |= {f"_l{j}": F.lag(f"_f{j}").over(w), f"_h{j}": F.lead(f"_f{j}").over(w)}
    d = d.withColumns(near)
    hs, hd = F.col(time) - F.col("_t0"), F.col("_t1") - F.col(time)

    def slope(j: int, value: str) -> Column:
        f, lo, hi = F.col(f"_f{j}"), F.col(f"_l{j}"), F.col(f"_h{j}")
        inner = F.try_divide(hs * hs * hi + (hd * hd - hs * hs) * f - hd * hd * lo, hs * hd * (hs + hd))
        ends = F.when(hs.isNull(), F.try_divide(hi - f, hd)).when(hd.isNull(), F.try_divide(f - lo, hs))
        return F.when(F.col(value).isNotNull(), ends.otherwise(inner))

    return d.withColumns({out: slope(j, v) for j, (v, out) in enumerate(slopes.items())}).drop("_t0", "_t1", *[f"_{s}{j}" for s in "flh" for j in range(len(slopes))])


def gradient(df: DataFrame, key: str, time: str, value: str, out: str = "slope") -> DataFrame:
    """gradients of one value."""
    return gradients(df, key, time, {value: out})


def zscore(df: DataFrame, key, value: str, out: str = "z", sample: bool = False, flat: float | None = None) -> DataFrame:
    """The value less its mean over its population (or sample) deviation; where there is none, `flat` (None: null)."""
    w = whole(key)
    deviation = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), deviation)
    return df.withColumn(out, z if flat is None else F.when(F.col(value).isNotNull(), F.coalesce(z, F.lit(flat))))


def centre(df: DataFrame, key, value: str, how=F.avg, out: str = "centred") -> DataFrame:
    return df.withColumn(out, F.col(value) - how(value).over(whole(key)))


def tail(df: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """The last `seconds` of a longer series."""
    return df.withColumn("_m", F.max(time).over(whole(key))).where(F.col(time) >= F.col("_m") - seconds).drop("_m")


def head(df: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    return df.withColumn("_m", F.min(time).over(whole(key))).where(F.col(time) <= F.col("_m") + seconds).drop("_m")


def mad(df: DataFrame, key: str, value: str) -> DataFrame:
    d = df.withColumn("_m", F.median(value).over(whole(key)))
    return d.groupBy(key).agg(F.max("_m").alias("median"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))


def rolling_variance(df: DataFrame, key: str, order, value: str, rows: int = 50, out: str = "rolling_var") -> DataFrame:
    return df.withColumn(out, F.var_samp(value).over(ordered(key, order).rowsBetween(1 - rows, 0)))


def baseline(df: DataFrame, key: str, order, value: str, rows: int = 100, out: str = "baseline") -> DataFrame:
    """df with the mean of the first `rows` known values of each series."""
    known = F.sum(F.col(value).isNotNull().cast("int")).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_c", known)
    return d.withColumn(out, F.avg(F.when(F.col("_c") <= rows, F.col(value))).over(whole(key))).drop("_c")


def local_peaks(df: DataFrame, key: str, order, value: str) -> DataFrame:
    """Strict local maxima that reach the series' 55th percentile."""
    w = ordered(key, order)
    d = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_h", F.percentile(value, 0.55).over(whole(key)))
    return d.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_h"))).drop("_a", "_b", "_h")


def autocorrelation(df: DataFrame, key: str, order, value: str, lag: int) -> DataFrame:
    d = centre(df, key, value, out="_x")
    d = d.withColumn("_y", F.lag("_x", lag).over(ordered(key, order)))
    return d.groupBy(key).agg(F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x"))).alias("acf"))
