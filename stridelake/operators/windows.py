"""Tumbling windows, active spans, event clusters and calendar windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.series import ordered, whole


def tumbling(df: DataFrame, key: str, micros: str, value: str, width: int) -> DataFrame:
    """Low, high, middle and range of each window of `width` microseconds from the series' first sample."""
    d = df.withColumn("_t0", F.min(micros).over(whole(key)))
    d = d.withColumn("win", F.floor((F.col(micros) - F.col("_t0")) / width).cast("long"))
    out = d.groupBy(key, "win").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return out.withColumn("mid", (F.col("low") + F.col("high")) / 2).withColumn("p2p", F.col("high") - F.col("low"))


def active_window(windows: DataFrame, key: str, k: float = 0.25, cap: float | None = None) -> DataFrame:
    """First to last window whose range reaches median + k * MAD (at most cap * the largest range)."""
    w = whole(key)
    d = windows.withColumn("_m", F.median("p2p").over(w)).withColumn("_d", F.median(F.abs(F.col("p2p") - F.col("_m"))).over(w))
    limit = F.col("_m") + k * F.col("_d")
    if cap:
        limit = F.least(limit, cap * F.max("p2p").over(w))
    d = d.withColumn("threshold", limit)
    on = F.when(F.col("p2p") >= F.col("threshold"), F.col("win"))
    out = d.groupBy(key).agg(F.max("threshold").alias("threshold"), F.min(on).alias("first_win"), F.max(on).alias("last_win"), F.count(on).alias("n_active"))
    return out.withColumn("n_span", F.col("last_win") - F.col("first_win") + 1)


def clusters(df: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """Events not more than `gap` after the one before are one cluster: its mean time and size."""
    w = ordered(key, time)
    d = df.withColumn("_new", (F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(float("inf"))) > gap).cast("int"))
    return d.withColumn("cluster", F.sum("_new").over(w)).groupBy(key, "cluster").agg(F.avg(time).alias("mean_time"), F.count("*").alias("n"))


def best_run_of_events(df: DataFrame, key: str, time: str, events: int = 11) -> DataFrame:
    """The window of `events` events with the steadiest intervals; ties go to the one nearest the middle, then the first."""
    w = ordered(key, time)
    d = df.withColumn("_gap", F.lead(time).over(w) - F.col(time))
    inner = w.rowsBetween(0, events - 2)
    d = d.withColumn("end_time", F.lead(time, events - 1).over(w)).withColumn("_cv", F.try_divide(F.stddev_pop("_gap").over(inner), F.avg("_gap").over(inner)))
    mid = (F.min(time).over(whole(key)) + F.max(time).over(whole(key))) / 2
    d = d.withColumn("_off", F.abs((F.col(time) + F.col("end_time")) / 2 - mid)).where("end_time is not null")
    pick = Window.partitionBy(key).orderBy(F.round("_cv", 9), F.round("_off", 6), time)
    return d.withColumn("_r", F.row_number().over(pick)).where("_r = 1").select(key, F.col(time).alias("start_time"), "end_time", F.col("_cv").alias("cv"))


def best_day_window(days: DataFrame, key: str, day: str, length: int = 30) -> DataFrame:
    """The window of `length` days with the most recorded days, the earliest of equals; days: one row per day number."""
    w = Window.partitionBy(key).orderBy(day).rangeBetween(0, length - 1)
    d = days.withColumn("n_days", F.count("*").over(w))
    pick = Window.partitionBy(key).orderBy(F.desc("n_days"), day)
    return d.withColumn("_r", F.row_number().over(pick)).where("_r = 1").select(key, F.col(day).alias("start_day"), "n_days")


def with_weeks(df: DataFrame, key: str, day: str) -> DataFrame:
    first = F.min(day).over(whole(key))
    return df.withColumn("home_day", F.col(day) - first + 1).withColumn("home_week", F.floor((F.col("home_day") - 1) / 7).cast("long") + 1)
