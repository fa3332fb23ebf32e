"""Boolean masks along a series: runs, gap closing, minimal runs, pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.series import ordered


def runs(df: DataFrame, key: str, order, mask: str, time: str) -> DataFrame:
    """Runs of equal mask: number, value, samples, first and last time."""
    w = ordered(key, order)
    d = df.withColumn("_new", F.coalesce((F.col(mask) != F.lag(mask).over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("run", F.sum("_new").over(w))
    return d.groupBy(key, "run", F.col(mask).alias("on")).agg(F.count("*").alias("n"), F.min(time).alias("start_time"), F.max(time).alias("end_time"))


def close_gaps(r: DataFrame, key: str, most: int) -> DataFrame:
    """Runs after inner gaps of at most `most` samples are closed."""
    w = Window.partitionBy(key)
    d = r.withColumn("_lo", F.min("run").over(w)).withColumn("_hi", F.max("run").over(w))
    inner = ~F.col("on") & (F.col("n") <= most) & (F.col("run") > F.col("_lo")) & (F.col("run") < F.col("_hi"))
    d = d.withColumn("on", F.col("on") | inner)
    o = Window.partitionBy(key).orderBy("run")
    d = d.withColumn("_new", F.coalesce((F.col("on") != F.lag("on").over(o)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(o))
    return d.groupBy(key, "run", "on").agg(F.sum("n").alias("n"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def largest(r: DataFrame, key: str) -> DataFrame:
    pick = Window.partitionBy(key).orderBy(F.desc("n"), "run")
    return r.where("on").withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_r", "on")


def pauses(r: DataFrame, key: str, beta: float = 0.6) -> DataFrame:
    """Quiet runs of two samples and more that last beta * their median or longer: count and total."""
    q = r.where("not on and n >= 2").withColumn("s", F.col("end_time") - F.col("start_time"))
    q = q.withColumn("_m", F.median("s").over(Window.partitionBy(key)) * beta)
    return q.groupBy(key).agg(F.count_if(F.col("s") >= F.col("_m")).alias("n_pauses"), F.sum(F.when(F.col("s") >= F.col("_m"), F.col("s")).otherwise(0.0)).alias("pause_s"))
