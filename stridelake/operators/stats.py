"""Agreement, repeatability and association statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def icc(long: DataFrame, subject: str, rater: str, value: str, kind: str = "consistency") -> DataFrame:
    """n, k and ICC(3,1) (consistency) or ICC(2,1) (agreement) of complete subjects; null where it is not defined."""
    k = long.agg(F.countDistinct(rater).alias("k"))
    full = long.where(F.col(value).isNotNull()).groupBy(subject, rater).agg(F.avg(value).alias("v"))
    whole = full.groupBy(subject).agg(F.count("*").alias("c"), F.avg("v").alias("rm")).crossJoin(F.broadcast(k)).where("c = k").drop("c")  # k: one row
    d = full.join(whole, subject)
    cols = d.groupBy(rater).agg(F.avg("v").alias("cm"))
    g = d.agg(F.avg("v").alias("g"), F.countDistinct(subject).alias("n"), F.max("k").alias("k"))
    s = d.join(cols, rater).crossJoin(F.broadcast(g.select("g", "n")))
    t = s.agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum(F.pow(F.col("rm") - F.col("g"), 2)).alias("sr"), F.sum(F.pow(F.col("cm") - F.col("g"), 2)).alias("sc"), F.sum(F.pow(F.col("v") - F.col("g"), 2)).alias("st"))
    t = t.withColumn("msr", F.try_divide("sr", F.col("n") - 1)).withColumn("msc", F.try_divide("sc", F.col("k") - 1))
    t = t.withColumn("mse", F.try_divide(F.col("st") - F.col("sr") - F.col("sc"), (F.col("n") - 1) * (F.col("k") - 1)))
    down = F.col("msr") + (F.col("k") - 1) * F.col("mse")
    if kind == "agreement":
        down = down + F.col("k") * (F.col("msc") - F.col("mse")) / F.col("n")
    return t.select("n", "k", F.when(down > 0, (F.col("msr") - F.col("mse")) / down).alias("icc"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, MAE, RMSE, bias, correlation and Bland-Altman limits of a against b."""
    e = F.col(a) - F.col(b)
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = p.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr(a, b).alias("r"), F.stddev_samp(e).alias("_s"))
    return out.select("n", "mae", "rmse", "bias", "r", (F.col("bias") - 1.96 * F.col("_s")).alias("loa_low"), (F.col("bias") + 1.96 * F.col("_s")).alias("loa_high"))


def two_by_two(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cells of the 2x2 table, chi-square without correction, and phi; null when a margin is empty."""
    c = lambda u, v: F.count_if((F.col(x) == u) & (F.col(y) == v))
    t = df.agg(c(0, 0).alias("a"), c(0, 1).alias("b"), c(1, 0).alias("c"), c(1, 1).alias("d"))
    a, b, cc, d = (F.col(k).cast("double") for k in "abcd")
    n = a + b + cc + d
    t = t.withColumn("chi2", F.try_divide(F.pow(a * d - b * cc, 2) * n, (a + b) * (cc + d) * (a + cc) * (b + d)))
    return t.withColumn("phi", F.sqrt(F.try_divide("chi2", n)))


def repeatability(weekly: DataFrame, group: str, subject: str, week: str, value: str) -> DataFrame:
    """Median over subjects of the coefficient of variation (percent) with its quartile range."""
    s = weekly.groupBy(group, subject).agg((F.try_divide(F.stddev_samp(value), F.abs(F.avg(value))) * 100).alias("cv"))
    return s.groupBy(group).agg(F.count("cv").alias("n"), F.median("cv").alias("cv_median"), (F.percentile("cv", 0.75) - F.percentile("cv", 0.25)).alias("cv_iqr"))


def fisher(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cells of the 2x2 table and the two-sided p of Fisher's exact test: the sum over all tables with these margins that
    are not likelier than the observed one."""
    t = two_by_two(df, x, y).select(*(F.col(k).cast("long") for k in "abcd"))
    r, c, n = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    t = t.withColumns({"_r": r, "_c": c, "_n": n})
    many = t.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_r") + F.col("_c") - F.col("_n")), F.least("_r", "_c"))))
    cells = [("k", -1), ("_r - k", -1), ("_c - k", -1), ("_n - _r - _c + k", -1), ("_r", 1), ("_n - _r", 1), ("_c", 1), ("_n - _c", 1), ("_n", -1)]
    many = many.withColumn("_p", F.exp(sum((sign * log_factorial(F.expr(cell)) for cell, sign in cells), F.lit(0.0))))
    own = F.max(F.when(F.col("k") == F.col("a"), F.col("_p"))).over(Window.partitionBy("_n"))
    many = many.withColumn("_own", own)
    return many.groupBy(*"abcd").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("_p") <= F.col("_own") * (1 + 1e-7), F.col("_p")))).alias("p"))


def log_factorial(n):
    """ln n! of a column: exact up to 20, then Stirling's series (its error is below 1e-15 there)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * 3.141592653589793 * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)
