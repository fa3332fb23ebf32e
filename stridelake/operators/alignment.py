"""Nearest as-of alignment as one union and two windows: no product of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_asof(left: DataFrame, right: DataFrame, by: str, on: str, value: str, tolerance: int) -> DataFrame:
    """left with the value of the right row nearest in `on` (the earlier on ties), null beyond the tolerance.

    Of right rows with equal key and time the largest value counts. Null times are dropped."""
    r = right.where(F.col(on).isNotNull()).groupBy(by, on).agg(F.max(value).alias("_v"))
    r = r.select(by, on, F.struct(F.col(on).alias("t"), F.col("_v").alias("v")).alias("_r"), F.lit(False).alias("_left"))
    both = left.where(F.col(on).isNotNull()).select(by, on, F.lit(True).alias("_left")).unionByName(r, allowMissingColumns=True)
    # Within one time the right row goes before the left ones in both directions, so running frames see it.
    forth = Window.partitionBy(by).orderBy(F.col(on), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0)
    back_ = Window.partitionBy(by).orderBy(F.col(on).desc(), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last("_r", True).over(forth)).withColumn("_f", F.last("_r", True).over(back_)).where("_left")
    back, ahead = F.col(on) - F.col("_b.t"), F.col("_f.t") - F.col(on)
    earlier = ahead.isNull() | (back <= ahead)
    pick = F.when(earlier, F.when(back <= tolerance, F.col("_b.v"))).otherwise(F.when(ahead <= tolerance, F.col("_f.v")))
    return both.select(by, on, pick.alias(value))


def synchronised(timeline: DataFrame, sensors: dict[str, DataFrame | None], by: str, on: str, tolerance: int, axes: tuple = ("x", "y", "z")) -> DataFrame:
    """The distinct times of `timeline` with each sensor's nearest axes (sensor_axis); what has no partner within the
    tolerance, and sensors that are missing, are 0."""
    out = timeline.select(by, on).where(F.col(on).isNotNull()).distinct()
    for name, rows in sensors.items():
        names = [f"{name}_{a}" for a in axes]
        if rows is None:
            out = out.select("*", *[F.lit(0.0).alias(n) for n in names])
            continue
        near = nearest_asof(out.select(by, on), rows.select(by, on, F.struct(*axes).alias("_xyz")), by, on, "_xyz", tolerance)
        near = near.select(by, on, *[F.coalesce(F.col(f"_xyz.{a}").cast("double"), F.lit(0.0)).alias(n) for a, n in zip(axes, names)])
        out = out.join(near, [by, on], "left")
    return out


def sensors_wide(rows: DataFrame, by: str, on: str, sensor: str, prefixes: dict[str, str], axes: tuple = ("x", "y", "z"), tolerance: float | None = None) -> DataFrame:
    """One row for each distinct time of the sensors of a recording, with each sensor's row nearest in time as
    <prefix>_<axis>: by, on and these columns. prefixes: the sensors that count, and their columns' prefix.

    Ties go to the earlier row; of a sensor's rows of one time the largest axes count; what has no partner within the
    tolerance, sensors that a recording lacks and null axes are 0. Without a tolerance it is 0.1 s, or 100 where a
    recording's times pass 1e12 and so are milliseconds. Null times are dropped.

    All sensors share one aggregate by time and one pair of running windows, however many they are."""
    d = rows.where(F.col(on).isNotNull() & F.col(sensor).isin(*prefixes))
    one = lambda s: F.max(F.when(F.col(sensor) == s, F.struct(F.col(on).alias("t"), *axes)))
    d = d.groupBy(by, on).agg(*[one(s).alias(f"_{i}") for i, s in enumerate(prefixes)])
    forth = Window.partitionBy(by).orderBy(F.col(on)).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by).orderBy(F.col(on).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = {f"_{w}{i}": F.last(f"_{i}", True).over(over) for i in range(len(prefixes)) for w, over in (("b", forth), ("f", back))}
    limit = F.lit(tolerance) if tolerance is not None else F.when(F.max(on).over(Window.partitionBy(by)) > 1e12, 100.0).otherwise(0.1)
    d = d.withColumns(near | {"_limit": limit})
    out = []
    for i, prefix in enumerate(prefixes.values()):
        before, after_ = F.col(on) - F.col(f"_b{i}.t"), F.col(f"_f{i}.t") - F.col(on)
        pick = F.when(after_.isNull() | (before <= after_), F.when(before <= F.col("_limit"), F.col(f"_b{i}"))).otherwise(F.when(after_ <= F.col("_limit"), F.col(f"_f{i}")))
        out += [F.coalesce(pick[a].cast("double"), F.lit(0.0)).alias(f"{prefix}_{a}") for a in axes]
    return d.select(by, on, *out)
