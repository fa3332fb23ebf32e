"""Study tables: canonical ids, coverage, participant summaries, reshaping and agreement over named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from stridelake.operators import stats
from stridelake.operators.series import ordered, whole
from stridelake.operators.windows import best_day_window


def numeric(df: DataFrame, *without: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without]


def natural_key(name: str) -> list[Column]:
    """Sort keys of an id: its first number (9999 where it has none), then the id."""
    return [F.coalesce(F.regexp_extract(name, "([0-9]+)", 1).try_cast("long"), F.lit(9999)), F.col(name)]


def padded(number: Column, prefix: str = "V", width: int = 2) -> Column:
    """V01 from 1."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def mapped(column: Column, values: dict) -> Column:
    """Lookup in a fixed map; what is not in it is null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column)


def any_value_in(*columns: str) -> Column:
    """Rows with at least one of the columns."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def complete(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def subject_map(pairs: DataFrame, legacy: dict[int, str] | None = None) -> DataFrame:
    """source, subject, rank from (subject, number): each number as patient_<n> (rank 1), legacy numbers that are not taken
    (rank 2) and each subject as itself (rank 0)."""
    spark = pairs.sparkSession
    own = pairs.select(F.col("subject").alias("source"), "subject", F.lit(0).alias("rank")).distinct()
    known = pairs.select(F.concat(F.lit("patient_"), F.col("number").cast("string")).alias("source"), "subject", F.lit(1).alias("rank"))
    old = spark.createDataFrame([(f"patient_{n}", s, 2) for n, s in (legacy or {}).items()], "source string, subject string, rank int")
    return own.unionByName(known).unionByName(old.join(known, "source", "left_anti"))


def canonical(rows: DataFrame, subjects: DataFrame, features: list[str], pattern: str = r"^SRS\d+$") -> DataFrame:
    """Rows under their canonical subject: unknown subjects, ids that do not match and rows without any feature go; of
    several sources for one subject and date the one of the lowest rank, then name, stays."""
    d = rows.join(F.broadcast(subjects), rows["patient_id"] == subjects["source"]).where(F.col("subject").rlike(pattern)).where(any_value_in(*features))
    pick = Window.partitionBy("subject", "date").orderBy("rank", "source")
    d = d.withColumn("_r", F.row_number().over(pick)).where("_r = 1")
    return d.select(F.col("subject").alias("patient_id"), "date", F.col("source").alias("source_patient_id"), *features)


def coverage(rows: DataFrame, subject: str, day: str, tasks: dict[str, list[str]], length: int = 30) -> DataFrame:
    """Per subject and task: first and last day, days, the best window of `length` days with its days as text. Days are
    dates; a day counts for a task when any of its columns is known."""
    parts = [rows.where(any_value_in(*columns)).select(subject, F.lit(task).alias("task"), F.col(day).cast("date").alias("day")) for task, columns in tasks.items()]
    days = reduce(DataFrame.unionByName, parts).where("day is not null").distinct().withColumn("key", F.concat_ws("\u0001", F.col(subject).cast("string"), "task"))
    days = days.withColumn("number", F.datediff("day", F.lit("1970-01-01").cast("date")))
    best = best_day_window(days.select("key", "number"), "key", "number", length)
    d = days.join(best.select("key", "start_day"), "key")
    inside = F.col("number").between(F.col("start_day"), F.col("start_day") + length - 1)
    text = F.date_format("day", "yyyy-MM-dd")
    out = d.groupBy(subject, "task").agg(
        F.min(text).alias("first_day"), F.max(text).alias("last_day"), F.count("*").alias("n_days"), F.first("start_day").alias("_s"), F.max(F.when(inside, text)).alias("last_inside"),
        F.count_if(inside).alias("n_inside"), F.array_join(F.array_sort(F.collect_list(F.when(inside, text))), ", ").alias("days_inside"),
    )
    start = F.date_add(F.lit("1970-01-01").cast("date"), F.col("_s").cast("int"))
    out = out.withColumns({"window_start": F.date_format(start, "yyyy-MM-dd"), "window_end": F.date_format(F.date_add(start, length - 1), "yyyy-MM-dd")}).drop("_s")
    # Tasks without a day have a row too.
    names = rows.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    every = rows.select(subject).distinct().crossJoin(F.broadcast(names))
    blank = {"n_days": F.coalesce("n_days", F.lit(0)), "n_inside": F.coalesce("n_inside", F.lit(0))} | {c: F.coalesce(c, F.lit("")) for c in ("first_day", "last_day", "window_start", "window_end", "last_inside", "days_inside")}
    return every.join(out, [subject, "task"], "left").withColumns(blank)


def medians_and_means(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """median_* and mean_* of every column per key."""
    return rows.groupBy(key).agg(*[F.median(c).alias(f"median_{c}") for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in columns])


def medians(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns])


def pooled_median(rows: DataFrame, key: str, columns: list[str], out: str) -> DataFrame:
    """Median, and how many values there are, over several columns taken as one."""
    return rows.select(key, F.explode(F.array(*columns)).alias("_v")).groupBy(key).agg(F.median("_v").alias(out), F.count("_v").alias(f"n_{out}"))


def first_days(rows: DataFrame, subject: str, day: str, required: list[str], count: int) -> DataFrame:
    """The first `count` complete days of subjects that have as many; several rows of a day give their medians."""
    columns = numeric(rows, subject, day)
    daily = medians(rows.where(complete(subject, day, *required)), [subject, day], columns)
    w = Window.partitionBy(subject)
    d = daily.withColumn("_i", F.row_number().over(w.orderBy(day))).withColumn("_n", F.count("*").over(w))
    return d.where((F.col("_n") >= count) & (F.col("_i") <= count)).drop("_i", "_n")


def home_features(rows: DataFrame, subject: str, day: str, required: list[str], left: list[str], right: list[str], count: int = 14) -> DataFrame:
    """Participant table of the first complete days: medians and means of all features, medians of the daily mean of
    each (left, right) pair as pooled_*, number of days and the first and last of them."""
    d = first_days(rows, subject, day, required, count)
    pools = {f"pooled_{a}_{b}": (F.col(a) + F.col(b)) / 2 for a, b in zip(left, right)}
    d = d.withColumns(pools)
    columns = numeric(d, subject, day, *pools)
    extra = d.groupBy(subject).agg(*[F.median(p).alias(p) for p in pools], F.count("*").alias("n_valid_days"), F.min(day).alias("first_valid_day"), F.max(day).alias("last_selected_day"))
    return medians_and_means(d, subject, columns).join(extra, subject)


def lab_features(rows: DataFrame, subject: str, visit: str, medians_of: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Participant table of all visits: number of visits, medians over columns pooled under each name with the number of
    values, medians and means of every column, and whether all the named medians are known."""
    out = medians_and_means(rows, subject, columns).join(rows.groupBy(subject).agg(F.countDistinct(visit).alias("n_visits")), subject)
    for name, pooled in medians_of.items():
        out = out.join(pooled_median(rows, subject, pooled, name), subject)
    return out.withColumn("complete_feature_set", complete(*medians_of))


def labelled(features: DataFrame, labels: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Features with the labels of their key, one row of labels a key."""
    return features.join(labels.dropDuplicates([key]), key, how)


def fixed_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns in their fixed order and types, then any others; what is missing is null."""
    there = set(df.columns)
    return df.select(*[F.col(c).try_cast(t).alias(c) if c in there else F.lit(None).cast(t).alias(c) for c, t in columns.items()], *[c for c in df.columns if c not in columns])


def wide(rows: DataFrame, keys: list[str], name: str, names: list[str], values: list[str]) -> DataFrame:
    """One row per key with {name}_{value} columns, for the given names; the first known value of each."""
    return rows.groupBy(*keys).agg(*[F.first(F.when(F.col(name) == n, F.col(v)), True).alias(f"{n}_{v}") for n in names for v in values])


def long(rows: DataFrame, keys: list[str], maps: dict[str, dict[str, str]], name: str = "activity") -> DataFrame:
    """Wide annotation columns to one row per key and activity: maps[activity][output] = input column; outputs an
    activity lacks, and inputs that are not there, are null. Rows without any output go."""
    outputs = list(dict.fromkeys(o for m in maps.values() for o in m))
    cell = lambda m, o: F.col(m[o]).try_cast("double") if m.get(o) in rows.columns else F.lit(None).cast("double")
    structs = [F.struct(F.lit(a).alias(name), *[cell(m, o).alias(o) for o in outputs]) for a, m in maps.items()]
    return rows.select(*keys, F.inline(F.array(*structs))).where(any_value_in(*outputs))


def ordinal(rows: DataFrame, keys: list[str], order, out: str = "trial_id") -> DataFrame:
    """Rows of each key numbered from 1 in order."""
    return rows.withColumn(out, F.row_number().over(ordered(keys, order)))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def crosstab(rows: DataFrame, x: str, y: str, xs: list, ys: list) -> DataFrame:
    """Counts for every pair of the given values, zero where there is none."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(a, b) for a in xs for b in ys], f"`{x}` {dict(rows.dtypes)[x]}, `{y}` {dict(rows.dtypes)[y]}")
    counts = rows.groupBy(x, y).agg(F.count("*").alias("n"))
    return every.join(counts, [x, y], "left").select(x, y, F.coalesce("n", F.lit(0)).alias("n"))


def formula_errors(rows: DataFrame, group: str, value: str, formula: Column) -> DataFrame:
    """Rows compared, and mean and largest absolute difference between a column and the formula it should follow."""
    e = F.abs(F.col(value) - formula)
    return rows.where(e.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"))


def quality_checks(rows: DataFrame, keys: list[str], columns: list[str], most: float = 0.2) -> DataFrame:
    """One row: rows, duplicate keys, rows without any value, and how many columns miss more than `most` of their values."""
    empty = (~any_value_in(*columns)).cast("long")
    agg = rows.agg(F.count("*").alias("n"), F.sum(empty).alias("n_empty"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"_{c}") for c in columns])
    agg = agg.select("n", F.coalesce("n_empty", F.lit(0)).alias("n_empty"), sum(F.coalesce((F.col(f"_{c}") > most).cast("long"), F.lit(0)) for c in columns).alias("n_sparse"))
    twice = rows.groupBy(*keys).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"))
    return agg.crossJoin(twice)  # one row each


def week_changes(weekly: DataFrame, group: str, subject: str, week: str, value: str) -> DataFrame:
    """Median over subjects and following weeks of the absolute change from week to week."""
    d = weekly.withColumn("_c", F.abs(F.col(value) - F.lag(value).over(ordered([group, subject], week))))
    return d.groupBy(group).agg(F.count("_c").alias("n_changes"), F.median("_c").alias("median_change"))


def top(rows: DataFrame, key: str, value: str, at: str, smallest: bool = False) -> DataFrame:
    """The first position of the largest (or smallest) value of each key."""
    v = F.col(value) if smallest else -F.col(value)
    m = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct(v.alias("v"), F.col(at).alias("a"))).alias("_m"))
    return m.select(key, F.col("_m.a").alias(at), (F.col("_m.v") if smallest else -F.col("_m.v")).alias(value))


def recalibrated(value: Column, slope: float = 1.0, intercept: float = 0.0, whole_steps: bool = False) -> Column:
    """slope * value + intercept, not below 0, as whole steps where wished (halves to even)."""
    x = F.greatest(F.lit(0.0), slope * value + intercept)
    return F.when(value.isNotNull(), F.rint(x) if whole_steps else x)


def with_errors(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """error, abs_error and percent_error of a against b (null where b is 0)."""
    e = F.col(a) - F.col(b)
    return pairs.withColumns({"error": e, "abs_error": F.abs(e), "percent_error": F.try_divide(e, F.nullif(F.abs(F.col(b)), F.lit(0.0))) * 100})


def compared(device: DataFrame, reference: DataFrame, keys: list[str], specs: list[dict], order: str) -> DataFrame:
    """Agreement of a device with a reference for each spec: one row with n, errors, correlation, limits and ICC(2,1).

    A spec names title, activity, device and reference columns, and slope, intercept and round of the device's
    recalibration. Of several trials of a key the first known value, in order of `order`, counts."""
    out = []
    for spec in specs:
        first = lambda d, c: d.where(F.col("activity") == spec["activity"]).groupBy(*keys).agg(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))  # noqa: B023, E731
        x = first(device, spec["device"]).withColumn("_x", recalibrated(F.col(spec["device"]), spec.get("slope", 1.0), spec.get("intercept", 0.0), spec.get("round", False)))
        y = first(reference, spec["reference"]).withColumn("_y", F.col(spec["reference"]).cast("double"))
        both = x.select(*keys, "_x").join(y.select(*keys, "_y"), keys).where("_x is not null and _y is not null")
        rated = both.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("s"), F.explode(F.array(F.struct(F.lit("x").alias("r"), F.col("_x").alias("v")), F.struct(F.lit("y").alias("r"), F.col("_y").alias("v")))).alias("e")).select("s", "e.r", "e.v")
        row = stats.agreement(both, "_x", "_y").crossJoin(stats.icc(rated, "s", "r", "v", "agreement").select("icc"))  # one row each
        out.append(row.select(F.lit(spec["title"]).alias("title"), "*", strength(F.col("icc")).alias("strength")))
    return reduce(DataFrame.unionByName, out)


def strength(icc: Column) -> Column:
    """Bands of an intraclass correlation: weak below 0.35, then fair, moderate from 0.5, strong from 0.75."""
    return F.when(icc >= 0.75, "strong").when(icc >= 0.5, "moderate").when(icc >= 0.35, "fair").when(icc.isNotNull(), "weak")


def sensor_pairs(rows: DataFrame, key: str, sensor: str, order: str, value: str, sensors: list[str]) -> DataFrame:
    """Samples of each pair of sensors (the first before the second in the list) beside each other, by order."""
    rank = mapped(F.col(sensor), {s: i for i, s in enumerate(sensors)})
    d = rows.select(key, order, F.col(sensor).alias("_s"), rank.alias("_k"), F.col(value).alias("_v")).where("_k is not null")
    a, b = d.alias("a"), d.alias("b")
    j = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{order}") == F.col(f"b.{order}")) & (F.col("a._k") < F.col("b._k")))
    return j.select(F.col(f"a.{key}").alias(key), F.col("a._s").alias("sensor_a"), F.col("b._s").alias("sensor_b"), F.col(f"a.{order}").alias(order), F.col("a._v").alias("a"), F.col("b._v").alias("b"))


def cluster_profile(rows: DataFrame, profile: str, columns: list[str]) -> DataFrame:
    """Size, means and medians of each profile."""
    return medians_and_means(rows, profile, columns).join(rows.groupBy(profile).agg(F.count("*").alias("n")), profile)


def ranked(rows: DataFrame, key: str, sort: list[Column], count: int) -> DataFrame:
    """The first `count` rows of each key."""
    w = Window.partitionBy(key).orderBy(*sort)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def shares(rows: DataFrame, key: str, *parts: str) -> DataFrame:
    """Share of each group within its key."""
    c = rows.groupBy(key, *parts).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(whole(key)))
