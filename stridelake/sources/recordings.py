"""Scans of recording folders, their canonical samples and the preprocess pipeline, and the sinks of feature tables.

Folders hold <patient>/<date>/<activity>.csv (or deeper, under other names). Everything is one scan: rows carry their
file's path, and what a path means is columns, so that Spark prunes and deals files as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.operators import segments, series, signal
from stridelake.operators.series import ordered, whole

# The names under which recorders write each channel, and how long an activity's recording is kept.
NAMES = {
    "timestamp": ["timestamp", "time"],
    "acc_x": ["accel_x", "acc_x"], "acc_y": ["accel_y", "acc_y"], "acc_z": ["accel_z", "acc_z"],
    "useracc_x": ["useraccel_x", "useracc_x", "linacc_x", "linearacc_x"], "useracc_y": ["useraccel_y", "useracc_y", "linacc_y", "linearacc_y"], "useracc_z": ["useraccel_z", "useracc_z", "linacc_z", "linearacc_z"],
    "gyro_x": ["gyro_x", "gyr_x"], "gyro_y": ["gyro_y", "gyr_y"], "gyro_z": ["gyro_z", "gyr_z"],
}
KEPT = {"walk": 31.0, "left_turn": 11.0, "right_turn": 11.0, "sit_to_stand": 17.0, "stand_to_sit": 17.0}
CHANNELS = [c for c in NAMES if c != "timestamp"]


def scan(spark: SparkSession, folder: str, numeric: float = 0.8) -> DataFrame:
    """path, seq, the canonical channels and `dated` of every CSV file below a folder, whatever its columns' names, order
    and case; channels a file lacks, and cells that are no numbers, are null. seq numbers a file's lines from 0.

    Where fewer than `numeric` of a file's timestamps are numbers, they are date-times (ISO; UTC where no zone is given),
    and timestamp is seconds since 1970: `dated` tells so. Cells in double quotes may hold commas.

    Files are read as lines, a file whole at a time, since each has its own header; a recording fits a task. Files that
    cannot be read give no rows (see `expected`)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", "true").text(folder, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r\n?|﻿", "\n"), "\n")
    d = files.select(F.col("_metadata.file_path").alias("path"), F.filter(lines, lambda x: F.length(F.trim(x)) > 0).alias("_l"))
    d = d.where(F.size("_l") > 1).withColumn("_h", F.transform(cells(F.get("_l", F.lit(0))), lambda c: F.lower(c)))
    # Each line is cut into cells once, and each name sought once in a file's header.
    d = d.withColumn("_l", F.transform(F.slice("_l", F.lit(2), F.size("_l") - 1), cells))
    # The first name that the header has; null where there is none.
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("_h", n), F.lit(0).cast("long")) for n in names]).cast("int")
    clean = lambda c: F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    d = d.withColumns({f"_at_{c}": place(names) for c, names in NAMES.items()})
    at = F.col("_at_timestamp")
    plain = F.size(F.filter("_l", lambda x: clean(F.try_element_at(x, at)).isNotNull()))
    d = d.withColumn("_dated", at.isNotNull() & (plain < numeric * F.size("_l")))
    d = d.select("path", "_dated", *[f"_at_{c}" for c in NAMES], F.posexplode("_l").alias("seq", "_row"))
    value = lambda c: F.try_element_at("_row", F.col(f"_at_{c}"))
    time = value("timestamp")
    return d.select("path", F.col("seq").cast("long").alias("seq"), F.when(F.col("_dated"), epoch(time)).otherwise(clean(time)).alias("timestamp"), *[clean(value(c)).alias(c) for c in CHANNELS], F.col("_dated").alias("dated"))


def cells(line: Column) -> Column:
    """The cells of a line, trimmed and without their quotes."""
    quoted = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    parts = F.when(line.contains('"'), F.transform(quoted, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))).otherwise(F.split(line, ","))
    return F.transform(parts, lambda c: F.trim(c))


def epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO date-time, in UTC where it names no zone; null for anything else."""
    whole_ = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), text)
    zoned = F.when(whole_.rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2}|UTC|GMT)$") & whole_.rlike("[T ]"), whole_).otherwise(F.concat(whole_, F.when(whole_.rlike("[T ]"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.unix_micros(zoned.try_cast("timestamp")) / 1e6


def placed(rows: DataFrame, folder_depth: int = 2) -> DataFrame:
    """rows with patient, date and stem from their path: .../<patient>/<date>/.../<stem>.csv; folders that begin with a
    dot and templates are left out."""
    part = lambda i: F.regexp_extract("path", rf"/([^/]+)/(\d{{4}}-\d{{2}}-\d{{2}}[^/]*)/(?:.*/)?([^/]+)\.csv$", i)
    d = rows.withColumns({"patient": part(1), "date": part(2), "stem": F.lower(part(3))})
    return d.where((F.col("patient") != "") & ~F.col("path").rlike(r"/\.[^/]*/") & ~F.lower("path").contains("/template"))


def decoded(path: Column) -> Column:
    """A file's path as it was named: Spark gives spaces and other characters as %XX."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def joined(text: Column) -> Column:
    """Lower case, everything but letters and digits as underscores, which also begin and end it."""
    return F.concat(F.lit("_"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def resolved(files: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """For each patient, date and activity the file to use, from (path, patient, date, stem): `<activity>.csv` right below
    the date's folder, else the best of the files in whose path below that folder an alias begins after a separator: +20
    for a synchronised one, +10 for an alias in the name itself, +5 for the activity in it; of equal ones the first path."""
    d = files.select("path", "patient", "date").distinct().withColumn("_path", decoded(F.col("path")))
    below = F.expr("substring(_path, locate(concat('/', patient, '/', date, '/'), _path) + length(patient) + length(date) + 3)")
    d = d.withColumns({"_below": below, "_all": joined(below), "_name": joined(F.regexp_extract(below, r"([^/]*)\.csv$", 1))})
    scores = []
    for activity, others in aliases.items():
        has = lambda c: F.exists(F.array(*map(F.lit, others)), lambda a: F.contains(c, F.concat(F.lit("_"), a)))  # noqa: B023, E731
        score = 20 * F.col("_all").contains("synchronized").cast("int") + 10 * has(F.col("_name")).cast("int") + 5 * F.col("_name").contains(activity).cast("int")
        exact = F.col("_below") == f"{activity}.csv"
        scores.append(F.struct(F.lit(activity).alias("activity"), exact.alias("exact"), F.when(exact | has(F.col("_all")), score).alias("score")))
    d = d.select("path", "patient", "date", F.inline(F.array(*scores))).where("score is not null")
    best = F.min(F.struct((~F.col("exact")).alias("e"), F.when(F.col("exact"), 0).otherwise(-F.col("score")).alias("s"), "path"))
    return d.groupBy("patient", "date", "activity").agg(best.alias("b")).select("patient", "date", "activity", F.col("b.path").alias("path"))


def expected(days: DataFrame, found: DataFrame, activities: list[str]) -> DataFrame:
    """Every activity of every (patient, date) with its path, null where there is no file."""
    spine = days.select("patient", "date").distinct().select("*", F.explode(F.array(*map(F.lit, activities))).alias("activity"))
    return spine.join(found, ["patient", "date", "activity"], "left")


def first_file(files: DataFrame, keys: list[str], path: str = "path", last: bool = False) -> DataFrame:
    """One file per key: a synchronised one if there is any, then the first (or last) in order of paths."""
    sync = F.lower(path).contains("synchronized")
    order = [F.desc(sync), F.desc(path) if last else F.asc(path)]
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest(days: DataFrame, patient: str, date: str) -> DataFrame:
    return days.groupBy(patient).agg(F.max(date).alias(date))


def seconds(df: DataFrame, key: str, order: str, time: str, out: str = "ts") -> DataFrame:
    """Time in seconds: its unit follows from the median positive step (over 1e8: nanoseconds, 1e5: micro, 1: milli), but
    for rows whose column `dated` (where there is one) says that they are seconds."""
    d = df.withColumn("_step", F.col(time) - F.lag(time).over(ordered(key, order)))
    step = F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(whole(key))
    scale = F.when(step > 1e8, 1e9).when(step > 1e5, 1e6).when(step > 1, 1e3).otherwise(1.0)
    scale = F.when(F.col("dated"), 1.0).otherwise(scale) if "dated" in df.columns else scale
    return d.withColumn(out, F.col(time) / scale).drop("_step")


def magnitude(prefix: str) -> Column:
    return F.sqrt(sum((F.col(f"{prefix}_{a}") * F.col(f"{prefix}_{a}") for a in "xyz"), F.lit(0.0)))


def derived(df: DataFrame, key: str, time: str = "t", magnitudes: bool = True) -> DataFrame:
    """The magnitudes (unless they are there), the acceleration without its mean and the four jerks."""
    d = df.withColumns({f"{p}_mag": magnitude(p) for p in ("acc", "useracc", "gyro")}) if magnitudes else df
    d = series.centre(d, key, "acc_mag", out="acc_free")
    return series.gradients(d, key, time, {"acc_mag": "acc_jerk", "acc_free": "acc_free_jerk", "useracc_mag": "useracc_jerk", "gyro_mag": "gyro_jerk"})


def preprocess(rows: DataFrame, key: str = "path", cutoff: float | None = 5.0, degree: int = 4, derive: bool = True) -> DataFrame:
    """Samples (key, i, t and channels) from scanned rows: seconds, clock resets taken out in order of arrival, equal
    times averaged, gaps filled by position, magnitudes (low-passed at `cutoff` where it is given), then `derived`; not
    with `derive` False, for samples that `truncated` derives anew."""
    d = seconds(rows.where("timestamp is not null"), key, "seq", "timestamp")
    d = series.unwrap_clock(d, key, "seq", "ts", out="ts")
    d = series.collapse_duplicates(d, key, "ts", *CHANNELS)
    d = series.interpolate_columns(d, key, "ts", {c: c for c in CHANNELS})
    d = segments.numbered(d, key, "ts").withColumn("t", F.col("ts") - F.min("ts").over(whole(key)))
    d = d.withColumns({f"{p}_mag": magnitude(p) for p in ("acc", "useracc", "gyro")})
    if cutoff:
        d = signal.low_pass_columns(segments.with_rate(d, key, "i", "t"), key, "i", ["acc_mag", "useracc_mag", "gyro_mag"], cutoff, "fs", degree)
    return derived(d, key, magnitudes=False) if derive else d


def truncated(samples: DataFrame, key: str, activity: Column, kept: dict[str, float] = KEPT) -> DataFrame:
    """The last seconds of recordings longer than their activity's, with time, number and what is derived anew; filters
    are not run again."""
    limit = F.coalesce(*[F.when(activity == a, F.lit(s)) for a, s in kept.items()], F.lit(float("inf")))
    d = samples.withColumn("_last", F.max("t").over(whole(key))).where(F.col("t") >= F.col("_last") - limit).drop("_last", "i")
    d = segments.numbered(d, key, "t").withColumn("t", F.col("t") - F.min("t").over(whole(key)))
    return derived(d, key, magnitudes=False)


def motion_channel(samples: DataFrame, key: str, peak: float | None = 1e-8, out: str = "motion") -> DataFrame:
    """The user acceleration where it moves (deviation above 1e-8, and magnitude above `peak` where that is given), else
    the acceleration without its mean; and which of them it is."""
    moves = F.coalesce(F.stddev_pop("useracc_mag").over(whole(key)) > 1e-8, F.lit(False))
    if peak is not None:
        moves = moves & (F.max(F.abs("useracc_mag")).over(whole(key)) > peak)
    d = samples.withColumn("_m", moves)
    return d.withColumn(out, F.when(F.col("_m"), F.col("useracc_mag")).otherwise(F.col("acc_free"))).withColumn(f"{out}_source", F.when(F.col("_m"), "useracc_mag").otherwise("acc_free")).drop("_m")


def sensor_signal(sensor: Column) -> Column:
    """The walk signal of a lab sensor."""
    return F.when(sensor == "right", F.col("gyro_x")).when(sensor == "left", F.abs("gyro_x")).when(sensor == "trunk", F.col("gyro_mag")).when(sensor == "sacrum", F.col("gyro_z")).otherwise(F.col("acc_free"))


def recorder_json(texts: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """path, key, seq, sensor, timestamp, x, y, z of recorder files: the first key of the object whose value is a list of
    objects holds the samples; each field may go by two names. Files without such a key give no rows."""
    field = lambda o, *names: F.coalesce(*[F.try_element_at(o, F.lit(n)) for n in names])
    top = F.from_json(F.col(text), "map<string,string>")
    rows = F.transform(F.map_entries(top), lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], "array<map<string,string>>").alias("rows")))
    first = F.filter(rows, lambda e: (F.size(e["rows"]) > 0) & e["rows"][0].isNotNull())
    d = texts.select(F.col(path).alias("path"), F.try_element_at(first, F.lit(1)).alias("_f")).where("_f is not null")
    d = d.select("path", F.col("_f.key").alias("key"), F.posexplode("_f.rows").alias("seq", "_o"))
    number = lambda *names: field(F.col("_o"), *names).try_cast("double")
    return d.select("path", "key", "seq", field(F.col("_o"), "sensorType", "Sensor Type").alias("sensor"), number("timestamp", "Timestamp").alias("timestamp"), number("x", "X").alias("x"), number("y", "Y").alias("y"), number("z", "Z").alias("z"))


def write_csv(rows: DataFrame, folder: str, partition: str | None = None, places: int = 3) -> None:
    """CSV files with a header, numbers rounded to `places`, empty cells for null and NaN; one folder for each value of
    `partition`. What was in the folder is replaced, and an empty table leaves a file with its header."""
    text = lambda n: F.when(F.col(n).isNotNull() & ~F.isnan(n), F.format_string(f"%.{places}f", F.round(n, places)))
    out = rows.select(*[text(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in rows.dtypes])
    if not partition and out.isEmpty():
        out = out.coalesce(1)
    # Tasks put their files in place themselves: with many small ones the driver would spend its time renaming.
    writer = out.write.mode("overwrite").option("header", "true").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (writer.partitionBy(partition) if partition else writer).csv(folder)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows under all columns; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
