"""Study files: tables with headers of their own, annotations, labels, subject maps, and the manifest of features.

A folder of CSV files is one scan: each row keeps its cells under its own file's column names, and columns come from these,
so that files need neither the same columns nor the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import tables
from stridelake.sources.discovery import listed
from stridelake.sources.recordings import cells, decoded

# Where the features of the participants' table come from.
MANIFEST = [
    ("walk_cadence_steps_min", "median sacrum 10-step walking cadence across all available laboratory visits and NW trials", "median smartphone walking cadence across the first 14 valid days"),
    ("pooled_median_turn_duration_s", "median of available sacrum left/right turn durations across all available laboratory visits", "median daily mean of left/right smartphone turn durations across 14 days"),
    ("pooled_median_turn_step_count", "median of available sacrum left/right turn step counts across all available laboratory visits", "median daily mean of left/right smartphone turn step counts across 14 days"),
    ("sit_to_stand_duration_s", "median sacrum sit-to-stand duration across all available laboratory visits and STS trials", "median smartphone sit-to-stand duration across 14 days"),
]


def csv_rows(spark: SparkSession, folder: str, names: str = "*.csv") -> DataFrame:
    """path, seq and cells (name to text) of the rows of all files; of columns of one name the first counts, empty cells are
    null. A file is read whole, since it has its own header; files without rows give none (see `skipped`)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("ignoreCorruptFiles", "true").text(folder, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", "\r\n?|﻿", "\n"), "\n"), lambda x: F.length(F.trim(x)) > 0)
    d = files.select(decoded(F.col("_metadata.file_path")).alias("path"), lines.alias("_l")).where(F.size("_l") > 1)
    # The header is a column before the lines become rows, so that no row carries its whole file.
    d = d.withColumn("_h", cells(F.get("_l", F.lit(0)))).withColumn("_l", F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))))
    d = d.select("path", "_h", F.posexplode("_l").alias("seq", "_row"))
    cell = F.transform(cells(F.col("_row")), lambda c: F.nullif(c, F.lit("")))
    pairs = F.transform(F.arrays_zip(F.col("_h").alias("h"), cell.alias("c")), lambda e, i: F.struct(e["h"].alias("name"), e["c"].alias("value"), (F.array_position("_h", e["h"]) == i + 1).alias("first")))
    kept = F.filter(pairs, lambda e: (e["name"] != "") & e["first"])
    return d.select("path", F.col("seq").cast("long").alias("seq"), F.map_from_entries(F.transform(kept, lambda e: F.struct(e["name"], e["value"]))).alias("cells"))


def united(rows: DataFrame, text: tuple[str, ...] = ()) -> DataFrame:
    """path, seq and all columns of all files, by name; what a file lacks is null. Columns all of whose known cells are
    numbers are double, but for those in `text`."""
    cell = F.explode("cells").alias("name", "value")
    known = rows.select(cell).groupBy("name").agg(F.count_if(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()).alias("words")).orderBy("name").collect()  # a row a column
    value = lambda r: F.try_element_at("cells", F.lit(r.name))
    return rows.select("path", "seq", *[(value(r) if r.words or r.name in text else value(r).try_cast("double")).alias(r.name) for r in known])


def skipped(spark: SparkSession, folder: str, rows: DataFrame, names: str = "*.csv") -> DataFrame:
    """path and reason of the files of which no row was read. (Spark does not list files of no bytes at all.)"""
    return listed(spark, folder, names).join(rows.select("path").distinct(), "path", "left_anti").withColumn("reason", F.lit("empty or unreadable"))


def subjects(texts: DataFrame, text: str = "value") -> DataFrame:
    """subject and number of JSON objects {subject: number}; other texts give no rows."""
    return texts.select(F.explode(F.from_json(F.col(text), "map<string,string>")).alias("subject", "_n")).select("subject", F.col("_n").try_cast("double").cast("int").alias("number")).where("number is not null")


def study_only(subject: str) -> Column:
    return F.trim(F.col(subject)).startswith("SRS")


def annotations(rows: DataFrame, maps: dict[str, dict[str, str]], numeric: list[str], keys: list[str], subject: str = "subject_id") -> DataFrame:
    """Annotated trials of the study's subjects as one row for each activity. rows: long already (a column `activity`), or
    wide, and then unpivoted by `maps` (see tables.long). Numbers that cannot be read are null."""
    d = rows.where(study_only(subject))
    if "activity" not in d.columns:
        return tables.long(d, keys, maps)
    return d.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in d.columns})


def fall_labels(rows: DataFrame, subject: str = "Participant ID", count: str = "12-Month Fall History", kind: str = "12-Month Fall History Classification") -> DataFrame:
    """subject_id, fall_history_count and fall_history_class (Faller for F, Non-Faller for NF, else null) of the study's
    subjects; of rows of one subject the first in the file counts."""
    d = rows.where(study_only(subject))
    first = F.min(F.struct("path", "seq", F.col(count).alias("n"), F.col(kind).alias("k"))).alias("_f")
    d = d.groupBy(F.trim(F.col(subject)).alias("subject_id")).agg(first)
    return d.select("subject_id", F.col("_f.n").alias("fall_history_count"), tables.mapped(F.col("_f.k"), {"F": "Faller", "NF": "Non-Faller"}).alias("fall_history_class"))


def manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFEST, "feature string, laboratory_source string, home_source string")
