"""Motion-capture exports: a CSV block of marker trajectories to long rows."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, fs_hz double, units string, frame long, sub_frame long, marker string, x double, y double, z double"


def number(cell: str) -> float | None:
    try:
        return float(cell)
    except ValueError:
        return None


def trajectories(path: str, text: str) -> Iterator[tuple]:
    """Rows of the block under the line `Trajectories`: rate, marker names (three columns each, behind an optional
    `subject:`), axes, units, then one line a frame. Nothing without such a block or without frames."""
    lines = list(csv.reader(text.removeprefix("﻿").splitlines()))
    at = next((i for i, row in enumerate(lines) if row and row[0].strip().lower() == "trajectories"), None)
    if at is None or len(lines) < at + 5:
        return
    fs = number(lines[at + 1][0]) if lines[at + 1] else None
    units = "mm" if any("mm" in c.lower() for c in lines[at + 4]) else "unknown"
    markers = [(i, c.strip().split(":", 1)[-1]) for i, c in enumerate(lines[at + 2]) if c.strip()]
    for row in lines[at + 5 :]:
        frame = number(row[0]) if len(row) > 1 else None
        if frame is None:
            continue
        sub = number(row[1])
        for i, name in markers:
            yield path, fs if fs and fs > 0 else None, units, int(frame), int(sub or 0), name, *(number(row[j]) if j < len(row) else None for j in range(i, i + 3))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, fs_hz, units, frame, sub_frame, marker, x, y, z of every CSV export below a folder; a file fits a task."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", "true").text(folder, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["value"]):
                rows = list(trajectories(path, text))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    out = files.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, ROWS)
    clean = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return out.withColumns({c: clean(F.col(c)) for c in ("fs_hz", "x", "y", "z")})


def trials(rows: DataFrame) -> DataFrame:
    """rows with subject, visit and trial from .../SRS<n>/visit<n>/<trial>/<file>.csv; folders that end in _x are left out."""
    part = lambda i: F.regexp_extract("path", r"/(SRS\d+)/([Vv]isit[^/]*)/(?:.*/)?([^/]+)/[^/]+\.csv$", i)
    return rows.withColumns({"subject": part(1), "visit": part(2), "trial": part(3)}).where((F.col("subject") != "") & ~F.col("path").rlike(r"_x/"))


def activity(trial: Column) -> Column:
    """Activity by a trial's prefix; null for others."""
    key = F.lower(trial)
    return F.when(key.startswith("nw"), "walk").when(key.startswith("sts"), "sit_to_stand").when(key.startswith("turnl"), "left_turn").when(key.startswith("turnr"), "right_turn")
