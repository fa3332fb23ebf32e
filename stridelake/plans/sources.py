"""Queries of the scans, sinks and the preprocess pipeline, over samples made from lineitem."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stridelake.operators import series
from stridelake.plans.catalog import query, r, table
from stridelake.plans.recordings import SMP, samples
from stridelake.sources import recordings, studies
from stridelake.sources.cuts import dealt, shared_folder


@query(SMP + " SELECT rec, i AS seq, round(t, 3) AS timestamp, round(acc_x, 3) AS acc_x, CASE WHEN i % 5 > 0 THEN round(gyro_z, 3) END AS gyro_z, NULL::DOUBLE AS useracc_x FROM smp")
def recording_scan(spark, d):
    """Recordings written as CSV files and scanned again under other names, a channel missing."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    s = samples(spark, d).select("rec", F.col("i").alias("line"), F.col("t").alias("Timestamp"), F.col("acc_x").alias("Accel_X"), F.when(F.col("i") % 5 > 0, F.col("gyro_z")).alias("GYR_Z"))
    recordings.write_csv(dealt(s, "rec", table(spark, d, "lineitem").count()).sortWithinPartitions("rec", "line").drop("line"), folder, "rec")
    back = recordings.scan(spark, folder).withColumn("rec", F.regexp_extract("path", "rec=([0-9]+)", 1).cast("long"))
    return back.select("rec", "seq", "timestamp", "acc_x", "gyro_z", "useracc_x")


RAW = SMP + """, raw AS (SELECT rec, i, t + CASE WHEN i >= 40 THEN -0.5::DOUBLE * (i >= 40)::INT ELSE 0 END AS t, CASE WHEN i % 11 > 0 THEN acc_x END AS x, acc_y AS y, acc_z AS z FROM smp)"""


def raw(spark, d):
    """Scanned rows in milliseconds: gaps in one channel, times that step back by less than a second and so overlap."""
    s = samples(spark, d)
    t = F.rint((F.col("t") - F.when(F.col("i") >= 40, 0.5).otherwise(0.0)) * 1000)
    x = F.when(F.col("i") % 11 > 0, F.col("acc_x")).alias("acc_x")
    s = s.select(F.col("rec").cast("string").alias("path"), F.col("i").alias("seq"), t.alias("timestamp"), x, *[c for c in recordings.CHANNELS if c != "acc_x"])
    return dealt(s, "path", table(spark, d, "lineitem").count())


@query(SMP + """, raw AS (SELECT rec, i, round_even((t - CASE WHEN i >= 40 THEN 0.5::DOUBLE ELSE 0 END) * 1000, 0) / 1000.0::DOUBLE AS ts, CASE WHEN i % 11 > 0 THEN acc_x END AS x, acc_y AS y, acc_z AS z FROM smp),
g AS (SELECT rec, ts, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM raw GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ts) - 1 AS k FROM g),
b AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN k END) OVER (PARTITION BY rec ORDER BY k) AS ka, min(CASE WHEN x IS NOT NULL THEN k END) OVER (PARTITION BY rec ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM n),
f AS (SELECT b.rec, b.k, b.ts - min(b.ts) OVER (PARTITION BY b.rec) AS t, b.y, b.z, CASE WHEN ka IS NULL THEN q.x WHEN kb IS NULL OR ka = kb THEN p.x ELSE p.x + (q.x - p.x) * (b.k - ka) / (kb - ka) END AS x FROM b LEFT JOIN n p ON p.rec = b.rec AND p.k = ka LEFT JOIN n q ON q.rec = b.rec AND q.k = kb),
m AS (SELECT rec, k, t, sqrt(x*x + y*y + z*z) AS a FROM f), c AS (SELECT *, a - avg(a) OVER (PARTITION BY rec) AS free FROM m), h AS (SELECT *, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(a) OVER w AS lo, lead(a) OVER w AS hi FROM c WINDOW w AS (PARTITION BY rec ORDER BY t))
SELECT rec::VARCHAR AS path, k AS i, round(t, 6) AS t, round(a, 6) AS acc_mag, round(free, 6) AS acc_free, round(CASE WHEN hs IS NULL THEN (hi - a) / hd WHEN hd IS NULL THEN (a - lo) / hs ELSE (hs*hs*hi + (hd*hd - hs*hs)*a - hd*hd*lo) / (hs*hd*(hs+hd)) END, 5) AS acc_jerk FROM h""")
def preprocessed_samples(spark, d):
    p = recordings.preprocess(raw(spark, d), cutoff=None)
    return p.select("path", F.col("i").cast("long").alias("i"), *r("t", "acc_mag", "acc_free"), *r("acc_jerk", places=5))


@query()
def preprocessed_filtered(spark, d):
    """The whole pipeline with its low-pass filter, cut to the last seconds of a turn."""
    p = recordings.truncated(recordings.preprocess(raw(spark, d)), "path", F.lit("left_turn"))
    return recordings.motion_channel(p, "path").select("path", "i", *r("t", "acc_mag", "gyro_jerk", "motion"), "motion_source")


@query(SMP + """, u AS (SELECT rec, i, t * CASE rec % 4 WHEN 0 THEN 1e9::DOUBLE WHEN 1 THEN 1e7::DOUBLE WHEN 2 THEN 1e3::DOUBLE ELSE 1::DOUBLE END AS x FROM smp), s AS (SELECT *, x - lag(x) OVER (PARTITION BY rec ORDER BY i) AS st FROM u), m AS (SELECT *, median(CASE WHEN st > 0 THEN st END) OVER (PARTITION BY rec) AS m FROM s)
SELECT rec, i, round(x / CASE WHEN m > 1e8 THEN 1e9 WHEN m > 1e5 THEN 1e6 WHEN m > 1 THEN 1e3 ELSE 1 END, 6) AS ts FROM m""")
def time_units(spark, d):
    k = F.col("rec") % 4
    s = samples(spark, d).withColumn("x", F.col("t") * F.when(k == 0, 1e9).when(k == 1, 1e7).when(k == 2, 1e3).otherwise(1.0))
    return recordings.seconds(s, "rec", "i", "x").select("rec", "i", *r("ts"))


@query(SMP + """, u AS (SELECT rec, i, CASE WHEN rec % 2 = 0 THEN sqrt(useracc_x*useracc_x + useracc_y*useracc_y + useracc_z*useracc_z) ELSE 0 END AS m, acc_x AS f FROM smp),
k AS (SELECT *, coalesce(stddev_pop(m) OVER w > 1e-8, false) AND max(abs(m)) OVER w > 1e-8 AS moves FROM u WINDOW w AS (PARTITION BY rec)) SELECT rec, i, round(CASE WHEN moves THEN m ELSE f END, 6) AS motion, CASE WHEN moves THEN 'useracc_mag' ELSE 'acc_free' END AS motion_source FROM k""")
def motion_source(spark, d):
    s = samples(spark, d).select("rec", "i", F.when(F.col("rec") % 2 == 0, recordings.magnitude("useracc")).otherwise(0.0).alias("useracc_mag"), F.col("acc_x").alias("acc_free"))
    return recordings.motion_channel(s, "rec").select("rec", "i", *r("motion"), "motion_source")


@query(SMP + " SELECT rec, i, round(CASE rec % 5 WHEN 0 THEN gyro_x WHEN 1 THEN abs(gyro_x) WHEN 2 THEN sqrt(gyro_x*gyro_x + gyro_y*gyro_y + gyro_z*gyro_z) WHEN 3 THEN gyro_z ELSE acc_x END, 6) AS value FROM smp")
def sensor_signals(spark, d):
    names = F.array(*[F.lit(s) for s in ("right", "left", "trunk", "sacrum", "other")])
    s = samples(spark, d).withColumns({"gyro_mag": recordings.magnitude("gyro"), "acc_free": F.col("acc_x"), "sensor": F.element_at(names, (F.col("rec") % 5 + 1).cast("int"))})
    return s.select("rec", "i", F.round(recordings.sensor_signal(F.col("sensor")), 6).alias("value"))


@query("""SELECT l_suppkey % 3 AS part, l_orderkey::DOUBLE AS l_orderkey, CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag WHEN l_suppkey % 3 = 1 AND l_linenumber = 1 THEN 'a, "b"' END AS note, CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity::DOUBLE END AS l_quantity FROM lineitem""")
def united_files(spark, d):
    """Three sets of files with columns of their own, read as one table."""
    folder = f"{shared_folder(spark)}/united-{uuid.uuid4().hex}"
    x = table(spark, d, "lineitem").withColumn("part", F.col("l_suppkey") % 3)
    parts = {0: ["l_orderkey", F.col("l_returnflag").alias("note")], 1: [F.when(F.col("l_linenumber") == 1, 'a, "b"').alias("note"), "l_quantity", "l_orderkey"], 2: ["l_quantity", "l_orderkey"]}
    for i, columns in parts.items():
        x.where(F.col("part") == i).select(*columns).write.option("header", "true").option("escape", '"').csv(f"{folder}/part{i}")
    rows = studies.united(studies.csv_rows(spark, folder))
    return rows.select(F.regexp_extract("path", "/part([0-9])/", 1).cast("long").alias("part"), "l_orderkey", "note", "l_quantity")


@query(SMP + """, n AS (SELECT rec, i, acc_x AS v, count(acc_x) OVER (PARTITION BY rec ORDER BY i) AS c FROM smp) SELECT rec, i, round(v - avg(CASE WHEN c <= 100 THEN v END) OVER (PARTITION BY rec), 6) AS above, round(coalesce((v - avg(v) OVER (PARTITION BY rec)) / nullif(stddev_samp(v) OVER (PARTITION BY rec), 0), 0), 6) AS z FROM n""")
def baseline_and_scores(spark, d):
    """Samples above the mean of the first hundred, and their z-scores by the sample deviation."""
    s = series.zscore(series.baseline(samples(spark, d), "rec", "i", "acc_x"), "rec", "acc_x", sample=True, flat=0.0)
    return s.select("rec", "i", F.round(F.col("acc_x") - F.col("baseline"), 6).alias("above"), *r("z"))
