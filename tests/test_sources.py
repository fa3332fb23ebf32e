"""Scans of recording folders, recorder files and the preprocess pipeline on files that the tests write."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from stridelake.operators import alignment, signal
from stridelake.sources import cuts, discovery, recordings, studies


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_scan(spark, tmp_path):
    put(tmp_path / "SRS01/2026-01-05/walk.csv", '﻿Timestamp,ACCEL_X ,"gyro_z"\r\n0,1.5,2\r\n\r\n20,abc,\r\n')
    put(tmp_path / "SRS01/2026-01-05/deep/x_synchronized/Normal Walk.csv", "time,acc_x\n1,2\n")
    put(tmp_path / "SRS01/2026-01-05/left turn 2.csv", "time,acc_x\n1,2\n")
    put(tmp_path / "SRS01/2026-01-05/deep/synchronized/my left.csv", "time,acc_x\n1,2\n")
    put(tmp_path / "SRS02/2026-01-06/.hidden/walk.csv", "time,acc_x\n1,2\n")
    put(tmp_path / "SRS02/2026-01-06/walk.csv", "")
    put(tmp_path / "SRS02/2026-01-06/other.csv", "time,acc_x\n")
    rows = recordings.placed(recordings.scan(spark, str(tmp_path)))
    walk = rows.where("path like '%/2026-01-05/walk.csv'").orderBy("seq").collect()
    assert [(r.patient, r.date, r.stem, r.timestamp, r.acc_x, r.gyro_z, r.acc_y) for r in walk] == [("SRS01", "2026-01-05", "walk", 0.0, 1.5, 2.0, None), ("SRS01", "2026-01-05", "walk", 20.0, None, None, None)]
    found = recordings.resolved(rows, {"walk": ["normal_walk"], "left_turn": ["left"]})
    assert {(r.activity, r.path.rsplit("/", 1)[1]) for r in found.collect()} == {("walk", "walk.csv"), ("left_turn", "my%20left.csv")}
    days = spark.createDataFrame([("SRS01", "2026-01-05"), ("SRS02", "2026-01-06")], "patient string, date string")
    every = recordings.expected(days, found, ["walk", "left_turn"]).collect()
    assert {(r.patient, r.activity) for r in every if r.path is None} == {("SRS02", "walk"), ("SRS02", "left_turn")} and len(every) == 4


def test_file_choice(spark):
    rows = [("a", "p/x_synchronized_1.csv"), ("a", "p/x_synchronized_2.csv"), ("a", "p/z.csv"), ("b", "q/1.csv"), ("b", "q/2.csv")]
    files = spark.createDataFrame(rows, "k string, path string")
    assert {r.path for r in recordings.first_file(files, ["k"]).collect()} == {"p/x_synchronized_1.csv", "q/1.csv"}
    assert {r.path for r in recordings.first_file(files, ["k"], last=True).collect()} == {"p/x_synchronized_2.csv", "q/2.csv"}


def test_recorder(spark):
    good = {"meta": {"a": 1}, "data": [{"timestamp": 1, "sensorType": "accel", "x": 1, "y": 2, "z": 3}, {"Timestamp": 2, "Sensor Type": "gyro", "X": 4, "Y": 5, "Z": None}]}
    texts = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps({"n": 1})), ("c", "broken"), ("d", None)], "path string, value string")
    got = recordings.recorder_json(texts).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("a", "data", 0, "accel", 1.0, 1.0, 2.0, 3.0), ("a", "data", 1, "gyro", 2.0, 4.0, 5.0, None)]


def test_preprocess(spark):
    rng = np.random.default_rng(2)
    n = 400
    t = np.arange(n) * 40.0 + 1000
    clock = np.where(t > 9000, t - 8000, t)  # the clock falls back once
    x = {c: rng.normal(size=n) for c in recordings.CHANNELS}
    rows = [("r", i, float(clock[i]), *(float(x[c][i]) for c in recordings.CHANNELS)) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, seq long, timestamp double, " + ", ".join(f"{c} double" for c in recordings.CHANNELS))
    got = recordings.preprocess(df).orderBy("i").toPandas()
    want_t = np.arange(n) * 0.04
    mag = np.sqrt(sum(x[f"acc_{a}"] ** 2 for a in "xyz"))
    b, a = signal.butter(4, 5.0, 25.0)
    low = signal.both_ways(b, a, mag)
    assert np.allclose(got.t, want_t) and np.allclose(got.acc_mag, low) and np.allclose(got.acc_free, low - low.mean())
    assert np.allclose(got.acc_jerk, np.gradient(low, want_t), atol=1e-6)
    cut = recordings.truncated(recordings.preprocess(df), "path", F.lit("left_turn")).toPandas()
    assert len(cut) in (275, 276) and cut.t.min() == 0 and 10.95 < cut.t.max() < 11.001


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, 1), ("b", None, 2)], "k string, x double, n int")
    recordings.write_csv(df, f"{tmp_path}/t", "k")
    assert {(r.k, r.x, r.n) for r in spark.read.csv(f"{tmp_path}/t", header=True).collect()} == {("a", "1.235", "1"), ("b", None, "2")}
    recordings.write_csv(df.where("false"), f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", header=True).columns == ["k", "x", "n"]
    assert recordings.union_all([df.select("k"), df.select("n")]).count() == 4


def test_resolved_below_the_date(spark, tmp_path):
    """Folders count, aliases begin after a separator, and <activity>.csv is exact only right below the date."""
    for name in ("360_leftturn/data.csv", "sidewalk.csv", "old/walk.csv", "x/turn r synchronized.csv", "x/turn_r.csv", "sit stand.csv", "stand_to_sit.csv", "a/stand_to_sit synchronized.csv"):
        put(tmp_path / "SRS 1/2026-01-05" / name, "time,acc_x\n1,2\n")
    files = recordings.placed(recordings.scan(spark, str(tmp_path)).withColumn("path", recordings.decoded(F.col("path"))))
    aliases = {"walk": ["walk", "10_mw"], "left_turn": ["left_turn", "360_leftturn"], "right_turn": ["turn_r"], "sit_to_stand": ["sit_stand"], "stand_to_sit": ["stand_sit"]}
    got = {r.activity: r.path.split("/2026-01-05/")[1] for r in recordings.resolved(files, aliases).collect()}
    assert got == {"walk": "old/walk.csv", "left_turn": "360_leftturn/data.csv", "right_turn": "x/turn r synchronized.csv", "sit_to_stand": "sit stand.csv", "stand_to_sit": "stand_to_sit.csv"}


def test_date_times(spark, tmp_path):
    """Date-times, with and without zones, beside files of numbers; one file with a few broken numbers stays numeric."""
    iso = ["2026-01-05T10:00:00.000Z", "2026-01-05 10:00:00.040", "2026-01-05T11:00:00.080+01:00", "not a time", "2026-01-05T10:00:00.160"]
    put(tmp_path / "a.csv", "time,acc_x\n" + "".join(f"{t},{i}\n" for i, t in enumerate(iso)))
    put(tmp_path / "b.csv", "time,acc_x\n" + "".join(f"{i * 40 if i % 6 else 'x'},{i}\n" for i in range(12)))
    put(tmp_path / "c.csv", 'note,time,acc_x\n"a, ""b""",2026-01-05,7\n"c",2026-01-06,8\nd,2026-01-09,"9"\n')
    rows = recordings.scan(spark, str(tmp_path))
    of = lambda n: [(r.timestamp, r.acc_x, r.dated) for r in rows.where(F.col("path").endswith(n)).orderBy("seq").collect()]
    start = 1767607200.0
    a = of("a.csv")
    assert [t and round(t - start, 6) for t, _, _ in a] == [0.0, 0.04, 0.08, None, 0.16] and all(d for _, _, d in a)
    assert [t for t, _, _ in of("b.csv")] == [None if i % 6 == 0 else i * 40.0 for i in range(12)] and not of("b.csv")[0][2]
    assert [(t, x) for t, x, _ in of("c.csv")] == [(1767571200.0, 7.0), (1767657600.0, 8.0), (1767916800.0, 9.0)]
    # Seconds stay seconds, however long their steps are; numbers are milliseconds here.
    done = {r.path[-5:]: r.last for r in recordings.preprocess(rows, cutoff=None).groupBy("path").agg(F.max("t").alias("last")).collect()}
    assert done == {"a.csv": 0.16, "b.csv": 0.4, "c.csv": 345600.0} or all(abs(done[k] - v) < 1e-6 for k, v in {"a.csv": 0.16, "b.csv": 0.4, "c.csv": 345600.0}.items())


def test_discovery(spark, tmp_path):
    for name in ("raw/10 MW/long name.csv", "walk/a.csv", "Left Turn/b.csv", "x/L_360 synchronized.csv", "none.csv"):
        put(tmp_path / "P1/2026-01-05" / name, "t\n1\n")
    files = discovery.listed(spark, str(tmp_path)).select(F.regexp_extract("path", "(P1/.*)", 1).alias("path"), F.lit("P1").alias("patient"))
    got = {r.activity: r.path.removeprefix("P1/2026-01-05/") for r in discovery.discovered(files, ["patient"]).collect()}
    assert got == {"walk": "walk/a.csv", "left_turn": "Left Turn/b.csv"}
    kinds = {r.path.rsplit("/", 1)[1]: r.activity for r in discovery.inferred(files).collect()}
    assert kinds == {"long name.csv": "walk", "a.csv": "walk", "b.csv": "left_turn", "L_360 synchronized.csv": "left_turn", "none.csv": None}
    below = spark.createDataFrame([("P1", "2026-01-05/a/x.csv"), ("P1", "2026-01-07/x.csv"), ("P1", "old/2026-01-01/x.csv"), ("P1", "very/old/2026-01-01/x.csv"), ("P2", "x.csv")], "patient string, below string")
    wanted = spark.createDataFrame([("P1", None), ("P1", "2026-01-01"), ("P1", "1999-01-01"), ("P2", None)], "patient string, date string")
    assert {tuple(r) for r in discovery.date_folders(below, wanted).collect()} == {("P1", None, "very"), ("P1", "2026-01-01", "old/2026-01-01"), ("P1", "1999-01-01", None), ("P2", None, None)}


def test_lab_discovery(spark, tmp_path):
    for name in ("SRS01/Visit 1/NW2/trunk.csv", "SRS01/Visit 1/NW10/trunk.csv", "SRS01/Visit 1/nw/trunk.csv", "SRS01/Visit 1/STS3/trunk.csv", "SRS01/Visit 1/STS1_b7/trunk.csv", "SRS01/other/NW1/trunk.csv", "pilot/visit1/TurnL1/trunk.csv"):
        put(tmp_path / name, "t\n1\n")
    files = discovery.listed(spark, str(tmp_path)).select(F.regexp_extract("path", "((SRS01|pilot)/.*)", 1).alias("below"))
    trials = discovery.lab_trials(discovery.lab_folders(files)).orderBy("activity", "ordinal").collect()
    assert [(r.folder, r.visit_id, r.ordinal) for r in trials] == [("STS1_b7", "V01", 1), ("STS3", "V01", 2), ("NW2", "V01", 1), ("NW10", "V01", 2), ("nw", "V01", 3)]
    chosen = {(r.subject, r.visit, r.activity): r.folder for r in discovery.lab_choice(discovery.lab_folders(files, named=False)).collect()}
    assert chosen == {("SRS01", "Visit 1", "walk"): "NW10", ("SRS01", "Visit 1", "sit_to_stand"): "STS3", ("SRS01", "other", "walk"): "NW1", ("pilot", "visit1", "left_turn"): "TurnL1"}


def test_sensors_wide(spark):
    rows = [
        ("a", 0.00, "accelerometer", 1.0, 2.0, 3.0), ("a", 0.00, "accelerometer", 1.0, 2.0, 3.0), ("a", 0.05, "gyroscope", 4.0, 5.0, None), ("a", 0.10, "accelerometer", 6.0, 6.0, 6.0), ("a", 1.00, "gyroscope", 7.0, 7.0, 7.0),
        ("a", 1.00, "barometer", 9.0, 9.0, 9.0), ("a", None, "gyroscope", 1.0, 1.0, 1.0), ("b", 2e12, "useraccelerometer", 1.0, 1.0, 1.0), ("b", 2e12 + 80, "gyroscope", 2.0, 2.0, 2.0), ("b", 2e12 + 200, "gyroscope", 3.0, 3.0, 3.0),
    ]
    df = spark.createDataFrame(rows, "rec string, t double, sensor string, x double, y double, z double")
    names = {"accelerometer": "acc", "useraccelerometer": "user", "gyroscope": "gyro"}
    got = {(r.rec, r.t): tuple(r)[2:] for r in alignment.sensors_wide(df, "rec", "t", "sensor", names).collect()}
    zero = (0.0,) * 3
    assert got == {
        ("a", 0.0): ((1.0, 2.0, 3.0) + zero + (4.0, 5.0, 0.0)), ("a", 0.05): ((1.0, 2.0, 3.0) + zero + (4.0, 5.0, 0.0)), ("a", 0.1): ((6.0,) * 3 + zero + (4.0, 5.0, 0.0)), ("a", 1.0): (zero + zero + (7.0,) * 3),
        ("b", 2e12): (zero + (1.0,) * 3 + (2.0,) * 3), ("b", 2e12 + 80): (zero + (1.0,) * 3 + (2.0,) * 3), ("b", 2e12 + 200): (zero + zero + (3.0,) * 3),
    }


def test_study_files(spark, tmp_path):
    put(tmp_path / "f/features_dataset_1.csv", '﻿patient_id,step_count,note,step_count\nSRS01,10,"a, b",99\nSRS02,,x\n')
    put(tmp_path / "f/features_dataset_2.csv", "date,patient_id,step_count\n2026-01-05,SRS03,12.5,extra\n")
    put(tmp_path / "f/features_dataset_3.csv", "patient_id\n")
    put(tmp_path / "f/features_dataset_4.csv", "\n")
    rows = studies.csv_rows(spark, str(tmp_path / "f"), "features_dataset_*.csv")
    d = studies.united(rows)
    assert d.columns == ["path", "seq", "date", "note", "patient_id", "step_count"] and dict(d.dtypes)["step_count"] == "double"
    assert {(r.patient_id, r.step_count, r.note, r.date) for r in d.collect()} == {("SRS01", 10.0, "a, b", None), ("SRS02", None, "x", None), ("SRS03", 12.5, None, "2026-01-05")}
    left = studies.skipped(spark, str(tmp_path / "f"), rows, "features_dataset_*.csv")
    assert {r.path.rsplit("_", 1)[1] for r in left.collect()} == {"3.csv", "4.csv"}
    texts = spark.createDataFrame([('{"SRS01": 71, "SRS02": "72", "x": null}',), ("broken",), (None,)], "value string")
    assert {tuple(r) for r in studies.subjects(texts).collect()} == {("SRS01", 71), ("SRS02", 72)}


def test_labels_and_annotations(spark, tmp_path):
    put(tmp_path / "l/a.csv", "Participant ID,12-Month Fall History,12-Month Fall History Classification\n SRS01 ,2,F\nSRS01,0,NF\nSRS02,0,NF\nSRS03,,?\nP1,1,F\n")
    labels = studies.fall_labels(studies.united(studies.csv_rows(spark, str(tmp_path / "l"))))
    assert {tuple(r) for r in labels.collect()} == {("SRS01", 2.0, "Faller"), ("SRS02", 0.0, "Non-Faller"), ("SRS03", None, None)}
    put(tmp_path / "w/a.csv", "subject_id,visit_id,walk_start_s,walk_end_s,turn_start_s\nSRS01,V01,1.5,3,bad\nX,V01,1,2,3\n")
    put(tmp_path / "g/a.csv", "subject_id,visit_id,activity,start_time_s\nSRS01,V01,walk,1.5\nSRS01,V01,turn,none\nX,V01,walk,2\n")
    maps = {"walk": {"start_time_s": "walk_start_s", "end_time_s": "walk_end_s"}, "turn": {"start_time_s": "turn_start_s"}}
    of = lambda f: studies.annotations(studies.united(studies.csv_rows(spark, str(tmp_path / f))), maps, ["start_time_s"], ["subject_id", "visit_id"]).collect()
    assert [(r.subject_id, r.activity, r.start_time_s, r.end_time_s) for r in of("w")] == [("SRS01", "walk", 1.5, 3.0)]
    assert {(r.subject_id, r.activity, r.start_time_s) for r in of("g")} == {("SRS01", "walk", 1.5), ("SRS01", "turn", None)}
    folder = f"{tmp_path}/manifest"
    recordings.write_csv(studies.manifest(spark), folder)
    assert spark.read.csv(folder, header=True).count() == 4


def test_cuts_are_cleaned(spark):
    table = cuts.written(spark.range(5))
    path = cuts.WRITTEN[-1].removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    assert cuts.clean(spark) >= 1 and not os.path.exists(path) and cuts.clean(spark) == 0
