"""Plans that stay whole and bounded as tables grow, and results that do not hang on the order of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stridelake.operators import features, pairs, segments, series, wavelets
from stridelake.sources import cuts, recordings
from stridelake.sources.cuts import bucketed, dealt

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["strongest_region", "flexion_extension", "anchored_extremes", "refined_window"])
def test_transitions_read_cut_tables(spark, name):
    """Reading the lines again for each join put dozens of sorts into one task."""
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert df.count() and not [f for f in df.inputFiles() if "lineitem" in f]


def test_strongest_region_in_one_pass(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, i / 10, float(rng.normal()), bool(rng.random() < 0.4)) for k in range(6) for i in range(80)] + [(9, 0, 0.0, 1.0, False), (8, 0, 0.0, 1.0, True)]
    df = spark.createDataFrame(rows, "k int, i int, t double, v double, m boolean")
    found = segments.strongest_region(df, "k", "i", "t", "v", F.col("m"), F.lit(1), F.lit(4))
    got = {r.k: (r.first, r.last, r.start, r.end) for r in found.select("k", "first", "last", "start", "end").collect()}
    want = {}
    for k in range(6):
        mine = [r for r in rows if r[0] == k]
        runs = []
        for at in [r[1] for r in mine if r[4]]:
            if runs and at - runs[-1][1] - 1 <= 1:
                runs[-1][1] = at
            else:
                runs.append([at, at])
        spread = lambda a, b: max(r[3] for r in mine[a : b + 1]) - min(r[3] for r in mine[a : b + 1])  # noqa: B023, E731
        kept = [(-round(spread(a, b), 9), a, b) for a, b in runs if b - a + 1 >= 4]
        if kept:
            _, a, b = min(kept)
            want[k] = (a, b, a / 10, b / 10)
    assert want and got == want
    assert "Join" not in plan(found)


def test_neighbours_without_rows_for_pairs(spark):
    x = np.round(np.random.default_rng(6).normal(size=(2, 60)), 3)
    df = spark.createDataFrame([(k, i, float(v)) for k in range(2) for i, v in enumerate(x[k])], "k int, i int, v double")
    e = pairs.embedded(df, "k", "i", "v")
    near = pairs.nearest_neighbour(e, "k")
    points = {(r.k, r.i): (r.x, r.y, r.z) for r in e.collect() if r.z is not None}
    apart = lambda k, i, j: round(math.dist(points[k, i], points[k, j]), 9)
    want = {(k, i): min((apart(k, i, j), j) for q, j in points if q == k and abs(i - j) > 10) for k, i in points}
    assert {(r.k, r.i): (r.d, r.j) for r in near.collect()} == want
    assert "array_min" in plan(near)
    far = {(r.k, r.i, r["k2"]): r.dk for r in pairs.divergence(e.withColumnRenamed("k", "g"), "g", 5).select(F.col("g").alias("k"), "i", F.col("k").alias("k2"), "dk").collect()}
    steps = {(k, i, s): apart(k, i + s, want[k, i][1] + s) for k, i in want for s in range(1, 6) if (k, i + s) in points and (k, want[k, i][1] + s) in points}
    assert far == pytest.approx(steps)


def test_a_mean_of_fifty_is_fifty_in_any_order(spark, tmp_path):
    """These five have the mean 50; added as doubles, they come to more in any order."""
    values = {1: [63.28, 91.65, 1.18, 71.65, 22.24], 2: [10.0, 20.0], 3: [90.0, 95.0], 4: [40.0], 5: [30.0]}
    rows = [(u * 10 + i, u, "click", v) for u, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.stands_for for r in __spark_entry__.queries()["label_agreement"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] != got[3]


def test_gaps_are_filled_from_one_sort(spark):
    x = [(1, i, v, w) for i, (v, w) in enumerate([(None, 1.0), (2.0, None), (None, None), (None, 4.0), (8.0, None), (None, None)])]
    d = series.interpolate_columns(spark.createDataFrame(x, "k int, i int, v double, w double"), "k", "i", {"v": "v", "w": "w"})
    got = sorted((r.i, r.v, r.w) for r in d.collect())
    assert got == [(0, 2.0, 1.0), (1, 2.0, 2.0), (2, 4.0, 3.0), (3, 6.0, 4.0), (4, 8.0, 4.0), (5, 8.0, 4.0)]
    assert plan(d.select("k", "i", "v", "w")).split("Initial Plan")[-1].count("Sort [") == 1


def test_dealt_follows_the_rows(spark):
    df = spark.range(1000).selectExpr("id % 100 as k")
    assert dealt(df, "k", 1000, 50).rdd.getNumPartitions() == 20
    assert dealt(df, "k", 1000).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_walk_computes_what_is_asked(spark):
    t = np.arange(400) / 25
    rows = [(k, i, float(t[i]), float(1 + np.sin((9 + k) * t[i]) * (50 < i < 350)), float(np.cos(t[i]))) for k in range(2) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, t double, a double, g double")
    full = {r.k: r.asDict() for r in features.walk(df, "k", "a", "g").collect()}
    for some in (["walk_jerk_mean", "walk_acc_mag_rms"], ["step_count", "mean_step_time"]):
        part = features.walk(df, "k", "a", "g", only=some)
        got = {r.k: r.asDict() for r in part.collect()}
        for k, row in full.items():
            assert got[k] == pytest.approx({n: v for n, v in row.items() if n in ("k", *some)})
        assert ("Pandas" in plan(part)) == (some[0] != "walk_jerk_mean")


def tables_of(spark, name):
    """What a query writes: the columns of each table, and how many of the tables are bucketed."""
    paths, tables = len(cuts.WRITTEN), len(cuts.TABLES)
    assert __spark_entry__.queries()[name](spark, SMALL).count()
    return [spark.read.parquet(p).columns for p in cuts.WRITTEN[paths:]], len(cuts.TABLES) - tables


def test_bucketed_tables_are_read_without_a_shuffle(spark):
    df = spark.range(400).selectExpr("id % 40 as k", "cast(id as double) as v")
    a = bucketed(df, "k", 8)
    b = bucketed(a.groupBy("k").agg(F.max("v").alias("top")), "k", 8)
    d = series.centre(a, "k", "v").join(b.hint("merge"), "k")
    assert "SortMergeJoin" in plan(d) and "Exchange" not in plan(d)
    assert d.count() == 400 and d.where("top < v").isEmpty()


def test_feature_table_moves_what_it_reads(spark):
    written, _ = tables_of(spark, "feature_table")
    assert written and not {c for t in written for c in t} & {"acc_x", "useracc_x", "acc_jerk", "gyro_jerk"}


def test_wavelet_bout_is_made_once(spark):
    """The lines were read and sorted again for each use of the bout."""
    df = __spark_entry__.queries()["wavelet_steps"](spark, SMALL)
    assert df.count() and not [f for f in df.inputFiles() if "lineitem" in f]


def test_wavelet_steps_sends_no_table_whole(spark):
    """The active seconds were broadcast, in the query and with a bout that is not cut."""
    df = __spark_entry__.queries()["wavelet_steps"](spark, SMALL)
    bout = spark.createDataFrame([(1, i / 10, float(i % 5)) for i in range(90)], "rec int, t double, v double")
    steps = wavelets.wavelet_steps(bout, "rec", "t", "v")
    assert df.count() and steps.count() == 1 and not [d for d in (df, steps) if "Broadcast" in plan(d)]


def test_lab_rises_moves_what_it_reads(spark):
    written, found = tables_of(spark, "lab_rises")
    assert len(written) == found and not {c for t in written for c in t} & {"acc_x", "useracc_x", "useracc_mag", "motion_source"}


@pytest.mark.parametrize("name", ["transition_features", "lab_walks", "reported_turns", "viewed_walks", "walk_regularity"])
def test_blocks_read_bucketed_tables(spark, name):
    written, found = tables_of(spark, name)
    assert found and found == len(written)


def test_scan_cuts_each_line_once(spark, tmp_path):
    """Lines were cut into cells anew for each channel."""
    (tmp_path / "a.csv").write_text('Time,GYR_Z,"Accel_X"\n0.5,"1,5",2\n\n1.5, 3 ,x\n')
    got = recordings.scan(spark, str(tmp_path)).select("seq", "timestamp", "acc_x", "gyro_z", "useracc_x")
    assert sorted(got.drop("dated").collect()) == [(0, 0.5, 2.0, None, None), (1, 1.5, None, 3.0, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(regexp_replace(") <= 4


@pytest.mark.parametrize("name", ["lyapunov_wolf", "lyapunov_rosenstein"])
def test_exponents_of_all_samples(spark, tmp_path, monkeypatch, name):
    """Of a recording of more than 900 samples only 900 took part. Here it is three blocks, and one beside it is short."""
    monkeypatch.setattr(pairs, "TILE", 500, raising=False)
    x = {1: np.round(np.random.default_rng(8).normal(50, 9, 1300), 2), 2: np.round(np.random.default_rng(9).normal(50, 9, 60), 2), 3: np.ones(40)}
    rows = [(k * 10_000 + i, k, "click", float(v)) for k, vs in x.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {r[0]: r[1] for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    for k in (1, 2):
        v = (x[k] - x[k].mean()) / x[k].std()
        want = pairs.exponents(pairs.distances(np.stack([v[:-2], v[1:-1], v[2:]], 1)), 10, 19, 8, 25)[name == "lyapunov_wolf"]
        assert got.pop(k) == pytest.approx(want, abs=2e-6)
    assert not got
