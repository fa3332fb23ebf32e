"""Queries of the viewers' turns and walks and of the activity score, over the samples of plans/recordings.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import viewers
from stridelake.plans.catalog import query, r
from stridelake.plans.recordings import FS, SMP, cutting, limit_sql, mask_sql, motion, peaks_sql, ranges_sql, smooth_sql

CHANNELS = ["useracc", "acc", "gyro"]


def score_sql() -> str:
    """The robust z-scores of all channels."""
    mid = ", ".join(f"abs({c} - median({c}) OVER (PARTITION BY rec)) AS a_{c}, stddev_pop({c}) OVER (PARTITION BY rec) AS d_{c}" for c in CHANNELS)
    z = ", ".join(f"a_{c} / coalesce(nullif(1.4826::DOUBLE * median(a_{c}) OVER (PARTITION BY rec), 0), nullif(d_{c}, 0))" for c in CHANNELS)
    return f", dev AS (SELECT rec, i, {mid} FROM mot) SELECT rec, i, round(greatest({z}), 5) AS score FROM dev"


@query(SMP + score_sql())
def activity_score(spark, d):
    return viewers.activity_score(motion(spark, d), "rec", CHANNELS).select("rec", "i", F.round("score", 5).alias("score"))


def turn_sql(width: float) -> str:
    """CTEs of the turn's span m with its threshold."""
    src = ranges_sql("v", width, "ab", "w") + limit_sql("p2p", 5.0, 0.3, "w", "l") + FS + ", src AS (SELECT ab.*, threshold, fs FROM ab JOIN l USING (rec) JOIN fr USING (rec))"
    return SMP + ", ab AS (SELECT rec, i, t, abs(gyro_x) AS v FROM mot)" + src + mask_sql("v >= threshold", "greatest(1, floor(0.6::DOUBLE * fs))", "greatest(1, floor(0.25::DOUBLE * fs))", "floor(0.15::DOUBLE * fs)::BIGINT", "src", "m")


def steps_sql(span: str, apart: str) -> str:
    """CTEs of the samples wi within a span, their smoothed ones sp with the limit h, and the peaks pk."""
    return f""", wi AS (SELECT mot.*, abs(gyro_x) AS v FROM mot JOIN {span} x USING (rec) WHERE t BETWEEN x.start AND x."end"),
wf AS (SELECT rec, 1 / median(st) AS wfs FROM (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY i) AS st FROM wi) WHERE st > 0 GROUP BY rec)""" + smooth_sql("useracc", 1.0, "wi", "sm") + f""",
sp AS (SELECT sm.*, avg(s) OVER (PARTITION BY sm.rec) AS h, greatest(1, {apart}) AS apart FROM sm JOIN wf USING (rec))""" + peaks_sql("sp", "h", "apart", "pk")


REPORT = turn_sql(1.0) + steps_sql("m", "floor(0.45::DOUBLE * wfs)") + """, c AS (SELECT rec, count(*)::DOUBLE AS n FROM pk GROUP BY rec),
qn AS (SELECT wi.rec, t, i, v < threshold AS q, CASE WHEN (v < threshold) IS DISTINCT FROM lag(v < threshold) OVER (PARTITION BY wi.rec ORDER BY i) THEN 1 ELSE 0 END AS nw FROM wi JOIN l USING (rec)), qr AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i) AS run FROM qn),
qs AS (SELECT rec, max(t) - min(t) AS s FROM qr WHERE q GROUP BY rec, run HAVING count(*) >= 2), ql AS (SELECT rec, s, 0.6::DOUBLE * median(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY rec) AS b FROM qs), qt AS (SELECT rec, sum(s) AS p FROM ql WHERE s >= coalesce(b, 0) GROUP BY rec)
SELECT m.rec, round(threshold, 6) AS threshold, round(m.start, 6) AS start, round(m."end", 6) AS "end", round(m.duration, 6) AS duration, coalesce(c.n, 0) AS step_count, round(coalesce(p, 0), 6) AS pause_time
FROM m JOIN l ON l.rec = m.rec LEFT JOIN c ON c.rec = m.rec LEFT JOIN qt ON qt.rec = m.rec"""


@query(REPORT)
def reported_turns(spark, d):
    n, cut = cutting(spark, d)
    out = viewers.reported_turn(motion(spark, d, n), "rec", "useracc", "gyro_x", cut=cut)
    return out.select("rec", *r("threshold", "start", "end", "duration"), "step_count", *r("pause_time"))


VIEW = turn_sql(0.4) + """, hi AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rec ORDER BY i) - 1 <= greatest(1, round_even(0.15::DOUBLE * fs, 0)) THEN 0 ELSE 1 END AS nw FROM src WHERE v >= threshold),
hj AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i) AS isl, max(v) OVER (PARTITION BY rec) AS top FROM hi), hr AS (SELECT rec, isl, min(i) AS a, max(i) AS b, max(v) AS v, any_value(top) AS top, any_value(fs) AS fs FROM hj GROUP BY rec, isl),
hs AS (SELECT rec, greatest(0, min(a) - any_value(greatest(1, round_even(0.15::DOUBLE * fs, 0))))::BIGINT AS a, (max(b) + any_value(greatest(1, round_even(0.15::DOUBLE * fs, 0))))::BIGINT AS b FROM hr WHERE b - a + 1 >= greatest(1, round_even(0.2::DOUBLE * fs, 0)) AND v >= 0.15::DOUBLE * top GROUP BY rec),
he AS (SELECT hs.rec, min(t) AS s, max(t) AS e FROM hs JOIN mot ON mot.rec = hs.rec AND mot.i BETWEEN hs.a AND hs.b GROUP BY hs.rec),
g AS (SELECT m.rec, coalesce(he.s, m.start) AS start, coalesce(he.e, m."end") AS "end" FROM m LEFT JOIN he ON he.rec = m.rec)""" + steps_sql("g", "round_even(0.37::DOUBLE * wfs, 0)") + """,
pc AS (SELECT rec, min(i) AS f, max(i) AS l, count(*)::DOUBLE AS n FROM pk GROUP BY rec),
ed AS (SELECT sp.rec, coalesce(max(sp.i) FILTER (s < h AND sp.i <= f) + 1, 0) AS a, coalesce(min(sp.i) FILTER (s < h AND sp.i >= pc.l), max(sp.i)) AS b, any_value(n) AS n FROM sp JOIN pc ON pc.rec = sp.rec GROUP BY sp.rec),
mv AS (SELECT ed.rec, min(t) AS s, max(t) AS e, any_value(n) AS n FROM sp JOIN ed ON ed.rec = sp.rec AND sp.i BETWEEN ed.a AND ed.b GROUP BY ed.rec),
fin AS (SELECT g.rec, coalesce(mv.s, g.start) AS s, coalesce(mv.e, g."end") AS e, coalesce(n, 0) AS n FROM g LEFT JOIN mv ON mv.rec = g.rec),
ve AS (SELECT fin.rec, max(v) AS top, avg(v) AS mean FROM ab JOIN fin ON fin.rec = ab.rec AND t BETWEEN s AND e GROUP BY fin.rec)
SELECT fin.rec, round(threshold, 6) AS threshold, round(s, 6) AS start, round(e, 6) AS "end", round(e - s, 6) AS duration, n AS step_count, round(CASE WHEN e > s THEN n / (e - s) END, 6) AS steps_per_second, round(top, 6) AS peak_angular_velocity, round(mean, 6) AS mean_angular_velocity
FROM fin JOIN l ON l.rec = fin.rec JOIN ve ON ve.rec = fin.rec"""


@query(VIEW)
def viewed_turns(spark, d):
    n, cut = cutting(spark, d)
    out = viewers.viewed_turn(motion(spark, d, n), "rec", "useracc", "gyro_x", cut=cut)
    return out.select("rec", *r("threshold", "start", "end", "duration"), "step_count", *r("steps_per_second", "peak_angular_velocity", "mean_angular_velocity"))


@query()
def viewed_walks(spark, d):
    """Prominence is beyond SQL; held against a direct computation in tests/test_viewers.py."""
    n, cut = cutting(spark, d)
    out = viewers.viewed_walk(motion(spark, d, n), "rec", "useracc", cut=cut)
    return out.select("rec", *r(*[n for n in out.columns if n != "rec"]))
