"""Queries of the wavelet step path, over recordings made from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import wavelets
from stridelake.plans.catalog import query, r
from stridelake.plans.recordings import SMP, cutting, motion, samples

BOUT = """, g0 AS (SELECT rec, t, acc AS v, lead(t) OVER w AS b, lead(acc) OVER w AS v2, min(t) OVER (PARTITION BY rec) AS t0, max(t) OVER (PARTITION BY rec) AS t1 FROM mot WINDOW w AS (PARTITION BY rec ORDER BY t)),
n AS (SELECT rec, any_value(t0) AS t0, ceil(round((any_value(t1) - any_value(t0)) * 10, 9))::BIGINT AS n FROM g0 GROUP BY rec),
m AS (SELECT *, CASE WHEN n % 10 >= 7 THEN n - n % 10 + 10 ELSE n - n % 10 END AS w FROM n), grid AS (SELECT rec, t0, n, unnest(range(0, w)) AS k FROM m),
bout AS (SELECT g.rec, k, g.t0 + k / 10.0::DOUBLE AS t, v + (v2 - v) * (g.t0 + least(k, n - 1) / 10.0::DOUBLE - s.t) / (b - s.t) AS value FROM grid g JOIN g0 s ON s.rec = g.rec
 AND ceil(round((s.t - s.t0) * 10, 9)) <= least(k, n - 1) AND least(k, n - 1) <= CASE WHEN b < t1 THEN ceil(round((b - s.t0) * 10, 9)) - 1 ELSE n - 1 END WHERE b IS NOT NULL)"""


@query(SMP + BOUT + " SELECT rec, k, round(t, 6) AS t, round(value, 6) AS value FROM bout")
def wavelet_bout(spark, d):
    return wavelets.even_bout(motion(spark, d), "rec", "t", "acc").select("rec", "k", *r("t", "value"))


@query()
def wavelet_power(spark, d):
    bout = wavelets.even_bout(motion(spark, d), "rec", "t", "acc")
    return wavelets.wavelet_power(bout, "rec", "k", "value").select("rec", "second", "bin", *r("hz", "power"))


@query()
def wavelet_squeezed(spark, d):
    bout = wavelets.even_bout(motion(spark, d), "rec", "t", "acc")
    return wavelets.wavelet_power(bout, "rec", "k", "value", squeeze=True).where("power > 0").select("rec", "second", "bin", *r("hz", "power"))


POWERS = SMP + ", pow AS (SELECT rec, i // 20 AS second, (i % 20)::INT AS bin, round(abs(acc_x), 2) AS power FROM smp)"
RIDGES = POWERS + """, rn AS (SELECT *, sum(nw) OVER (PARTITION BY rec, second ORDER BY bin) AS run FROM (SELECT *, (power IS DISTINCT FROM lag(power) OVER (PARTITION BY rec, second ORDER BY bin))::INT AS nw FROM pow)),
lv AS (SELECT rec, second, run, any_value(power) AS p, (min(bin) + max(bin)) // 2 AS bin FROM rn GROUP BY ALL), pk AS (SELECT * FROM (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b FROM lv WINDOW w AS (PARTITION BY rec, second ORDER BY run)) WHERE p > a AND p > b),
bst AS (SELECT rec, second, max(p) AS pa, arg_min(bin, (-p, bin)) AS ba, max(p) FILTER (bin BETWEEN 5 AND 14) AS pin, arg_min(bin, (-p, bin)) FILTER (bin BETWEEN 5 AND 14) AS bin FROM pk GROUP BY ALL),
rdg AS (SELECT rec, second, bin FROM bst WHERE pin IS NOT NULL AND CASE WHEN ba > 14 THEN pa / pin < 1.2 WHEN ba < 5 THEN pa / pin < 1.05 ELSE true END)"""


def powers(spark, d):
    """A matrix of 20 bins a second for each recording."""
    return samples(spark, d).select("rec", F.expr("i div 20").alias("second"), (F.col("i") % 20).cast("int").alias("bin"), F.round(F.abs("acc_x"), 2).alias("power"))


@query(RIDGES + " SELECT rec, second, bin FROM rdg")
def wavelet_ridges(spark, d):
    return wavelets.ridges(powers(spark, d), "rec", 5, 14, below=1.05, above=1.2)


@query(RIDGES + """, st AS (SELECT *, CASE WHEN second - lag(second) OVER w = 1 AND abs(bin - lag(bin) OVER w) <= 3 THEN 0 ELSE 1 END AS nw FROM rdg WINDOW w AS (PARTITION BY rec ORDER BY second)),
rr AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY second) AS run FROM st) SELECT rec, second, bin FROM rr QUALIFY count(*) OVER (PARTITION BY rec, run) >= 3""")
def lasting_ridges(spark, d):
    return wavelets.lasting(wavelets.ridges(powers(spark, d), "rec", 5, 14, below=1.05, above=1.2), "rec", least=3, delta=3)


@query()
def wavelet_steps(spark, d):
    n, cut = cutting(spark, d)
    return wavelets.wavelet_steps(motion(spark, d, n), "rec", "t", "acc", cut=cut).select("rec", *r("start", "end", "duration", "step_count", "cadence"))
