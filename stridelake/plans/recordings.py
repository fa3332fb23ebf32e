"""Queries on recordings: segments and the blocks of the feature table, over samples made from lineitem.

A supplier's lines, in order, are one recording of about 25 samples a second with bursts of motion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import features, lab, segments, series
from stridelake.plans.catalog import EV, ORACLE, query, r, table
from stridelake.sources import recordings
from stridelake.sources.cuts import bucketed, buckets, written


def samples(spark, d, n=None):
    """rec, i, t and the channels of each sample; with n dealt by rec in n partitions, as tables in n buckets are."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    x = x.repartition(n, "rec") if n else x
    x = segments.numbered(x, "rec", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"]).withColumn("t", (F.col("i") * 40 + F.col("l_linenumber") % 3 * 2) / 1000.0)
    b = F.when((F.col("i") % 300).between(60, 240), 1.0).otherwise(0.1)
    step, turn = 11.31 * F.col("t"), 2.5 * F.col("t")
    return x.select(
        "rec", F.col("i").cast("long").alias("i"), "t",
        (b * F.sin(step) + F.col("l_discount")).alias("acc_x"), (b * 0.5 * F.cos(step) + F.col("l_tax")).alias("acc_y"), (1.0 + 0.01 * (F.col("l_quantity") % 7)).alias("acc_z"),
        (b * F.sin(step)).alias("useracc_x"), (b * 0.5 * F.cos(step) + F.col("l_tax")).alias("useracc_y"), (0.01 * (F.col("l_quantity") % 7)).alias("useracc_z"),
        (b * 2.0 * F.sin(turn) + F.col("l_discount")).alias("gyro_x"), (b * F.cos(turn)).alias("gyro_y"), (b * 0.3 * F.sin(2 * turn) + F.col("l_tax")).alias("gyro_z"),
    )


def cutting(spark, d):
    """The number of buckets for the samples, and a cut that buckets its tables by rec."""
    n = buckets(spark, table(spark, d, "lineitem").count())
    return n, lambda df: bucketed(df, "rec", n)


def motion(spark, d, n=None):
    """Samples with the magnitudes, rounded to 9 places so that both engines compare equal values."""
    size = lambda p: F.round(F.sqrt(sum((F.col(f"{p}_{c}") * F.col(f"{p}_{c}") for c in "xyz"), F.lit(0.0))), 9)
    s = samples(spark, d, n)
    return s.select("rec", "i", "t", *[F.round(c, 9).alias(c) for c in ("gyro_x", "gyro_y", "gyro_z")], size("acc").alias("acc"), size("useracc").alias("useracc"), size("gyro").alias("gyro"))


SMP = """WITH b0 AS (SELECT l_suppkey AS rec, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax) - 1)::BIGINT AS i, l_linenumber AS ln, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS di, l_tax::DOUBLE AS tx FROM lineitem),
b1 AS (SELECT *, (i * 40 + ln % 3 * 2) / 1000.0::DOUBLE AS t, CASE WHEN i % 300 BETWEEN 60 AND 240 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS b FROM b0),
smp AS (SELECT rec, i, t, b*sin(11.31::DOUBLE*t)+di AS acc_x, b*0.5::DOUBLE*cos(11.31::DOUBLE*t)+tx AS acc_y, 1.0::DOUBLE+0.01::DOUBLE*(q%7) AS acc_z, b*sin(11.31::DOUBLE*t) AS useracc_x, b*0.5::DOUBLE*cos(11.31::DOUBLE*t)+tx AS useracc_y, 0.01::DOUBLE*(q%7) AS useracc_z,
b*2.0::DOUBLE*sin(2.5::DOUBLE*t)+di AS gyro_x, b*cos(2.5::DOUBLE*t) AS gyro_y, b*0.3::DOUBLE*sin(5.0::DOUBLE*t)+tx AS gyro_z FROM b1),
mot AS (SELECT rec, i, t, round(gyro_x, 9) AS gyro_x, round(gyro_y, 9) AS gyro_y, round(gyro_z, 9) AS gyro_z, round(sqrt(acc_x*acc_x+acc_y*acc_y+acc_z*acc_z), 9) AS acc, round(sqrt(useracc_x*useracc_x+useracc_y*useracc_y+useracc_z*useracc_z), 9) AS useracc, round(sqrt(gyro_x*gyro_x+gyro_y*gyro_y+gyro_z*gyro_z), 9) AS gyro FROM smp)"""


def ranges_sql(value: str, width: float, source: str = "mot", out: str = "w") -> str:
    """CTEs of the windows of a value."""
    return f""", {out}0 AS (SELECT rec, t, {value} AS v, min(t) OVER (PARTITION BY rec) AS t0, floor((max(t) OVER (PARTITION BY rec) - min(t) OVER (PARTITION BY rec)) / {width}::DOUBLE) AS nn FROM {source}),
{out}1 AS (SELECT rec, least(floor((t - t0) / {width}::DOUBLE), nn)::BIGINT AS win, min(v) AS low, max(v) AS high, count(*) AS n FROM {out}0 GROUP BY ALL),
{out} AS (SELECT g.rec, g.win, g.t0 + g.win * {width}::DOUBLE AS start, {out}1.low, {out}1.high, coalesce({out}1.n, 0) AS n, {out}1.high - {out}1.low AS p2p FROM (SELECT rec, t0, unnest(range(0, nn::BIGINT + 1)) AS win FROM (SELECT rec, any_value(t0) AS t0, any_value(nn) AS nn FROM {out}0 GROUP BY rec)) g LEFT JOIN {out}1 ON g.rec = {out}1.rec AND g.win = {out}1.win)"""


def limit_sql(value: str, k: float, cap: float | None, source: str, out: str) -> str:
    """CTEs of median + k * MAD, capped."""
    t = f"CASE WHEN x > 0 THEN least(m + {k}::DOUBLE * d, {cap}::DOUBLE * x) ELSE m + {k}::DOUBLE * d END" if cap else f"m + {k}::DOUBLE * d"
    return f""", {out}m AS (SELECT rec, {value} AS v, median({value}) OVER (PARTITION BY rec) AS m FROM {source}), {out}d AS (SELECT rec, max(m) AS m, median(abs(v - m)) AS d, max(v) AS x FROM {out}m GROUP BY rec), {out} AS (SELECT rec, {t} AS threshold FROM {out}d)"""


def active_sql(value: str, width: float, k: float, cap: float | None, least: float, out: str, source: str = "mot") -> str:
    return ranges_sql(value, width, source, out + "w") + limit_sql("p2p", k, cap, out + "w", out + "l") + f""",
{out}a AS (SELECT w.rec, max(threshold) AS threshold, min(start) FILTER (p2p >= threshold) AS start, max(start) FILTER (p2p >= threshold) AS e, count(*) FILTER (p2p >= threshold) AS n_active FROM {out}w w JOIN {out}l l ON w.rec = l.rec GROUP BY w.rec),
{out}b AS (SELECT a.*, least(z, e + {width}::DOUBLE) AS "end" FROM {out}a a JOIN (SELECT rec, max(t) AS z FROM {source} GROUP BY rec) y ON a.rec = y.rec),
{out} AS (SELECT rec, threshold, n_active, CASE WHEN "end" - start >= {least} THEN start END AS start, CASE WHEN "end" - start >= {least} THEN "end" END AS "end", CASE WHEN "end" - start >= {least} THEN "end" - start END AS duration FROM {out}b)"""


def mask_sql(on: str, gap: str, run: str, pad: str, source: str, out: str) -> str:
    """CTEs of the span of a mask; gap, run and pad are expressions on the source's columns."""
    return f""", {out}h AS (SELECT rec, i, {gap} AS gap, {run} AS run, {pad} AS pad, CASE WHEN i - lag(i) OVER (PARTITION BY rec ORDER BY i) - 1 <= {gap} THEN 0 ELSE 1 END AS nw FROM {source} WHERE {on}),
{out}i AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i) AS isl FROM {out}h), {out}r AS (SELECT rec, isl, min(i) AS a, max(i) AS b, any_value(run) AS run, any_value(pad) AS pad FROM {out}i GROUP BY ALL),
{out}s AS (SELECT rec, greatest(0, min(a) - max(pad)) AS first, max(b) + max(pad) AS last FROM {out}r WHERE b - a + 1 >= run GROUP BY rec),
{out} AS (SELECT s.rec, s.first, least(s.last, z.n - 1) AS last, p.t AS start, q.t AS "end", q.t - p.t AS duration FROM {out}s s JOIN (SELECT rec, count(*) AS n FROM mot GROUP BY rec) z ON z.rec = s.rec JOIN mot p ON p.rec = s.rec AND p.i = s.first JOIN mot q ON q.rec = s.rec AND q.i = least(s.last, z.n - 1))"""


FS = ", fr AS (SELECT rec, 1 / median(st) AS fs FROM (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY i) AS st FROM mot) WHERE st > 0 GROUP BY rec)"
SPAN = 'rec, round(start, 6) AS start, round("end", 6) AS "end", round(duration, 6) AS duration'


def span(df, *more):
    return df.select("rec", *more, *r("start", "end", "duration"))


@query(SMP + ", gap AS (SELECT * FROM mot WHERE i % 300 < 240)" + ranges_sql("acc", 1.0, "gap") + " SELECT rec, win, round(start, 6) AS start, round(low, 6) AS low, round(high, 6) AS high, n, round(p2p, 6) AS p2p FROM w")
def window_ranges(spark, d):
    w = segments.window_ranges(motion(spark, d).where("i % 300 < 240"), "rec", "t", "acc")
    return w.select("rec", "win", "n", *r("start", "low", "high", "p2p"))


@query(SMP + active_sql("useracc", 1.0, 0.25, None, 1.0, "a") + f" SELECT {SPAN}, round(threshold, 6) AS threshold, n_active FROM a")
def walk_span(spark, d):
    return span(segments.active_span(motion(spark, d), "rec", "t", "useracc", cap=None, least=1.0), "n_active", *r("threshold"))


@query(SMP + limit_sql("abs(gyro_x)", 3.0, 0.3, "mot", "l") + " SELECT rec, round(threshold, 6) AS threshold FROM l")
def sample_threshold(spark, d):
    m = motion(spark, d).withColumn("a", F.abs("gyro_x"))
    return segments.spread_threshold(m, "rec", "a", 3.0).select("rec", *r("threshold"))


@query(SMP + ", ab AS (SELECT rec, i, t, abs(gyro_x) AS v FROM mot)" + ranges_sql("v", 0.4, "ab", "w") + limit_sql("p2p", 5.0, 0.3, "w", "l") + FS + ", src AS (SELECT ab.*, threshold, fs FROM ab JOIN l USING (rec) JOIN fr USING (rec))"
       + mask_sql("v >= threshold", "greatest(1, floor(0.6::DOUBLE * fs))", "greatest(1, floor(0.25::DOUBLE * fs))", "floor(0.15::DOUBLE * fs)::BIGINT", "src", "m") + f" SELECT {SPAN}, round(threshold, 6) AS threshold FROM m JOIN l USING (rec)")
def turn_window(spark, d):
    m = motion(spark, d).withColumn("a", F.abs("gyro_x"))
    return span(segments.turn_span(m, "rec", "i", "t", "a"), *r("threshold"))


PEAK = SMP + FS + ", top AS (SELECT rec, 0.25::DOUBLE * max(gyro) AS threshold FROM mot GROUP BY rec), src AS (SELECT mot.*, threshold, fs FROM mot JOIN top USING (rec) JOIN fr USING (rec))" + mask_sql("gyro >= threshold", "greatest(1, round_even(0.2::DOUBLE * fs, 0))", "1", "greatest(1, round_even(0.1::DOUBLE * fs, 0))::BIGINT", "src", "m")


@query(PEAK + f" SELECT {SPAN}, first::BIGINT AS first, last::BIGINT AS last, round(threshold, 6) AS threshold FROM m JOIN top USING (rec)")
def gyro_turn_window(spark, d):
    return span(segments.peak_span(motion(spark, d), "rec", "i", "t", "gyro"), "first", "last", *r("threshold"))


BROAD = SMP + active_sql("gyro", 1.0, 3.0, 0.3, 0.5, "a")
REFINED = BROAD + """, ins AS (SELECT mot.*, abs(gyro_x) AS v FROM mot JOIN a USING (rec) WHERE a.start IS NULL OR t BETWEEN a.start AND a."end")""" + limit_sql("v", 3.0, 0.3, "ins", "l") + """,
rf0 AS (SELECT rec, max(threshold) AS threshold, min(t) AS s, max(t) AS e, min(t) FILTER (v >= threshold) AS start, max(t) FILTER (v >= threshold) AS "end" FROM ins JOIN l USING (rec) GROUP BY rec),
rf AS (SELECT rec, threshold, CASE WHEN "end" - start >= 0.5 THEN start ELSE s END AS start, CASE WHEN "end" - start >= 0.5 THEN "end" ELSE e END AS "end" FROM rf0)"""


def _broad(spark, d):
    """The samples' gyro and the broad span. Both are cut: plans that go on from them would sort the samples once for each
    of their joins and windows, all in the memory of one task."""
    m = written(motion(spark, d).select("rec", "i", "t", "gyro_x", "gyro"), "motion")
    return m, written(segments.active_span(m, "rec", "t", "gyro", k=3.0, least=0.5, fallback=0.1), "broad")


def _transition(spark, d):
    m, broad = _broad(spark, d)
    return m, written(segments.refined_span(m, "rec", "i", "t", "gyro_x", broad), "refined")


@query(BROAD + f" SELECT {SPAN}, round(threshold, 6) AS threshold FROM a")
def transition_span(spark, d):
    return span(_broad(spark, d)[1], *r("threshold"))


@query(REFINED + """ SELECT rec, round(start, 6) AS start, round("end", 6) AS "end", round("end" - start, 6) AS duration, round(threshold, 6) AS threshold FROM rf""")
def refined_window(spark, d):
    return span(_transition(spark, d)[1], *r("threshold"))


EXTREME = REFINED + """, pk AS (SELECT mot.* FROM mot JOIN rf USING (rec) WHERE t BETWEEN start AND "end"),
ex AS (SELECT rec, arg_min(struct_pack(o := i, t := t, v := gyro_x), struct_pack(x := -gyro_x, o := i)) AS h, arg_min(struct_pack(o := i, t := t, v := gyro_x), struct_pack(x := gyro_x, o := i)) AS l FROM pk GROUP BY rec),
ed AS (SELECT rec, h.v AS flexion_peak, h.t AS flexion_time, l.v AS extension_peak, l.t AS extension_time, least(h.o, l.o) AS a, greatest(h.o, l.o) AS b, threshold, start AS s, "end" AS e FROM ex JOIN rf USING (rec))"""
ENDS = "rec, round(flexion_peak, 6) AS flexion_peak, round(flexion_time, 6) AS flexion_time, round(extension_peak, 6) AS extension_peak, round(extension_time, 6) AS extension_time"


@query(EXTREME + f""", en AS (SELECT ed.rec, coalesce(min(t) FILTER (abs(gyro_x) < threshold AND t BETWEEN s AND e AND i > b), any_value(e)) AS "end" FROM mot JOIN ed USING (rec) GROUP BY ed.rec)
SELECT {ENDS}, round(s, 6) AS start, round("end", 6) AS "end", round("end" - s, 6) AS duration FROM ed JOIN en USING (rec)""")
def flexion_extension(spark, d):
    m, refined = _transition(spark, d)
    return span(segments.motion_end(m, "rec", "i", "t", "gyro_x", refined), *r("flexion_peak", "flexion_time", "extension_peak", "extension_time"))


@query(EXTREME + f""", en AS (SELECT ed.rec, coalesce(max(t) FILTER (abs(gyro_x) < threshold AND i <= a), min(t)) AS start, coalesce(min(t) FILTER (abs(gyro_x) < threshold AND i >= b), max(t)) AS "end" FROM mot JOIN ed USING (rec) GROUP BY ed.rec)
SELECT {ENDS}, round(start, 6) AS start, round("end", 6) AS "end", round("end" - start, 6) AS duration FROM ed JOIN en USING (rec)""")
def anchored_extremes(spark, d):
    m, refined = _transition(spark, d)
    return span(segments.motion_end(m, "rec", "i", "t", "gyro_x", refined, anchored=True), *r("flexion_peak", "flexion_time", "extension_peak", "extension_time"))


@query(REFINED + FS + """, src AS (SELECT mot.*, threshold, fs FROM mot JOIN rf USING (rec) JOIN fr USING (rec) WHERE t BETWEEN start AND "end"),
h AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rec ORDER BY i) - 1 <= greatest(1, round_even(0.75::DOUBLE * fs, 0)) THEN 0 ELSE 1 END AS nw FROM src WHERE abs(gyro_x) >= threshold),
g AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i) AS isl FROM h), e AS (SELECT rec, isl, min(i) AS first, max(i) AS last, any_value(fs) AS fs FROM g GROUP BY ALL),
c AS (SELECT e.rec, e.first, e.last, round(max(gyro_x) - min(gyro_x), 9) AS score FROM e JOIN mot ON mot.rec = e.rec AND mot.i BETWEEN e.first AND e.last WHERE e.last - e.first + 1 >= greatest(1, round_even(0.5::DOUBLE * fs, 0)) GROUP BY ALL),
z AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, first) = 1)
SELECT z.rec, z.first, z.last, round(p.t, 6) AS start, round(q.t, 6) AS "end", round(q.t - p.t, 6) AS duration FROM z JOIN mot p ON p.rec = z.rec AND p.i = z.first JOIN mot q ON q.rec = z.rec AND q.i = z.last""")
def strongest_region(spark, d):
    m, refined = _transition(spark, d)
    rate = segments.with_rate(m, "rec", "i", "t").join(refined.select("rec", "threshold", "start", "end"), "rec")
    on = F.col("t").between(F.col("start"), F.col("end")) & (F.abs("gyro_x") >= F.col("threshold"))
    s = segments.strongest_region(rate.select("rec", "i", "t", "gyro_x", "fs", on.alias("on")), "rec", "i", "t", "gyro_x", F.col("on"), segments.samples(0.75, F.col("fs")), segments.samples(0.5, F.col("fs")))
    return span(s, "first", "last")


@query(SMP + active_sql("useracc", 1.0, 0.25, None, 1.0, "a") + """, p AS (SELECT mot.*, lag(useracc) OVER (PARTITION BY rec ORDER BY i) AS lo, lead(useracc) OVER (PARTITION BY rec ORDER BY i) AS hi FROM mot),
k AS (SELECT p.rec, min(i) AS first, max(i) AS last, max(threshold) AS threshold FROM p JOIN a USING (rec) WHERE useracc > lo AND useracc > hi AND useracc >= threshold GROUP BY p.rec),
s AS (SELECT k.rec, coalesce(max(t) FILTER (useracc < threshold AND i <= first), min(t)) AS start, coalesce(min(t) FILTER (useracc < threshold AND i >= last), max(t)) AS "end" FROM mot JOIN k USING (rec) GROUP BY k.rec)
SELECT rec, round(start, 6) AS start, round("end", 6) AS "end", round("end" - start, 6) AS duration FROM s""")
def step_crossings(spark, d):
    m = motion(spark, d)
    limit = segments.active_span(m, "rec", "t", "useracc", cap=None, least=1.0).select("rec", "threshold")
    w = series.ordered("rec", "i")
    p = m.withColumn("lo", F.lag("useracc").over(w)).withColumn("hi", F.lead("useracc").over(w)).join(limit, "rec").where("useracc > lo and useracc > hi and useracc >= threshold")
    peaks = p.groupBy("rec").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("threshold").alias("threshold"))
    return span(segments.crossing_span(m, "rec", "i", "t", "useracc", peaks, "threshold"))


@query(BROAD + """, ins AS (SELECT mot.*, threshold FROM mot JOIN a USING (rec) WHERE a.start IS NULL OR t BETWEEN a.start AND a."end"), l2 AS (SELECT *, greatest(threshold, 0.15::DOUBLE * max(gyro) OVER (PARTITION BY rec)) AS lim FROM ins),
s AS (SELECT rec, coalesce(min(t) FILTER (gyro >= lim), min(t)) AS start, coalesce(max(t) FILTER (gyro >= lim), max(t)) AS "end" FROM l2 GROUP BY rec) SELECT rec, round(start, 6) AS start, round("end", 6) AS "end", round("end" - start, 6) AS duration FROM s""")
def main_motion(spark, d):
    m, broad = _broad(spark, d)
    return span(segments.main_motion(m, "rec", "i", "t", "gyro", broad))


@query(SMP + FS + """, p AS (SELECT rec, i, t, abs(acc - median(acc) OVER (PARTITION BY rec)) AS a FROM mot), q AS (SELECT *, median(a) OVER (PARTITION BY rec) AS m FROM p), s AS (SELECT *, 1.4826::DOUBLE * median(abs(a - m)) OVER (PARTITION BY rec) AS dv FROM q),
u AS (SELECT s.*, m + 1.0::DOUBLE * dv AS thr, greatest(0.35::DOUBLE * (m + 1.0::DOUBLE * dv), m + 0.5::DOUBLE * dv) AS ex, greatest(1, round_even(0.1::DOUBLE * fs, 0)) AS len, round_even(0.15::DOUBLE * fs, 0) AS pad, count(*) OVER (PARTITION BY rec) AS n FROM s JOIN fr USING (rec)),
h AS (SELECT *, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS isl FROM u WHERE a > thr), g AS (SELECT rec, isl, min(i) AS s, max(i) + 1 AS e, max(a) AS p, count(*) AS c, max(len) AS l FROM h GROUP BY ALL HAVING count(*) >= max(len)),
bst AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(p * c, 9) DESC, s) = 1),
x AS (SELECT u.rec, any_value(b.s) AS s, any_value(n) AS n, any_value(len) AS l, any_value(pad) AS pad, arg_min(i, struct_pack(x := -round(a, 9), o := i)) AS top, max(i) FILTER (a <= ex AND i <= b.s) AS f, min(i) FILTER (a <= ex AND i >= b.e) AS z FROM u LEFT JOIN bst b ON b.rec = u.rec GROUP BY u.rec),
y AS (SELECT rec, greatest(0, CASE WHEN s IS NOT NULL THEN coalesce(f, 0) - pad ELSE top - l END)::BIGINT AS first, least(n - 1, CASE WHEN s IS NOT NULL THEN coalesce(z, n - 1) + pad ELSE top + l END)::BIGINT AS last FROM x)
SELECT y.rec, first, last, round(p.t, 6) AS start, round(q.t, 6) AS "end", round(q.t - p.t, 6) AS duration FROM y JOIN mot p ON p.rec = y.rec AND p.i = first JOIN mot q ON q.rec = y.rec AND q.i = last""")
def motion_window(spark, d):
    return span(segments.motion_window(motion(spark, d), "rec", "i", "t", "acc", k=1.0, least=0.1, pad=0.15), "first", "last")


def smooth_sql(value: str, sigma: float, source: str, out: str) -> str:
    """CTEs of the Gaussian smoothing of a value along i = 0, 1 ...: out (rec, i, t, s)."""
    reach = int(4 * sigma + 0.5)
    return f""", {out}n AS (SELECT rec, t, {value} AS v, row_number() OVER (PARTITION BY rec ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM {source}),
{out}o AS (SELECT rec, i, t, n, o, ((i + o) % (2*n) + 2*n) % (2*n) AS m FROM {out}n, generate_series(-{reach}, {reach}) AS s(o)),
{out} AS (SELECT o.rec, o.i, any_value(o.t) AS t, sum(exp(-o*o / {2 * sigma * sigma}::DOUBLE) * x.v) / sum(exp(-o*o / {2 * sigma * sigma}::DOUBLE)) AS s FROM {out}o o JOIN {out}n x ON x.rec = o.rec AND x.i = CASE WHEN m < o.n THEN m ELSE 2*o.n-1-m END GROUP BY o.rec, o.i)"""


def peaks_sql(source: str, height: str, distance: str, out: str) -> str:
    """CTEs of the peaks of s in source (rec, i, t, s and what height and distance name): out (rec, i, t)."""
    return f""", {out}c AS (SELECT *, lag(s) OVER w AS lo, lead(s) OVER w AS hi FROM {source} WINDOW w AS (PARTITION BY rec ORDER BY i)),
{out}l AS (SELECT rec, list([i] ORDER BY s DESC, i DESC) AS l, any_value({distance}) AS d FROM {out}c WHERE s > lo AND s > hi AND s >= {height} GROUP BY rec),
{out}k AS (SELECT rec, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < d)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS i FROM {out}l),
{out} AS (SELECT k.rec, k.i, s.t FROM {out}k k JOIN {source} s ON s.rec = k.rec AND s.i = k.i)"""


WALK = SMP + active_sql("useracc", 1.0, 0.25, None, 1.0, "a") + FS + """, win AS (SELECT mot.* FROM mot JOIN a USING (rec) WHERE start IS NOT NULL AND t BETWEEN start AND "end"),
wf AS (SELECT rec, 1 / median(st) AS wfs FROM (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY i) AS st FROM win) WHERE st > 0 GROUP BY rec)""" + smooth_sql("useracc", 3.0, "win", "sm") + """,
sp AS (SELECT sm.*, threshold, greatest(1, round_even(0.3::DOUBLE * wfs, 0)) AS apart FROM sm JOIN a USING (rec) JOIN wf USING (rec))""" + peaks_sql("sp", "threshold", "apart", "pk") + """,
gp AS (SELECT rec, t, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS g FROM pk), ct AS (SELECT rec, count(*)::DOUBLE AS n, coalesce(avg(g), 1.0::DOUBLE) AS m, coalesce(stddev_pop(g), 0.0::DOUBLE) AS sd FROM gp GROUP BY rec),
task AS (SELECT rec, max(t) - min(t) AS task FROM mot GROUP BY rec), base AS (SELECT task.rec, task, duration, coalesce(n, 0) AS n, m, sd FROM task LEFT JOIN a USING (rec) LEFT JOIN ct USING (rec))"""
STEP_NAMES = ["walk_duration", "step_count", "cadence", "walk_task_duration", "walk_task_cadence", "walk_task_mean_step_time", "walk_protocol_duration", "walk_protocol_cadence", "walk_protocol_mean_step_time", "walking_speed", "mean_step_time", "step_time_std", "step_time_cv"]


def _walk(spark, d, names):
    n, cut = cutting(spark, d)
    return features.walk(motion(spark, d, n), "rec", "useracc", "gyro", cut=cut, only=names)


@query(WALK + """ SELECT rec, round(duration, 6) AS walk_duration, n AS step_count, round(60 * n / duration, 6) AS cadence, round(task, 6) AS walk_task_duration, round(60 * n / nullif(task, 0), 6) AS walk_task_cadence, round(task / nullif(n, 0), 6) AS walk_task_mean_step_time,
30.0::DOUBLE AS walk_protocol_duration, round(60 * n / 30.0::DOUBLE, 6) AS walk_protocol_cadence, round(30.0::DOUBLE / nullif(n, 0), 6) AS walk_protocol_mean_step_time, round(10.0::DOUBLE / duration, 6) AS walking_speed, round(m, 6) AS mean_step_time, round(sd, 6) AS step_time_std, round(sd / m, 6) AS step_time_cv FROM base""")
def walk_steps(spark, d):
    return _walk(spark, d, STEP_NAMES).select("rec", *r(*STEP_NAMES))


@query(WALK + """, tw AS (SELECT rec, row_number() OVER w AS n, t AS a, lead(t, 10) OVER w AS b, lead(t) OVER w - t AS g FROM pk WINDOW w AS (PARTITION BY rec ORDER BY t)),
ts AS (SELECT *, stddev_pop(g) OVER w AS sd, min(g) OVER w AS lo, max(g) OVER w AS hi FROM tw WINDOW w AS (PARTITION BY rec ORDER BY a ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
tc AS (SELECT ts.*, b - ts.a AS d, 600 / (b - ts.a) AS cad, sd / ((b - ts.a) / 10) AS cv, (x.start + x."end") / 2 AS mid FROM ts JOIN a x USING (rec) WHERE b IS NOT NULL), tf AS (SELECT *, cad BETWEEN 30 AND 180 AND lo >= 0.25 AND hi <= 2.5 AS fine FROM tc),
tp AS (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY rec ORDER BY fine DESC, CASE WHEN fine THEN round(cv, 9) END NULLS FIRST, CASE WHEN fine THEN round(abs((a + b) / 2 - mid), 6) END NULLS FIRST, n) = 1)
SELECT task.rec, round(a, 6) AS walk_10_step_start_time, round(b, 6) AS walk_10_step_end_time, round(d, 6) AS walk_10_step_duration, CASE WHEN d IS NOT NULL THEN 10.0::DOUBLE END AS walk_10_step_count, round(cad, 6) AS walk_10_step_cadence, round(d / 10, 6) AS walk_10_step_mean_step_time, round(cv, 6) AS walk_10_step_time_cv FROM task LEFT JOIN tp USING (rec)""")
def walk_ten_steps(spark, d):
    names = [n for n in features.WALK if "10_step" in n]
    return _walk(spark, d, names).select("rec", *r(*names))


@query(WALK + """, wi AS (SELECT mot.* FROM mot JOIN a USING (rec) WHERE start IS NULL OR t BETWEEN start AND "end"),
g AS (SELECT rec, t, useracc AS f, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(useracc) OVER w AS lo, lead(useracc) OVER w AS hi FROM mot WINDOW w AS (PARTITION BY rec ORDER BY t)),
j AS (SELECT rec, t, CASE WHEN hs IS NULL THEN (hi - f) / nullif(hd, 0) WHEN hd IS NULL THEN (f - lo) / nullif(hs, 0) ELSE (hs*hs*hi + (hd*hd - hs*hs)*f - hd*hd*lo) / nullif(hs*hd*(hs+hd), 0) END AS j FROM g), ji AS (SELECT j.* FROM j JOIN a USING (rec) WHERE start IS NULL OR t BETWEEN start AND "end")
SELECT rec, round(avg(useracc), 6) AS walk_acc_mag_mean, round(stddev_pop(useracc), 6) AS walk_acc_mag_std, round(sqrt(avg(useracc * useracc)), 6) AS walk_acc_mag_rms, round(stddev_pop(gyro), 6) AS walk_gyro_mag_std, any_value(jm) AS walk_jerk_mean, any_value(js) AS walk_jerk_std
FROM wi JOIN (SELECT rec, round(avg(abs(j)), 6) AS jm, round(stddev_pop(j), 6) AS js FROM ji GROUP BY rec) USING (rec) GROUP BY rec""")
def walk_motion(spark, d):
    names = ["walk_acc_mag_mean", "walk_acc_mag_std", "walk_acc_mag_rms", "walk_gyro_mag_std", "walk_jerk_mean", "walk_jerk_std"]
    return _walk(spark, d, names).select("rec", *r(*names))


@query(WALK + """, wi AS (SELECT mot.rec, useracc - avg(useracc) OVER (PARTITION BY mot.rec) AS x, row_number() OVER (PARTITION BY mot.rec ORDER BY i) AS i FROM mot JOIN a USING (rec) WHERE start IS NULL OR t BETWEEN start AND "end"),
lg AS (SELECT rec, round_even(m * fs, 0)::BIGINT AS lag FROM ct JOIN fr USING (rec) WHERE m IS NOT NULL), v AS (SELECT rec, sum(x*x) AS v, count(*) AS n FROM wi GROUP BY rec),
c AS (SELECT p.rec, sum(p.x * q.x) FILTER (p.i - q.i = lag) AS one, sum(p.x * q.x) FILTER (p.i - q.i = 2 * lag) AS two FROM wi p JOIN lg ON lg.rec = p.rec JOIN wi q ON q.rec = p.rec AND (p.i - q.i = lag OR p.i - q.i = 2 * lag) GROUP BY p.rec)
SELECT lg.rec, CASE WHEN lag > 0 AND lag < n THEN round(one / nullif(v, 0), 6) END AS step_regularity, CASE WHEN lag > 0 AND 2 * lag < n THEN round(two / nullif(v, 0), 6) END AS stride_regularity FROM lg JOIN v USING (rec) LEFT JOIN c USING (rec)""")
def walk_regularity(spark, d):
    names = ["step_regularity", "stride_regularity"]
    return _walk(spark, d, ["mean_step_time", *names]).where("mean_step_time is not null").select("rec", *r(*names))


def welch_sql(source: str, out: str, segment: int = 256) -> str:
    """CTEs of the Welch entropy of v in source (rec, i from 0, v): out (rec, entropy)."""
    return f""", {out}n AS (SELECT rec, i, v, least({segment}, count(*) OVER (PARTITION BY rec)) AS z, count(*) OVER (PARTITION BY rec) AS n FROM {source}),
{out}g AS (SELECT rec, z, unnest(range(0, n - z + 1, z - z // 2)) AS b FROM (SELECT DISTINCT rec, z, n FROM {out}n WHERE z >= 4)),
{out}s AS (SELECT g.rec, g.b, g.z, n.i - g.b AS k, n.v - avg(n.v) OVER (PARTITION BY g.rec, g.b) AS v FROM {out}g g JOIN {out}n n ON n.rec = g.rec AND n.i >= g.b AND n.i < g.b + g.z),
{out}f AS (SELECT rec, b, z, f, sum(v * (0.5 - 0.5 * cos(2 * pi() * k / z)) * cos(2 * pi() * k * f / z)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * k / z)) * sin(2 * pi() * k * f / z)) AS im FROM {out}s, unnest(range(0, z // 2 + 1)) AS q(f) GROUP BY ALL),
{out}a AS (SELECT rec, z, f, avg(re*re + im*im) AS p0 FROM {out}f GROUP BY rec, z, f), {out}p AS (SELECT rec, z, f, p0 * CASE WHEN f > 0 AND 2 * f < z THEN 2 ELSE 1 END AS p FROM {out}a), {out}q AS (SELECT rec, z, p / sum(p) OVER (PARTITION BY rec) AS q, sum(p) OVER (PARTITION BY rec) AS total FROM {out}p),
{out} AS (SELECT rec, CASE WHEN max(total) > 0 THEN -(sum(q * log2(q)) FILTER (q > 0)) / log2(max(z) // 2 + 1) END AS entropy FROM {out}q GROUP BY rec)"""


@query(WALK + """, wi AS (SELECT mot.rec, useracc AS v, row_number() OVER (PARTITION BY mot.rec ORDER BY i) - 1 AS i FROM mot JOIN a USING (rec) WHERE start IS NULL OR t BETWEEN start AND "end")""" + welch_sql("wi", "we") + """,
h AS (SELECT rec, i, count(*) OVER p AS n, (v - avg(v) OVER p) * (0.5 - 0.5 * cos(2 * pi() * i / (count(*) OVER p - 1))) AS c FROM wi WINDOW p AS (PARTITION BY rec)),
pw AS (SELECT rec, n, f, sum(c * cos(2 * pi() * i * f / n)) AS re, sum(c * sin(2 * pi() * i * f / n)) AS im FROM h, unnest(range(1, n // 2 + 1)) AS s(f) WHERE n >= 8 GROUP BY ALL), tp AS (SELECT rec, f / n::DOUBLE AS hz FROM pw QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(re*re + im*im, 6) DESC, f) = 1)
SELECT we.rec, round(hz * fs, 6) AS walk_dominant_frequency, round(entropy, 6) AS walk_spectral_entropy FROM we LEFT JOIN tp USING (rec) LEFT JOIN fr USING (rec)""")
def walk_spectrum(spark, d):
    names = ["walk_dominant_frequency", "walk_spectral_entropy"]
    return _walk(spark, d, names).select("rec", *r(*names))


TURN = PEAK + """, wi AS (SELECT mot.*, abs(gyro_x) AS v, abs(useracc) AS s0, threshold, row_number() OVER (PARTITION BY mot.rec ORDER BY i) - 1 AS k FROM mot JOIN m USING (rec) JOIN top USING (rec) WHERE t BETWEEN m.start AND m."end"),
wf AS (SELECT rec, 1 / median(st) AS wfs FROM (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY i) AS st FROM wi) WHERE st > 0 GROUP BY rec)"""


@query(TURN + smooth_sql("s0", 2.0, "wi", "sm") + """, sp AS (SELECT sm.*, quantile_cont(s, 0.55) OVER (PARTITION BY sm.rec) AS h, greatest(1, floor(0.5::DOUBLE * wfs)) AS apart FROM sm JOIN wf USING (rec))""" + peaks_sql("sp", "h", "apart", "pk") + """,
c AS (SELECT rec, count(*)::DOUBLE AS n FROM pk GROUP BY rec), g AS (SELECT rec, t, v AS f, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(v) OVER w AS lo, lead(v) OVER w AS hi FROM wi WINDOW w AS (PARTITION BY rec ORDER BY t)),
j AS (SELECT rec, stddev_pop(CASE WHEN hs IS NULL THEN (hi - f) / nullif(hd, 0) WHEN hd IS NULL THEN (f - lo) / nullif(hs, 0) ELSE (hs*hs*hi + (hd*hd - hs*hs)*f - hd*hd*lo) / nullif(hs*hd*(hs+hd), 0) END) AS jerk FROM g GROUP BY rec),
qn AS (SELECT rec, t, i, gyro < threshold AS q, CASE WHEN (gyro < threshold) IS DISTINCT FROM lag(gyro < threshold) OVER (PARTITION BY rec ORDER BY i) THEN 1 ELSE 0 END AS nw FROM wi), qr AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i) AS run FROM qn),
qs AS (SELECT rec, max(t) - min(t) AS s FROM qr WHERE q GROUP BY rec, run HAVING count(*) >= 2), ql AS (SELECT rec, s, 0.6::DOUBLE * median(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY rec) AS l FROM qs), qt AS (SELECT rec, sum(s) AS p FROM ql WHERE s >= coalesce(l, 0) GROUP BY rec)
SELECT wi.rec, round(any_value(m.duration), 6) AS duration, round(avg(v), 6) AS mean_angular_velocity, round(max(v), 6) AS peak_angular_velocity, round(stddev_pop(v), 6) AS ang_vel_std, coalesce(any_value(c.n), 0) AS step_count, round(coalesce(any_value(qt.p), 0), 6) AS pause_time, round(any_value(jerk), 6) AS jerk_std
FROM wi JOIN m ON m.rec = wi.rec LEFT JOIN c ON c.rec = wi.rec LEFT JOIN qt ON qt.rec = wi.rec LEFT JOIN j ON j.rec = wi.rec GROUP BY wi.rec""")
def turn_features(spark, d):
    n, cut = cutting(spark, d)
    return features.turn(motion(spark, d, n).select("rec", "i", "t", "useracc", "gyro", "gyro_x"), "rec", "useracc", "gyro", "gyro_x", cutoff=None, cut=cut).select("rec", *r(*features.TURN[:-1]))


@query(TURN + ", en AS (SELECT rec, k AS i, v FROM wi)" + welch_sql("en", "we") + " SELECT rec, round(entropy, 6) AS entropy FROM we")
def turn_entropy(spark, d):
    n, cut = cutting(spark, d)
    return features.turn(motion(spark, d, n).select("rec", "i", "t", "useracc", "gyro", "gyro_x"), "rec", "useracc", "gyro", "gyro_x", cutoff=None, cut=cut).select("rec", *r("entropy"))


MOVE = EXTREME + FS + """, en AS (SELECT ed.rec, coalesce(min(t) FILTER (abs(gyro_x) < threshold AND t BETWEEN s AND e AND i > b), any_value(e)) AS "end" FROM mot JOIN ed USING (rec) GROUP BY ed.rec),
wi AS (SELECT mot.*, row_number() OVER (PARTITION BY mot.rec ORDER BY i) - 1 AS k FROM mot JOIN ed USING (rec) JOIN en USING (rec) WHERE t BETWEEN s AND en."end")"""


@query(MOVE + """, sp AS (SELECT wi.rec, k AS i, t, useracc AS s, greatest(1, round_even(0.15::DOUBLE * fs, 0)) AS apart FROM wi JOIN fr USING (rec))""" + peaks_sql("sp", "-1e9", "apart", "pq") + """, c AS (SELECT rec, count(*)::DOUBLE AS n FROM pq GROUP BY rec),
tp AS (SELECT rec, t AS pt, useracc AS pv FROM wi QUALIFY row_number() OVER (PARTITION BY rec ORDER BY useracc DESC, t) = 1), g AS (SELECT rec, t, useracc AS f, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(useracc) OVER w AS lo, lead(useracc) OVER w AS hi FROM wi WINDOW w AS (PARTITION BY rec ORDER BY t)),
j AS (SELECT rec, CASE WHEN hs IS NULL THEN (hi - f) / nullif(hd, 0) WHEN hd IS NULL THEN (f - lo) / nullif(hs, 0) ELSE (hs*hs*hi + (hd*hd - hs*hs)*f - hd*hd*lo) / nullif(hs*hd*(hs+hd), 0) END AS j FROM g), js AS (SELECT rec, avg(abs(j)) AS jm, stddev_pop(j) AS jd FROM j GROUP BY rec), en2 AS (SELECT rec, k AS i, useracc AS v FROM wi)""" + welch_sql("en2", "we") + """
SELECT wi.rec, round(any_value(en."end" - ed.s), 6) AS duration, round(any_value(pt) - min(wi.t), 6) AS time_to_peak_acc, round(any_value(pv), 6) AS peak_acc, round(any_value(flexion_peak), 6) AS flexion_peak, round(any_value(extension_peak), 6) AS extension_peak, round(max(gyro), 6) AS peak_gyro, round(sqrt(avg(useracc * useracc)), 6) AS acc_rms,
round(any_value(jm), 6) AS jerk_mean, round(any_value(jd), 6) AS jerk_std, coalesce(any_value(c.n), 0) AS peak_count, round(any_value(entropy), 6) AS entropy
FROM wi JOIN en USING (rec) JOIN ed USING (rec) JOIN tp USING (rec) JOIN js USING (rec) LEFT JOIN c USING (rec) LEFT JOIN we USING (rec) GROUP BY wi.rec""")
def transition_features(spark, d):
    """The dominant axis is gyro_x in all recordings."""
    n, cut = cutting(spark, d)
    return features.transition(motion(spark, d, n).drop("acc"), "rec", "useracc", "gyro", ["gyro_x", "gyro_y", "gyro_z"], cut=cut).select("rec", *r(*features.TRANSITION))


def lab_samples(spark, d, n=None):
    """Samples of laboratory sensors: every fifth recording is of one sensor, one of them without values of its own."""
    names = F.array(*[F.lit(n) for n in ("right", "left", "trunk", "sacrum", "thigh")])
    s = samples(spark, d, n).withColumns({f"{p}_mag": recordings.magnitude(p) for p in ("acc", "gyro", "useracc")})
    s = series.centre(segments.with_rate(s, "rec", "i", "t"), "rec", "acc_mag", out="acc_free")
    return s.withColumn("sensor", F.element_at(names, (F.col("rec") % 5 + 1).cast("int")))


@query()
def lab_walks(spark, d):
    n, cut = cutting(spark, d)
    s = cut(lab_samples(spark, d, n).select("rec", "i", "t", "fs", "sensor", "gyro_x", "gyro_z", "gyro_mag", "acc_free"))
    out = lab.walking(s, "rec", cut=cut)
    return out.select("rec", "sensor", *r(*[n for n in out.columns if n not in ("rec", "sensor")]))


LAB_TURN = SMP + FS + """, v AS (SELECT s.rec, i, t, abs(gyro_y) AS v, fs FROM smp s JOIN fr USING (rec)), tp AS (SELECT rec, 0.25::DOUBLE * max(v) AS threshold, max(i) AS n, greatest(1, round_even(0.10::DOUBLE * any_value(fs), 0)) AS pad FROM v GROUP BY rec),
hit AS (SELECT v.rec, min(i) AS a, max(i) AS b FROM v JOIN tp USING (rec) WHERE v >= threshold GROUP BY v.rec), sp AS (SELECT rec, greatest(0, a - pad)::BIGINT AS a, least(n, b + pad)::BIGINT AS b FROM hit JOIN tp USING (rec)),
w AS (SELECT v.*, sp.a, sp.b FROM v JOIN sp USING (rec) WHERE i BETWEEN sp.a AND sp.b)"""


@query(LAB_TURN + """ SELECT rec, round(min(t), 6) AS start_time_s, round(max(t), 6) AS end_time_s, round(max(t) - min(t), 6) AS duration_s, round(max(v), 6) AS peak_angular_velocity, round(avg(v), 6) AS mean_angular_velocity FROM w GROUP BY rec""")
def lab_turns(spark, d):
    n, cut = cutting(spark, d)
    s = cut(lab_samples(spark, d, n).select("rec", "i", "t", "gyro_y", "acc_free"))
    return lab.turning(s, "rec").select("rec", *r("start_time_s", "end_time_s", "duration_s", "peak_angular_velocity", "mean_angular_velocity"))


@query()
def lab_rises(spark, d):
    n, cut = cutting(spark, d)
    m = recordings.motion_channel(lab_samples(spark, d, n), "rec")
    m = cut(m.select("rec", "sensor", "i", "t", "motion", "gyro_mag", "gyro_x", "gyro_y", "gyro_z"))
    out = lab.with_offsets(lab.rising(m, "rec", cut=cut).join(m.groupBy("rec").agg(F.first("sensor").alias("sensor")), "rec"))
    return out.select("rec", "sensor", *r(*[n for n in out.columns if n not in ("rec", "sensor")]))


@query()
def feature_table(spark, d):
    """All features of patients made of five recordings each: raw rows, preprocess, last seconds, motion channel, blocks."""
    kinds = F.array(*[F.lit(a) for a in recordings.KEPT])
    rows = table(spark, d, "lineitem").count()
    n, held = buckets(spark, rows, 100_000), buckets(spark, rows, 800_000)  # a block takes a seventh of the rows or less
    s = samples(spark, d, n)
    raw = s.select(F.col("rec").alias("path"), F.col("i").alias("seq"), (F.col("t") * 1000).alias("timestamp"), *recordings.CHANNELS)
    of = F.element_at(kinds, (F.col("path").cast("int") % 5 + 1))
    axes = ["gyro_x", "gyro_y", "gyro_z"]
    # What the features read: all else would be moved with each sample.
    p = recordings.preprocess(raw, derive=False).select("path", "t", "acc_mag", "useracc_mag", "gyro_mag", *axes)
    p = recordings.motion_channel(recordings.truncated(p.repartition(n, "path"), "path", of), "path")
    p = p.withColumns({"patient": F.expr("cast(path as int) div 5"), "date": F.lit("2026-01-05"), "activity": of})
    out = features.table(p, "patient", "date", "activity", axes, cut=lambda df: bucketed(df, "_key", held))
    return out.select("patient", "date", *[F.round(f, 3).alias(f) for f in features.feature_names()])


# SQL of two queries on events, by the CTEs above.
ORACLE["find_peaks_distance"] = EV + ", sp AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id AS t, value AS s, 5 AS apart FROM ev)" + peaks_sql("sp", "-1e18", "apart", "pk") + " SELECT pk.rec AS user_id, pk.t AS event_id, round(sp.s, 6) AS height FROM pk JOIN sp ON sp.rec = pk.rec AND sp.i = pk.i"
ORACLE["welch_entropy"] = EV + ", en AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM ev)" + welch_sql("en", "we") + " SELECT rec AS user_id, round(entropy, 6) AS spectral_entropy FROM we"
