"""All registered queries of the series engine over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import alignment, clusters, islands, pairs, series, signal, stats, windows
from stridelake.sources.cuts import written

DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: micros and seconds beside key, order and value."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", us.alias("us"), (us / 1e6).alias("t"))


EV = "WITH ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) / 1e6::DOUBLE AS t FROM events)"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


@query(EV + f""", w AS (SELECT user_id, (us - t0) // {DAY} AS win, max(value) - min(value) AS p2p FROM (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0 FROM ev) GROUP BY ALL),
m AS (SELECT *, median(p2p) OVER (PARTITION BY user_id) AS m FROM w), d AS (SELECT *, m + 0.25::DOUBLE * median(abs(p2p - m)) OVER (PARTITION BY user_id) AS th FROM m)
SELECT user_id, round(max(th), 6) AS threshold, min(win) FILTER (p2p >= th) AS first_win, max(win) FILTER (p2p >= th) AS last_win, count(*) FILTER (p2p >= th) AS n_active,
max(win) FILTER (p2p >= th) - min(win) FILTER (p2p >= th) + 1 AS n_span FROM d GROUP BY user_id""")
def active_window(spark, d):
    w = windows.active_window(windows.tumbling(events(spark, d), "user_id", "us", "value", DAY), "user_id")
    return w.select("user_id", *r("threshold"), "first_win", "last_win", "n_active", "n_span")


@query(EV + """, s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM ev)
SELECT user_id, count(*) AS n_samples, round(median(step) FILTER (step > 0), 6) AS dt_s, round(max(t) - min(t), 6) AS duration_s FROM s GROUP BY user_id""")
def sampling_meta(spark, d):
    return series.sampling_meta(events(spark, d), "user_id", "t").select("user_id", "n_samples", *r("dt_s", "duration_s"))


@query(EV + """, c AS (SELECT *, (us % 7000000) / 1e6::DOUBLE AS clock FROM ev), s AS (SELECT *, clock - lag(clock) OVER (PARTITION BY user_id ORDER BY us, event_id) AS step FROM c),
m AS (SELECT *, median(CASE WHEN step > 0 THEN step END) OVER (PARTITION BY user_id) AS dt FROM s)
SELECT event_id, round(clock + sum(CASE WHEN step < -1 THEN coalesce(dt, 0) - step ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id), 6) AS unwrapped FROM m""")
def clock_unwrap(spark, d):
    e = events(spark, d).withColumn("clock", (F.col("us") % 7_000_000) / 1e6)
    return series.unwrap_clock(e, "user_id", ["us", "event_id"], "clock").select("event_id", *r("unwrapped"))


@query(EV + ", h AS (SELECT user_id, us // 3600000000 AS hour, value FROM ev) SELECT user_id, hour, round(avg(value), 6) AS value FROM h GROUP BY ALL")
def dedup_mean(spark, d):
    e = events(spark, d).withColumn("hour", F.expr("us div 3600000000"))
    return series.collapse_duplicates(e, "user_id", "hour", "value").select("user_id", "hour", *r("value"))


@query(EV + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM ev),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM n)
SELECT k.event_id, round(CASE WHEN k.a IS NULL THEN y.v WHEN k.b IS NULL OR k.a = k.b THEN x.v ELSE x.v + (y.v - x.v) * (k.i - k.a) / (k.b - k.a) END, 6) AS filled
FROM k LEFT JOIN n x ON x.user_id = k.user_id AND x.i = k.a LEFT JOIN n y ON y.user_id = k.user_id AND y.i = k.b""")
def interpolate_linear(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return series.interpolate(e, "user_id", ["us", "event_id"], "v").select("event_id", *r("filled"))


@query(EV + """, g AS (SELECT event_id, value AS f, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(CASE WHEN hs IS NULL THEN (hi - f) / nullif(hd, 0) WHEN hd IS NULL THEN (f - lo) / nullif(hs, 0) ELSE (hs*hs*hi + (hd*hd - hs*hs)*f - hd*hd*lo) / nullif(hs*hd*(hs+hd), 0) END, 6) AS slope FROM g""")
def gradient(spark, d):
    return series.gradient(events(spark, d), "user_id", "t", "value").select("event_id", *r("slope"))


@query(EV + " SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS z, round(value - avg(value) OVER w, 6) AS gravity_removed, round(value - median(value) OVER w, 6) AS centred FROM ev WINDOW w AS (PARTITION BY user_id)")
def normalised(spark, d):
    e = series.zscore(events(spark, d), "user_id", "value")
    e = series.centre(series.centre(e, "user_id", "value", out="gravity_removed"), "user_id", "value", F.median)
    return e.select("event_id", *r("z", "gravity_removed", "centred"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax), 6) AS magnitude FROM lineitem")
def magnitude(spark, d):
    x = [F.col(c) * F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt(x[0] + x[1] + x[2]), 6).alias("magnitude"))


@query(EV + " SELECT event_id, 'tail' AS part FROM (SELECT *, max(t) OVER (PARTITION BY user_id) AS m FROM ev) WHERE t >= m - 432000 UNION ALL SELECT event_id, 'head' FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS m FROM ev) WHERE t <= m + 432000")
def truncated(spark, d):
    e = events(spark, d)
    return series.tail(e, "user_id", "t", 432_000).select("event_id", F.lit("tail").alias("part")).unionByName(series.head(e, "user_id", "t", 432_000).select("event_id", F.lit("head").alias("part")))


@query(EV + """, m AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM ev)
SELECT event_type, round(max(m), 6) AS median, round(median(abs(value - m)), 6) AS mad, round(sqrt(avg(value * value)), 6) AS rms, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM m GROUP BY event_type""")
def robust_spread(spark, d):
    e = events(spark, d)
    more = e.groupBy("event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    return series.mad(e, "event_type", "value").join(more, "event_type").select("event_type", *r("median", "mad", "rms", "iqr"))


@query(EV + f""" SELECT user_id, (us - t0) // {DAY} AS win, round(min(value), 6) AS low, round(max(value), 6) AS high, round((min(value) + max(value)) / 2, 6) AS mid FROM (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0 FROM ev) GROUP BY ALL""")
def envelope(spark, d):
    return windows.tumbling(events(spark, d), "user_id", "us", "value", DAY).select("user_id", "win", *r("low", "high", "mid"))


@query(EV + " SELECT event_id, round(var_samp(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 7) AS rolling_var FROM ev")
def rolling_variance(spark, d):
    return series.rolling_variance(events(spark, d), "user_id", ["us", "event_id"], "value").select("event_id", *r("rolling_var", places=7))


def _runs(spark, d):
    e = events(spark, d)
    e = e.withColumn("on", F.col("value") >= F.median("value").over(series.whole("user_id")))
    return islands.runs(e, "user_id", ["us", "event_id"], "on", "t")


RUNS = EV + """, k AS (SELECT *, value >= median(value) OVER (PARTITION BY user_id) AS "on" FROM ev),
c AS (SELECT *, CASE WHEN "on" IS DISTINCT FROM lag("on") OVER (PARTITION BY user_id ORDER BY us, event_id) THEN 1 ELSE 0 END AS nw FROM k),
n AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM c),
r AS (SELECT user_id, run, "on", count(*) AS n, min(t) AS s, max(t) AS e FROM n GROUP BY ALL),
q AS (SELECT *, "on" OR (n <= 2 AND run > min(run) OVER w AND run < max(run) OVER w) AS f FROM r WINDOW w AS (PARTITION BY user_id)),
g AS (SELECT *, sum(CASE WHEN chg THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY run) AS run2 FROM (SELECT *, f IS DISTINCT FROM lag(f) OVER (PARTITION BY user_id ORDER BY run) AS chg FROM q)),
z AS (SELECT user_id, run2, f, sum(n) AS n, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)"""


@query(RUNS + " SELECT user_id, run2::BIGINT AS run, n::BIGINT AS n, round(s, 3) AS start_time, round(e, 3) AS end_time FROM z WHERE f AND n >= 3")
def close_gaps(spark, d):
    c = islands.close_gaps(_runs(spark, d), "user_id", 2).where("on and n >= 3")
    return c.select("user_id", "run", "n", *r("start_time", "end_time", places=3))


@query(RUNS + " SELECT user_id, run2::BIGINT AS run, n::BIGINT AS n FROM z WHERE f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run2) = 1")
def largest_segment(spark, d):
    return islands.largest(islands.close_gaps(_runs(spark, d), "user_id", 2), "user_id").select("user_id", "run", "n")


@query(RUNS + """, p AS (SELECT *, e - s AS d, median(e - s) OVER (PARTITION BY user_id) * 0.6::DOUBLE AS m FROM r WHERE NOT "on" AND n >= 2)
SELECT user_id, count(*) FILTER (d >= m) AS n_pauses, round(sum(CASE WHEN d >= m THEN d ELSE 0 END), 3) AS pause_s FROM p GROUP BY user_id""")
def pause_segments(spark, d):
    return islands.pauses(_runs(spark, d), "user_id").select("user_id", "n_pauses", *r("pause_s", places=3))


@query(EV + """, c AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t), 1e18) > 21600 THEN 1 ELSE 0 END AS nw FROM ev),
n AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t) AS cluster FROM c) SELECT user_id, cluster::BIGINT AS cluster, round(avg(t), 2) AS mean_time, count(*) AS n FROM n GROUP BY ALL""")
def event_clusters(spark, d):
    return windows.clusters(events(spark, d), "user_id", "t", 21_600).select("user_id", "cluster", *r("mean_time", places=2), "n")


@query(EV + """, p AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, quantile_cont(value, 0.55) OVER (PARTITION BY user_id) AS h FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, count(*) AS n_peaks FROM p WHERE value > a AND value > b AND value >= h GROUP BY user_id""")
def local_peaks(spark, d):
    return series.local_peaks(events(spark, d), "user_id", ["us", "event_id"], "value").groupBy("user_id").agg(F.count("*").alias("n_peaks"))


@query(EV + """, g AS (SELECT *, lead(t) OVER w - t AS gap, lead(t, 10) OVER w AS e, min(t) OVER (PARTITION BY user_id) AS lo, max(t) OVER (PARTITION BY user_id) AS hi FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, stddev_pop(gap) OVER w / nullif(avg(gap) OVER w, 0) AS cv FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, round(t, 3) AS start_time, round(e, 3) AS end_time, round(cv, 6) AS cv FROM s WHERE e IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(cv, 9), round(abs((t + e) / 2 - (lo + hi) / 2), 6), t) = 1""")
def ten_event_window(spark, d):
    return windows.best_run_of_events(events(spark, d), "user_id", "t").select("user_id", *r("start_time", "end_time", places=3), *r("cv"))


@query(EV + """, l AS (SELECT DISTINCT user_id, us FROM ev), rr AS (SELECT user_id, us, max(value) AS v FROM ev WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT l.user_id, l.us, rr.us AS bt, rr.v AS bv FROM l ASOF LEFT JOIN rr ON l.user_id = rr.user_id AND l.us >= rr.us),
f AS (SELECT b.*, rr.us AS ft, rr.v AS fv FROM b ASOF LEFT JOIN rr ON b.user_id = rr.user_id AND b.us <= rr.us)
SELECT user_id, us, CASE WHEN ft IS NULL OR us - bt <= ft - us THEN CASE WHEN us - bt <= 43200000000 THEN bv END ELSE CASE WHEN ft - us <= 43200000000 THEN fv END END AS value FROM f""")
def asof_nearest_sync(spark, d):
    e = events(spark, d)
    return alignment.nearest_asof(e.select("user_id", "us").distinct(), e.where("event_type = 'click'"), "user_id", "us", "value", 43_200_000_000)


def _weekly(spark, d):
    e = events(spark, d).withColumn("day", F.expr(f"us div {DAY}"))
    w = windows.with_weeks(e, "user_id", "day").where("home_week between 1 and 3")
    return w.groupBy("user_id", "home_week").agg(F.avg("value").alias("value"))


WEEK = EV + f""", w AS (SELECT user_id, (us // {DAY} - min(us // {DAY}) OVER (PARTITION BY user_id)) // 7 + 1 AS home_week, event_type, value FROM ev),
wk AS (SELECT user_id, home_week, avg(value) AS value FROM w WHERE home_week <= 3 GROUP BY ALL)"""


@query(WEEK + " SELECT user_id, home_week, round(value, 6) AS value FROM wk")
def weekly_means(spark, d):
    return _weekly(spark, d).select("user_id", "home_week", *r("value"))


@query(WEEK + " SELECT user_id, round(max(value) FILTER (home_week = 1), 6) AS week_1, round(max(value) FILTER (home_week = 2), 6) AS week_2, round(max(value) FILTER (home_week = 3), 6) AS week_3 FROM wk GROUP BY user_id")
def pivot_weeks(spark, d):
    p = _weekly(spark, d).groupBy("user_id").pivot("home_week", [1, 2, 3]).agg(F.first("value"))
    return p.select("user_id", *[F.round(str(k), 6).alias(f"week_{k}") for k in (1, 2, 3)])


def _icc_sql(source: str, down: str) -> str:
    return source + f""", k AS (SELECT count(DISTINCT c) AS k FROM x), f AS (SELECT *, count(*) OVER (PARTITION BY s) AS n_c, avg(v) OVER (PARTITION BY s) AS rm FROM x WHERE v IS NOT NULL),
d AS (SELECT f.*, k FROM f, k WHERE n_c = k), a AS (SELECT *, avg(v) OVER (PARTITION BY c) AS cm, avg(v) OVER () AS g FROM d),
t AS (SELECT count(DISTINCT s) AS n, max(k) AS k, sum((rm-g)*(rm-g)) AS sr, sum((cm-g)*(cm-g)) AS sc, sum((v-g)*(v-g)) AS st FROM a),
m AS (SELECT n, k, sr/(n-1) AS msr, sc/(k-1) AS msc, (st-sr-sc)/((n-1)*(k-1)) AS mse FROM t)
SELECT n, k, round((msr-mse)/({down}), 6) AS icc FROM m"""


@query(_icc_sql(WEEK + ", x AS (SELECT user_id AS s, home_week AS c, value AS v FROM wk)", "msr+(k-1)*mse"))
def icc_3_1(spark, d):
    return stats.icc(_weekly(spark, d), "user_id", "home_week", "value").select("n", "k", *r("icc"))


PAIR = EV + ", x AS (SELECT user_id AS s, event_type AS c, avg(value) AS v FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL)"


def _pair(spark, d):
    return events(spark, d).where("event_type in ('click', 'view')").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))


@query(_icc_sql(PAIR, "msr+(k-1)*mse+k*(msc-mse)/n"))
def icc_2_1(spark, d):
    return stats.icc(_pair(spark, d), "user_id", "event_type", "value", "agreement").select("n", "k", *r("icc"))


@query(PAIR + """, p AS (SELECT s, max(v) FILTER (c = 'click') AS a, max(v) FILTER (c = 'view') AS b FROM x GROUP BY s), q AS (SELECT *, a - b AS e FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS bias, round(corr(a, b), 6) AS r, round(avg(e) - 1.96*stddev_samp(e), 6) AS loa_low, round(avg(e) + 1.96*stddev_samp(e), 6) AS loa_high FROM q""")
def agreement_metrics(spark, d):
    p = _pair(spark, d).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.first("value"))
    return stats.agreement(p, "click", "view").select("n", *r("mae", "rmse", "bias", "r", "loa_low", "loa_high"))


@query(EV + f""", w AS (SELECT event_type, user_id, (us // {DAY} - min(us // {DAY}) OVER (PARTITION BY user_id)) // 7 + 1 AS wk, value FROM ev), m AS (SELECT event_type, user_id, wk, avg(value) AS v FROM w GROUP BY ALL),
s AS (SELECT event_type, user_id, stddev_samp(v) / nullif(abs(avg(v)), 0) * 100 AS cv FROM m GROUP BY ALL) SELECT event_type, count(cv) AS n, round(median(cv), 6) AS cv_median, round(quantile_cont(cv, 0.75) - quantile_cont(cv, 0.25), 6) AS cv_iqr FROM s GROUP BY event_type""")
def repeatability(spark, d):
    e = windows.with_weeks(events(spark, d).withColumn("day", F.expr(f"us div {DAY}")), "user_id", "day")
    m = e.groupBy("event_type", "user_id", "home_week").agg(F.avg("value").alias("v"))
    return stats.repeatability(m, "event_type", "user_id", "home_week", "v").select("event_type", "n", *r("cv_median", "cv_iqr"))


@query(EV + f""", x AS (SELECT DISTINCT user_id, us // {DAY} AS day FROM ev), c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n_days FROM x)
SELECT user_id, day AS start_day, n_days FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n_days DESC, day) = 1""")
def best_day_window(spark, d):
    return windows.best_day_window(events(spark, d).select("user_id", F.expr(f"us div {DAY}").alias("day")).distinct(), "user_id", "day", 10)


@query(EV + f""", x AS (SELECT user_id, us // {DAY} AS day, avg(value) AS v FROM ev GROUP BY ALL), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) <= 14)
SELECT user_id, count(*) AS n_days, round(median(v), 6) AS median_value, round(avg(v), 6) AS mean_value FROM f GROUP BY user_id HAVING count(*) >= 14""")
def first_complete_days(spark, d):
    x = events(spark, d).groupBy("user_id", F.expr(f"us div {DAY}").alias("day")).agg(F.avg("value").alias("v"))
    x = x.withColumn("i", F.row_number().over(series.ordered("user_id", "day"))).where("i <= 14")
    out = x.groupBy("user_id").agg(F.count("*").alias("n_days"), F.median("v").alias("median_value"), F.avg("v").alias("mean_value")).where("n_days >= 14")
    return out.select("user_id", "n_days", *r("median_value", "mean_value"))


@query("""SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS first_filled, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first_key FROM orders GROUP BY o_custkey""")
def first_non_null(spark, d):
    ok = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", ok).alias("first_filled"), F.min(ok).alias("first_key"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def source_priority_dedup(spark, d):
    w = series.ordered("o_custkey", ["o_orderpriority", "o_orderkey"])
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.row_number().over(w).alias("i")).where("i = 1").drop("i")


@query("SELECT l_returnflag, round(median(v), 6) AS pooled_median FROM (SELECT l_returnflag, l_discount AS v FROM lineitem UNION ALL SELECT l_returnflag, l_tax FROM lineitem) GROUP BY l_returnflag")
def pooled_median(spark, d):
    x = table(spark, d, "lineitem").unpivot(["l_returnflag"], ["l_discount", "l_tax"], "feature", "v")
    return x.groupBy("l_returnflag").agg(F.round(F.median("v"), 6).alias("pooled_median"))


@query("SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT), 9999) AS natural_key, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) AS norm_name FROM customer")
def natural_sort_key(spark, d):
    digits = F.regexp_extract("c_name", "([0-9]+)", 1).try_cast("long")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(digits, F.lit(9999)).cast("long").alias("natural_key"), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]+", "_")).alias("norm_name"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_left_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""WITH t AS (SELECT count(*) FILTER (quality=0 AND toxic=0) AS a, count(*) FILTER (quality=0 AND toxic=1) AS b, count(*) FILTER (quality=1 AND toxic=0) AS c, count(*) FILTER (quality=1 AND toxic=1) AS d FROM labels),
u AS (SELECT *, (a::DOUBLE*d-b::DOUBLE*c)*(a::DOUBLE*d-b::DOUBLE*c)*(a+b+c+d)/nullif((a+b)::DOUBLE*(c+d)*(a+c)*(b+d),0) AS x FROM t) SELECT a, b, c, d, round(x, 6) AS chi2, round(sqrt(x/nullif(a+b+c+d,0)), 6) AS phi FROM u""")
def crosstab_chi2_phi(spark, d):
    return stats.two_by_two(table(spark, d, "labels"), "quality", "toxic").select(*"abcd", *r("chi2", "phi"))


@query("SELECT lang, count(*) AS n, count(*) - count(DISTINCT text) AS n_repeated, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing FROM documents GROUP BY lang")
def quality_checks(spark, d):
    missing = F.sum(F.col("text").isNull().cast("long")).alias("n_missing")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("text")).alias("n_repeated"), missing)


def _embedding(kept: str) -> str:
    return EV + f""", nb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS r0, count(*) OVER (PARTITION BY user_id) AS n0 FROM ev), ns AS (SELECT * FROM nb WHERE {kept}),
o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, (value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0) AS x FROM ns),
p AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY user_id ORDER BY i) AS z FROM o)"""


EMB = _embedding("n0 <= 900 OR ((r0 * 899 + n0 - 2) // greatest(n0 - 1, 1) * (n0 - 1)) // 899 = r0")  # 900 samples, spread evenly


@query(EMB + """, c AS (SELECT a.user_id, count(*) FILTER (abs(a.x-b.x) <= 0.2 AND abs(a.y-b.y) <= 0.2) AS b_pairs, count(*) FILTER (abs(a.x-b.x) <= 0.2 AND abs(a.y-b.y) <= 0.2 AND abs(a.z-b.z) <= 0.2) AS a_pairs FROM p a JOIN p b ON a.user_id = b.user_id AND a.i < b.i GROUP BY 1)
SELECT user_id, b_pairs, a_pairs, CASE WHEN a_pairs > 0 AND b_pairs > 0 THEN round(-ln(a_pairs / b_pairs::DOUBLE), 6) END AS sampen FROM c""")
def sample_entropy(spark, d):
    e = pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value")
    return pairs.sample_entropy(e, "user_id").select("user_id", "b_pairs", "a_pairs", *r("sampen"))


@query(_embedding("true") + """, q AS (SELECT user_id, (x <= y)::INT || '' || (y <= z)::INT || (x <= z)::INT AS pat, count(*) AS n FROM p WHERE z IS NOT NULL GROUP BY ALL), f AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM q)
SELECT user_id, round(-sum(p * log2(p)) / log2(6), 6) AS perm_entropy FROM f GROUP BY user_id""")
def permutation_entropy(spark, d):
    e = pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value", most=None)  # linear: no sample is needed
    return pairs.permutation_entropy(e, "user_id").select("user_id", *r("perm_entropy"))


@query(EMB + """, v AS (SELECT * FROM p WHERE z IS NOT NULL), j AS (SELECT a.user_id, a.i, b.i AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS d FROM v a JOIN v b ON a.user_id = b.user_id AND abs(a.i-b.i) > 10)
, n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY d, j) = 1) SELECT user_id, i, j, round(d, 6) AS d FROM n WHERE d > 0""")
def nearest_neighbour(spark, d):
    e = pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value")
    n = pairs.nearest_neighbour(e, "user_id")
    return n.select("user_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *r("d"))


@query(EV + """, c AS (SELECT user_id, us, event_id, value - avg(value) OVER (PARTITION BY user_id) AS x FROM ev), l AS (SELECT *, lag(x, 3) OVER (PARTITION BY user_id ORDER BY us, event_id) AS y FROM c) SELECT user_id, round(sum(x*y)/nullif(sum(x*x),0), 6) AS acf FROM l GROUP BY user_id""")
def autocorr_lag(spark, d):
    return series.autocorrelation(events(spark, d), "user_id", ["us", "event_id"], "value", 3).select("user_id", *r("acf"))


@query(EV + """, c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, value - avg(value) OVER (PARTITION BY user_id) AS x, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE value IS NOT NULL),
v AS (SELECT user_id, sum(x*x) AS s FROM c WHERE n >= 3 GROUP BY 1) SELECT a.user_id, b.i - a.i AS lag, round(sum(a.x*b.x) / any_value(s), 6) AS acf FROM c a JOIN c b ON a.user_id = b.user_id AND b.i >= a.i JOIN v ON v.user_id = a.user_id WHERE s > 1e-12 GROUP BY ALL""")
def autocorrelations(spark, d):
    return signal.autocorrelations(events(spark, d), "user_id", ["us", "event_id"], "value").select("user_id", "lag", *r("acf"))


PLACED = EV + ", pl AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS place, value FROM ev)"


@query(PLACED + """, m AS (SELECT a.user_id, a.event_type AS sa, b.event_type AS sb, a.place, a.value AS x, b.value AS y FROM pl a JOIN pl b ON a.user_id = b.user_id AND a.place = b.place AND a.event_type < b.event_type WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
z AS (SELECT user_id, sa, sb, place, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY user_id, sa, sb)), q AS (SELECT user_id, sa, sb, sqrt(sum(x*x) * sum(y*y)) AS s FROM z WHERE n >= 3 GROUP BY ALL),
c AS (SELECT p.user_id, p.sa, p.sb, p.place - o.place AS lag, round(sum(p.x * o.y) / any_value(s), 9) AS c FROM z p JOIN z o ON p.user_id = o.user_id AND p.sa = o.sa AND p.sb = o.sb JOIN q ON q.user_id = p.user_id AND q.sa = p.sa AND q.sb = p.sb WHERE s > 1e-9 GROUP BY ALL)
SELECT user_id, sa AS sensor_a, sb AS sensor_b, lag, round(c, 6) AS peak FROM c QUALIFY row_number() OVER (PARTITION BY user_id, sa, sb ORDER BY c DESC, lag) = 1""")
def sensor_peaks(spark, d):
    """The events of a type are a sensor's samples, in order."""
    e = events(spark, d).withColumn("place", F.row_number().over(series.ordered(["user_id", "event_type"], ["us", "event_id"])).cast("long"))
    return signal.sensor_peaks(e, "user_id", "event_type", "place", "value").select("user_id", "sensor_a", "sensor_b", "lag", *r("peak"))


@query(EV + """, s AS (SELECT user_id, us, event_type AS s, max((value, event_id)) AS v FROM ev WHERE event_type IN ('click', 'view', 'purchase') AND NOT (event_type = 'view' AND user_id % 3 = 0) GROUP BY ALL), l AS (SELECT DISTINCT user_id, us FROM s),
k AS (SELECT unnest(['click', 'view', 'purchase']) AS s), g AS (SELECT * FROM l, k),
b AS (SELECT g.user_id, g.us, g.s, x.us AS bt, x.v AS bv FROM g ASOF LEFT JOIN s x ON g.user_id = x.user_id AND g.s = x.s AND g.us >= x.us), f AS (SELECT b.*, x.us AS ft, x.v AS fv FROM b ASOF LEFT JOIN s x ON b.user_id = x.user_id AND b.s = x.s AND b.us <= x.us),
n AS (SELECT user_id, us, s, CASE WHEN ft IS NULL OR us - bt <= ft - us THEN CASE WHEN us - bt <= 43200000000 THEN bv END ELSE CASE WHEN ft - us <= 43200000000 THEN fv END END AS v FROM f)
SELECT user_id, us, round(coalesce(max(v[1]) FILTER (s = 'click'), 0), 6) AS accel_value, coalesce(max(v[2]) FILTER (s = 'click'), 0)::DOUBLE AS accel_event_id, round(coalesce(max(v[1]) FILTER (s = 'view'), 0), 6) AS useraccel_value, coalesce(max(v[2]) FILTER (s = 'view'), 0)::DOUBLE AS useraccel_event_id,
round(coalesce(max(v[1]) FILTER (s = 'purchase'), 0), 6) AS gyro_value, coalesce(max(v[2]) FILTER (s = 'purchase'), 0)::DOUBLE AS gyro_event_id FROM n GROUP BY ALL""")
def sensors_wide(spark, d):
    """Three types of events as sensors, of which every third user lacks one."""
    e = events(spark, d).where("not (event_type = 'view' and user_id % 3 = 0)")
    names = {"click": "accel", "view": "useraccel", "purchase": "gyro"}
    w = alignment.sensors_wide(e, "user_id", "us", "event_type", names, ("value", "event_id"), 43_200_000_000)
    return w.select("user_id", "us", *[F.round(f"{p}_value", 6).alias(f"{p}_value") for p in names.values()], *[f"{p}_event_id" for p in names.values()])


@query(EV + " SELECT user_id, round(regr_slope(value, t / 86400), 6) AS slope FROM ev GROUP BY user_id")
def slope(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(F.regr_slope("value", F.col("t") / 86400), 6).alias("slope"))


@query(EV + """, n AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM ev)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM n""")
def ffill_bfill(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return signal.fill(e, "user_id", ["us", "event_id"], "v").select("event_id", "filled")


@query(EV + """, m AS (SELECT user_id, event_type, round(avg(abs(value)), 9) AS strength FROM ev GROUP BY ALL)
SELECT user_id, event_type, round(strength, 6) AS strength FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, event_type) = 1""")
def dominant_channel(spark, d):
    return signal.dominant(events(spark, d), "user_id", "event_type", "value").select("user_id", "event_type", *r("strength"))


@query(EV + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
o AS (SELECT event_id, user_id, n, o, (((i + o) % (2*n)) + 2*n) % (2*n) AS m FROM n, generate_series(-12, 12) AS s(o))
SELECT o.event_id, round(sum(exp(-o*o/18.0::DOUBLE) * x.value) / sum(exp(-o*o/18.0::DOUBLE)), 6) AS smooth FROM o JOIN n x ON x.user_id = o.user_id AND x.i = CASE WHEN m < o.n THEN m ELSE 2*o.n-1-m END GROUP BY o.event_id""")
def gaussian_smooth(spark, d):
    return signal.gaussian_smooth(events(spark, d), "user_id", ["us", "event_id"], "value", 3.0).select("event_id", *r("smooth"))


@query(EV + """, u AS (SELECT user_id, t, min(value) AS v FROM ev GROUP BY ALL), l AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id, k, t0 + (t1 - t0) * k / 100 AS g FROM (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM u GROUP BY 1) CROSS JOIN generate_series(0, 100) AS s(k) WHERE t1 > t0)
SELECT g.user_id, g.k, round(CASE WHEN t2 IS NULL THEN v ELSE v + (v2 - v) * (g - t) / (t2 - t) END, 5) AS value FROM g ASOF JOIN l ON g.user_id = l.user_id AND g.g >= l.t""")
def resample_101(spark, d):
    return signal.resample(events(spark, d), "user_id", "t", "value").select("user_id", "k", *r("value", places=5))


@query(EV + """, a AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS gap, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), b AS (SELECT * FROM a),
z AS (SELECT user_id, i, count(*) OVER p AS n, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS x, (gap - avg(gap) OVER p) / nullif(stddev_pop(gap) OVER p, 0) AS y FROM b WINDOW p AS (PARTITION BY user_id)),
c AS (SELECT p.user_id, p.i - q.i AS lag, round(sum(p.x * q.y) / max(p.n), 9) AS c FROM z p JOIN z q ON p.user_id = q.user_id GROUP BY ALL)
SELECT user_id, lag, round(c, 6) AS peak FROM c WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(c) DESC, lag) = 1""")
def xcorr_peak(spark, d):
    w = series.ordered("user_id", ["us", "event_id"])
    e = events(spark, d).withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)))
    x = signal.cross_correlation(e, "user_id", ["us", "event_id"], "value", "gap")
    return x.select("user_id", F.col("lag").cast("long").alias("lag"), *r("peak"))


@query(EV + """, a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM ev), b AS (SELECT *, count(*) OVER p AS n, value - avg(value) OVER p AS c FROM a WINDOW p AS (PARTITION BY user_id)),
h AS (SELECT user_id, i, n, c * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS c FROM b WHERE n >= 8),
p AS (SELECT user_id, n, f, sum(c * cos(2 * pi() * i * f / n)) AS re, sum(c * sin(2 * pi() * i * f / n)) AS im FROM h, unnest(range(1, n // 2 + 1)) AS s(f) GROUP BY ALL)
SELECT user_id, f AS bin, round(f / n::DOUBLE, 6) AS hz FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(re*re + im*im, 6) DESC, f) = 1""")
def dft_dominant(spark, d):
    return signal.dominant_frequency(events(spark, d), "user_id", ["us", "event_id"], "value").select("user_id", "bin", *r("hz"))


@query()
def butterworth(spark, d):
    return signal.low_pass(events(spark, d), "user_id", "event_id", "value", 5.0, 25.0).select("event_id", *r("filtered"))


@query()
def find_peaks_distance(spark, d):
    return signal.peaks(events(spark, d), "user_id", "event_id", "value", distance=5).select("user_id", "event_id", *r("height"))


@query()
def welch_entropy(spark, d):
    return signal.spectral_entropy(events(spark, d), "user_id", "event_id", "value").select("user_id", *r("spectral_entropy"))


@query(EMB + """, t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM p WHERE y IS NOT NULL),
c AS (SELECT a.user_id, a.i, a.n, count(*) FILTER (abs(a.x-b.x) <= 0.2 AND abs(a.y-b.y) <= 0.2) AS c2, count(*) FILTER (abs(a.x-b.x) <= 0.2 AND abs(a.y-b.y) <= 0.2 AND abs(a.z-b.z) <= 0.2) AS c3 FROM t a JOIN t b ON a.user_id = b.user_id GROUP BY ALL)
SELECT user_id, round(avg(ln(c2 / n::DOUBLE)) - avg(ln(c3 / (n - 1)::DOUBLE)) FILTER (c3 > 0), 6) AS apen FROM c WHERE c2 > 0 GROUP BY 1""")
def approximate_entropy(spark, d):
    return pairs.approximate_entropy(pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value"), "user_id").select("user_id", *r("apen"))


@query(EV + """, q AS (SELECT *, (value >= quantile_cont(value, 0.25) OVER p)::INT + (value >= quantile_cont(value, 0.5) OVER p)::INT + (value >= quantile_cont(value, 0.75) OVER p)::INT AS b FROM ev WINDOW p AS (PARTITION BY user_id)),
w AS (SELECT user_id, b, lead(b) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b2 FROM q), c AS (SELECT user_id, b, b2, count(*) AS n FROM w WHERE b2 IS NOT NULL GROUP BY ALL),
f AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS symbolic_entropy FROM f GROUP BY 1""")
def symbolic_entropy(spark, d):
    return pairs.symbolic_entropy(events(spark, d), "user_id", ["us", "event_id"], "value").select("user_id", *r("symbolic_entropy"))


DIV = _embedding("true") + """, v AS (SELECT * FROM p WHERE z IS NOT NULL), j AS (SELECT a.user_id, a.i, b.i AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS d FROM v a JOIN v b ON a.user_id = b.user_id AND abs(a.i-b.i) > 10),
nn AS (SELECT * FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY d, j) = 1) WHERE d > 0),
dv AS (SELECT nn.user_id, nn.d AS d0, s.k, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS dk FROM nn CROSS JOIN generate_series(1, 19) AS s(k) JOIN v a ON a.user_id = nn.user_id AND a.i = nn.i + s.k JOIN v b ON b.user_id = nn.user_id AND b.i = nn.j + s.k)"""


@query(DIV + " SELECT user_id, round(avg(ln(dk / d0)), 6) AS wolf FROM dv WHERE k = 1 AND dk > 0 GROUP BY 1")
def lyapunov_wolf(spark, d):
    return pairs.wolf(written(pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value", most=None), "embedded"), "user_id").select("user_id", *r("wolf"))


@query(DIV + """, m AS (SELECT user_id, k, avg(ln(dk)) AS m FROM dv WHERE dk > 0 GROUP BY ALL), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) <= 8)
SELECT user_id, CASE WHEN max(n) >= 25 AND count(*) >= 3 THEN round(regr_slope(m, k), 6) END AS rosenstein FROM f JOIN (SELECT user_id, count(*) AS n FROM v GROUP BY 1) USING (user_id) GROUP BY 1""")
def lyapunov_rosenstein(spark, d):
    return pairs.rosenstein(written(pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value", most=None), "embedded"), "user_id").select("user_id", *r("rosenstein"))


@query(EMB + """, v AS (SELECT * FROM p WHERE z IS NOT NULL), j AS (SELECT a.user_id, a.i, b.i AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS d FROM v a JOIN v b ON a.user_id = b.user_id),
rd AS (SELECT user_id, quantile_cont(d, 0.1) AS radius FROM j WHERE i < j AND d > 0 GROUP BY 1), m AS (SELECT j.*, d <= radius AND i <> j AS on_ FROM j JOIN rd USING (user_id)),
l AS (SELECT user_id, 'd' AS kind, j - i AS l, i AS p FROM m WHERE on_ UNION ALL SELECT user_id, 'v', j, i FROM m WHERE on_ UNION ALL SELECT user_id, 'w', j, i FROM m WHERE NOT on_),
g AS (SELECT *, p - row_number() OVER (PARTITION BY user_id, kind, l ORDER BY p) AS g FROM l), n AS (SELECT user_id, kind, count(*) AS n FROM g GROUP BY user_id, kind, l, g HAVING count(*) >= 2), c AS (SELECT user_id, kind, n, count(*) AS c FROM n GROUP BY ALL),
q AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id, kind) AS q FROM c), s AS (SELECT user_id, kind, sum(n * c) AS total, sum(n * c) / sum(c) AS mean, max(n)::DOUBLE AS most, -sum(q * log2(q)) AS entropy FROM q GROUP BY ALL),
z AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 5), o2 AS (SELECT user_id, count(*) FILTER (on_) AS on_ FROM m GROUP BY 1)
SELECT z.user_id, round(o2.on_ / (z.n * (z.n - 1))::DOUBLE, 6) AS rec, round(max(total) FILTER (kind = 'd') / nullif(any_value(o2.on_), 0), 6) AS det, round(max(total) FILTER (kind = 'v') / nullif(any_value(o2.on_), 0), 6) AS lam, round(max(mean) FILTER (kind = 'd'), 6) AS mean_line, max(most) FILTER (kind = 'd') AS max_line,
round(max(entropy) FILTER (kind = 'd'), 6) AS entropy_line, round(max(entropy) FILTER (kind = 'v'), 6) AS entropy_vertical, round(max(entropy) FILTER (kind = 'w'), 6) AS entropy_white FROM z JOIN o2 USING (user_id) LEFT JOIN s USING (user_id) GROUP BY z.user_id, z.n, o2.on_""")
def recurrence(spark, d):
    e = pairs.embedded(events(spark, d), "user_id", ["us", "event_id"], "value")
    return pairs.recurrence(e, "user_id").select("user_id", *r("rec", "det", "lam", "mean_line"), "max_line", *r("entropy_line", "entropy_vertical", "entropy_white"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def label_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.n AS n_open FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def outer_assembly(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a, b = o.groupBy("k").agg(F.count("*").alias("n_orders")), o.where("o_orderstatus = 'O'").groupBy("k").agg(F.count("*").alias("n_open"))
    return a.join(b, "k", "full")


@query()
def kmeans_profiles(spark, d):
    v = clusters.standardised(clusters.vectors(table(spark, d, "embeddings"), "vec_id", "embedding"))
    return clusters.kmeans(v, "vec_id")


@query()
def pca_variance(spark, d):
    v = clusters.standardised(clusters.vectors(table(spark, d, "embeddings"), "vec_id", "embedding"))
    return clusters.explained_variance(v, 10).select("component", *r("share", "running"))
