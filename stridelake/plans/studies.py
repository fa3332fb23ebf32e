"""Queries of the study tables over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stridelake.operators import clusters, stats, tables, windows
from stridelake.plans.catalog import DAY, EV, WEEK, _weekly, events, query, r, table

KINDS = ["click", "view", "purchase"]


def wide_days(spark, d):
    """One row per user and day with the mean value of each kind of event; kinds are the tasks of a day."""
    e = events(spark, d).withColumn("day", F.expr(f"cast(us div {DAY} as int)"))
    return e.groupBy("user_id", "day").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in KINDS])


DAYS = EV + f", wd AS (SELECT user_id, (us // {DAY})::INT AS day, " + ", ".join(f"avg(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM ev GROUP BY ALL)"


@query(DAYS + """, k AS (SELECT DISTINCT user_id, task, date '1970-01-01' + day AS d, day FROM (SELECT user_id, 'walk' AS task, day FROM wd WHERE click IS NOT NULL UNION ALL SELECT user_id, 'turn', day FROM wd WHERE view IS NOT NULL OR purchase IS NOT NULL)),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, task ORDER BY day RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m FROM k), b AS (SELECT user_id, task, day AS s FROM c QUALIFY row_number() OVER (PARTITION BY user_id, task ORDER BY m DESC, day) = 1),
f AS (SELECT k.user_id, k.task, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, count(*) AS n_days, any_value(s) AS s, strftime(max(d) FILTER (day BETWEEN s AND s + 9), '%Y-%m-%d') AS last_inside, count(*) FILTER (day BETWEEN s AND s + 9) AS n_inside,
string_agg(strftime(d, '%Y-%m-%d'), ', ' ORDER BY d) FILTER (day BETWEEN s AND s + 9) AS days_inside FROM k JOIN b ON k.user_id = b.user_id AND k.task = b.task GROUP BY ALL),
e AS (SELECT DISTINCT user_id, task FROM wd, (VALUES ('walk'), ('turn')) v(task))
SELECT e.user_id, e.task, coalesce(first_day, '') AS first_day, coalesce(last_day, '') AS last_day, coalesce(n_days, 0) AS n_days, coalesce(strftime(date '1970-01-01' + s, '%Y-%m-%d'), '') AS window_start, coalesce(strftime(date '1970-01-01' + s + 9, '%Y-%m-%d'), '') AS window_end,
coalesce(last_inside, '') AS last_inside, coalesce(n_inside, 0) AS n_inside, coalesce(days_inside, '') AS days_inside FROM e LEFT JOIN f ON e.user_id = f.user_id AND e.task = f.task""")
def coverage_table(spark, d):
    rows = wide_days(spark, d).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))
    return tables.coverage(rows, "user_id", "day", {"walk": ["click"], "turn": ["view", "purchase"]}, 10)


@query(DAYS + """, c AS (SELECT *, (view + click) / 2 AS pooled_click_view, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM wd WHERE click IS NOT NULL AND view IS NOT NULL)
SELECT user_id, round(median(click), 6) AS median_click, round(avg(click), 6) AS mean_click, round(median(view), 6) AS median_view, round(avg(view), 6) AS mean_view, round(median(purchase), 6) AS median_purchase, round(avg(purchase), 6) AS mean_purchase,
round(median(pooled_click_view), 6) AS pooled_click_view, count(*) AS n_valid_days, min(day) AS first_valid_day, max(day) AS last_selected_day FROM c WHERE n >= 3 AND i <= 3 GROUP BY user_id""")
def home_participants(spark, d):
    out = tables.home_features(wide_days(spark, d), "user_id", "day", ["click", "view"], ["click"], ["view"], 3)
    return out.select("user_id", *r(*[f"{a}_{k}" for k in KINDS for a in ("median", "mean")], "pooled_click_view"), "n_valid_days", "first_valid_day", "last_selected_day")


@query("""WITH l AS (SELECT l_suppkey AS s, l_returnflag AS v, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, CASE WHEN l_linenumber > 1 THEN l_tax::DOUBLE END AS t FROM lineitem),
p AS (SELECT s, round(median(x), 6) AS turn, count(x) AS n_turn FROM (SELECT s, d AS x FROM l UNION ALL SELECT s, t FROM l) GROUP BY s)
SELECT l.s AS subject, count(DISTINCT v) AS n_visits, round(median(q), 6) AS median_quantity, round(avg(q), 6) AS mean_quantity, round(median(q), 6) AS walk, count(q) AS n_walk, any_value(turn) AS turn, any_value(n_turn) AS n_turn, median(q) IS NOT NULL AND any_value(turn) IS NOT NULL AS complete_feature_set FROM l JOIN p ON l.s = p.s GROUP BY l.s""")
def lab_participants(spark, d):
    x = table(spark, d, "lineitem")
    rows = x.select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("visit"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("left"), F.when(F.col("l_linenumber") > 1, F.col("l_tax").cast("double")).alias("right"))
    out = tables.lab_features(rows, "subject", "visit", {"walk": ["quantity"], "turn": ["left", "right"]}, ["quantity"])
    return out.select("subject", "n_visits", *r("median_quantity", "mean_quantity", "walk", "turn"), "n_walk", "n_turn", "complete_feature_set")


@query("""WITH m AS (SELECT DISTINCT 'SRS' || lpad((c_custkey % 40)::VARCHAR, 2, '0') AS subject, c_custkey % 40 AS number FROM customer WHERE c_custkey % 40 < 30), s AS (SELECT DISTINCT subject AS source, subject, 0 AS rank FROM m UNION ALL SELECT DISTINCT 'patient_' || number, subject, 1 FROM m UNION ALL SELECT 'patient_35', 'SRS05', 2),
o AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'SRS' || lpad((o_custkey % 40)::VARCHAR, 2, '0') ELSE 'patient_' || (o_custkey % 40) END AS patient_id, strftime(o_orderdate, '%Y-%m') AS date, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice::DOUBLE END AS a, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS b, o_orderkey FROM orders),
g AS (SELECT patient_id, date, max(a) AS a, max(b) AS b FROM o GROUP BY ALL)
SELECT subject AS patient_id, date, source AS source_patient_id, a, b FROM g JOIN s ON g.patient_id = s.source WHERE a IS NOT NULL OR b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject, date ORDER BY rank, source) = 1""")
def canonical_rows(spark, d):
    number = F.col("c_custkey") % 40
    pairs = table(spark, d, "customer").where(number < 30).select(tables.padded(number, "SRS").alias("subject"), number.alias("number")).distinct()
    o = table(spark, d, "orders")
    n = F.col("o_custkey") % 40
    rows = o.select(F.when(F.col("o_orderkey") % 3 == 0, tables.padded(n, "SRS")).otherwise(F.concat(F.lit("patient_"), n.cast("string"))).alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM").alias("date"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("double")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")).alias("b"))
    rows = rows.groupBy("patient_id", "date").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return tables.canonical(rows, tables.subject_map(pairs, {35: "SRS05"}), ["a", "b"])


@query(WEEK + """, m AS (SELECT event_type, user_id, home_week, avg(value) AS v FROM w GROUP BY ALL), c AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY event_type, user_id ORDER BY home_week)) AS ch FROM m) SELECT event_type, count(ch) AS n_changes, round(median(ch), 6) AS median_change FROM c GROUP BY event_type""")
def week_changes(spark, d):
    e = windows.with_weeks(events(spark, d).withColumn("day", F.expr(f"us div {DAY}")), "user_id", "day")
    m = e.groupBy("event_type", "user_id", "home_week").agg(F.avg("value").alias("v"))
    return tables.week_changes(m, "event_type", "user_id", "home_week", "v").select("event_type", "n_changes", *r("median_change"))


@query("SELECT o_custkey, " + ", ".join(f"""max(CASE WHEN o_orderstatus = '{s}' THEN p END) AS "{s}_total", max(CASE WHEN o_orderstatus = '{s}' THEN n END) AS "{s}_count" """ for s in "FOP") + " FROM (SELECT o_custkey, o_orderstatus, round(sum(o_totalprice::DOUBLE), 2) AS p, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def sensor_prefix_pivot(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"), F.count("*").alias("count"))
    return tables.wide(x, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], ["total", "count"])


@query("""SELECT o_orderkey, 'walk' AS activity, o_totalprice::DOUBLE AS duration, o_custkey::DOUBLE AS steps FROM orders UNION ALL SELECT o_orderkey, 'turn', CASE WHEN o_orderkey % 4 > 0 THEN o_custkey::DOUBLE END, NULL FROM orders WHERE o_orderkey % 4 > 0""")
def annotations_long(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("w_d"), F.col("o_custkey").alias("w_s"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("t_d"))
    return tables.long(x, ["o_orderkey"], {"walk": {"duration": "w_d", "steps": "w_s"}, "turn": {"duration": "t_d", "steps": "not_there"}})


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey)::INT AS trial_id FROM orders")
def trial_ordinals(spark, d):
    return tables.ordinal(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "trial_id")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def value_counts(spark, d):
    return tables.value_counts(table(spark, d, "part"), "p_brand")


@query("SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('X')) s(o_orderstatus) CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) p(o_orderpriority) LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority GROUP BY ALL")
def crosstab_filled(spark, d):
    return tables.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["F", "O", "X"], ["1-URGENT", "2-HIGH", "9-NONE"])


@query("SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice::DOUBLE - l_quantity::DOUBLE * 1000)), 4) AS mean_error, round(max(abs(l_extendedprice::DOUBLE - l_quantity::DOUBLE * 1000)), 4) AS max_error FROM lineitem GROUP BY l_returnflag")
def formula_errors(spark, d):
    return tables.formula_errors(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", F.col("l_quantity").cast("double") * 1000).select("l_returnflag", "n", *r("mean_error", "max_error", places=4))


@query("""WITH x AS (SELECT user_id, event_type, CASE WHEN event_id % 4 > 0 THEN value END AS a, CASE WHEN event_id % 8 = 1 THEN value END AS b FROM events)
SELECT count(*) AS n, count(*) FILTER (a IS NULL AND b IS NULL) AS n_empty, (avg((a IS NULL)::INT) > 0.2)::BIGINT + (avg((b IS NULL)::INT) > 0.2)::BIGINT AS n_sparse, (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM x GROUP BY user_id, event_type)) AS n_duplicates FROM x""")
def dataset_checks(spark, d):
    x = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 8 == 1, F.col("value")).alias("b"))
    return tables.quality_checks(x, ["user_id", "event_type"], ["a", "b"])


@query(EV + " SELECT a.user_id, a.us AS top_us, a.value AS top, b.us AS low_us, b.value AS low FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, us) = 1) a JOIN (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, us) = 1) b USING (user_id)")
def first_extremes(spark, d):
    e = events(spark, d)
    hi, lo = tables.top(e, "user_id", "value", "us").toDF("user_id", "top_us", "top"), tables.top(e, "user_id", "value", "us", smallest=True).toDF("user_id", "low_us", "low")
    return hi.join(lo, "user_id")


SPEC = [
    {"title": "steps", "activity": "click", "device": "x", "reference": "y", "slope": 0.9, "intercept": 0.5, "round": True},
    {"title": "time", "activity": "view", "device": "x", "reference": "y"},
]


@query(EV + """, e AS (SELECT user_id, event_type, event_id, value AS x, CASE WHEN event_id % 5 > 0 THEN value + event_id % 3 END AS y FROM ev),
f AS (SELECT user_id, event_type, arg_min(x, event_id) AS x, arg_min(y, event_id) FILTER (y IS NOT NULL) AS y FROM e GROUP BY ALL), p AS (SELECT event_type, user_id AS s, CASE event_type WHEN 'click' THEN round_even(greatest(0, 0.9::DOUBLE * x + 0.5::DOUBLE), 0) ELSE greatest(0, x) END AS a, y AS b FROM f WHERE event_type IN ('click', 'view') AND y IS NOT NULL),
r AS (SELECT event_type, s, a AS v, 'x' AS c FROM p UNION ALL SELECT event_type, s, b, 'y' FROM p), q AS (SELECT *, avg(v) OVER (PARTITION BY event_type) AS g, avg(v) OVER (PARTITION BY event_type, s) AS rm, avg(v) OVER (PARTITION BY event_type, c) AS cm FROM r),
t AS (SELECT event_type, count(DISTINCT s) AS n, sum((rm-g)*(rm-g)) / (count(DISTINCT s) - 1) AS msr, sum((cm-g)*(cm-g)) AS msc, (sum((v-g)*(v-g)) - sum((rm-g)*(rm-g)) - sum((cm-g)*(cm-g))) / (count(DISTINCT s) - 1) AS mse FROM q GROUP BY event_type),
i AS (SELECT event_type, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM t)
SELECT CASE event_type WHEN 'click' THEN 'steps' ELSE 'time' END AS title, count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a-b)*(a-b))), 6) AS rmse, round(avg(a - b), 6) AS bias, round(corr(a, b), 6) AS r, round(avg(a-b) - 1.96*stddev_samp(a-b), 6) AS loa_low, round(avg(a-b) + 1.96*stddev_samp(a-b), 6) AS loa_high, round(any_value(icc), 6) AS icc,
CASE WHEN any_value(icc) >= 0.75 THEN 'strong' WHEN any_value(icc) >= 0.5 THEN 'moderate' WHEN any_value(icc) >= 0.35 THEN 'fair' ELSE 'weak' END AS strength FROM p JOIN i USING (event_type) GROUP BY event_type""")
def agreement_specs(spark, d):
    e = events(spark, d).select("user_id", F.col("event_type").alias("activity"), "event_id", F.col("value").alias("x"), F.when(F.col("event_id") % 5 > 0, F.col("value") + F.col("event_id") % 3).alias("y"))
    out = tables.compared(e, e, ["user_id"], SPEC, "event_id")
    return out.select("title", "n", *r("mae", "rmse", "bias", "r", "loa_low", "loa_high", "icc"), "strength")


@query(EV + """, e AS (SELECT event_id, value AS a, greatest(0, 0.9::DOUBLE * value - 5) AS b FROM ev) SELECT event_id, round(a - b, 6) AS error, round(abs(a - b), 6) AS abs_error, round((a - b) / nullif(abs(b), 0) * 100, 6) AS percent_error FROM e""")
def error_columns(spark, d):
    e = events(spark, d).select("event_id", F.col("value").alias("a"), tables.recalibrated(F.col("value"), 0.9, -5.0).alias("b"))
    return tables.with_errors(e, "a", "b").select("event_id", *r("error", "abs_error", "percent_error"))


@query(DAYS + """, l AS (SELECT user_id, day, 'click' AS s, 0 AS k, click AS v FROM wd UNION ALL SELECT user_id, day, 'view', 1, view FROM wd UNION ALL SELECT user_id, day, 'purchase', 2, purchase FROM wd)
SELECT a.user_id, a.s AS sensor_a, b.s AS sensor_b, a.day, round(a.v, 6) AS a, round(b.v, 6) AS b FROM l a JOIN l b ON a.user_id = b.user_id AND a.day = b.day AND a.k < b.k""")
def sensor_pairs(spark, d):
    x = wide_days(spark, d).unpivot(["user_id", "day"], KINDS, "sensor", "v")
    return tables.sensor_pairs(x, "user_id", "sensor", "day", "v", KINDS).select("user_id", "sensor_a", "sensor_b", "day", *r("a", "b"))


@query("SELECT l_returnflag, count(*) AS n, round(median(l_quantity::DOUBLE), 6) AS median_l_quantity, round(avg(l_quantity::DOUBLE), 6) AS mean_l_quantity, round(median(l_tax::DOUBLE), 6) AS median_l_tax, round(avg(l_tax::DOUBLE), 6) AS mean_l_tax FROM lineitem GROUP BY l_returnflag")
def profile_summary(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double"), F.col("l_tax").cast("double"))
    return tables.cluster_profile(x, "l_returnflag", ["l_quantity", "l_tax"]).select("l_returnflag", "n", *r("median_l_quantity", "mean_l_quantity", "median_l_tax", "mean_l_tax"))


@query("SELECT c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT), 9999) DESC, c_name) <= 3")
def first_by_number(spark, d):
    number, name = tables.natural_key("c_name")
    return tables.ranked(table(spark, d, "customer"), "c_nationkey", [number.desc(), name], 3).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, NULL::DOUBLE AS missing, l_returnflag AS z FROM lineitem")
def fixed_order(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("z"), F.col("l_quantity").cast("string").alias("a"))
    kinds = dict(x.dtypes)
    return tables.fixed_columns(x, {"l_orderkey": kinds["l_orderkey"], "l_linenumber": kinds["l_linenumber"], "a": "double", "missing": "double"})


@query(WEEK + """, p AS (SELECT user_id, home_week, (value > 50)::INT AS profile, CASE WHEN home_week = 1 THEN 'Faller' WHEN home_week = 2 THEN 'Non-Faller' END AS label FROM wk), k AS (SELECT * FROM p WHERE label IS NOT NULL AND profile IS NOT NULL),
g AS (SELECT count(*) FILTER ((profile = 0) = (label = 'Faller')) AS straight, count(*) AS n FROM k) SELECT k.user_id, k.home_week, label, CASE WHEN (profile = 0) = (straight >= n - straight) THEN 'Faller' ELSE 'Non-Faller' END AS stands_for, round(100.0::DOUBLE * greatest(straight, n - straight) / n, 6) AS agreement FROM k, g""")
def label_agreement(spark, d):
    """Two profiles of weekly values, the labels that they stand for, and how many rows agree."""
    labels = ["Faller", "Non-Faller"]
    w = _weekly(spark, d).withColumn("label", tables.mapped(F.col("home_week"), dict(enumerate(labels, 1))))
    # A mean of exactly 50 comes out a little above or below by the order in which Spark adds; rounded, it is 50 in any.
    w = w.withColumn("profile", (F.round("value", 9) > 50).cast("int"))
    names, share = clusters.agreement(w, "profile", "label", labels)
    w = w.where("label is not null and profile is not null")
    return w.select("user_id", "home_week", "label", tables.mapped(F.col("profile"), names).alias("stands_for"), F.round(F.lit(share), 6).alias("agreement"))


TRANSFER = """WITH src AS (SELECT o_custkey, count(*)::DOUBLE AS n, avg(o_totalprice::DOUBLE) AS price FROM orders GROUP BY 1), lab AS (SELECT * FROM src WHERE o_custkey % 3 = 0),
sc AS (SELECT avg(n) AS mn, stddev_pop(n) AS sn, avg(price) AS mp, stddev_pop(price) AS sp, corr(n, price) AS c FROM lab), home AS (SELECT o_custkey, (n - mn) / sn AS x, (price - mp) / sp AS y, c FROM src, sc WHERE o_custkey % 3 <> 0)"""


def transferred(spark, d):
    """Customers of one group, to fit on, and the others, both standardised by the first."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("price"))
    lab = o.where("o_custkey % 3 = 0")
    scaler = clusters.Scaler.fit(lab, ["n", "price"])
    return scaler.transform(lab), scaler.transform(o.where("o_custkey % 3 <> 0")), F.array("n", "price")


@query(TRANSFER + " SELECT o_custkey, round((x + sign(c) * y) / sqrt(2), 6) AS pc1, round((x - sign(c) * y) / sqrt(2), 6) AS pc2, round((1 + abs(c)) / 2, 6) AS share FROM home")
def axes_transferred(spark, d):
    """Principal axes of one group applied to the other: of two standardised columns they are the diagonals."""
    lab, home, values = transferred(spark, d)
    axes = clusters.Axes.fit(lab, values)
    return home.select("o_custkey", *[F.round(c, 6).alias(f"pc{i + 1}") for i, c in enumerate(axes.scores(values))], F.lit(round(float(axes.share[0]), 6)).alias("share"))


@query(TRANSFER + """, ct AS (SELECT unnest([[-0.9, 0.4], [0.1, -1.2], [1.1, 0.3]]::DOUBLE[][]) AS v, unnest([0, 1, 2]) AS i) SELECT o_custkey, arg_min(i, (round((x - v[1]) ** 2 + (y - v[2]) ** 2, 12), i))::INT AS profile FROM home, ct GROUP BY o_custkey""")
def profiles_applied(spark, d):
    """Given centres applied to rows scaled by another group."""
    _, home, values = transferred(spark, d)
    return home.select("o_custkey", clusters.Profiles(np.array([[-0.9, 0.4], [0.1, -1.2], [1.1, 0.3]]), 0.0).nearest(values).alias("profile"))


@query()
def profiles_transferred(spark, d):
    """Centres fitted on one group applied to the other."""
    lab, home, values = transferred(spark, d)
    return home.select("o_custkey", clusters.Profiles.fit(lab, values).nearest(values).alias("profile"))


@query("""WITH t AS (SELECT count(*) FILTER (quality=0 AND toxic=0) AS a, count(*) FILTER (quality=0 AND toxic=1) AS b, count(*) FILTER (quality=1 AND toxic=0) AS c, count(*) FILTER (quality=1 AND toxic=1) AS d FROM labels), m AS (SELECT *, a+b AS r, a+c AS k, a+b+c+d AS n FROM t),
g AS (SELECT *, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x FROM m), p AS (SELECT *, exp(lgamma(r+1) + lgamma(n-r+1) + lgamma(k+1) + lgamma(n-k+1) - lgamma(n+1) - lgamma(x+1) - lgamma(r-x+1) - lgamma(k-x+1) - lgamma(n-r-k+x+1)) AS p FROM g)
SELECT a, b, c, d, round(least(1, sum(p) FILTER (p <= o * 1.0000001::DOUBLE)), 6) AS p FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER () AS o FROM p) GROUP BY ALL""")
def fisher_exact(spark, d):
    return stats.fisher(table(spark, d, "labels"), "quality", "toxic").select(*"abcd", *r("p"))


@query("SELECT l_returnflag, l_linestatus, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS quantity, l_orderkey, l_linenumber, l_partkey, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS tax FROM (SELECT * REPLACE (l_quantity::DOUBLE AS l_quantity, l_tax::DOUBLE AS l_tax) FROM lineitem)")
def population_scaler(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").cast("double").alias("tax"))
    scaled = clusters.Scaler.fit(x, ["quantity", "tax"]).transform(x)
    return scaled.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", *r("quantity", "tax"))


@query()
def mixture_profiles(spark, d):
    """Profiles of customers by a mixture fitted on their orders, with the labels that they stand for."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("price"))
    x = clusters.Scaler.fit(o, ["n", "price"]).transform(o)
    m = clusters.mixture(x, ["n", "price"])
    p = m.predict(x).withColumn("label", F.when(F.col("n") > 0, "many").otherwise("few"))
    names = clusters.aligned(p, "profile", "label", ["few", "many"])
    return p.select("o_custkey", "profile", *r("membership"), tables.mapped(F.col("profile"), names).alias("stands_for"))
