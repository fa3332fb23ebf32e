"""Queries of file discovery, over paths made from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.plans.catalog import query, table
from stridelake.sources import discovery

FOLDERS = ["", "raw/", "deep/10_MW/", "Left Turn 1/", "x_synchronized/STS/", "turnr/old/", "1 meter/"]
STEMS = ["walk", "360 left", "TurnR_synchronized", "sit-stand", "standtosit 2", "notes", "a_left", "10mw.v2", "L_360", "right"]
PATHS = f"""WITH raw AS (SELECT l_suppkey % 40 AS s, l_shipdate::DATE::VARCHAR AS dt, ({FOLDERS!r})[1 + (l_partkey % 7)::INT] AS f, ({STEMS!r})[1 + ((l_orderkey + l_linenumber) % 10)::INT] AS n, l_quantity::INT AS q FROM lineitem),
pth AS (SELECT DISTINCT 'SRS' || s AS patient, dt, f || n || '_' || q || '.csv' AS below, 'home/SRS' || s || '/' || dt || '/' || f || n || '_' || q || '.csv' AS path FROM raw)"""
ALIAS = ", al AS (SELECT activity, rank - 1 AS rank, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS alias FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS activity, unnest({n!r}) AS name, unnest(range(1, {len(n) + 1})) AS rank" for a, n in discovery.ALIASES.items()
) + """)),
pr AS (SELECT *, string_split(path, '/') AS p, trim(regexp_replace(lower(regexp_replace(p[-1], '\\.[^.]*$', '') || ' ' || p[-2] || ' ' || path), '[^a-z0-9]+', ' ', 'g')) AS probe FROM pth),
mt AS (SELECT patient, dt, path, p, activity, min(rank) AS rank, arg_min(length(alias), rank) AS size FROM pr JOIN al ON contains(probe, alias) GROUP BY ALL)"""


def paths(spark, d):
    """patient, dt, below and path of files."""
    x = table(spark, d, "lineitem")
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    file = F.concat(of(FOLDERS, F.col("l_partkey") % 7), of(STEMS, (F.col("l_orderkey") + F.col("l_linenumber")) % 10), F.lit("_"), F.col("l_quantity").cast("int").cast("string"), F.lit(".csv"))
    x = x.select(F.concat(F.lit("SRS"), F.col("l_suppkey") % 40).alias("patient"), F.col("l_shipdate").cast("date").cast("string").alias("dt"), file.alias("below"))
    return x.withColumn("path", F.concat_ws("/", F.lit("home"), "patient", "dt", "below")).distinct()


@query(PATHS + ALIAS + " SELECT patient, dt, activity, arg_min(path, (rank, (NOT contains(lower(p[-1]), 'synchronized'))::INT, len(p), length(p[-1]), lower(p[-1]), path)) AS path FROM mt GROUP BY ALL")
def activity_files(spark, d):
    return discovery.discovered(paths(spark, d), ["patient", "dt"])


@query(PATHS + ALIAS + " SELECT pth.path, m.activity FROM pth LEFT JOIN (SELECT path, arg_max(activity, (size, -rank, activity)) AS activity FROM mt GROUP BY path) m ON pth.path = m.path")
def activity_of_path(spark, d):
    return discovery.inferred(paths(spark, d).select("path"))


@query(PATHS + """, bl AS (SELECT patient, CASE WHEN length(below) % 3 = 0 THEN 'deep/' ELSE '' END || dt || '/' || below AS below FROM pth), sp AS (SELECT patient, string_split(below, '/') AS p FROM bl), fo AS (SELECT DISTINCT patient, array_to_string(p[1:k], '/') AS folder, p[k] AS name, k FROM (SELECT *, unnest(range(1, len(p))) AS k FROM sp)),
wn AS (SELECT DISTINCT patient, CASE WHEN patient LIKE '%7' THEN NULL ELSE dt END AS date FROM pth WHERE dt LIKE '%1') SELECT w.patient, w.date, CASE WHEN w.date IS NULL THEN max(name) FILTER (k = 1) ELSE arg_min(fo.folder, (k, fo.folder)) FILTER (name = w.date) END AS folder FROM wn w JOIN fo ON fo.patient = w.patient GROUP BY w.patient, w.date""")
def date_folders(spark, d):
    p = paths(spark, d)
    files = p.select("patient", F.concat(F.when(F.length("below") % 3 == 0, "deep/").otherwise(""), "dt", F.lit("/"), "below").alias("below"))
    wanted = p.where("dt like '%1'").select("patient", F.when(~F.col("patient").like("%7"), F.col("dt")).alias("date"))
    return discovery.date_folders(files, wanted)


LAB = """WITH lb AS (SELECT DISTINCT CASE WHEN l_suppkey % 9 = 0 THEN 'pilot' ELSE 'SRS' || l_suppkey % 30 END AS subject, ['Visit 1', 'visit2', 'VISIT', 'extra'][1 + (l_partkey % 4)::INT] AS visit, ['NW', 'nw run ', 'TurnL', 'TURNR_b', 'STS', 'rest', 'STS2x'][1 + (l_orderkey % 7)::INT] || CASE WHEN l_quantity % 5 = 0 THEN '' ELSE l_quantity::INT::VARCHAR END || CASE WHEN l_linenumber = 3 THEN '_' || l_partkey % 4 ELSE '' END AS folder FROM lineitem),
ac AS (SELECT *, CASE WHEN lower(folder) LIKE 'nw%' THEN 'walk' WHEN lower(folder) LIKE 'turnl%' THEN 'left_turn' WHEN lower(folder) LIKE 'turnr%' THEN 'right_turn' WHEN lower(folder) LIKE 'sts%' THEN 'sit_to_stand' END AS activity FROM lb)"""


def lab(spark, d):
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    x = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    subject = F.when(F.col("l_suppkey") % 9 == 0, "pilot").otherwise(F.concat(F.lit("SRS"), F.col("l_suppkey") % 30))
    folder = F.concat(of(["NW", "nw run ", "TurnL", "TURNR_b", "STS", "rest", "STS2x"], F.col("l_orderkey") % 7), F.when(F.col("q") % 5 == 0, "").otherwise(F.col("q").cast("string")), F.when(F.col("l_linenumber") == 3, F.concat(F.lit("_"), F.col("l_partkey") % 4)).otherwise(""))
    return x.select(F.concat_ws("/", subject, of(["Visit 1", "visit2", "VISIT", "extra"], F.col("l_partkey") % 4), folder, F.lit("trunk.csv")).alias("below"))


@query(LAB + """, nm AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(folder, '([0-9]+)', 1), '') AS BIGINT), 9999) AS number, regexp_replace(visit, '[^0-9]', '', 'g') AS dg FROM ac WHERE activity IS NOT NULL AND subject LIKE 'SRS%' AND lower(visit) LIKE 'visit%')
SELECT subject, visit, activity, folder, number, CASE WHEN dg <> '' THEN printf('V%02d', dg::BIGINT) ELSE visit END AS visit_id, row_number() OVER (PARTITION BY subject, visit, activity ORDER BY number, lower(folder), folder) AS ordinal FROM nm""")
def lab_trials(spark, d):
    return discovery.lab_trials(discovery.lab_folders(lab(spark, d)))


@query(LAB + """, nm AS (SELECT *, coalesce(regexp_extract_all(folder, '[0-9]+')[-1]::BIGINT, -1) AS num, folder AS f FROM ac WHERE activity IS NOT NULL)
SELECT subject, visit, activity, CASE WHEN activity = 'sit_to_stand' THEN arg_min(f, (num, f)) ELSE arg_max(f, (num, f)) END AS folder, CASE WHEN activity = 'sit_to_stand' THEN min(num) ELSE max(num) END AS number FROM nm GROUP BY subject, visit, activity""")
def lab_choice(spark, d):
    return discovery.lab_choice(discovery.lab_folders(lab(spark, d), named=False))
