"""Which file is which recording: activities from paths, folders of dates, trials of laboratory visits.

All of it works on a table of paths (see `listed`), so that a listing of any size is one plan; aliases and prefixes are
constants of the plan. Names that Spark gives as %XX are read as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.series import ordered
from stridelake.sources.recordings import decoded

# The names under which home activities are found, best first, and the prefixes of laboratory trials.
ALIASES = {
    "walk": ["walk", "10_mw", "10mw", "1m", "1 meter"],
    "left_turn": ["left_turn", "left turn", "turnl", "turn l", "l_360", "360 left", "left"],
    "right_turn": ["right_turn", "right turn", "turnr", "turn r", "r_360", "360 right", "right"],
    "sit_to_stand": ["sit_to_stand", "sit to stand", "sit_stand", "sittostand", "sitstand"],
    "stand_to_sit": ["stand_to_sit", "stand to sit", "stand_sit", "standtosit", "standsit"],
}
PREFIXES = {"walk": ["NW"], "left_turn": ["TurnL"], "right_turn": ["TurnR"], "sit_to_stand": ["STS"]}


def listed(spark: SparkSession, folder: str, names: str = "*.csv") -> DataFrame:
    """path of each file below a folder, as it is named; files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    return files.select(decoded(F.col("path")).alias("path"))


def plain(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words_of(path: Column) -> Column:
    """What aliases are looked for in: the stem, the folder and the whole path of a file."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return plain(F.concat_ws(" ", stem, F.try_element_at(parts, F.lit(-2)), path))


def matches(words: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """An array of (activity, rank, size): of each activity the best-ranked alias that the words hold, and its length."""
    found = []
    for activity, names in aliases.items():
        ranked = F.array(*[F.struct(plain(F.lit(n)).alias("alias"), F.lit(i).alias("rank")) for i, n in enumerate(names)])
        first = F.slice(F.filter(ranked, lambda a: (a["alias"] != "") & F.contains(words, a["alias"])), 1, 1)
        found.append(F.transform(first, lambda a: F.struct(F.lit(activity).alias("activity"), a["rank"].alias("rank"), F.length(a["alias"]).alias("size"))))  # noqa: B023
    return F.flatten(F.array(*found))


def inferred(files: DataFrame, path: str = "path", out: str = "activity", aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """files with the activity whose alias in the path is the longest, then of the lower rank, then last by name; null
    without one."""
    d = files.withColumn("_words", words_of(F.col(path)))
    scored = F.transform(matches(F.col("_words"), aliases), lambda m: F.struct(m["size"].alias("size"), (-m["rank"]).alias("rank"), m["activity"].alias("activity")))
    return d.withColumn(out, F.array_max(scored)["activity"]).drop("_words")


def discovered(files: DataFrame, by: list[str], aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """by, activity, path: for each activity of a folder (`by`) the file of the best alias, then a synchronised name, then
    the fewest folders, the shortest name and the first name and path. A file may stand for several activities."""
    name = F.element_at(F.split("path", "/"), -1)
    d = files.select(*by, "path", words_of(F.col("path")).alias("_words"))
    # inline_outer, as a filter for files without a match would look for all aliases once more.
    d = d.select(*by, "path", F.inline_outer(matches(F.col("_words"), aliases))).where("activity is not null")
    order = F.struct("rank", (~F.lower(name).contains("synchronized")).alias("apart"), F.size(F.split("path", "/")).alias("depth"), F.length(name).alias("length"), F.lower(name).alias("name"), "path")
    return d.groupBy(*by, "activity").agg(F.min(order).alias("b")).select(*by, "activity", F.col("b.path").alias("path"))


def date_folders(files: DataFrame, wanted: DataFrame, patient: str = "patient") -> DataFrame:
    """patient, date, folder for each row (patient, date) of `wanted`: the folder of that name with the fewest folders
    above it; without a date the last of those right below the patient's. Null where there is none.

    files: patient, and `below`, the file's path below the patient's folder."""
    parts = F.split("below", "/")
    d = files.select(patient, parts.alias("_p")).where(F.size("_p") > 1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)))
    d = d.select(patient, F.array_join(F.slice("_p", F.lit(1), F.col("_k")), "/").alias("_folder"), F.element_at("_p", F.col("_k")).alias("_name"), "_k").distinct()
    named = d.groupBy(patient, F.col("_name").alias("_date")).agg(F.min(F.struct("_k", "_folder")).alias("_f")).select(patient, "_date", F.col("_f._folder").alias("_named"))
    last = d.where("_k = 1").groupBy(patient).agg(F.max("_name").alias("_last"))
    w = wanted.select(patient, F.col("date").alias("_date")).distinct()
    out = w.join(named, [patient, "_date"], "left").join(last, patient, "left")
    return out.select(patient, F.col("_date").alias("date"), F.when(F.col("_date").isNull(), F.col("_last")).otherwise(F.col("_named")).alias("folder"))


def integer_in(name: Column, last: bool = False) -> Column:
    """The first (or last) run of digits in a name; without one 9999 (or -1)."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(runs, F.lit(-1 if last else 1)).try_cast("long"), F.lit(-1 if last else 9999).cast("long"))


def lab_folders(files: DataFrame, prefixes: dict[str, list[str]] = PREFIXES, named: bool = True) -> DataFrame:
    """subject, visit, activity, folder of the trials in .../<subject>/<visit>/<folder>/.../<file>, by the prefix of the
    folder in any case. With `named`, subjects begin with SRS and visits with visit (in any case). `below`: path below the root."""
    parts = F.split("below", "/")
    d = files.where(F.size(parts) > 3).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("subject", "visit", "folder"))])
    d = d.where(F.col("subject").startswith("SRS") & F.lower("visit").startswith("visit")) if named else d
    kinds = [F.when(F.exists(F.array(*map(F.lit, names)), lambda p: F.lower(F.col("folder")).startswith(F.lower(p))), F.lit(a)) for a, names in prefixes.items()]
    return d.withColumn("activity", F.coalesce(*kinds)).where("activity is not null").select("subject", "visit", "activity", "folder").distinct()


def lab_trials(folders: DataFrame) -> DataFrame:
    """folders with visit_id, number and ordinal: a visit's trials of an activity in the order of the first integer in
    their name, then of the name."""
    d = folders.withColumn("number", integer_in(F.col("folder")))
    digits = F.regexp_replace("visit", "[^0-9]", "")
    visit = F.when(digits != "", F.format_string("V%02d", digits.try_cast("long"))).otherwise(F.col("visit"))
    return d.withColumn("visit_id", visit).withColumn("ordinal", F.row_number().over(ordered(["subject", "visit", "activity"], ["number", F.lower("folder"), "folder"])))


def lab_choice(folders: DataFrame, first: tuple[str, ...] = ("sit_to_stand",)) -> DataFrame:
    """One trial of each visit and activity: the last by the last integer in its name (-1 without one), but for the
    activities in `first` the first."""
    d = folders.withColumn("number", integer_in(F.col("folder"), last=True))
    low, high = F.min(F.struct("number", "folder")), F.max(F.struct("number", "folder"))
    d = d.groupBy("subject", "visit", "activity").agg(low.alias("low"), high.alias("high"))
    pick = F.when(F.col("activity").isin(*first), F.col("low")).otherwise(F.col("high"))
    return d.select("subject", "visit", "activity", pick["folder"].alias("folder"), pick["number"].alias("number"))
