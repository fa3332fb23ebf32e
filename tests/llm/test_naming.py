"""Block naming against plain grouping by the text."""

import collections
import hashlib
import os
import re

from pyspark.sql import functions as F

from stridelake.llm import naming, shared

LONG = "ab " * 200
ROWS = [
    (3, "one two"), (1, "onetwo"), (2, "one\ttwo\n"), (4, "one twO"), (5, None), (6, ""), (7, " \n\t\v\f\r"), (8, LONG), (9, LONG + "c"), (10, LONG + " "), (8, LONG),
    (11, "abcdabcd"), (12, "abcdabcdabcd"), (13, "abcdabcdabcdabcd"), (14, "dcbaabcd"), (15, "é x"), (16, "éx"), (17, " éx"), (None, "onetwo  "), (None, "only here"), (None, None),
    (20, "xyz " * 60_000), (21, "xyz" * 60_000), (22, "xyz" * 59_999 + "xyy"),
]


def brute(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[plain(t)].append((-len(t or ""), d is None, d or 0, d))
    out = collections.Counter()
    for t, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for i, m in enumerate(members):
            out[m[3], members[0][3], len(members), i == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_naming(spark):
    docs = spark.createDataFrame([(d, t, 1, "x", "r") for d, t in ROWS], "doc_id long, text string, n int, name string, row string").repartition(3)
    short = [r for r in ROWS if (r[0] or 0) < 20]
    clash = lambda b: F.struct(F.pmod(F.xxhash64(b), F.lit(2)))  # noqa: E731  two labels for all blocks: found by their bytes
    for block, label in ((4, naming.digest), (4096, naming.digest), (16, clash)):
        rows = ROWS if block > 1000 else short
        got = naming.classes(docs if block > 1000 else docs.where("coalesce(doc_id, 0) < 20"), block=block, label=label).drop("row")
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert collections.Counter(tuple(r) for r in got.collect()) == brute(rows)
    kept = naming.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len({w[4] for w in brute(ROWS)})
    assert naming.classes(docs.where("false")).count() == naming.dedup(docs.where("false")).count() == 0


def test_naming_hot(spark):
    """Nine in ten rows are copies of one text; their blocks, pairs and class are all hot keys."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.lit("hot " * 10)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = naming.classes(docs, block=8)
    assert got.groupBy("group_size").count().orderBy("group_size").collect() == [(1, 300), (2700, 2700)]
    assert got.where("kept").count() == 301 and got.where("group_size > 1 and keep_id <> 1").count() == 0


def test_clean(spark):
    """What an operator leaves in the shared folder goes when its result has been taken."""
    docs = spark.createDataFrame([(1, "a b"), (2, "ab")], "doc_id long, text string")
    before = set(shared.WRITTEN)
    assert naming.classes(docs).where("kept").count() == 1
    left = [p.removeprefix("file://") for p in shared.WRITTEN if p not in before]
    assert left and all(os.path.isdir(p) for p in left)
    assert shared.clean(spark) >= len(left) and not any(os.path.exists(p) for p in left)
