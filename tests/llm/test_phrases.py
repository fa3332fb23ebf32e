"""Phrase mining against plain counting."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from stridelake.llm import phrases

KIND = "doc_id long, lang string, text string, n int, words string, chunk int"


def brute(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang or "und"] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang or "und", tuple(ws[i : i + m])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(g == lang and len(q) > len(p) and b >= a and inside(q) for (g, q), b in found.items()):
            continue
        s, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def texts(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "x\x00y", "a b", "stone", "Stone", "old", "tree", "a", "a"]
    rows = []
    for i in range(150):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(1, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "a b"]), t + rng.choice(["", " old tree of the stone", "; new york city hall new york"])))
    return [*rows, rows[0], ("en", None), ("en", ""), ("en", " .,;\n"), ("fr", "a " * 3000), ("en", "one only"), (None, "old tree " * 40), ("en", "big; cold, " * 400 + "x " * 300)]


def test_phrases(spark):
    rows = texts()
    table = spark.createDataFrame([(i, g, t, 1, "w", 2) for i, (g, t) in enumerate(rows)], KIND).repartition(3)
    for size, least, top in ((500, 12, 50), (1 << 23, 12, 8), (2000, 40, 100)):
        got = sorted(tuple(r) for r in phrases.mine(table, least=least, top=top, size=size).collect())
        assert got == brute(rows, least, top) and got
    assert phrases.mine(table.where("false")).count() == 0


def test_scores_pass_64_bits(spark):
    counts = [("en", "x", 1, 10**13), ("en", "y", 1, 10**13 + 7), ("en", "x y", 2, 10**12 + 3), ("en", "x y x", 3, 10**12)]
    frequent = spark.createDataFrame(counts + [("en", "y x", 2, 10**12 + 1)], "lang string, phrase string, m int, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, words long")
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.scores(frequent, totals).collect()}
    assert got["x y"] == (10**13, 10**13 + 7, 1000 * (10**12 + 3) * 10**15 // (10**13 * (10**13 + 7)))
    assert got["x y x"][2] == min(1000 * 10**12 * 10**15 // (10**13 * (10**12 + 1)), 1000 * 10**12 * 10**15 // ((10**12 + 3) * 10**13))
    kept = phrases.outermost(phrases.scores(frequent, totals)).select("phrase").collect()
    assert {r.phrase for r in kept} == {"x y", "x y x", "y x"}
    assert {r.phrase for r in phrases.outermost(phrases.scores(frequent, totals), percent=90).collect()} == {"x y x"}


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_chunks_keep_pieces(spark, size):
    """Texts longer than a chunk are parted between pieces; counts of words do not depend on the size."""
    docs = spark.range(20).select(F.lit("en").alias("lang"), F.concat(F.expr("repeat('one two, three\nfour ', 30)"), F.col("id")).alias("text"))
    frequent, totals = phrases.frequencies(docs, least=20, size=size)
    assert {(r.phrase, r.f) for r in frequent.collect() if r.m > 1} == {("one two", 600), ("four one", 580), ("four one two", 580)}
    assert totals.first().words == 20 * 121


def test_runs_follow_the_input():
    """Each chunk packs a run for each range; both their numbers grew with the input, so the runs with its square. The
    figures are those of the longer phrases over 0.5 GB."""
    runs = [k * 176 * phrases.ranges_of(k * 325_600_000, k * 176) for k in (1, 12, 100)]
    assert runs[1] <= 3 * 12 * runs[0]
    assert [k * 325_600_000 // phrases.ranges_of(k * 325_600_000, k * 176) < 2 << 22 for k in (1, 12, 100)] == [True] * 3
    assert phrases.ranges_of(0, 0) == phrases.ranges_of(1000, 5) == 1
