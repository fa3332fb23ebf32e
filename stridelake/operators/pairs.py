"""Pair joins inside one series: entropies, nearest neighbours, exponents and recurrence measures.

Their cost is quadratic in the samples, so a longer recording gives `most` samples spread evenly over all of it (900 by
default; None takes all, as the queries of the exponents do). Pairs are dealt by blocks of BLOCK samples (neighbours: of
TILE), so that a long series is spread over tasks; only the recurrence measures, which need the matrix of all pairs, take a
recording in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.series import ordered, whole

BLOCK, TILE = 1_000, 4_000


def even_sample(df: DataFrame, key: str, order, most: int = 900) -> DataFrame:
    """The samples at floor(k * (n - 1) / (most - 1)), k = 0 .. most - 1, of series longer than `most`."""
    d = df.withColumn("_r", F.row_number().over(ordered(key, order)).cast("long") - 1).withColumn("_n", F.count("*").over(whole(key)))
    k = F.expr(f"(_r * {most - 1} + _n - 2) div greatest(_n - 1, 1)")
    return d.withColumn("_k", k).where(f"_n <= {most} or (_k * (_n - 1)) div {most - 1} = _r").drop("_r", "_n", "_k")


def embedded(df: DataFrame, key: str, order, value: str, most: int | None = 900) -> DataFrame:
    """Position, population-standardised value and the next two, of each sample."""
    d = df.where(F.col(value).isNotNull())
    d = even_sample(d, key, order, most) if most else d
    d = d.withColumn("i", F.row_number().over(ordered(key, order)))
    d = d.withColumn("x", F.try_divide(F.col(value) - F.avg(value).over(whole(key)), F.stddev_pop(value).over(whole(key))))
    w = Window.partitionBy(key).orderBy("i")
    return d.select(key, "i", "x", F.lead("x", 1).over(w).alias("y"), F.lead("x", 2).over(w).alias("z"))


def paired(p: DataFrame, key: str, where) -> DataFrame:
    """Pairs (a, b) of samples of one series that meet a condition on a and b."""
    p = p.withColumn("_m", F.floor((F.col("i") - 1) / BLOCK)).withColumn("_all", F.sequence(F.lit(0).cast("long"), F.max("_m").over(whole(key))))
    a = p.select("*", F.col("_m").alias("_r"), F.explode("_all").alias("_c")).alias("a")
    b = p.select("*", F.col("_m").alias("_c"), F.explode("_all").alias("_r")).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "_r", "_c")]
    return a.join(b, same[0] & same[1] & same[2] & where)


def sample_entropy(e: DataFrame, key: str, r: float = 0.2) -> DataFrame:
    """Template pairs within r for two and three values, and -ln of their ratio."""
    j = paired(e, key, F.col("a.i") < F.col("b.i"))
    two = (F.abs(F.col("a.x") - F.col("b.x")) <= r) & (F.abs(F.col("a.y") - F.col("b.y")) <= r)
    three = two & (F.abs(F.col("a.z") - F.col("b.z")) <= r)
    out = j.groupBy(F.col(f"a.{key}").alias(key)).agg(F.count_if(two).alias("b_pairs"), F.count_if(three).alias("a_pairs"))
    return out.withColumn("sampen", F.when((F.col("a_pairs") > 0) & (F.col("b_pairs") > 0), -F.log(F.col("a_pairs") / F.col("b_pairs"))))


def nearest_of(at: np.ndarray, p: np.ndarray, at2: np.ndarray, p2: np.ndarray, theiler: int, step: int = 64) -> tuple[np.ndarray, ...]:
    """The nearest of the points p2 (a column each, at positions at2, in order) to each of p, and of p to each of p2, more
    than `theiler` positions off: places and distances (inf: none), the first of equal ones."""
    mate, far = np.zeros(len(at), np.int64), np.full(len(at), np.inf)
    mate2, far2 = np.zeros(len(at2), np.int64), np.full(len(at2), np.inf)
    for k in range(0, len(at), step):
        part = slice(k, k + step)
        d = sum(np.square(np.subtract.outer(c, c2)) for c, c2 in zip(p[:, part], p2))
        d = np.sqrt(d, out=d).round(9, out=d)
        near = slice(*np.searchsorted(at2, [at[part][0] - theiler, at[part][-1] + theiler + 1]))
        d[:, near][np.abs(np.subtract.outer(at[part], at2[near])) <= theiler] = np.inf
        mate[part] = d.argmin(1)
        far[part] = d[np.arange(len(d)), mate[part]]
        first = d.argmin(0)
        least = d[first, np.arange(len(at2))]
        mate2, far2 = np.where(least < far2, first + k, mate2), np.minimum(least, far2)
    return mate, far, mate2, far2


def nearest_neighbour(e: DataFrame, key: str, theiler: int = 10) -> DataFrame:
    """For each embedded point the nearest other one more than `theiler` samples off; points whose nearest is equal to
    them have none.

    Each two blocks of TILE points of a series meet in one group, whose distances are held for 64 points at a time, so that
    no row is made for a pair and a long series is spread over tasks; it moves a point once for each block of its series."""

    tile = TILE

    def one(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("i", "ascending")])).combine_chunks()
        at, p = t["i"].to_numpy().astype(np.int64), np.array([t[c].to_numpy() for c in "xyz"])
        lost = ~np.isfinite(p).all(0)  # a value that is not finite leaves none in its series
        p[:, lost] = 0.0
        cut = np.searchsorted((at - 1) // tile, t["_r"][0].as_py(), "right")  # of one block, or of two
        mate, far, mate2, far2 = nearest_of(at[:cut], p[:, :cut], at[cut:] if cut < len(at) else at, p[:, cut:] if cut < len(at) else p, theiler)
        if cut < len(at):
            mate, far = np.concatenate([mate + cut, mate2]), np.concatenate([far, far2])
        on = np.isfinite(far)
        return pa.table({key: t[key].filter(pa.array(on)), "i": pa.array(at[on], pa.int32()), "j": pa.array(at[mate[on]], pa.int32()), "d": pa.array(np.where(lost, np.nan, far)[on])})

    p = e.where(F.col(key).isNotNull() & F.col("z").isNotNull()).withColumn("_m", F.floor((F.col("i") - 1) / tile))
    p = p.withColumn("_top", F.max("_m").over(whole(key))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"))))
    p = p.select(key, "i", "x", "y", "z", F.least("_m", "_o").alias("_r"), F.greatest("_m", "_o").alias("_c"))
    # A number of its own, as few bytes can be much work.
    n = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), e.sparkSession.sparkContext.defaultParallelism)
    near = p.repartition(n, key, "_r", "_c").groupBy(key, "_r", "_c").applyInArrow(one, f"`{key}` {dict(p.dtypes)[key]}, i int, j int, d double")
    m = F.array_min("_near")  # one of each block
    return near.groupBy(key, "i").agg(F.collect_list(F.struct("d", "j")).alias("_near")).where(m["d"] > 0).select(key, "i", m["j"].alias("j"), m["d"].alias("d"))


def permutation_entropy(e: DataFrame, key: str) -> DataFrame:
    order = F.concat((F.col("x") <= F.col("y")).cast("int"), (F.col("y") <= F.col("z")).cast("int"), (F.col("x") <= F.col("z")).cast("int"))
    c = e.where("z is not null").groupBy(key, order.alias("pattern")).agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(whole(key)))
    return c.groupBy(key).agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(6.0))).alias("perm_entropy"))


def approximate_entropy(e: DataFrame, key: str, r: float = 0.2) -> DataFrame:
    """Mean log share of templates within r for two values less that for three; a template matches itself."""
    p = e.where("y is not null").withColumn("n", F.count("*").over(whole(key)))
    two = (F.abs(F.col("a.x") - F.col("b.x")) <= r) & (F.abs(F.col("a.y") - F.col("b.y")) <= r)
    three = two & (F.abs(F.col("a.z") - F.col("b.z")) <= r)
    c = paired(p, key, F.lit(True)).groupBy(F.col(f"a.{key}").alias(key), F.col("a.i").alias("i"), F.col("a.n").alias("n"))
    c = c.agg(F.count_if(two).alias("c2"), F.count_if(three).alias("c3"))
    phi2, phi3 = F.avg(F.log(F.col("c2") / F.col("n"))), F.avg(F.when(F.col("c3") > 0, F.log(F.col("c3") / (F.col("n") - 1))))
    return c.groupBy(key).agg((phi2 - phi3).alias("apen"))


def symbolic_entropy(df: DataFrame, key: str, order, value: str) -> DataFrame:
    """Shannon bits of pairs of neighbouring quartile bins; a value on an edge is of the upper bin."""
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).over(whole(key))
    d = df.withColumn("_q", q).withColumn("_b", sum((F.col(value) >= F.col("_q")[i]).cast("int") for i in range(3)))
    d = d.withColumn("_w", F.col("_b") * 4 + F.lead("_b").over(ordered(key, order))).where("_w is not null")
    c = d.groupBy(key, "_w").agg(F.count("*").alias("_n")).withColumn("_p", F.col("_n") / F.sum("_n").over(whole(key)))
    return c.groupBy(key).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("symbolic_entropy"))


def divergence(e: DataFrame, key: str, steps: int, theiler: int = 10) -> DataFrame:
    """For each point and its nearest neighbour the distance d0, and dk after k = 1..steps samples; positive ones only.

    Each point brings the values that follow it along, so that point and neighbour are joined once for all k."""
    n = nearest_neighbour(e, key, theiler).select(F.col(key).alias("_k"), "i", "j", F.col("d").alias("d0"))
    later = F.collect_list("x").over(ordered(key, "i").rowsBetween(1, steps + 2))
    p = e.select(F.col(key).alias("_p"), F.col("i").alias("_i"), later.alias("_x"))
    a, b = (p.select(F.col("_p").alias(f"_k{s}"), F.col("_i").alias(f"_i{s}"), F.col("_x").alias(f"_{s}")) for s in "ab")
    j = n.join(a, (F.col("_k") == F.col("_ka")) & (F.col("i") == F.col("_ia"))).join(b, (F.col("_k") == F.col("_kb")) & (F.col("j") == F.col("_ib")))
    j = j.select("_k", "i", "d0", "_a", "_b", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"))
    # Beyond the last value there is null, and so no distance.
    d = F.sqrt(sum((F.pow(F.get("_a", F.col("k") - 1 + c) - F.get("_b", F.col("k") - 1 + c), 2) for c in range(3)), F.lit(0.0)))
    return j.select(F.col("_k").alias(key), "i", "k", "d0", F.round(d, 9).alias("dk")).where("dk > 0")


def wolf(e: DataFrame, key: str, fs: float = 1.0) -> DataFrame:
    """Mean log growth of neighbour distances over one sample, a second."""
    return divergence(e, key, 1).groupBy(key).agg((F.avg(F.log(F.col("dk") / F.col("d0"))) * fs).alias("wolf"))


def rosenstein(e: DataFrame, key: str, fs: float = 1.0, steps: int = 19, points: int = 8, least: int = 25) -> DataFrame:
    """Slope of the mean log divergence over the first `points` of `steps` samples, a second; null for fewer than
    `least` embedded points or three points of the line."""
    m = divergence(e, key, steps).groupBy(key, "k").agg(F.avg(F.log("dk")).alias("m"))
    m = m.withColumn("_r", F.row_number().over(ordered(key, "k"))).where(F.col("_r") <= points)
    slope = m.groupBy(key).agg(F.count("*").alias("_c"), F.regr_slope("m", F.col("k") / fs).alias("_s"))
    size = e.where("z is not null").groupBy(key).agg(F.count("*").alias("_n"))
    return size.join(slope, key).select(key, F.when((F.col("_n") >= least) & (F.col("_c") >= 3), F.col("_s")).alias("rosenstein"))


def run_lengths(on: np.ndarray) -> np.ndarray:
    """Lengths of the runs of True down the columns."""
    flat = np.concatenate([[False], np.pad(on, ((0, 1), (0, 0))).T.reshape(-1)]).astype(np.int8)
    edge = np.flatnonzero(np.diff(flat))
    return edge[1::2] - edge[::2]


def diagonals(m: np.ndarray) -> np.ndarray:
    """The diagonals of a square matrix as columns: in rows of 2n - 1 that are read as rows of 2n, they stand upright."""
    n = len(m)
    flat = np.pad(m, ((0, 0), (0, n - 1))).reshape(-1)
    return np.pad(flat, (0, -len(flat) % (2 * n))).reshape(-1, 2 * n)


def line_measures(lengths: np.ndarray, line: int) -> tuple[float, float, float, float]:
    """Points in lines of `line` or more, mean and largest length, entropy (bits) of the lengths; NaN without a line."""
    n, count = np.unique(lengths[lengths >= line], return_counts=True)
    if not len(n):
        return (np.nan,) * 4
    share = count / count.sum()
    return float((n * count).sum()), float((n * share).sum()), float(n.max()), float(-(share * np.log2(share)).sum())


def distances(points: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(np.square(np.subtract.outer(c, c)) for c in points.T)).round(9)


def recurrence_of(d: np.ndarray, share: float, line: int) -> list[float] | None:
    """The measures of RECURRENCE from a matrix of distances; None for fewer than five points, or none apart."""
    n = len(d)
    apart = d[np.triu_indices(n, 1)]
    apart = apart[apart > 0]
    if n < 5 or not len(apart):
        return None
    on = d <= np.percentile(apart, 100 * share)
    np.fill_diagonal(on, False)
    pairs_on = float(on.sum())
    diagonal, vertical, white = (line_measures(run_lengths(m), line) for m in (diagonals(on), on, ~on))
    return [pairs_on / (n * (n - 1)), diagonal[0] / pairs_on, vertical[0] / pairs_on, *diagonal[1:], vertical[3], white[3]]


RECURRENCE = ["rec", "det", "lam", "mean_line", "max_line", "entropy_line", "entropy_vertical", "entropy_white"]


def recurrence(e: DataFrame, key: str, share: float = 0.10, line: int = 2) -> DataFrame:
    """Recurrence measures of embedded points: two points recur when not further apart than the `share` quantile of all
    positive distances. Lines are diagonal or vertical runs of `line` recurring pairs or more (white: vertical runs of
    pairs that do not recur); both triangles count, the main diagonal does not recur.

    rec, det, lam, mean_line, max_line and the entropies (bits) of line lengths: diagonal, vertical, white. A recording's
    points are a matrix in the task that holds them (6.5 MB for the 900 points of `embedded`); fewer than five points, or
    none apart, give no row."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        row = recurrence_of(distances(p.sort_values("i")[["x", "y", "z"]].to_numpy(float)), share, line)
        return pd.DataFrame({key: p[key].iloc[: int(row is not None)], **{c: [v] for c, v in zip(RECURRENCE, row or [])}}, columns=[key, *RECURRENCE])

    d = e.where("z is not null").select(key, "i", "x", "y", "z")
    out = d.groupBy(key).applyInPandas(one, f"`{key}` {dict(d.dtypes)[key]}, " + ", ".join(f"{c} double" for c in RECURRENCE))
    return out.select(key, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in RECURRENCE])


NONLINEAR = ["apen", "sampen", "symbolic_entropy", "perm_entropy", "rosenstein", "wolf", *RECURRENCE]


def bits(values: np.ndarray) -> float:
    """Shannon entropy of the values' frequencies."""
    share = np.unique(values, return_counts=True)[1] / max(len(values), 1)
    return float(-(share * np.log2(share)).sum()) if len(share) else np.nan


def template_entropies(x: np.ndarray, r: float) -> tuple[float, float]:
    """Approximate and sample entropy of a series, from its matrices of near templates."""
    near = np.abs(np.subtract.outer(x, x)) <= r
    two = near[:-1, :-1] & near[1:, 1:]
    three = two[:-1, :-1] & near[2:, 2:]
    n = len(two)
    with np.errstate(divide="ignore"):
        apen = np.log(two.sum(1) / n).mean() - (np.log(three.sum(1) / (n - 1)).mean() if n > 1 else np.nan)
    b, a = np.triu(two, 1).sum(), np.triu(three, 1).sum()
    return float(apen), float(-np.log(a / b)) if a and b else np.nan


def exponents(d: np.ndarray, theiler: int, steps: int, points: int, least: int) -> tuple[float, float]:
    """Rosenstein's and Wolf's exponents a sample, from the distances of embedded points."""
    n = len(d)
    at = np.arange(n)
    apart = np.where(np.abs(np.subtract.outer(at, at)) > theiler, d, np.inf)
    mate, start = apart.argmin(1), apart.min(1)
    on = np.isfinite(start) & (start > 0)
    line, wolf = [], np.nan
    for k in range(1, steps + 1):
        i = at[on & (at + k < n) & (mate + k < n)]
        later, first = d[i + k, mate[i] + k], start[i]
        first, later = first[later > 0], later[later > 0]
        if len(later):
            line.append((k, np.log(later).mean()))
            wolf = float(np.log(later / first).mean()) if k == 1 else wolf
    line = line[:points]
    slope = float(np.polyfit(*zip(*line), 1)[0]) if n >= least and len(line) >= 3 else np.nan
    return slope, wolf


def nonlinear(e: DataFrame, key: str, r: float = 0.2, theiler: int = 10, steps: int = 19, points: int = 8, least: int = 25, share: float = 0.10, line: int = 2) -> DataFrame:
    """key and all measures of this module (NONLINEAR; the exponents a sample) for each embedded recording, from one pass
    over the matrix of its points: what the single operators give, without a join of pairs for each of them."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        x = p["x"].to_numpy(float)
        got = dict.fromkeys(NONLINEAR, np.nan)
        if len(x) >= 3 and np.isfinite(x).all():
            got["apen"], got["sampen"] = template_entropies(x, r)
            a, b, c = x[:-2], x[1:-1], x[2:]
            got["perm_entropy"] = bits((a <= b) * 4 + (b <= c) * 2 + (a <= c)) / np.log2(6)
            quarter = (x[:, None] >= np.percentile(x, [25, 50, 75])).sum(1)
            got["symbolic_entropy"] = bits(quarter[:-1] * 4 + quarter[1:])
            d = distances(np.stack([a, b, c], 1))
            got["rosenstein"], got["wolf"] = exponents(d, theiler, steps, points, least)
            got.update(zip(RECURRENCE, recurrence_of(d, share, line) or []))
        return pd.DataFrame({key: p[key].iloc[:1], **{c: [v] for c, v in got.items()}})

    d = e.select(key, "i", "x")
    out = d.groupBy(key).applyInPandas(one, f"`{key}` {dict(d.dtypes)[key]}, " + ", ".join(f"{c} double" for c in NONLINEAR))
    return out.select(key, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in NONLINEAR])
