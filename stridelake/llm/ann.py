"""Operator 3: approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by their own codebook (k-means on a sample of at most `sample` vectors, those with
the smallest hash of vec_id); the pair of centroids is the vector's cell, and every vector is in the index. Codebooks
grow with the square root of the vectors, up to what the sample can teach. A query visits pairs in order of summed
distance by a heap until the cells hold a share of the index, and ranks these by their exact distance in double
precision. The share is measured, not set: vectors of the sample are searched among the sample by brute force, and the
share is what their neighbours' cells needed (`recall` of them, with a margin). Clustered vectors need little of the
index, isotropic noise about half of it; the true neighbours in the whole index lie closer than those in the sample, so
the measured share errs on the safe side. Vectors are dealt to groups by cell (a cell of many vectors is cut by vec_id);
a query goes once to each group that holds a cell it visits, and a group reads its queries as a stream behind its
vectors, so neither the queries of a group nor a hot cell need fit a task.

Defined cases: vectors null, zero, holding null, NaN or infinity, or of another length than most of the sample, take no
part; ties go to the smaller vec_id; rows with the query's vec_id are its own; rows that repeat a vec_id are one candidate
(its nearest vector counts) and one query (all its vectors ask); fewer than k candidates are all returned; vec_id null
takes no part; an empty table gives no rows; vectors may be of any length, and other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.shared import batches_of, written

KIND = "query_id long, vec_id long, score double"
ROWS = "g long, kind int, id long, cell long, v binary, cells array<long>"  # kind 0: a vector of the index, 1: a query
NAMES = ["g", "kind", "id", "cell", "v", "cells"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def visits(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of left[i] + right[j] until they hold `enough` vectors (multi-sequence algorithm)."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out, held = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (left[a[u]] + right[b[v]], u, v))
    return out


def needed_share(x: np.ndarray, books: list[np.ndarray], half: int, k: int, recall: float, asked: int = 200) -> float:
    """Share of the sample that stands in the cells up to a neighbour's own, which `recall` of the neighbours need."""
    near = [nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])]
    cell = near[0] * len(books[1]) + near[1]
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    k, need = min(k, len(x) - 1), []
    for q in range(min(asked, len(x))) if k else ():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        far = [((b - v) ** 2).sum(1) for b, v in zip(books, (x[q, :half], x[q, half:]))]
        order = np.argsort((far[0][:, None] + far[1][None]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        need += (upto[cell[np.argpartition(d, k - 1)[:k]]] / len(x)).tolist()
    return min(1.0, 1.1 * float(np.quantile(need, recall))) if need else 1.0


def search(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = 0.95, share: float | None = None, sample: int = 8000, group_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good)
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not drawn:
        return empty
    sizes = [len(r.v) for r in drawn]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    usable = usable.where(F.size("v") == dim)
    x = np.array([r.v for r in drawn if len(r.v) == dim])
    half, total = (dim + 1) // 2, usable.count()
    codes = max(1, min(len(x) // 20, max(8, int(total**0.5 / 7))))
    books = [kmeans(x[:, :half], codes), kmeans(x[:, half:], codes)] if dim > 1 else [kmeans(x, codes), np.zeros((1, 0))]
    wide = len(books[1])
    share = needed_share(x, books, half, k, recall) if share is None else share

    def rows(b) -> np.ndarray:
        return np.asarray(b.column("v").flatten()).reshape(-1, dim)

    def cells_of(x: np.ndarray) -> np.ndarray:
        return nearest(x[:, :half], books[0]) * wide + nearest(x[:, half:], books[1])

    def found(batches):
        for b in batches:
            yield pa.record_batch([pa.array(cells_of(rows(b)))], names=["cell"])

    counts = np.zeros(len(books[0]) * wide, np.int64)
    for r in usable.mapInArrow(found, "cell long").groupBy("cell").count().collect():  # a row per cell, (sample / 20)^2 at most
        counts[r["cell"]] = r["count"]
    # Neighbouring cells fill a group; a cell of more than group_rows vectors is cut into parts of its own.
    parts = np.maximum(1, -(-counts // group_rows))
    first = np.where(parts > 1, 0, np.cumsum(np.where(parts > 1, 0, counts)) // group_rows)
    plain = int(first.max(initial=0)) + 1
    first = np.where(parts > 1, plain + np.cumsum(np.where(parts > 1, parts, 0)) - parts, first)
    enough = 1 + max(2 * k, int(share * counts.sum()))

    def place(batches):
        for b in batches:
            x, ids = rows(b), np.asarray(b.column("vec_id"))
            cell = cells_of(x)
            g = first[cell] + (ids * np.int64(0x9E3779B1) >> np.int64(7)) % parts[cell]
            yield pa.record_batch([pa.array(g), pa.array(np.zeros(len(g), np.int32)), pa.array(ids), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(len(g), pa.list_(pa.int64()))], names=NAMES)

    def visit(batches):
        for b in batches:
            x, out = rows(b), []
            d = [((p[:, None] - c) ** 2).sum(2) for p, c in ((x[:, :half], books[0]), (x[:, half:], books[1]))]
            for i, q in enumerate(b.column("vec_id").to_pylist()):
                at = np.array(visits(d[0][i], d[1][i], counts, enough), np.int64)
                blob, many = x[i].tobytes(), np.repeat(at, parts[at])
                g = first[many] + np.arange(len(many)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
                order = np.argsort(g, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                    out.append((int(g[own[0]]), 1, q, 0, blob, many[own]))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

    index = usable.mapInArrow(place, ROWS)
    queries = usable.where(F.col("vec_id") % every == 0).mapInArrow(visit, ROWS)
    groups = int(plain + parts[parts > 1].sum())

    def near(batches):
        held, group, xs, ids, cuts, order, most = [], None, None, None, None, None, 0
        for b in batches:
            of, kind = np.asarray(b.column("g")), np.asarray(b.column("kind"))
            edges = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *edges], [*edges, len(of)]) if len(of) else ():
                part = b.slice(i, j - i)
                if of[i] != group:
                    held, group, xs = [], of[i], None
                if kind[i] == 0:
                    held.append(part)
                    continue
                if xs is None:
                    t = pa.Table.from_batches(held) if held else None
                    if t:  # equal rows are one
                        once = list(dict.fromkeys(zip(t.column("id").to_pylist(), t.column("v").to_pylist(), t.column("cell").to_pylist())))
                        t = pa.table(list(zip(*once)), names=["id", "v", "cell"])
                    xs = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, dim) if t else np.zeros((0, dim))
                    ids, cell = (np.asarray(t.column(c)) if t else np.zeros(0, np.int64) for c in ("id", "cell"))
                    order = np.argsort(cell, kind="stable")
                    cuts, held = cell[order], []
                    most = 4 * k if len(np.unique(ids)) == len(ids) else len(ids)  # a vec_id with several vectors: no cut
                y = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(-1, dim)
                asked, lists = np.asarray(part.column("id")), part.column("cells")
                per, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
                who, got = np.repeat(np.arange(len(per)), per), []
                for c in np.unique(flat):
                    a, qs = order[slice(*np.searchsorted(cuts, (c, c + 1)))], who[flat == c]
                    step = max(1, (1 << 21) // max(1, len(a) * dim))
                    for turn in (qs[z : z + step] for z in range(0, len(qs), step)):
                        d = np.sqrt(((y[turn][:, None] - xs[a][None]) ** 2).sum(2))
                        d[asked[turn][:, None] == ids[a][None]] = np.inf
                        top = np.argsort(d, axis=1, kind="stable")[:, :most] if len(a) > most else np.broadcast_to(np.arange(len(a)), d.shape)
                        last = np.take_along_axis(d, top, 1).max(1, initial=-1)
                        for z in np.flatnonzero((d <= last[:, None]).sum(1) > top.shape[1]):  # ties at the edge: all of them
                            tied = np.flatnonzero(d[z] <= last[z])
                            got.append((np.full(len(tied), turn[z]), ids[a][tied], d[z][tied]))
                        got.append((np.repeat(turn, top.shape[1]), ids[a][top].ravel(), np.take_along_axis(d, top, 1).ravel()))
                q, v, d = (np.concatenate(z) for z in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                fine = np.isfinite(d)
                q, v, d = q[fine], v[fine], d[fine]
                best = np.lexsort((d, v, q))  # the nearest row of a vec_id
                best = best[np.append(True, (q[best][1:] != q[best][:-1]) | (v[best][1:] != v[best][:-1]))[: len(best)]]
                best = best[np.lexsort((v[best], d[best], q[best]))]
                new = np.append(True, q[best][1:] != q[best][:-1])[: len(best)]
                within = np.arange(len(best)) - np.maximum.accumulate(np.where(new, np.arange(len(best)), 0))
                best = best[within < k]
                yield pa.record_batch([pa.array(asked[q[best]]), pa.array(v[best]), pa.array(d[best])], names=["query_id", "vec_id", "score"])

    with batches_of(spark, 2_000):
        dealt = index.unionByName(queries).repartition(max(8, groups // 2), "g").sortWithinPartitions("g", "kind")
        near_rows = written(dealt.mapInArrow(near, KIND), "nearest")
    once = near_rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows of each group at most
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
