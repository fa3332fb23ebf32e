"""Operator 1: language-model scores by deleted interpolation.

The model mixes maximum-likelihood n-gram estimates of every order up to `order` and a uniform one. The mixture weights
depend on how often the two longest contexts were seen (buckets by powers of two) and are learned by expectation
maximisation on held-out counts: one fold of the training documents is deleted from the counts, and the weights maximise
its likelihood; the final counts are those of all training documents.

Documents are laid out once as chunks (rows of the shared folder). Each chunk sends its distinct n-grams, hashed to 56
bits, with its own counts to shards of the hash space; a shard sums them and answers each chunk with the totals in the
order in which they were asked, so hot n-grams cost a row per chunk and no n-gram goes back. Chunks then score their
documents from the answers. EM runs as aggregates over the held-out fold's counts.

Defined cases: null text is empty and scores its end token; very long texts are read whole (a text longer than a chunk is
a chunk of its own); doc_id null counts as training; rows that are repeated count and are scored each; without training
tokens every score is that of the uniform model (base 0.1 / 0.1); an empty table gives no rows; other columns of docs are
not read and clash with nothing. N-grams are told apart by 55 bits of a hash: of 1e8 distinct ones about 0.1 pairs are
taken for one, of 1e12 one in 36,000.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import U64, id_text, mix, pack, segments, slices, text_bytes, unpack, utf8, word_hashes, written

END, BEGIN = U64(0x51ED270B7F4A7C15), U64(0xB5297A4D3F84D5B5)
LEVELS = 24
WIDTH = 7  # bytes of a hashed n-gram
OWN, TOTAL = 4, 6  # bytes of a count in one chunk (less than 2 GB of text) and in all (2.8e14); zero bytes compress away
PART_BYTES = 8 << 20  # text for each partition of an exchange


def chunks(docs: DataFrame, folds: int = 10, chunk_bytes: int = 3 << 20) -> DataFrame:
    """Rows of chunk, deleted (its documents are the fold that EM learns from), doc ids, held-out flags and texts."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(2))
    source = id_text(docs).withColumn("fold", fold)

    def run(batches):
        from pyspark import TaskContext

        task, turn = TaskContext.get().partitionId(), 0
        held = {False: [], True: []}
        size = {False: 0, True: 0}

        def out(deleted):
            nonlocal turn
            rows = pa.Table.from_batches(held[deleted]).combine_chunks()
            data, offs = utf8(rows.column("text"))
            held[deleted], size[deleted] = [], 0
            turn += 1
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("doc_id").combine_chunks())
            flags = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.array(np.asarray(rows.column("fold")) == 0))
            ends = pa.ListArray.from_arrays(pa.array([0, len(offs)], pa.int32()), pa.array(offs))
            blob = pa.Codec("zstd", compression_level=6).compress(data.tobytes(), asbytes=True)
            return pa.record_batch([pa.array([(task << 32) + turn]), pa.array([deleted]), ids, flags, ends, pa.array([blob], pa.binary())], names=["chunk", "deleted", "ids", "held", "offs", "blob"])

        for b in batches:
            b = b.set_column(1, "text", b.column("text").cast(pa.large_string()))
            offs = utf8(b.column("text"))[1]
            for i, j in slices(offs, chunk_bytes // 4):
                part = b.slice(i, j - i)
                em = np.asarray(part.column("fold")) == 1
                for deleted in (False, True):
                    rows = part.filter(pa.array(em == deleted))
                    if len(rows):
                        held[deleted].append(rows)
                        size[deleted] += int(np.diff(offs[i : j + 1])[em == deleted].sum())
                        if size[deleted] >= chunk_bytes:
                            yield out(deleted)
        for deleted in (False, True):
            if held[deleted]:
                yield out(deleted)

    return written(source.mapInArrow(run, "chunk long, deleted boolean, ids array<long>, held array<boolean>, offs array<long>, blob binary"), "chunks")


@dataclass
class Grams:
    """N-grams of a chunk: for each predicted token and order m the number of its m-gram in the sorted distinct keys."""

    keys: np.ndarray
    at: list[np.ndarray]  # by order - 1: key number of each token's n-gram
    context: list[np.ndarray]  # by order - 1: key number of each token's context; -1: nothing but beginnings
    doc: np.ndarray


def grams(row: dict, order: int) -> Grams:
    """A chunk's n-grams; each document is order - 1 beginnings, its words and one end."""
    offs = np.asarray(row["offs"])
    data = np.frombuffer(pa.decompress(row["blob"], int(offs[-1]), codec="zstd"), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
    hs, ws = [], []
    for i, j in slices(offs, 2 << 20):
        h, w = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        hs.append(h)
        ws.append(w)
    h, words = np.concatenate(hs), np.concatenate(ws)
    pad = order - 1
    doc = segments(words + 1)
    first = np.cumsum(words + 1) - (words + 1)
    token = np.empty(len(doc), U64)
    last = first + words
    inner = np.ones(len(doc), bool)
    inner[last] = False
    token[inner], token[last] = h, END
    since = np.arange(len(doc)) - first[doc]  # words before in the document
    back = [token]
    for k in range(1, pad + 1):
        prior = np.full(len(doc), BEGIN)
        prior[k:] = token[:-k]
        prior[since < k] = BEGIN
        back.append(prior)
    low = U64(8)
    parts = []
    for m in range(1, order + 1):
        key = back[m - 1]
        for k in range(m - 2, -1, -1):
            key = mix(key * U64(0xD6E8FEB86659FD93) + back[k] + U64(m))
        parts.append((mix(key) >> low) & ~U64(1) | U64(m == 1))
    n = len(token)
    del back, data, h
    parts = np.concatenate(parts)
    keys, number = np.unique(parts, return_inverse=True)
    del parts
    number = number.astype(np.int32)
    at = [number[m * n : (m + 1) * n] for m in range(order)]
    context = [np.zeros(0, np.int64)]
    for m in range(1, order):  # the context of an (m + 1)-gram is the m-gram before
        c = np.full(n, -1)
        c[1:] = at[m - 1][:-1]
        c[since == 0] = -1
        context.append(c)
    return Grams(keys, at, context, doc)


def asked(row: dict, order: int, shards: int):
    """Rows for the shards: this chunk's keys and how often its training documents hold each."""
    g = grams(row, order)
    train = ~np.asarray(row["held"], bool)[g.doc]
    count = sum(np.bincount(a[train], minlength=len(g.keys)) for a in g.at)
    cut = np.searchsorted(g.keys, ((np.arange(1, shards, dtype=object) << 56) // shards).astype(U64))
    for s, (i, j) in enumerate(zip([0, *cut], [*cut, len(g.keys)])):
        if j > i:
            yield s, int(j - i), pack(g.keys[i:j], WIDTH), pack(count[i:j].astype(U64), OWN)


class Counts:
    """What a chunk's n-grams count in the whole: n-gram and context counts by order."""

    def __init__(self, row: dict, order: int, answers: list[tuple], column: int, documents: int):
        self.g = grams(row, order)
        flat = np.concatenate([unpack(a[2 + column], a[1], TOTAL) for a in sorted(answers, key=lambda a: a[0])]).astype(np.int64)
        if len(flat) != len(self.g.keys):
            raise RuntimeError("answers do not match the chunk")
        self.c = [flat[a] for a in self.g.at]
        self.ctx = [None] + [np.where(x >= 0, flat[x], documents) for x in self.g.context[1:]]

    def features(self, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each token, and probabilities by order (uniform first); those whose context is new are 0."""
        n = len(self.c[0])
        p = np.zeros((n, len(self.c) + 1))
        p[:, 0] = 1 / (kinds + 1)
        p[:, 1] = self.c[0] / max(tokens, 1)
        level = [np.zeros(n, np.int64)]
        for m in range(1, len(self.c)):
            p[:, m + 1] = self.c[m] / np.maximum(self.ctx[m], 1)
            level.append(np.minimum(LEVELS - 1, np.frexp(self.ctx[m].astype(float))[1]))
        return level[-1] * LEVELS + (level[-2] if len(level) > 1 else 0), p


def usable(bucket: np.ndarray, order: int) -> np.ndarray:
    """Which estimates a bucket's contexts allow (uniform and unigram always)."""
    ok = np.ones((len(bucket), order + 1), bool)
    if order >= 2:
        ok[:, order] = bucket // LEVELS > 0
    if order >= 3:
        ok[:, order - 1] = bucket % LEVELS > 0
    return ok


def learn(held: DataFrame, order: int, rounds: int = 12) -> np.ndarray:
    """Weights by bucket from rows (bucket, p0.., n): each round is one aggregate with a row per bucket."""
    spark, names = held.sparkSession, [f"p{k}" for k in range(order + 1)]
    every = np.arange(LEVELS * LEVELS)
    ok = usable(every, order)
    weights = ok / ok.sum(1, keepdims=True)
    for _ in range(rounds):
        rows = [(int(b), *map(float, w)) for b, w in enumerate(weights)]
        w = spark.createDataFrame(rows, "bucket int, " + ", ".join(f"w{k} double" for k in range(order + 1)))
        mixed = sum((F.col(f"w{k}") * F.col(p) for k, p in enumerate(names)), F.lit(0.0))
        step = held.join(F.broadcast(w), "bucket").withColumn("z", F.col("n") / mixed)
        got = step.groupBy("bucket").agg(*[F.sum(F.col("z") * F.col(f"w{k}") * F.col(p)).alias(p) for k, p in enumerate(names)]).collect()
        total = np.zeros_like(weights)
        for r in got:  # LEVELS * LEVELS rows at most
            total[r["bucket"]] = [r[p] for p in names]
        overall = (total.sum(0) + 1e-3) / (total.sum() + 1e-3 * (order + 1))
        smooth = (total + overall) * ok  # a bucket without held-out counts takes the overall weights
        weights = smooth / smooth.sum(1, keepdims=True)
    return weights


def score(docs: DataFrame, order: int = 3, folds: int = 10, shard_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    size = text_bytes(docs.select("text"))
    # Shards and partitions follow the bytes, so that the largest task stays as it is when the input grows.
    shards, parts = max(64, size // shard_bytes), max(8, size // PART_BYTES)
    laid = chunks(docs, folds)

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                out = list(zip(*asked(row, order, shards)))
                n = len(out[0]) if out else 0
                cols = out or [[]] * 4
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array([row["chunk"]] * n, pa.int64()), pa.array([row["deleted"]] * n, pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["shard", "chunk", "deleted", "n", "keys", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        n, deleted = group.column("n").to_pylist(), group.column("deleted").to_pylist()
        keys = np.concatenate([unpack(k.as_py(), m, WIDTH) for k, m in zip(group.column("keys"), n)])
        mine = np.concatenate([unpack(k.as_py(), m, OWN) for k, m in zip(group.column("counts"), n)]).astype(np.float64)
        keys, number = np.unique(keys, return_inverse=True)
        kept = np.bincount(number, mine * np.repeat(~np.array(deleted), n), minlength=len(keys))
        total = np.bincount(number, mine, minlength=len(keys))
        word = (keys & U64(1)) == 1
        at, rows = 0, []
        for d, m in zip(deleted, n):
            of = number[at : at + m]
            rows.append((pack(total[of].astype(U64), TOTAL), pack(kept[of].astype(U64), TOTAL) if d else b""))
            at += m
        sums = [int((word & (total > 0)).sum()), int(total[word].sum()), int(kept[word].sum())]
        return pa.table({
            "chunk": group.column("chunk"), "deleted": group.column("deleted"), "shard": group.column("shard"), "n": group.column("n"),
            "total": pa.array([r[0] for r in rows], pa.binary()), "kept": pa.array([r[1] for r in rows], pa.binary()),
            **{k: pa.array([s] + [0] * (len(n) - 1), pa.int64()) for k, s in zip(("kinds", "tokens", "kept_tokens"), sums)},
        })

    wanted = laid.mapInArrow(ask, "shard int, chunk long, deleted boolean, n long, keys binary, counts binary")
    answers = written(wanted.repartition(parts, "shard").groupBy("shard").applyInArrow(answer, "chunk long, deleted boolean, shard int, n long, total binary, kept binary, kinds long, tokens long, kept_tokens long"), "answers")
    kinds, tokens, kept_tokens = (int(x or 0) for x in answers.agg(F.sum("kinds"), F.sum("tokens"), F.sum("kept_tokens")).first())
    flags = laid.select("deleted", F.explode("held").alias("held")).where("not held").groupBy("deleted").count().collect()
    documents = {r["deleted"]: r["count"] for r in flags}
    trained, kept_docs = sum(documents.values()), documents.get(False, 0)

    def together(chunk: pa.Table, got: pa.Table, column: int, n_docs: int):
        row = chunk.slice(0, 1).to_pylist()[0]
        lists = zip(*(got.column(c).to_pylist() for c in ("shard", "n", "total", "kept")))
        return row, Counts(row, order, list(lists), column, n_docs)

    def held_counts(chunk: pa.Table, got: pa.Table) -> pa.Table:
        _, c = together(chunk, got, 1, kept_docs)
        bucket, p = c.features(kept_tokens, kinds)
        rows = np.column_stack([bucket, p])
        order_ = np.lexsort(rows.T)
        rows = rows[order_]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1))
        n = np.diff(np.append(np.flatnonzero(new), len(rows)))
        rows = rows[new]
        return pa.table({"bucket": rows[:, 0].astype(np.int32), **{f"p{k}": rows[:, k + 1] for k in range(order + 1)}, "n": n})

    def cogroup(where: str):
        got = answers.where(where).select("chunk", "shard", "n", "total", "kept")
        return laid.where(where).repartition(parts, "chunk").groupBy("chunk").cogroup(got.repartition(parts, "chunk").groupBy("chunk"))

    kind = "bucket int, " + ", ".join(f"p{k} double" for k in range(order + 1)) + ", n long"
    weights = learn(written(cogroup("deleted").applyInArrow(held_counts, kind), "held"), order)

    def scored(chunk: pa.Table, got: pa.Table) -> pa.Table:
        row, c = together(chunk, got, 0, trained)
        bucket, p = c.features(tokens, kinds)
        n = len(row["ids"])
        doc = c.g.doc
        log = np.log10((weights[bucket] * p).sum(1))
        base = np.log10((c.c[0] + 0.1) / (tokens + 0.1 * (kinds + 1)))
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc, c.c[0] > 0, minlength=n).astype(np.int64),
            "train_tokens": np.full(n, tokens), "base_score": np.bincount(doc, base, minlength=n), "score": np.bincount(doc, log, minlength=n),
        })

    return cogroup("true").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
