"""Operator 9: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded (byte-class unigram and bigram shares, word
repetition and length statistics, through a learned tanh layer); a gated attention layer, tanh(Vh) * sigmoid(Uh), gives
each passage a weight; the document's score is a logistic function of the weighted passage representation. All layers
are learned together from document labels alone, by Adam with hand-written gradients.

The fit uses at most `per_class` labelled documents of each class (those with the smallest hash of doc_id: a bounded,
documented sample); scoring is a map over all documents without a shuffle.

Defined cases: null or empty text is one empty passage and is scored; very long texts are scored by all their passages; doc_id null has held_out false; documents
repeated in the table are scored each; labels other than 0 and 1 are ignored, and of several labels of one document the
smallest holds; with no usable labels, or labels of one class only, every score is the share of label 1 (0.5 when there
is none at all). Other columns of the input are not read and clash with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import id_text, return_memory, segments, slices, span_hash, prefix_hash, utf8, word_spans

PASSAGE_BYTES = 400
CLASSES = 12
FEATURES = CLASSES + CLASSES * CLASSES + 6


def _byte_classes() -> np.ndarray:
    t = np.full(256, 11, np.uint8)  # control
    t[0x21:0x7F] = 5  # other punctuation
    for k, chars in enumerate((b" ", b"\n\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")):
        t[list(chars)] = k
    t[list(b".,;:'\"")] = 6
    t[list(b"!?")] = 7
    t[list(b"<>/={}")] = 8
    t[0x80:0xC0] = 9
    t[0xC0:] = 10
    return t


BYTE_CLASS = _byte_classes()


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of all passages, and passages per document (one at least)."""
    sizes = np.diff(offs)
    per = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    base = np.cumsum(per) - per
    n = int(per.sum())
    where = np.arange(len(data)) - np.repeat(offs[:-1], sizes)
    of = np.repeat(base, sizes) + where // PASSAGE_BYTES
    kind = BYTE_CLASS[data].astype(np.int64)
    x = np.zeros((n, FEATURES), np.float32)
    length = np.bincount(of, minlength=n).astype(np.float32)
    safe = np.maximum(length, 1)[:, None]
    x[:, :CLASSES] = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / safe
    if len(data) > 1:
        same = of[1:] == of[:-1]
        pair = (of[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        x[:, CLASSES : CLASSES + CLASSES**2] = np.bincount(pair[same], minlength=n * CLASSES**2).reshape(n, -1) / safe
    start, end, _ = word_spans(data, offs)
    rest = x[:, CLASSES + CLASSES**2 :]
    if len(start):
        home = of[start]
        words = np.bincount(home, minlength=n)
        h = span_hash(prefix_hash(data), start, end)
        order = np.lexsort((h, home))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (home[order][1:] != home[order][:-1])
        distinct = np.bincount(home[order][fresh], minlength=n)
        again = np.zeros(len(start), bool)
        again[1:] = (h[1:] == h[:-1]) & (home[1:] == home[:-1])
        width = np.minimum(end - start, 60)
        some = np.maximum(words, 1)
        rest[:, 0] = distinct / some
        rest[:, 1] = np.bincount(home, again, minlength=n) / some
        rest[:, 2] = np.bincount(home, width, minlength=n) / some / 10
        rest[:, 3] = np.sqrt(np.bincount(home, width.astype(float) ** 2, minlength=n) / some) / 10
        rest[:, 4] = np.log1p(words) / 5
    rest[:, 5] = np.log1p(length) / 6
    return x, per


@dataclass
class GatedAttention:
    """Encoder W, attention V and U with vector w, and output c; prior is the share of label 1."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    p: dict | None = None

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(per), self.prior)
        logit = forward(self.p, np.clip((x - self.mean) * self.scale, -6, 6), np.cumsum(per) - per, segments(per))[0]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def forward(p: dict, x: np.ndarray, first: np.ndarray, of: np.ndarray):
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, first)[of])
    a /= np.add.reduceat(a, first)[of]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return z @ p["c"] + p["d"], h, t, g, a, z


def fit_arrays(x, per, y, dim=24, gate=12, epochs=40, batch=128, rate=4e-3, decay=1e-4, seed=7) -> GatedAttention:
    """Adam over mini-batches of whole bags; examples weigh so that both classes count alike, then the logit is shifted
    back to the classes' shares."""
    n, prior = len(y), float(y.mean()) if len(y) else 0.5
    if n == 0 or prior in (0.0, 1.0):
        return GatedAttention(prior)
    mean, scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
    x = np.clip((x - mean) * scale, -6, 6)
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": init(x.shape[1], dim), "b": np.zeros(dim, np.float32), "V": init(dim, gate), "U": init(dim, gate)}
    p |= {"w": init(gate), "c": init(dim), "d": np.zeros(1, np.float32)}
    m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior)).astype(np.float32)
    start = np.cumsum(per) - per
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            docs = order[lo : lo + batch]
            rows = np.concatenate([np.arange(start[d], start[d] + per[d]) for d in docs])
            k = per[docs]
            of, first, xb = segments(k), np.cumsum(k) - k, x[rows]
            logit, h, t, g, a, z = forward(p, xb, first, of)
            dl = (weight[docs] * (1 / (1 + np.exp(-logit)) - y[docs]) / len(docs)).astype(np.float32)
            dz = (dl[:, None] * p["c"])[of]
            da = (dz * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, first)[of])
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"W": xb.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl}
            grad["d"] = dl.sum(keepdims=True)
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for key, q in p.items():
                d = grad[key] + decay * q
                m[key] = 0.9 * m[key] + 0.1 * d
                v[key] = 0.999 * v[key] + 0.001 * d * d
                q -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    p["d"] = p["d"] + np.float32(np.log(prior / (1 - prior)))
    return GatedAttention(prior, mean, scale, p)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, folds: int = 5) -> GatedAttention:
    """Fit on labelled documents whose crc32(doc_id) mod `folds` is not 0; at most `per_class` of each class."""
    spark = docs.sparkSession
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    share = usable.agg(F.avg("y")).first()[0]
    known = id_text(docs).where("doc_id is not null").select("doc_id")
    usable = usable.join(known, "doc_id", "left_semi")
    picked = [
        usable.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for k in (0, 1)
    ]
    wanted = {r.doc_id: r.y for rows in picked for r in rows}
    if not wanted:
        return GatedAttention(0.5 if share is None else float(share))
    chosen = spark.createDataFrame([(int(k),) for k in wanted], "doc_id long")  # 2 * per_class rows at most

    def encode(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            x, per = passages(data, offs)
            cut = np.cumsum(per) - per
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([x[i : i + k].tobytes() for i, k in zip(cut, per, strict=True)], pa.binary())],
                names=["doc_id", "x"],
            )

    rows = id_text(docs).join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(encode, "doc_id long, x binary").collect()
    rows = sorted({r.doc_id: r for r in rows}.values(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([wanted[r.doc_id] for r in rows], np.float32)
    model = fit_arrays(np.concatenate(bags), np.array([len(b) for b in bags]), y) if bags else GatedAttention(0.5)
    if model.p is not None and share is not None and 0 < share < 1:  # the sample is balanced further than the labels are
        model.p["d"] = model.p["d"] + np.float32(np.log(share / (1 - share)) - np.log(model.prior / (1 - model.prior)))
    return model


def score(docs: DataFrame, model: GatedAttention, threshold: float = 0.3, folds: int = 5, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; with keep, the rows of docs predicted 1 and all columns."""

    def scores(text) -> np.ndarray:
        data, offs = utf8(text)
        out = np.zeros(len(offs) - 1)
        for a, b in slices(offs, 1 << 20):
            out[a:b] = model.score(*passages(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
        return out

    if keep:
        schema = docs.schema

        def kept(batches):
            return_memory()
            for b in batches:
                yield b.filter(pa.array(scores(b.column("text")) >= threshold))

        return docs.mapInArrow(kept, schema)

    def run(batches):
        return_memory()
        for b in batches:
            s = scores(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2000) -> DataFrame:
    return score(docs, fit(docs, labels, per_class=per_class), threshold)
