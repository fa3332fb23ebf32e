"""Operator 5: suffix-array dedup by run-length indexes.

Every byte covered by a LENGTH-byte string that also starts elsewhere is removed. Windows of LENGTH bytes are dealt by
content: the rightmost smallest K-gram hash in a window is its anchor, so equal windows have equal anchors, wherever
they stand. Windows of one document that follow each other and share an anchor make one segment. Then

1. equal segments are counted (map-side pre-aggregation): of two or more, every byte is covered;
2. segments that share an anchor but differ go, one copy each, to an index shard: a suffix array, its run-compressed
   Burrows-Wheeler transform with sampled run ends, and the longest common prefixes at the run ends; matching statistics
   are streamed in text order from these samples alone (one less at each step inside a run), and windows whose
   statistic reaches LENGTH are covered;
3. an anchor with more than `most_shard` bytes of different segments is not
   indexed as a whole: its windows are hashed one by one to 128 bits, dealt by hash and counted (the exact way for the
   rest). An index takes about 80 bytes of memory a byte, in one task.

Defined cases: null text is empty; shorter texts keep all; very long texts are read whole, by blocks whose edges are
joined again; rows equal in doc_id and text count as two rows, each of which repeats the other; doc_id null is a document
like any other; an empty table gives no rows; other columns of docs are not read and clash with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import U64, id_text, mix, powers, prefix_hash, segments, slices, span_hash, utf8, written

K = 32
BLOCK = 1 << 20


def anchors(data: np.ndarray, offs: np.ndarray, length: int):
    """Segments: anchor hash, segment hash, row, start in the row, bytes."""
    c, inverse = prefix_hash(data), powers(len(data) + 1)[1]
    width = length - K + 1
    low_bits = U64((1 << 24) - 1)
    windows = np.maximum(0, np.diff(offs) - length + 1)
    all_rows = segments(windows)
    all_starts = np.arange(len(all_rows)) + np.repeat(offs[:-1] - (np.cumsum(windows) - windows), windows)
    out = []
    for lo in range(0, max(0, len(data) - length + 1), BLOCK):
        hi = min(lo + BLOCK, len(data) - length + 1)  # windows lo..hi-1
        i, j = np.searchsorted(all_starts, (lo, hi))
        if i == j:
            continue
        end = hi + width - 1  # K-grams lo..end-1
        n = -(-(end - lo) // width) * width
        v = np.full(n, ~U64(0))
        part = v[: end - lo]
        np.subtract(c[lo + K : end + K], c[lo:end], out=part)
        part *= inverse[lo:end]
        part ^= part >> U64(32)
        part *= U64(0x9FB21C651E98DF25)
        part &= ~low_bits
        part |= np.arange(int(low_bits), int(low_bits) - len(part), -1).astype(U64)
        v = v.reshape(-1, width)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[: hi - lo], ahead[width - 1 : width - 1 + hi - lo])
        s, row = all_starts[i:j], all_rows[i:j]
        p = (low_bits - (best[s - lo] & low_bits)).astype(np.int64) + lo
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        out.append((p[first], row[first], s[first], s[last] + length))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z.astype(U64), z, z, z
    p, row, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(p) > 1:  # a segment cut by a block's edge is joined again
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        p, row, a, b = p[first], row[first], a[first], b[np.append(first[1:], len(new)) - 1]
    return span_hash(c, p, p + K), span_hash(c, a, b), row, a - offs[row], b - a


def suffix_array(text: np.ndarray, deepest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes in order of their first `deepest` bytes by prefix doubling, and the ranks at each depth."""
    n = len(text)
    packed = n <= 1 << 21  # two ranks and the position then fit one sortable word
    h, bits, own = 5, U64(21), np.arange(n, dtype=U64)
    padded = np.concatenate([text, np.zeros(h, np.uint8)])
    key = np.zeros(n, U64)
    for j in range(h):
        key = (key << U64(8)) | padded[j : j + n].astype(U64)
    ranks = {}
    while True:
        if packed:
            both = np.sort((key << bits) | own)
            order, key = (both & U64((1 << 21) - 1)).astype(np.int64), both >> bits
        else:
            order = np.argsort(key)
            key = key[order]
        new = np.ones(n, np.int32)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        ranks[h] = rank
        if h >= deepest or new.all():
            return order, ranks
        wide = rank.astype(U64)
        key = wide << (bits if packed else U64(32))
        key[: n - h] |= wide[h:]  # a suffix that ends here is told apart by its own mark before
        h *= 2


def common(text: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a and b, from the doubling ranks."""
    n, off = len(text), np.zeros(len(a), np.int64)
    for h in sorted(ranks, reverse=True):
        x, y = a + off, b + off
        ok = (x + h <= n) & (y + h <= n)
        ok[ok] = ranks[h][x[ok]] == ranks[h][y[ok]]
        off[ok] += h
    for _ in range(8):
        x, y = a + off, b + off
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        off[ok] += 1
    return off


class RunIndex:
    """Run-compressed Burrows-Wheeler transform with sampled run ends.

    heads and tails are the text positions sampled at the first and last row of each run; head_lcp and tail_lcp their
    common prefixes with the row before and after. Inside a run these fall by one at each text position, so the samples
    give every matching statistic.
    """

    def __init__(self, text: np.ndarray, deepest: int):
        sa, ranks = suffix_array(text, deepest)
        bwt = text[sa - 1].astype(np.int16)
        bwt[sa == 0] = -1
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.n, self.letters = len(text), bwt[np.append(0, change)]
        self.heads, self.tails = sa[np.append(0, change)], sa[np.append(change, len(sa)) - 1]
        self.head_lcp, self.tail_lcp = np.zeros(len(self.heads), np.int64), np.zeros(len(self.heads), np.int64)
        between = common(text, ranks, sa[change - 1], sa[change])
        self.head_lcp[1:], self.tail_lcp[:-1] = between, between

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text, the longest match of its suffix with one that starts elsewhere."""
        out = np.zeros(self.n, np.int64)
        for where, lcp in ((self.heads, self.head_lcp), (self.tails, self.tail_lcp)):
            sample = np.full(self.n, -1, np.int64)
            sample[where] = lcp
            last = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), 0))
            np.maximum(out, sample[last] - (np.arange(self.n) - last), out=out)
        return out


def covered_spans(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each part, [start, end) rows of the bytes covered by windows that also start elsewhere in the parts."""
    sizes = np.array([len(x) for x in parts])
    cut = np.cumsum(sizes + 8) - (sizes + 8)
    text = np.full(int((sizes + 8).sum()), 0xFF, np.uint8)  # never a byte of UTF-8
    mark = (np.arange(len(parts))[:, None] >> (6 * np.arange(5))) & 63  # each end is followed by its own number
    for i, x in enumerate(parts):
        text[cut[i] : cut[i] + len(x)] = x
        text[cut[i] + len(x) + 1 : cut[i] + len(x) + 6] = mark[i]
    index = RunIndex(text, int(sizes.max()) + 16)
    long = np.flatnonzero(index.matching_statistics() >= length)
    out = [np.zeros((0, 2), np.int32)] * len(parts)
    of = np.searchsorted(cut, long, "right") - 1
    inside = long + length <= cut[of] + sizes[of]  # a match may run on into the mark of a part's end
    long, of = long[inside], of[inside]
    if len(long):
        new = np.ones(len(long), bool)
        new[1:] = (long[1:] > long[:-1] + length) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(long)) - 1
        spans = np.stack([long[first], long[last] + length], 1) - cut[of[first]][:, None]
        for p in np.unique(of):
            out[p] = spans[of[first] == p].astype(np.int32)
    return out


def union(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) rows; spans that touch are joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > end[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], end[np.append(first[1:], len(spans)) - 1]], 1)


def marked(docs: DataFrame, length: int = 400, shard_bytes: int = 1 << 20, most_shard: int = 32 << 20) -> DataFrame:
    """doc_id, text and what was found (start of a segment in the document, covered spans in it) of every row."""
    source = id_text(docs).withColumn("rid", F.xxhash64("doc_id", "text"))

    def scan(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            rid = np.asarray(b.column("rid"))
            for i, j in slices(offs, BLOCK):
                anchor, seg, row, start, size = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
                cols = [anchor.view(np.int64), seg.view(np.int64), rid[i:j][row], start, size]
                yield pa.record_batch([pa.array(x) for x in cols], names=["anchor", "seg", "rid", "start", "size"])

    seen = written(source.select("rid", "text").mapInArrow(scan, "anchor long, seg long, rid long, start long, size long"), "segments")
    shared = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("s0"), F.max("seg").alias("s1"))
    shared = shared.where("n > 1").select("anchor", (F.col("s0") != F.col("s1")).alias("mixed"))
    shared = written(shared, "shared")  # so that the join can split hot anchors
    met = written(seen.join(shared, "anchor"), "met")
    kinds = met.groupBy("anchor", "seg", "size", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("one"))
    copied = kinds.where("n > 1").select("anchor", "seg", "size", F.expr("array(0, cast(size as int))").alias("spans"))
    unlike = written(kinds.where("mixed").select("anchor", "seg", "size", "n", "one.rid", "one.start"), "unlike")
    heavy = unlike.groupBy("anchor").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most_shard).select("anchor", F.lit(True).alias("heavy"))
    unlike = unlike.join(heavy, "anchor", "left")
    shards = max(16, int(unlike.agg(F.sum("size")).first()[0] or 0) // shard_bytes)
    wanted = unlike.groupBy("rid").agg(F.collect_list(F.struct("anchor", "seg", "size", "start", F.coalesce("heavy", F.lit(False)).alias("heavy"))).alias("parts"))

    def cut(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            base = offs[segment_rows(b.column("parts"))]
            p = b.column("parts").flatten()
            start, size = np.asarray(p.field("start")), np.asarray(p.field("size"))
            blob = pa.array([data[o + s : o + s + n].tobytes() for o, s, n in zip(base, start, size)], pa.binary())
            yield pa.record_batch([p.field("anchor"), p.field("seg"), p.field("size"), p.field("heavy"), blob], names=["anchor", "seg", "size", "heavy", "blob"])

    texts = source.select("rid", "text").join(wanted, "rid").mapInArrow(cut, "anchor long, seg long, size long, heavy boolean, blob binary")
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))

    def index(group: pa.Table) -> pa.Table:
        keys = np.stack([np.asarray(group.column(c)) for c in ("anchor", "seg")], 1)
        _, first = np.unique(keys, axis=0, return_index=True)  # a row that is there twice sends its part twice
        group = group.take(np.sort(first))
        spans = covered_spans([np.frombuffer(x.as_py(), np.uint8) for x in group.column("blob")], length)
        return group.select(["anchor", "seg", "size"]).append_column("spans", pa.array([x.ravel() for x in spans], pa.list_(pa.int32())))

    kind = "anchor long, seg long, size long, spans array<int>"
    light = texts.where("not heavy").groupBy("shard").applyInArrow(index, kind).where("size(spans) > 0")
    spans = copied.unionByName(light)
    if heavy.limit(1).count():
        spans = spans.unionByName(_by_window(written(texts.where("heavy"), "heavy"), length))
    found = met.join(spans, ["anchor", "seg", "size"]).groupBy("rid").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    return source.join(found, "rid", "left").select("doc_id", "text", "found")


def row_spans(found) -> list[np.ndarray]:
    """Disjoint spans of each row of a batch's `found` column."""
    starts, spans = found.flatten().field("start"), found.flatten().field("spans")
    counts = np.asarray(spans.value_lengths().fill_null(0)) // 2
    base = np.repeat(np.asarray(starts), counts)
    flat = np.asarray(spans.flatten(), np.int64).reshape(-1, 2) + base[:, None]
    per = np.zeros(len(found), np.int64)
    np.add.at(per, segment_rows(found), counts)
    cut = np.cumsum(per) - per
    return [union(flat[i : i + n]) if n else flat[:0] for i, n in zip(cut, per)]


def repeats(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, text, spans (start, end, start, end ... in bytes: what to remove) of every row of docs."""

    def merge(batches):
        for b in batches:
            spans = pa.array([x.ravel() for x in row_spans(b.column("found"))], pa.list_(pa.int64()))
            yield pa.record_batch([b.column("doc_id"), b.column("text"), spans], names=["doc_id", "text", "spans"])

    return marked(docs, **parameters).mapInArrow(merge, "doc_id long, text string, spans array<long>")


def segment_rows(lists) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))


def _by_window(texts: DataFrame, length: int) -> DataFrame:
    """Spans of parts whose anchor is too heavy for one shard, by counting each window's 128-bit hash."""

    keys, tables = ("anchor", "seg", "size"), [mix(np.arange(k, k + 256, dtype=U64)) for k in (1, 1001)]

    def hashes(batches):
        for b in batches:
            data, offs = utf8(b.column("blob"))
            for i, j in slices(offs, BLOCK >> 2):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                windows = np.maximum(0, np.diff(o) - length + 1)
                row = segments(windows)
                at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                w = [span_hash(prefix_hash(part, t), o[row] + at, o[row] + at + length).view(np.int64) for t in tables]
                same = [b.column(c).slice(i, j - i).take(pa.array(row)) for c in keys]
                yield pa.record_batch([*same, pa.array(at), *map(pa.array, w)], names=[*keys, "at", "w1", "w2"])

    def joined(batches):
        for b in batches:
            at, row = np.asarray(b.column("at").flatten()), segment_rows(b.column("at"))
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)
            first = np.flatnonzero(new)
            spans = np.stack([at[first], at[np.append(first[1:], len(at)) - 1] + length], 1).ravel().astype(np.int32)
            ends = np.append(0, 2 * np.cumsum(np.bincount(row[first], minlength=len(b)))).astype(np.int32)
            yield pa.record_batch([*(b.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(spans))], names=[*keys, "spans"])

    one = texts.dropDuplicates(["anchor", "seg", "size"])
    w = written(one.mapInArrow(hashes, "anchor long, seg long, size long, at long, w1 long, w2 long"), "windows")
    twice = w.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    at = F.sort_array(F.collect_list("at"))
    hit = w.join(twice, ["w1", "w2"]).groupBy("anchor", "seg", "size").agg(at.alias("at"))  # bounded by a segment's windows
    return hit.mapInArrow(joined, "anchor long, seg long, size long, spans array<int>")


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            spans = row_spans(b.column("found"))
            removed, sums = np.zeros(len(spans), np.int64), []
            for i, s in enumerate(spans):
                kept, at = hashlib.sha256(), offs[i]
                for u, v in s:
                    kept.update(data[at : offs[i] + u])
                    at = offs[i] + v
                    removed[i] += v - u
                kept.update(data[at : offs[i + 1]])
                sums.append(kept.hexdigest())
            cols = [pa.array(np.diff(offs)), pa.array(removed), pa.array([len(s) for s in spans], pa.int64()), pa.array(sums, pa.string())]
            yield pa.record_batch([b.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked(docs, **parameters).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
