"""Operator 10: benchmark decontamination by q-gram lemma filtering.

An item of L bytes that occurs with at most e edits shares L + 1 - q(e + 1) q-grams at least with the place where it
occurs, and their diagonals lie within e of each other. So shared q-grams are counted in diagonal bands of width 2e that
overlap by e; bands that reach the bound are verified by banded alignment. Letters A-Z are compared in lower case and
white-space bytes as blanks. The benchmark is a stated query set: it goes to the tasks in blocks of at most
`block_bytes`, each against all documents.

Defined cases: null and empty items or documents match nothing; items shorter than q bytes must occur exactly, and each
of their places is reported; very long texts and items are read whole; equal items are all reported; repeated documents
are reported each; doc_id and item_id may be null; no items or no documents give no rows; `matches` reads no other
columns, `clean` keeps them all under whatever names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import LOWER, SPACE, U64, id_text, prefix_hash, slices, powers, text_bytes, utf8

Q = 10
EDIT_RATE = 0.08
FOLD = np.where(SPACE, 0x20, LOWER).astype(np.uint8)
BITS = 22
HITS = 1 << 21


class Items:
    """Index of one block of items: q-grams by hash, and each item's edit budget and bound."""

    def __init__(self, ids: list, texts: list[str], q: int, rate: float):
        self.ids, self.q = ids, q
        self.bytes = [FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        self.size = np.array([len(x) for x in self.bytes])
        self.edits = np.maximum(0, np.minimum((self.size * rate).astype(int), self.size // q - 1))
        self.need = np.maximum(1, self.size + 1 - q * (self.edits + 1))
        grams = [self.hashes(x) for x in self.bytes]
        h = np.concatenate(grams) if grams else np.zeros(0, U64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.keys >> U64(64 - BITS)).astype(np.int64)] = True

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.q + 1
        if n < 1:
            return np.zeros(0, U64)
        c = prefix_hash(data)
        h = (c[self.q :] - c[:n]) * powers(n)[1]
        h ^= h >> U64(29)
        return h * U64(0xBF58476D1CE4E5B9)

    def bands(self, data: np.ndarray, offs: np.ndarray):
        """(row, item, lowest diagonal within the row) of the bands that reach the item's bound."""
        h = self.hashes(data)
        at = np.flatnonzero(self.seen[(h >> U64(64 - BITS)).astype(np.int64)])
        where = np.searchsorted(self.keys, h[at])
        where[where == len(self.keys)] = 0
        same = self.keys[where] == h[at] if len(self.keys) else np.zeros(0, bool)
        at, where = at[same], where[same]
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + self.q <= offs[row + 1]
        at, where, row = at[inside], where[inside], row[inside]
        times = self.count[where]
        most = int(max(np.diff(offs).max(initial=0), self.size.max(initial=0))) + 2  # beyond any band
        keys, counts, i, total = [], [], 0, np.append(0, np.cumsum(times))
        while i < len(at):  # a q-gram common to text and items (a run of blanks) has many hits: HITS of them at a time
            j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
            n = times[i:j]
            hit = np.repeat(self.first[where[i:j]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            of, item = np.repeat(row[i:j], n), self.item[hit]
            diagonal = np.repeat(at[i:j], n) - offs[of] - self.pos[hit]
            band = diagonal // np.maximum(1, self.edits)[item]
            key = (of * len(self.ids) + item) * (2 * most + 1) + band + most
            key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys.append(key)
            counts.append(count)
            i = j
        key, number = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = np.bincount(number, np.concatenate(counts), minlength=len(key)) if keys else key
        item = key // (2 * most + 1) % max(1, len(self.ids))
        ok = count >= self.need[item]
        key, item = key[ok], item[ok]
        return key // (2 * most + 1) // max(1, len(self.ids)), item, (key % (2 * most + 1) - most) * np.maximum(1, self.edits)[item]


def aligned(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the item's best place in text on the diagonals low..low+width-1, if at most `most`."""
    far = 1 << 20

    def rows(item, text, low, free):
        k, d = np.arange(width), np.full(width, far)
        col = low + k
        d[(col >= 0) & (col <= len(text))] = 0
        if not free:  # must begin at column 0
            d = np.where((col >= 0) & (col <= len(text)), np.abs(col), far)
        for i in range(1, len(item) + 1):
            col = low + i + k
            ok = (col >= 1) & (col <= len(text))
            cost = np.ones(width, np.int64)
            cost[ok] = text[col[ok] - 1] != item[i - 1]
            new = np.where(ok, d + cost, far)
            new[:-1] = np.minimum(new[:-1], d[1:] + 1)
            new[(col < 0) | (col > len(text))] = far
            d = np.minimum.accumulate(new - k) + k
        return d

    d = rows(item, text, low, True)
    best = int(d.argmin())
    if d[best] > most:
        return None
    end = low + len(item) + best
    back = rows(item[::-1], text[:end][::-1], -(width // 2), False)
    size = len(item) - width // 2 + int(back.argmin())
    return max(0, end - size), end, int(d[best])


def places(index: Items, text_column) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """(row, item, end) of each place where an item occurs in a batch: start, end, edits."""
    data, offs = utf8(text_column)
    data, out, q = FOLD[data], {}, index.q
    short = [i for i, n in enumerate(index.size) if n < q]
    for i, j in slices(offs, 1 << 20):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        for row, item, low in zip(*(x.tolist() for x in index.bands(part, o))):
            text, e, size = part[o[row] : o[row + 1]], int(index.edits[item]), int(index.size[item])
            lo, hi = max(0, low - e), max(0, low + 3 * e + size + 1)
            found = text[lo:hi].tobytes().find(index.bytes[item].tobytes())
            if found >= 0:
                place = (lo + found, lo + found + size, 0)
            else:
                place = aligned(index.bytes[item], text, low - 1, 2 * e + 3, e) if e else None
            if place:
                key = (i + row, item, place[1])
                out[key] = min(out.get(key, place), place, key=lambda p: p[2])
        for s in short:  # each place, also where places overlap
            word, size = index.bytes[s].tobytes(), int(index.size[s])
            for row in range(j - i):
                text = part[o[row] : o[row + 1]].tobytes()
                at = text.find(word)
                while at >= 0:
                    out[(i + row, s, at + size)] = (at, at + size, 0)
                    at = text.find(word, at + 1)
    return out


def indexes(benchmark: DataFrame, q: int, rate: float, block_bytes: int):
    """Indexes of the benchmark's items, in blocks of about block_bytes (each is what goes to the tasks at once)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("octet_length(text) > 0")
    blocks = 1 + text_bytes(items) // block_bytes
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if got:
            yield Items([r.item_id for r in got], [r.text for r in got], q, rate)


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the text) and edits of each place where an item occurs."""
    source, kind = id_text(docs), "doc_id long, item_id long, start long, end long, edits int"

    def search(index: Items):
        def run(batches):
            for b in batches:
                out = places(index, b.column("text"))
                if out:
                    ids = pa.array([index.ids[k[1]] for k in out], pa.int64())
                    cols = list(zip(*out.values()))
                    yield pa.record_batch([b.column("doc_id").take(pa.array([k[0] for k in out])), ids, *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])

        return source.mapInArrow(run, kind)

    found = [search(index) for index in indexes(benchmark, q, rate, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs in which no item occurs, with all columns; a map without a shuffle for each block of items."""

    def without(index: Items):
        def run(batches):
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[k[0] for k in places(index, b.column("text"))]] = False
                yield b.filter(pa.array(keep))

        return run

    for index in indexes(benchmark, q, rate, block_bytes):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs
