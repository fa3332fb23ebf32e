"""Operator 7: edit-aware token counting.

A document's pre-tokens are grouped, LEAF at a time, into the leaves of a segment tree that holds characters and tokens
(both as sums). An edit (at, removed, inserted; in characters) finds its leaf by descent, re-splits from one leaf before
it (the boundary context) and stops as soon as it stands on an old leaf's boundary behind the edit: from there on the
split is the old one. Only that stretch is encoded; the leaves it replaces get its sums, and the sums above them are
brought up to date along their paths.

Defined cases: null text is empty; an edit's `at` and `removed` are clipped to the text, nulls count as 0 and as no
text; edits apply in order of `seq`, each to the text that the one before left; documents without edits keep their
counts; edits of unknown documents are ignored; rows that are repeated are counted each; very long texts are one tree
each; doc_id null keeps its counts, and no edit reaches it; an empty table gives no rows; other columns of docs are not
read and clash with nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import id_text, segments, slices, utf8
from stridelake.llm.tokens import PATTERN, encoder

LEAF = 16
EDITS = "array<struct<seq:int,at:int,removed:int,inserted:string>>"


class Tree:
    """Segment tree over leaves; heap order, two sums a node."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.slots = 1 << max(0, int(len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.slots, 2), np.int64)
        self.sums[self.slots : self.slots + len(chars), 0] = chars
        self.sums[self.slots : self.slots + len(chars), 1] = tokens
        n = self.slots
        while n > 1:
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character `at` (or the last), and where the leaf starts."""
        node, before = 1, 0
        while node < self.slots:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if at - before >= left and self.sums[node + 1, 0] > 0:
                before, node = before + left, node + 1
        return node - self.slots, before

    def put(self, leaf: int, chars: int, tokens: int):
        node = leaf + self.slots
        change = np.array((chars, tokens)) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


@functools.lru_cache(1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def edit(tree: Tree, text: str, at: int, removed: int, inserted: str, tokens_of) -> tuple[str, int]:
    """The new text and how many characters were encoded again; the tree is brought up to date."""
    at = min(max(at, 0), len(text))
    removed = min(max(removed, 0), len(text) - at)
    new = text[:at] + inserted + text[at + removed :]
    leaf, start = tree.find(at)
    first = leaf
    while first > 0 and at - start < 2 * LEAF:  # what stands before may look ahead into the edit
        first -= 1
        start -= int(tree.sums[first + tree.slots, 0])
    edge, last, shift = start, first, len(inserted) - removed  # edge: end of old leaf `last` - 1
    pos, tokens = start, 0
    behind = at + removed
    while pos < len(new):
        old = pos - shift
        if pos >= at + len(inserted) and old >= behind:
            while last < tree.slots and edge < old:
                edge += int(tree.sums[last + tree.slots, 0])
                last += 1
            if edge == old and old > behind:
                break
        match = splitter().match(new, pos)
        tokens += tokens_of(match[0])
        pos = match.end()
    else:
        last = tree.slots
    for i in range(first + 1, last):
        if tree.sums[i + tree.slots].any():
            tree.put(i, 0, 0)
    tree.put(first, pos - start, tokens)
    return new, pos - start


def trees(docs: DataFrame, tokenizer: str, *also: Column) -> DataFrame:
    """doc_id, text, leaf_chars and leaf_tokens (the leaves of the tree) and n_tokens, and further columns."""
    names = [f"extra_{i}" for i in range(len(also))]

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in slices(offs, 1 << 20):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                count, start, per = enc.counts(part, o)
                whole = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                chars = np.diff(np.append(whole[start], whole[-1]))
                within = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
                first = np.flatnonzero(within % LEAF == 0)
                leaves = -(-per // LEAF)
                ends = np.append(0, np.cumsum(leaves)).astype(np.int32)
                sums = [np.add.reduceat(x, first) if len(first) else x for x in (chars, count)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in sums]
                total = np.bincount(segments(per), count, minlength=len(per)).astype(np.int64)
                rest = [b.column(c).slice(i, j - i) for c in names]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), b.column("text").slice(i, j - i), *lists, pa.array(total), *rest], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(c.alias(n) for c, n in zip(also, names)))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(run, f"doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long{extra}")


def recount(grown: DataFrame, tokenizer: str, edits: str) -> DataFrame:
    """doc_id, n_tokens, n_after, n_chars, n_encoded, text_after for a column of edits beside the trees."""

    def run(batches):
        enc, known = encoder(tokenizer), {}

        def tokens_of(s: str) -> int:
            if s not in known:
                if len(known) > 400_000:
                    known.clear()
                known[s] = len(enc.tokenizer.encode(s, add_special_tokens=False).ids)
            return known[s]

        for b in batches:
            out = []
            for text, chars, tokens, todo in zip(*(b.column(c) for c in ("text", "leaf_chars", "leaf_tokens", edits))):
                text, again = text.as_py(), 0
                tree = Tree(np.asarray(chars.values), np.asarray(tokens.values))
                for e in sorted(todo.as_py() or [], key=lambda e: e["seq"] or 0):
                    text, n = edit(tree, text, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", tokens_of)
                    again += n
                out.append((int(tree.sums[1, 1]), len(text), again, text))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.record_batch([b.column("doc_id"), b.column("n_tokens"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_tokens", "n_after", "n_chars", "n_encoded", "text_after"])

    return grown.mapInArrow(run, "doc_id long, n_tokens long, n_after long, n_chars long, n_encoded long, text_after string")


def apply_edits(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """As recount, for a table of edits (doc_id, seq, at, removed, inserted); the edits of one document fit a row."""
    todo = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("seq").cast("int"), F.col("at").cast("int"), F.col("removed").cast("int"), "inserted")).alias("todo"))
    joined = id_text(docs).join(todo, "doc_id", "left")
    return recount(trees(joined, tokenizer, F.col("todo").cast(EDITS)), tokenizer, "extra_0")
