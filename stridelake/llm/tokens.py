"""Token ids of a byte-level BPE file, many documents at a time.

The split into pre-tokens is done on whole batches with NumPy; a BPE never crosses a pre-token, so only pre-tokens that
the worker has not met yet are handed to the tokenizers library: to its BPE model, many at a time, where all characters
are below U+0240, and else to the whole tokenizer (which does its own split again, so that its Unicode tables decide). A
string such as <|endoftext|> in a text is ordinary text.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from stridelake.llm.shared import U64, prefix_hash, segments, span_hash

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
FIRST_RARE = 0xC9  # UTF-8 without bytes from here on has no character from U+0240 on
AT_ONCE = 16  # pre-tokens in one call of the model; more than a few make no difference
# Fixed: the pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        pick = np.flatnonzero((cp >= low) & (cp < high) & (cp == data[at]))
        value = cp[pick] & mask
        for j in range(1, more + 1):
            value = (value << 6) | (data[at[pick] + j] & 0x3F)
        cp[pick] = value
    return cp, at


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte at which each pre-token starts (they cover the documents without gaps), and pre-tokens per document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    cp, at = code_points(data)
    n = len(cp)
    kind = char_classes()[cp]
    edge = np.zeros(n + 1, bool)  # a document starts here
    edge[np.searchsorted(at, offs)] = True
    white = kind == WHITE
    cut = edge[:-1].copy()
    change = kind[1:] != kind[:-1]
    after_blank = cp[:-1] == 0x20
    cut[1:] |= change & ~(after_blank & ~white[1:])
    last_white = white[:-1] & ~white[1:] & ~edge[1:-1]  # a run's last character goes its own way when a word follows
    cut[:-1] |= last_white
    for i in np.flatnonzero((cp == 0x27) & cut):
        near = "".join(map(chr, cp[i + 1 : i + 3]))
        size = 2 if near[:1] in set("stmd") and near else 3 if near in ("re", "ve", "ll") else 0
        if size and not edge[i + 1 : i + size].any():
            cut[i + 1] = False
            if i + size < n:
                cut[i + size] = True
    start = at[cut]
    return start, np.diff(np.searchsorted(start, offs))


def byte_chars() -> np.ndarray:
    """Code point that stands for each byte in a byte-level vocabulary."""
    out = np.arange(256, dtype="<u4")
    shown = (out >= 0x21) & (out <= 0x7E) | (out >= 0xA1) & (out != 0xAD)
    out[~shown] = 256 + np.arange(np.count_nonzero(~shown))
    return out


class Encoder:
    """Ids by pre-token, kept for the life of the worker up to `most` pre-tokens."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores: threads would only wait
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        self.chars = byte_chars()
        self.mark = self._mark()
        self.clear()

    def _mark(self) -> int | None:
        """A byte that is in no UTF-8 text and that the model never merges: pre-tokens between such bytes keep their ids."""
        model, vocabulary = self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False)
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if self.tokenizer.normalizer is not None or any(getattr(model, k, True) for k in plain):
            return None
        merged = set("".join(t for t in vocabulary if len(t) > 1))
        free = (b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if chr(self.chars[b]) in vocabulary and chr(self.chars[b]) not in merged)
        return next(free, None)

    def clear(self):
        self.hashes, self.row = np.zeros(0, U64), np.zeros(0, np.int64)  # in order of the hashes
        self.sizes, self.starts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.met, self.met_row = np.zeros(1 << 18, U64), np.zeros(1 << 18, np.int64)  # the last one met of each first 18 bits
        self.met[0] = ~U64(0)

    def _by_model(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pre-tokens one after the other, and ids of each."""
        size = end - start + 1
        cut = np.cumsum(size)
        flat = data[np.minimum(np.repeat(start - (cut - size), size) + np.arange(cut[-1]), len(data) - 1)]
        flat[cut - 1] = self.mark
        text, tokenize = self.chars[flat].tobytes().decode("utf-32-le"), self.tokenizer.model.tokenize
        edges = [0, *cut[AT_ONCE - 1 :: AT_ONCE].tolist(), int(cut[-1])]
        ids = np.fromiter((t.id for a, b in itertools.pairwise(edges) if a < b for t in tokenize(text[a:b])), np.uint32)
        last = np.flatnonzero(ids == self.tokenizer.model.token_to_id(chr(self.chars[self.mark])))
        return np.delete(ids, last), np.diff(last, prepend=-1) - 1

    def _whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist())]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Store these pre-tokens; their rows."""
        rare = np.append(0, np.cumsum(data >= FIRST_RARE))
        common = (rare[end] == rare[start]) & (self.mark is not None)
        rows = np.zeros(len(start), np.int64)
        for which, encode in ((common, self._by_model), (~common, self._whole)):
            if which.any():
                ids, size = encode(data, start[which], end[which])
                rows[which] = len(self.sizes) + np.arange(len(size))
                self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(size) - size])
                self.sizes = np.concatenate([self.sizes, size])
                self.pool = np.concatenate([self.pool, ids])
        return rows

    def rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row in sizes, starts of each pre-token."""
        if len(self.row) > self.most:
            self.clear()
        every = span_hash(prefix_hash(data), start, end)
        slot = (every >> U64(46)).astype(np.int64)
        out = self.met_row[slot]
        rest = np.flatnonzero(self.met[slot] != every)
        h, first, inverse = np.unique(every[rest], return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        there = np.append(self.hashes, U64(0))[at] == h
        there &= at < len(self.hashes)
        known = np.append(self.row, 0)[at]
        new = np.flatnonzero(~there)
        if len(new):
            where = rest[first[new]]
            known[new] = self._learn(data, start[where], end[where])
            self.hashes, self.row = np.insert(self.hashes, at[new], h[new]), np.insert(self.row, at[new], known[new])
        out[rest] = known[inverse]
        self.met[slot[rest]], self.met_row[slot[rest]] = every[rest], out[rest]
        return out

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each pre-token, its first byte, and pre-tokens per document."""
        start, per = pre_tokens(data, offs)
        if not len(start):
            return np.zeros(0, np.int64), start, per
        row = self.rows(data, start, np.append(start[1:], len(data)))
        return self.sizes[row], start, per

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and ids per document."""
        start, per = pre_tokens(data, offs)
        if not len(start):
            return np.zeros(0, np.uint32), per
        row = self.rows(data, start, np.append(start[1:], len(data)))
        size = self.sizes[row]
        flat = self.pool[np.repeat(self.starts[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return flat, np.bincount(segments(per), size, minlength=len(per)).astype(np.int64)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
