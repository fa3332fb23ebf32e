"""Phrase collocations: candidates from sketch upper bounds, counted by automata, scored with exact integers.

Texts are split into pieces and words and dealt into chunks of one language and bounded size; a chunk is a row of a written
table with its words numbered by a list of its own. Two sketches are filled: one with words and pairs of words, one with
phrases of three to five words, of those runs only in which each word and each pair may be frequent. A sketch has 2**48
cells of which only those in use are held, added up by each chunk for itself first and dealt by ranges of cells, so it
grows with the input and no task or broadcast holds it whole. A cell's sum bounds the count of each phrase in it from
above, so no phrase of `least` occurrences is lost; a chunk gets back those of its own cells that reach `least`. Words
that cannot be frequent become delimiters, so the chunks shrink on the way.

Then the candidates of each chunk are compiled into an Aho-Corasick automaton over word numbers, whose delimiter 0 is in
no candidate, so that no match crosses a piece or starts within a word, and the chunk is scanned; overlapping matches all
count. A candidate has the same cell in all chunks, so the counts, summed over tasks, are exact, and the thresholds are
applied to these sums alone. Parts of a frequent phrase are frequent, so their counts are among the sums.

Defined cases: null texts are empty, a null language is `und`; words are split at spaces and tabs only; repeated rows and
rows without a doc_id count like others; a very long text is many pieces, dealt over chunks (a single piece longer than a
chunk is a chunk of its own); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import collections
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.shared import LOWER, U64, attach, batches_of, mix, pack, prefix_hash, return_memory, span_hash, unpack, utf8, written

CELLS = U64((1 << 48) - 1)
CHUNK_BYTES = 8 << 20
LONGEST = 5
CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = CUTS.copy()
GAPS[[0x20, 0x09]] = True
CHUNK = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n_all", pa.int64()), ("n_words", pa.int64()), ("n_bytes", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])
CHUNK_DDL = "chunk long, lang string, n_all long, n_words long, n_bytes long, words binary, counts binary, n_tokens long, tokens binary"
CELL_DDL = "chunk long, range long, n long, cells binary, sums binary"
SUM_DDL = "lang string, phrase string, m int, n long"
ROWS_OUT, HELD = 1 << 16, 1 << 19
NO_CELLS = np.zeros(0, U64)


def numbered(data: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the bytes, their counts, and the words in order as numbers from 1, with 0 between pieces."""
    data = LOWER[data]
    solid = np.concatenate([[False], ~GAPS[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    offs = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(data[solid[1:-1]])]).dictionary_encode()
    number = listed.indices.to_numpy().astype(np.int64) + 1
    before = np.searchsorted(np.flatnonzero(CUTS[data]), start)  # delimiters before each word
    return listed.dictionary.to_pylist(), np.bincount(number, minlength=1)[1:], np.insert(number, np.flatnonzero(np.diff(before) > 0) + 1, 0)


class Chunk:
    """A row of the table of chunks: the words of its list with their counts, and its text as numbers of words."""

    def __init__(self, chunk: int, lang: str, n_all: int, words: list[bytes], counts: np.ndarray, tokens: np.ndarray, hot: list[int] | None = None):
        self.chunk, self.lang, self.n_all, self.words, self.counts, self.tokens = chunk, lang, n_all, words, counts, tokens
        self.hot = np.sort(np.array(hot or [], np.int64)).astype(U64)

    @classmethod
    def of(cls, r: dict) -> Chunk:
        words = pa.decompress(r["words"], r["n_bytes"], codec="zstd", asbytes=True).split(b" ") if r["n_words"] else []
        counts, tokens = unpack(r["counts"], r["n_words"], 6), unpack(r["tokens"], r["n_tokens"], 4)
        return cls(r["chunk"], r["lang"], r["n_all"], words, counts.astype(np.int64), tokens.astype(np.int64), r.get("hot"))

    def batch(self) -> pa.RecordBatch:
        joined = b" ".join(self.words)
        values = [self.chunk, self.lang, self.n_all, len(self.words), len(joined), pa.compress(joined, codec="zstd", asbytes=True), pack(self.counts, 6), len(self.tokens), pack(self.tokens, 4)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNK)], schema=CHUNK)

    def hashes(self) -> np.ndarray:
        """A hash of each word, the same in all chunks of a language; index 0 is the delimiter's."""
        parts = [self.lang.encode(), *self.words]
        size = np.array([len(w) for w in parts])
        end = np.cumsum(size)
        h = span_hash(prefix_hash(np.frombuffer(b"".join(parts), np.uint8)), end - size, end)
        return mix(h + mix(h[:1] + U64(1)))

    def word_cells(self) -> np.ndarray:
        return self.hashes()[1:] & CELLS

    def places(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of m words begin, and their cells."""
        n = len(self.tokens) - m + 1
        if n <= 0:
            return np.zeros(0, np.int64), NO_CELLS
        within = self.tokens[:n] > 0
        for i in range(1, m):
            within &= self.tokens[i : i + n] > 0
        at, h = np.flatnonzero(within), self.hashes()
        key = np.full(len(at), m, U64)
        for i in range(m):
            key = mix(key * U64(0x9E3779B97F4A7C15) + h[self.tokens[at + i]])
        return at, key & CELLS

    def among(self, cells: np.ndarray) -> np.ndarray:
        return np.isin(cells, self.hot)


def by_chunk(rows: DataFrame, make: Callable[[Chunk], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What `make` gives for each chunk."""

    def run(batches):
        return_memory()
        for batch in batches:
            for r in batch.to_pylist():
                yield from make(Chunk.of(r))

    return rows.mapInArrow(run, ddl)


def one_at_a_time(rows: DataFrame, name: str) -> DataFrame:
    """rows as a written table; on the way, chunks come to tasks one at a time."""
    with batches_of(rows.sparkSession, 1):
        return written(rows, name)


def chunks(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """A written table of chunks of about `size` bytes of text."""

    def run(batches):
        return_memory()
        number, held, kept = pyspark.TaskContext.get().partitionId() << 32, collections.defaultdict(list), collections.Counter()

        def closed(name):
            nonlocal number
            number += 1
            del kept[name]
            words, counts, tokens = numbered(np.concatenate(held.pop(name)))
            return Chunk(number, name, int(counts.sum()), words, counts, tokens).batch()

        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for name, a, z in zip(batch.column("lang").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                while a < z:
                    b = z
                    if z - a > size:  # a long text is parted after a delimiter, so that no piece is
                        near = np.flatnonzero(CUTS[data[a + size : z]])
                        b = a + size + int(near[0]) + 1 if len(near) else z
                    held[name] += [data[a:b].copy(), np.array([10], np.uint8)]
                    kept[name] += b - a + 1
                    a = b
                    if kept[name] >= size:
                        yield closed(name)
                if kept.total() >= 4 * size:  # many languages at once: close the largest
                    yield closed(kept.most_common(1)[0][0])
        for name in list(held):
            yield closed(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    with batches_of(docs.sparkSession, 500):
        return written(rows.mapInArrow(run, CHUNK_DDL), "chunks")


def ranges_of(total: int, chunks: int) -> int:
    """Into how many ranges the cells are dealt: of 2**18 items, or of up to 2**22 where a chunk would add less than 2**12
    to a range, as each run that a chunk packs for a range costs as much as thousands of items."""
    return max(1, min(total >> 18, max(total >> 22, total // max(chunks, 1) >> 12), 1 << 24))


def with_hot(rows: DataFrame, least: int, items: str, cells: Callable[[Chunk], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """The chunks with `hot`, those of their cells whose sums over all chunks reach `least`.

    `cells` gives the cells that a chunk adds to, and how much (None: 1); `items` is SQL for a bound of their number. The
    cells are dealt by ranges, of which a task holds one at a time, as sorted runs that a chunk packs for each range; the
    task that sums a range answers each chunk."""
    total, count = rows.agg(F.coalesce(F.sum(F.expr(items)), F.lit(0)), F.count("*")).first()
    ranges = U64(ranges_of(total, count))

    def add(c: Chunk):
        cell, n = cells(c)
        kinds, place = np.unique(cell, return_inverse=True)
        sums = np.bincount(place, n, len(kinds)).astype(np.int64)
        at, edge = np.unique((kinds >> U64(24)) * ranges >> U64(24), return_index=True)
        edge = [*edge.tolist(), len(kinds)]
        for i in range(0, len(at), 1000):
            runs = list(zip(edge[i : i + 1000], edge[i + 1 : i + 1001]))
            columns = [[c.chunk] * len(runs), at[i : i + 1000].tolist(), [y - x for x, y in runs], [pack(np.diff(kinds[x:y], prepend=U64(0)), 6) for x, y in runs], [pack(sums[x:y], 6) for x, y in runs]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["chunk", "range", "n", "cells", "sums"])

    def answer(group: pa.Table) -> pa.Table:
        runs = group.to_pylist()
        cell = np.concatenate([np.cumsum(unpack(r["cells"], r["n"], 6)) for r in runs])
        kinds, place = np.unique(cell, return_inverse=True)
        reached = (np.bincount(place, np.concatenate([unpack(r["sums"], r["n"], 6) for r in runs])) >= least)[place]
        edge = np.cumsum([0, *(r["n"] for r in runs)])
        found = [(r["chunk"], cell[x:y][reached[x:y]].astype(np.int64)) for r, x, y in zip(runs, edge[:-1], edge[1:])]
        return pa.table({"chunk": pa.array([c for c, v in found if len(v)], pa.int64()), "hot": pa.array([v for c, v in found if len(v)], pa.list_(pa.int64()))})

    sketch = by_chunk(rows, add, CELL_DDL)
    hot = sketch.groupBy("range").applyInArrow(answer, "chunk long, hot array<long>").groupBy("chunk").agg(F.flatten(F.collect_list("hot")).alias("hot"))
    return rows.join(hot.hint("merge"), "chunk", "left")


def frequent_words(c: Chunk):
    """The chunk with its frequent words only; others are delimiters."""
    keep = c.among(c.word_cells())
    tokens = np.concatenate([[0], np.cumsum(keep) * keep])[c.tokens]
    tokens = tokens[(tokens > 0) | np.concatenate([[False], tokens[:-1] > 0])[: len(tokens)]]
    yield Chunk(c.chunk, c.lang, c.n_all, [w for w, k in zip(c.words, keep) if k], c.counts[keep], tokens).batch()


def frequent_pairs(c: Chunk):
    """The chunk with the words of frequent pairs only, and delimiters where no pair joins a word to the next. The list of words stays."""
    at, cell = c.places(2)
    joined = np.zeros(len(c.tokens) + 1, bool)
    joined[at[c.among(cell)] + 1] = True  # the pair that ends here
    last = joined.copy()
    last[:-1] &= ~joined[1:]
    keep = joined.copy()
    keep[:-1] |= joined[1:]
    keep = np.flatnonzero(keep[: len(c.tokens)])
    yield Chunk(c.chunk, c.lang, c.n_all, c.words, c.counts, np.insert(c.tokens[keep], np.flatnonzero(last[keep]) + 1, 0)).batch()


def matches(c: Chunk, most: int) -> tuple[list[bytes], list[int]]:
    """The chunk's frequent words and its candidates, with their counts: the words' own, the candidates' by an automaton."""
    import ahocorasick

    candidates: list[tuple[int, ...]] = []
    for m in range(2, most + 1):
        at, cell = c.places(m)
        if m > 2:  # all pairs that are left are frequent
            at = at[c.among(cell)]
        candidates += set(zip(*(c.tokens[at + i].tolist() for i in range(m))))
    if not candidates:
        return c.words, c.counts.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, key in enumerate(candidates):
        automaton.add_word(key, i)
    automaton.make_automaton()
    found = np.fromiter(map(operator.itemgetter(1), automaton.iter(tuple(c.tokens.tolist()))), np.int64)
    return c.words + [b" ".join([c.words[t - 1] for t in key]) for key in candidates], c.counts.tolist() + np.bincount(found, minlength=len(candidates)).tolist()


def counted(rows: DataFrame, most: int) -> DataFrame:
    """lang, phrase, m (its words) and n: what each task counts in its chunks, added up by up to HELD phrases at a time."""

    def run(batches):
        return_memory()
        held: dict[str, dict[bytes, int]] = collections.defaultdict(dict)

        def out():
            for lang, sums in held.items():
                phrases = list(sums)
                for i in range(0, len(phrases), ROWS_OUT):
                    part = phrases[i : i + ROWS_OUT]
                    columns = [[lang] * len(part), [p.decode() for p in part], [p.count(b" ") + 1 for p in part], [sums[p] for p in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.string(), pa.string(), pa.int32(), pa.int64()])], ["lang", "phrase", "m", "n"])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk.of(r)
                sums = held[c.lang]
                for phrase, n in zip(*matches(c, most)):
                    sums[phrase] = sums.get(phrase, 0) + n
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, SUM_DDL)


def frequencies(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, most: int = LONGEST, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Exact counts: lang, phrase, m and f of all phrases of 1 to `most` words that occur `least` times; lang and its number of words."""
    rows = chunks(docs, lang, text, size)
    totals = written(rows.groupBy("lang").agg(F.sum("n_all").alias("words")), "totals")
    rows = one_at_a_time(by_chunk(with_hot(rows, least, "n_words", lambda c: (c.word_cells(), c.counts)), frequent_words, CHUNK_DDL), "chunks")
    rows = one_at_a_time(by_chunk(with_hot(rows, least, "n_tokens", lambda c: (c.places(2)[1], None)), frequent_pairs, CHUNK_DDL), "chunks")
    longer = lambda c: (np.concatenate([NO_CELLS, *(c.places(m)[1] for m in range(3, most + 1))]), None)
    sums = counted(with_hot(rows, least, f"n_tokens * {most}", longer), most).groupBy("lang", "phrase", "m").agg(F.sum("n").alias("f"))
    return one_at_a_time(sums.where(F.col("f") >= least), "frequencies"), totals


def scores(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, m, a, l, r, n and score of each phrase of two words or more, by its lowest-scoring cut."""
    words, part = F.split("phrase", " ", -1), F.col("side")
    cuts = frequent.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    sides = cuts.withColumn("side", F.explode(F.array(F.lit("l"), F.lit("r"))))
    piece = F.when(part == "l", F.slice(words, F.lit(1), F.col("k"))).otherwise(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")))
    sides = written(sides.withColumn("piece", F.array_join(piece, " ")), "sides")
    asked = sides.groupBy("lang", "piece").agg(F.count("*").alias("n"))
    known = frequent.select("lang", F.col("phrase").alias("piece"), "f")
    known = written(asked.join(known.hint("merge"), ["lang", "piece"]), "pieces")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cut = written(attach(sides, known, ["lang", "piece"], sides.count()).groupBy("lang", "phrase", "m", "a", "k").agg(side("l"), side("r")), "cuts")
    of = cut.groupBy("lang").agg(F.count("*").alias("n"))
    cut = attach(cut, written(of.join(totals.hint("merge"), "lang"), "langs"), ["lang"], cut.count())
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('words')} * 1000) div ({wide('l')} * {wide('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "m").agg(F.first("a").alias("a"), F.first("words").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "m", "a", "best.l", "best.r", "n", "best.score")


def outermost(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Without phrases that lie in a longer one of at least `percent` per cent of their count."""
    inner = scored.where("m > 2").select("lang", F.col("a").alias("longer"), "m", F.split("phrase", " ", -1).alias("w"), F.explode(F.expr("sequence(2, m - 1)")).alias("size"))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, m - size + 1)")))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = scored.join(inner.hint("merge"), ["lang", "phrase"], "left")
    return kept.where(F.expr(f"longer is null or 100 * longer < {percent} * a")).drop("longer")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, top: int = 2000, size: int = CHUNK_BYTES) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n and score."""
    frequent, totals = frequencies(docs, lang, text, least, size=size)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # a limit by group comes before the exchange
    ranked = outermost(written(scores(frequent, totals), "scored")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
