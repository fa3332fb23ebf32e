"""Operator 8: line dedup by content-defined line chunks.

Lines with text are hashed, and a rolling hash goes over `least - spread + 1` of them at a time. A place is a boundary
where its rolling hash is the smallest of some window of `spread` neighbouring ones: boundaries are chosen by content
alone and shift with their lines, and as any `least` lines hold one whole window, any run of `least` lines or more has a
boundary at the same line of each of its copies, whatever stands around it. The lines under the rolling hash at a
boundary are its chunk; with the default, two lines and a spread of two, about two lines in three begin one.

Chunks whose hash occurs again anywhere are seeds. A seed is extended to both sides a line at a time: every run of `least`
lines that holds it is grouped by its bytes themselves, and every occurrence but the first (smallest doc_id, then place)
is removed with its line ends. Overlapping runs add up to whole passages, so each repeated passage of `least` lines or
more goes whole, as if all its runs had been compared. Blank lines inside a run belong to it.

Defined cases: null text is empty and stays as it is; texts with fewer than `least` lines of text stay, and so do lines
that repeat alone; very long texts are read whole; rows equal in doc_id and text are one document and keep the same;
doc_id null counts as the largest; an empty table gives no rows. All columns of docs are kept under their names, whatever
these are; columns n_lines and n_removed of docs are replaced by this operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stridelake.llm.shared import SPACE, U64, mix, prefix_hash, slices, span_hash, utf8, written

LAST = (1 << 63) - 1


def line_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the line end) and row of each line."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(data == 10) + 1
    start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], new[new < len(data)]]))
    end = np.append(start[1:], len(data))
    return start, end - (data[end - 1] == 10), np.searchsorted(offs, start, "right") - 1


def text_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_starts of the lines with text."""
    start, end, row = line_starts(data, offs)
    solid = np.append(0, np.cumsum(~SPACE[data]))
    text = solid[end] > solid[start]
    return start[text], end[text], row[text]


def line_chunks(data: np.ndarray, offs: np.ndarray, spread: int = 2, least: int = 2):
    """Chunks at the boundaries: row, number of the first line among the row's lines with text, hash."""
    start, end, row = text_lines(data, offs)
    rolled = least - spread + 1
    h = span_hash(prefix_hash(data), start, end)
    n = len(h) - least + 1  # places that may begin a run of `least` lines
    if n < 1:
        return row[:0], row[:0], h[:0]
    rolling = h[: len(h) - rolled + 1].copy()
    for j in range(1, rolled):
        rolling = mix(rolling * U64(31) + h[j : len(h) - rolled + 1 + j])
    smallest = np.min([rolling[j : n + j] for j in range(spread)], axis=0)
    within, chosen = row[:n] == row[least - 1 :], np.zeros(len(rolling), bool)
    for j in range(spread):
        chosen[j : n + j] |= within & (rolling[j : n + j] == smallest)
    at = np.flatnonzero(chosen)
    return row[at], at - np.searchsorted(row, row[at]), rolling[at]


def runs_of(start: np.ndarray, end: np.ndarray, at: np.ndarray, spread: int, least: int):
    """First and last byte of the runs of `least` of a row's lines that hold the chunks at lines `at`."""
    first = np.unique(np.add.outer(at, -np.arange(spread)))
    first = first[(first >= 0) & (first + least <= len(start))]
    return start[first], end[first + least - 1]


def dedup(docs: DataFrame, spread: int = 2, least: int = 2) -> DataFrame:
    """All columns of docs with the text that is left, and n_lines, n_removed. 2 <= spread <= least."""
    if not 2 <= spread <= least:
        raise ValueError("spread must be between 2 and least")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    fields = [f for f in docs.schema if f.name in columns]
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("rid")]
    source = docs.select(*key, F.col("text"))  # a row is known by doc_id and its text's hash

    def scan(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in slices(offs):
                row, line, h = line_chunks(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], spread, least)
                at = pa.array(row + i)
                yield pa.record_batch([b.column("id").take(at), b.column("rid").take(at), pa.array(line), pa.array(h.view(np.int64))], names=["id", "rid", "line", "h"])

    seen = written(source.mapInArrow(scan, "id long, rid long, line long, h long"), "chunks")
    # Both sides of each join are written tables, so that a chunk that is everywhere can be split.
    again = written(seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    wanted = seen.join(again, "h").groupBy("id", "rid").agg(F.collect_set("line").alias("parts"))  # a document's own chunks

    def extend(batches):
        for b in batches:
            whole, ends = utf8(b.column("text"))
            for i, j in slices(ends):
                data, offs = whole[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                start, end, row = text_lines(data, offs)
                edge, of, begin, size, blob = np.searchsorted(row, np.arange(j - i + 1)), [], [], [], []
                for x, seeds in enumerate(b.column("parts").slice(i, j - i)):
                    lines = slice(edge[x], edge[x + 1])
                    for p, q in zip(*runs_of(start[lines], end[lines], seeds.values.to_numpy(), spread, least)):
                        of.append(i + x)
                        begin.append(p - offs[x])
                        size.append(q - p)
                        blob.append(data[p:q].tobytes())
                at = pa.array(of, pa.int64())
                yield pa.record_batch([b.column("id").take(at), b.column("rid").take(at), pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], names=["id", "rid", "start", "size", "bytes"])

    texts = source.join(wanted, ["id", "rid"]).select("id", "rid", "text", "parts")
    parts = written(texts.mapInArrow(extend, "id long, rid long, start long, size long, bytes binary"), "candidates")
    place = F.struct("id", "rid", "start")
    groups = parts.groupBy("bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    groups = written(groups.where("first <> last").select("bytes", "first"), "repeated")
    gone = parts.join(groups, "bytes").where(place != F.col("first")).groupBy("id", "rid").agg(F.collect_set(F.struct("start", "size")).alias("gone"))
    whole = docs.select(*key, F.struct(*[docs[c] for c in columns]).alias("row"))
    joined = whole.join(gone, ["id", "rid"], "left").select("row", "gone")

    def keep(batches):
        for b in batches:
            every, of_gone = dict(zip(columns, b.column("row").flatten())), b.column("gone")
            whole, ends = utf8(every["text"])
            for i, j in slices(ends):
                row, data, offs = {c: x.slice(i, j - i) for c, x in every.items()}, whole[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                start, _, of = line_starts(data, offs)
                kept = np.ones(len(data) + 1, bool)
                for x, spans in enumerate(of_gone.slice(i, j - i).to_pylist()):
                    for s in spans or ():
                        a = int(offs[x]) + s["start"]
                        kept[a : min(a + s["size"] + 1, int(offs[x + 1]))] = False
                lines, removed = np.bincount(of, minlength=j - i), np.bincount(of[~kept[start]], minlength=j - i)
                kept = kept[: len(data)]
                if not kept.all():
                    cut = np.append(0, np.cumsum(kept))[offs]
                    text = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data[kept].tobytes())])
                    row["text"] = pc.if_else(row["text"].is_valid(), text.cast(pa.large_string()).cast(pa.string()), pa.scalar(None, pa.string()))
                yield pa.record_batch([*row.values(), pa.array(lines.astype(np.int64)), pa.array(removed.astype(np.int64))], names=[*columns, "n_lines", "n_removed"])

    schema = StructType([*(StructField("text", f.dataType) if f.name == "text" else f for f in fields), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(keep, schema)
