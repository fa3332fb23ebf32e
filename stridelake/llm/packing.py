"""Operator 2: concatenate and cut.

All documents, each followed by an end id, are one stream that is cut into sequences of `length` ids. First pass: each
task tokenises its documents, writes the ids with each document's start within the task, and so the task's total. The
totals' prefix sums give each task's start in the whole stream. Second pass: every document is cut where a window ends;
the pieces are the boundary records. Nothing is shuffled but one total per task; all sequences but the last are full.

Defined cases: null and empty texts are the end id alone; very long texts are cut into as many pieces as they need;
repeated rows are packed each; an empty table gives no rows; doc_id null is kept; other columns of docs are not read and
clash with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.shared import id_text, pack, slices, unpack, utf8, written
from stridelake.llm.tokens import encoder


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Table of task, start within the task, doc_id, n and ids (packed, with the end id), in the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        task, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in slices(offs, 1 << 20):
                flat, per = enc.ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                flat = np.insert(flat, np.cumsum(per), end_id)
                per = per + 1
                cut = np.cumsum(per) - per
                blobs = [pack(flat[x : x + n], 4) for x, n in zip(cut, per)]
                yield pa.record_batch(
                    [pa.array(np.full(j - i, task)), pa.array(at + cut), b.column("doc_id").slice(i, j - i), pa.array(per), pa.array(blobs, pa.binary())],
                    names=["task", "at", "doc_id", "n", "ids"],
                )
                at += int(per.sum())

    return written(id_text(docs).mapInArrow(run, "task long, at long, doc_id long, n long, ids binary"), "tokens")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = tokenised(docs, tokenizer, end_id)
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n"))  # one row per task of the first pass
    base = totals.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))

    def cut(batches):
        for b in batches:
            doc, at, n = b.column("doc_id"), np.asarray(b.column("at")), np.asarray(b.column("n"))
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // length + k
            begin = np.maximum(at[row], sequence * length)
            size = np.minimum(at[row] + n[row], (sequence + 1) * length) - begin
            start, out, last = begin - at[row], [], -1
            for r, s, m in zip(row.tolist(), start.tolist(), size.tolist()):
                if r != last:
                    ids, last = unpack(b.column("ids")[r].as_py(), int(n[r]), 4).astype("<u4"), r
                out.append(ids[s : s + m].tobytes())
            cols = [doc.take(pa.array(row)), pa.array(start), pa.array(size), pa.array(out, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)]
            yield pa.record_batch(cols, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    # One row of 16 bytes for each task of the first pass: a million tasks are 16 MB.
    placed = tokens.join(F.broadcast(base), "task").select("doc_id", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
