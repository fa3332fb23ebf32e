"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text, without its white space, is cut into blocks of a fixed number of bytes. All distinct blocks of the table are
sorted, and the place in that order is a block's integer name, so equal names mean equal bytes. Then neighbouring names are
paired and the distinct pairs are sorted and named in the same way, until each text is down to one name. Texts that need
the same number of steps and end in the same name are equal, with no chance of a collision.

The bytes of the blocks travel once, to be sorted. Rows find the names of their blocks by a 128-bit digest; the sorted
table shows whether two of its blocks share a digest, and in that case rows find them by the bytes themselves.

Defined cases: null texts are empty; empty texts (white space only, too) have one empty block and are equal to each other;
a very long text is many blocks, and its steps grow with the logarithm of its length; rows without a doc_id take part and
yield to rows with one; rows that repeat a doc_id are rows of their own, of which exactly one of a group stays; an empty
table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import attach, written

WHITE = " \t\n\v\f\r"


def digest(block: Column) -> Column:
    return F.struct(F.xxhash64(block), F.xxhash64(F.lit(1), block))


def _cut(docs: DataFrame, text: str, block: int, *columns: Column) -> DataFrame:
    """The given columns, the normalised text as `data`, and its blocks."""
    rows = docs.select(*columns, F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, "").cast("binary").alias("data"))
    # The text goes through an array of one, so that each block takes its bytes from the same buffer without a copy of it.
    one = lambda t: F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.octet_length(t) - 1, F.lit(0)) / block)), lambda i: F.substring(t, (i * block + 1).cast("int"), F.lit(block)))
    return rows.withColumn("blocks", F.flatten(F.transform(F.array("data"), one)))


def _sorted_names(counted: DataFrame, key: list[str], *columns: Column) -> DataFrame:
    """A written table of the given columns with the name of each row of `counted`, which its key tells apart.

    Names follow the partitions of the aggregate that made the rows, and in each of them the sorted order of the keys.
    """
    return written(counted.sortWithinPartitions(*key).select(*columns, "n", (F.monotonically_increasing_id() + 1).alias("name")), "names")


def identities(rows: DataFrame, blocks: DataFrame, label: Callable[[Column], Column]) -> DataFrame | None:
    """row, level and name: one identity for each of `rows` (row, labels of its blocks in order).

    `blocks` has every block of these rows. None where two distinct blocks share a label.
    """
    counted = blocks.groupBy("block").agg(F.count("*").alias("n"))
    names = _sorted_names(counted, ["block"], label(F.col("block")).alias("label"))
    if not names.groupBy("label").count().where("count > 1").isEmpty():
        return None
    most, total = rows.agg(F.max(F.size("labels")), F.sum(F.size("labels"))).first()
    items = rows.select("row", F.size("labels").cast("long").alias("left"), F.posexplode("labels").alias("i", "label"))
    items = written(attach(items, names, ["label"], total or 0).select("row", "left", F.col("i").cast("long").alias("i"), "name"), "level")
    done, level = [], 0
    while True:
        done.append(items.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        if (most or 0) <= 1:
            break
        name_at = lambda side: F.coalesce(F.max(F.when(F.col("i") % 2 == side, F.col("name"))), F.lit(0))
        # 0 is no name: a text with an odd number of names pairs its last one with it.
        pairs = items.where("left > 1").groupBy("row", F.expr("i div 2").alias("i")).agg(F.expr("(max(left) + 1) div 2").alias("left"), name_at(0).alias("a"), name_at(1).alias("b"))
        pairs = written(pairs, "pairs")
        names = _sorted_names(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], F.col("a"), F.col("b"))
        items = written(attach(pairs, names, ["a", "b"], pairs.count()).select("row", "left", "i", "name"), "level")
        most, level = (most + 1) // 2, level + 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, block: int = 4096, label: Callable[[Column], Column] = digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs, and its number in the column `row`.

    Of equal texts the row of the most code points stays, then that of the smallest doc_id. `row` names a column of docs
    that tells its rows apart and stays the same when they are read again; without one the rows are numbered here, once.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    points = F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("points")
    told = lambda how: written(
        _cut(docs, text, block, number.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), points).select(
            "row", "doc_id", "points", F.unhex(F.sha2("data", 256)).alias("sha"), F.transform("blocks", how).alias("labels")
        ),
        "rows",
    )
    # explode_outer, as a filter for empty arrays, which do not occur, would cut each text again for each of its blocks.
    blocks = _cut(docs, text, block).select(F.explode_outer("blocks").alias("block"))
    rows = told(label)
    found = identities(rows.select("row", "labels"), blocks, label)
    if found is None:
        itself = lambda b: F.struct(b)
        rows = told(itself)
        found = identities(rows.select("row", "labels"), blocks, itself)
    rows = written(rows.drop("labels").join(found.hint("merge"), "row"), "identities")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("at")))
    groups = written(rows.groupBy("level", "name").agg(F.count("*").alias("n"), F.count("*").alias("group_size"), best.alias("best")), "groups")
    return attach(rows, groups, ["level", "name"], rows.count()).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.at")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row"
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    stay = classes(numbered, doc_id, text, row, block).where("kept").select(F.col("row").alias(row))
    return numbered.join(stay.hint("merge"), row, "left_semi").select(*docs.columns)
