"""The corpus pipeline: quality classifier, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of docs.

Defined cases, for all stages: null and empty texts, very long texts, rows without a doc_id, repeated rows and other
columns go through as the operators state; an empty table stays empty. Rows that repeat a doc_id with different texts are
one node of the near-duplicate stage: all of them stay when the doc_id does, but equal rows stay once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import decontam, jaccard, linededup, packing, quality
from stridelake.llm.queries import table, tokenizer_path
from stridelake.llm.shared import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more."""
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that occur before; a document of which nothing is left goes."""
    kept = linededup.dedup(docs).where("n_removed = 0 or length(trim(text)) > 0")
    count = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")} if "n_chars" in docs.columns else {}
    return kept.withColumns(count).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each class linked by 5-word shingles at a Jaccard similarity of 0.8."""
    classes = jaccard.join(docs, percent=80, k=5)
    keep = written(classes.where("component_id = doc_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n")), "kept")
    # Kept ids grow with the input, so they are not broadcast, at any size.
    among = lambda ids: docs.join(ids.select("kept_id").hint("merge"), docs["doc_id"] == ids["kept_id"], "left_semi")
    repeated = among(keep.where("n > 1")).dropDuplicates(["doc_id", "text"])
    return among(keep.where("n = 1")).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.digest(packing.pack_documents(docs, tokenizer_path()))


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_lines),
    ("near duplicates", one_of_each),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Trained scores and signatures by custom hashes are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
