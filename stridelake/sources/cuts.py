"""Tables in the folder that all executors share, to cut a plan where its result is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WRITTEN: list[str] = []  # paths of the tables of this driver
TABLES: list[str] = []  # names of those that are bucketed


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="stridelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int, most: int = 100_000) -> DataFrame:
    """df by key in partitions of about `most` rows (`rows`: how many there are, about), and in no fewer than shuffles have,
    so that a task's share of windows over the key does not grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), key)


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "cut") -> DataFrame:
    """df as a Parquet table in the shared folder, bucketed by key and read back: windows, groups and joins by that key
    go on from it without a shuffle."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table = f"{name}_{uuid.uuid4().hex}"
    WRITTEN.append(path)
    TABLES.append(table)
    df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def buckets(spark: SparkSession, rows: int, most: int = 200_000) -> int:
    """Buckets of about `most` rows, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def clean(spark: SparkSession) -> int:
    """Delete the tables that this driver has written so far, and give their number. For when results have been taken:
    DataFrames that still read these tables fail afterwards."""
    for table in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    TABLES.clear()
    for path in WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(WRITTEN)
    WRITTEN.clear()
    return n
