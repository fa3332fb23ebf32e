"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import written


def _with_least(edges: DataFrame, at: str, least: DataFrame, hub_edges: int) -> DataFrame:
    """edges with the column m that `least` (node, m) has for the node in column `at`; null where it has none.

    A node of more than hub_edges edges is a hub: its edges are dealt over one salt for each hub_edges of them, and its
    row of `least` is copied to each salt. There are at most edges / hub_edges hubs.
    """
    hubs = edges.groupBy(F.col(at).alias("hub")).agg(F.floor(F.count("*") / hub_edges).cast("int").alias("salts")).where("salts > 0")
    hubs = written(hubs, "hubs")  # so that Spark knows the size, and sends it to all tasks only where it is small
    salted = edges.join(hubs, edges[at] == hubs["hub"], "left").withColumn("salt", F.when(F.col("salts") > 0, F.pmod(F.xxhash64("u", "v"), F.col("salts") + 1)).otherwise(0).cast("int")).drop("hub", "salts")
    copies = least.join(hubs, least["node"] == hubs["hub"], "left").select("node", "m", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(0)))).alias("copy"))
    return salted.join(copies, (salted[at] == copies["node"]) & (salted["salt"] == copies["copy"]), "left").select("u", "v", "m")


def connected(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, hub_edges: int = 1_000) -> DataFrame:
    """node, component (smallest node reachable) of all nodes with an edge to another node.

    Edges are kept as (higher, lower). A round ties the higher end of each edge to the least neighbour of its lower end
    (large star), then all lower neighbours of a node to the least of them (small star); edge tables never grow, and the
    result of each round is a table in the shared folder. Rounds grow with the logarithm of the nodes, so `most_rounds`
    is far beyond any table; an error is raised there rather than a wrong result given. Nulls and self-edges are
    ignored; repeated edges count once; an empty table gives no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # The least neighbour of v matters only where it is below v, and then v is the higher end of that edge.
        low = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = written(_with_least(e, "v", low, hub_edges).select("u", F.least("v", "m").alias("v")).distinct(), "edges")
        low = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = _with_least(large, "u", low, hub_edges)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small.where("u > v").distinct(), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
