"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarrystone.llm.shared import discard, saved


#: Edges in one file of a round, or more where the cluster has fewer files than cores.
EDGES = 100_000


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """The edges, saved, and their number and a sum over them, observed as they are written."""
    seen = Observation()
    rows = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), label)
    return rows, seen.get


def _least(pairs: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) with the least of u and its v's; that is written, so that Spark can split hot u in the join, and returned too."""
    least = saved(pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m")), least


def components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (longs u, v) but the least of its component: u, and that least node as v.

    Large stars hang a node's greater neighbours on its least one, small stars
    its lesser neighbours; both in turn end in one star per component, after a
    number of rounds that grows with the logarithm of the nodes. Loops,
    repeated and reversed edges do no harm; no edges give no rows. Rounds write
    as few files as their edges need, not one for each shuffle partition, and
    what a round wrote goes when the next one stands.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    now, state = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while state["n"]:
        files = max(cores, state["n"] // EDGES)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, least = _least(both, files)
        large = saved(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files), "large-stars")
        small, least_of_small = _least(large, files)
        before, old = state, now
        now, state = _written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
            .coalesce(files),
            "small-stars",
        )
        discard(old, least, large, least_of_small)
        if state == before:
            break
    return now
