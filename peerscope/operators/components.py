"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``(u, v)``; the root is the lowest node.

    Large-star and small-star steps (Kiveris, Lattanzi, Mirrokni, Rastogi and
    Vassilvitskii, 2014) until no edge changes. Each round is written to the
    shared folder, which cuts its lineage.
    """
    current = materialize(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = _fingerprint(current)
    while mark[0]:
        before = current
        current = materialize(_small_star(_large_star(before)), "edges")
        new_mark = _fingerprint(current)
        # Equal hashes only suggest an end; equal edges prove it.
        if new_mark == mark and current.join(before, ["u", "v"], "left_anti").isEmpty():
            break
        mark = new_mark
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.join(current.select(F.col("u").alias("node")), "node", "left_anti")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of the distinct edges and a hash of their set."""
    row = edges.agg(F.count("*").alias("edges"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")).first()
    return row["edges"], row["hash"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every higher neighbour of a node to the node's lowest neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lower neighbours to the lowest of them."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    others = edges.join(lowest, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.unionAll(lowest.select("u", F.col("low").alias("v"))).distinct()
