"""Conversations: packets summed per source, destination, service and protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flow_edges(packets: DataFrame) -> DataFrame:
    """One row per (src_ip, dst_ip, dst_port, protocol).

    Sums combine before the shuffle, so one busy conversation costs one row
    per task. Everything but cadence is computed from this table.
    """
    return packets.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.count("*").alias("packets"), F.sum("size").alias("bytes")
    )


def merge_flow_edges(edges: DataFrame) -> DataFrame:
    """Sum up flow rows of several captures."""
    return edges.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )


def by_endpoint(edges: DataFrame) -> DataFrame:
    """Each flow seen from both ends: ``outbound`` is true for the sender."""
    return edges.select(
        F.expr("stack(2, src_ip, true, dst_ip, dst_ip, false, src_ip) AS (ip_address, outbound, peer)"),
        "dst_port", "protocol", "packets", "bytes",
    )
