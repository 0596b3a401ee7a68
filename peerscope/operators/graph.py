"""Node and edge sets of the packet graph, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ends(packets: DataFrame) -> DataFrame:
    """Both ends of every packet."""
    return packets.select(
        F.expr("stack(2, src_ip, src_port, 'SENT', dst_ip, dst_port, 'RECEIVED') "
               "AS (ip_address, port, relation)"),
        "packet_id",
    )


def ip_nodes(packets: DataFrame) -> DataFrame:
    return _ends(packets).select("ip_address").distinct()


def port_nodes(packets: DataFrame) -> DataFrame:
    return _ends(packets).select("ip_address", "port").distinct()


def packet_edges(packets: DataFrame) -> DataFrame:
    """One SENT and one RECEIVED edge per packet."""
    return _ends(packets).select("ip_address", "port", "relation", "packet_id")


def entity_counts(packets: DataFrame, owners: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Entities stored per kind."""
    def count(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("entities")).select(F.lit(kind).alias("kind"), "entities")

    return (
        count("PACKET", packets)
        .unionAll(count("IP_ADDRESS", ip_nodes(packets).unionAll(owners.select("ip_address")).distinct()))
        .unionAll(count("PORT", port_nodes(packets)))
        .unionAll(count("ORGANIZATION", owners.select("org").distinct()))
        .unionAll(count("ENDPOINT", endpoints))
    )
