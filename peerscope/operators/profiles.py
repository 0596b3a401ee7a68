"""One profile per address: traffic by direction, ports, protocols, cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.operators.flows import by_endpoint, flow_edges
from peerscope.operators.timing import endpoint_timing
from peerscope.schema import PORTS_KEPT
from peerscope.session import materialize
from peerscope.sources.packets import real_packets


def _first_ports(port: Column) -> Column:
    # At most 65 536 values can meet here: a port has 16 bits.
    return F.slice(F.sort_array(F.collect_set(port)), 1, PORTS_KEPT)


def _one_direction(packets: DataFrame, own: str, peer: str) -> DataFrame:
    return flow_edges(real_packets(packets)).groupBy(F.col(own).alias("ip_address")).agg(
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        F.count_distinct(peer).alias("peers"),
        _first_ports(F.col("dst_port")).alias("ports"),
        F.sort_array(F.collect_set("protocol")).alias("protocols"),
    )


def outbound_profile(packets: DataFrame) -> DataFrame:
    """Traffic each address sent; ports are the services it contacted."""
    return _one_direction(packets, "src_ip", "dst_ip")


def inbound_profile(packets: DataFrame) -> DataFrame:
    """Traffic each address received; ports are its own that received."""
    return _one_direction(packets, "dst_ip", "src_ip")


def traffic_profile(edges: DataFrame) -> DataFrame:
    """Both directions at once from flow rows; an absent direction is 0 or empty.

    Pass stored rows: they are read for the sums and for the sets. Peers are
    first reduced to one row per (address, peer), so a hub with most peers does
    not gather them in one task.
    """
    sent, received = F.col("outbound"), ~F.col("outbound")
    ends = by_endpoint(edges)
    sums = (
        ends.groupBy("ip_address", "peer")
        .agg(
            F.sum(F.when(sent, F.col("bytes")).otherwise(0)).alias("bytes_out"),
            F.sum(F.when(sent, F.col("packets")).otherwise(0)).alias("packets_out"),
            F.sum(F.when(received, F.col("bytes")).otherwise(0)).alias("bytes_in"),
            F.sum(F.when(received, F.col("packets")).otherwise(0)).alias("packets_in"),
        )
        .groupBy("ip_address")
        .agg(
            F.sum("bytes_out").alias("bytes_out"),
            F.sum("packets_out").alias("packets_out"),
            F.count_if(F.col("packets_out") > 0).alias("out_peers"),
            F.sum("bytes_in").alias("bytes_in"),
            F.sum("packets_in").alias("packets_in"),
            F.count_if(F.col("packets_in") > 0).alias("in_peers"),
        )
    )
    sets = ends.groupBy("ip_address").agg(
        _first_ports(F.when(sent, F.col("dst_port"))).alias("out_ports"),
        _first_ports(F.when(received, F.col("dst_port"))).alias("in_ports"),
        F.sort_array(F.collect_set("protocol")).alias("protocols"),
    )
    return sums.join(sets, "ip_address")


def endpoint_profile(packets: DataFrame, metadata: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The profile of every address that sent or received a packet.

    Pass stored packets: they are read for flows and for cadence. ``edges`` may
    pass a stored flow table of the same packets; else one is written to the
    shared folder.
    """
    packets = real_packets(packets)
    edges = materialize(flow_edges(packets), "flows") if edges is None else real_packets(edges)
    return (
        traffic_profile(edges)
        .join(endpoint_timing(packets), "ip_address", "left")
        .join(metadata, "ip_address", "left")
        .select(
            "ip_address", "org", "hostname", "location",
            "bytes_out", "packets_out", "out_peers", "out_ports",
            "bytes_in", "packets_in", "in_peers", "in_ports",
            "protocols", "interval_mean", "interval_cv",
        )
    )


def upsert_endpoints(current: DataFrame, profiles: DataFrame, known_ips: DataFrame) -> DataFrame:
    """``current`` endpoints with new profiles merged in by address.

    A profile replaces everything but the outlier verdict; endpoints without a
    new profile stay; a profile of an address that is not in the graph is
    left out.
    """
    new = profiles.join(known_ips.select("ip_address"), "ip_address", "left_semi")
    old, fresh = current.alias("old"), new.alias("new")
    has_new = F.col("new.ip_address").isNotNull()
    merged = [
        F.when(has_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        for c in current.columns
        if c != "outlier"
    ]
    return old.join(fresh, F.col("old.ip_address") == F.col("new.ip_address"), "full_outer").select(
        *merged, F.col("old.outlier").alias("outlier")
    )


def write_verdicts(endpoints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set ``outlier`` of the scored endpoints; the others keep theirs.

    ``verdicts`` is ``(ip_address, is_outlier)``. Null stays for an endpoint
    never scored.
    """
    return (
        endpoints.join(verdicts.select("ip_address", "is_outlier"), "ip_address", "left")
        .withColumn("outlier", F.coalesce("is_outlier", "outlier"))
        .select(endpoints.columns)
    )
