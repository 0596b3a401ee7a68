"""Read views: recent profiles and the drill-down into one address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.columns import clean_names, clean_ports, peer_of, touches
from peerscope.schema import FETCH_MINUTES, FETCH_ROWS, PACKET_ROWS, PEER_ROWS
from peerscope.sources.drilldown import DrillDown

PROFILE = [
    "bytes_out", "packets_out", "out_peers", "out_ports",
    "bytes_in", "packets_in", "in_peers", "in_ports",
    "protocols", "interval_mean", "interval_cv", "outlier",
]


def _profile(endpoints: DataFrame, metadata: DataFrame) -> DataFrame:
    """Profiles with gaps in their description filled from the metadata."""
    owner = metadata.select(
        "ip_address", *[F.col(c).alias(f"owner_{c}") for c in ("org", "hostname", "location")]
    )
    return endpoints.join(owner, "ip_address", "left").select(
        "ip_address",
        *[F.coalesce(c, f"owner_{c}").alias(c) for c in ("org", "hostname", "location")],
        *PROFILE,
        F.col("profiled_at").alias("timestamp"),
    )


def fetch_traffic(
    endpoints: DataFrame, metadata: DataFrame, minutes: int = FETCH_MINUTES, limit: int = FETCH_ROWS,
    as_of: Column | None = None,
) -> DataFrame:
    """Profiles of the last ``minutes``, newest first, at most ``limit``."""
    now = F.current_timestamp() if as_of is None else as_of
    recent = endpoints.filter(F.col("profiled_at") > now - F.make_dt_interval(mins=F.lit(minutes)))
    # An endpoint has one owner, so the rows to show are known before the join.
    shown = recent.orderBy(F.desc("profiled_at"), "ip_address").limit(limit)
    return _profile(shown, metadata).orderBy(F.desc("timestamp"), "ip_address")


def inspect_profile(endpoints: DataFrame, metadata: DataFrame, ip: str) -> DataFrame:
    """The profile of one address, or no row."""
    at = F.col("ip_address") == ip
    return _profile(endpoints.filter(at), metadata.filter(at))


def inspect_totals(packets: DataFrame, endpoints: DataFrame, ip: str) -> DataFrame:
    """Packets and distinct peers of one address over everything captured, and
    whether it is known at all."""
    profiled = endpoints.filter(F.col("ip_address") == ip).agg(F.count("*").alias("n")).scalar()
    return (
        packets.filter(touches(ip))
        .groupBy(peer_of(ip).alias("peer"))
        .agg(F.count("*").alias("packets"))
        .agg(
            F.coalesce(F.sum("packets"), F.lit(0)).alias("packets"),
            F.count("peer").alias("peers"),
        )
        .select(F.lit(ip).alias("ip_address"), "packets", "peers",
                ((F.col("packets") > 0) | (profiled > 0)).alias("found"))
    )


def inspect_peers(packets: DataFrame, metadata: DataFrame, ip: str, limit: int = PEER_ROWS) -> DataFrame:
    """Who one address talked to, by total bytes; outbound is what it sent."""
    size, outbound = F.col("size"), F.col("src_ip") == ip
    conversations = (
        packets.filter(touches(ip))
        .groupBy(peer_of(ip).alias("peer_ip"))
        .agg(
            F.sum(F.when(outbound, size).otherwise(0)).alias("bytes_out"),
            F.count_if(outbound).alias("packets_out"),
            F.sum(F.when(outbound, 0).otherwise(size)).alias("bytes_in"),
            F.count_if(~outbound).alias("packets_in"),
            F.sum("size").alias("bytes_total"),
            clean_names(F.collect_set("protocol")).alias("protocols"),
            clean_ports(F.collect_set("src_port"), F.collect_set("dst_port")).alias("ports"),
        )
    )
    return _top_peers(conversations, metadata, limit)


def _top_peers(conversations: DataFrame, metadata: DataFrame, limit: int) -> DataFrame:
    # An address has one owner, so the rows to show are known before the join.
    shown = conversations.orderBy(F.desc("bytes_total"), "peer_ip").limit(limit)
    peers = metadata.select(
        F.col("ip_address").alias("peer_ip"),
        *[F.col(c).alias(f"peer_{c}") for c in ("org", "hostname", "location")],
    )
    return (
        shown.join(peers, "peer_ip", "left")
        .select(
            "peer_ip", "peer_org", "peer_hostname", "peer_location",
            "bytes_out", "packets_out", "bytes_in", "packets_in", "bytes_total", "protocols", "ports",
        )
        .orderBy(F.desc("bytes_total"), "peer_ip")
    )


def inspect_packets(packets: DataFrame, ip: str, limit: int = PACKET_ROWS) -> DataFrame:
    """The latest packets of one address."""
    return _latest(packets.filter(touches(ip)), limit)


def _latest(packets: DataFrame, limit: int) -> DataFrame:
    return (
        packets.orderBy(F.desc("ts"), F.desc("packet_id"))
        .limit(limit)
        .select("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "size", F.col("ts").alias("timestamp"))
    )


def indexed_totals(index: DrillDown, endpoints: DataFrame, ip: str) -> DataFrame:
    """As ``inspect_totals``, from the address's rows of the index alone."""
    profiled = endpoints.filter(F.col("ip_address") == ip).agg(F.count("*").alias("n")).scalar()
    return index.conversations_of(ip).agg(
        F.coalesce(F.sum(F.col("packets_out") + F.col("packets_in")), F.lit(0)).alias("packets"), F.count("peer_ip").alias("peers")
    ).select(F.lit(ip).alias("ip_address"), "packets", "peers", ((F.col("packets") > 0) | (profiled > 0)).alias("found"))


def indexed_peers(index: DrillDown, metadata: DataFrame, ip: str, limit: int = PEER_ROWS) -> DataFrame:
    """As ``inspect_peers``, from the address's rows of the index alone."""
    total = F.col("bytes_out") + F.col("bytes_in")
    return _top_peers(index.conversations_of(ip).withColumn("bytes_total", total), metadata, limit)


def indexed_packets(index: DrillDown, ip: str, limit: int = PACKET_ROWS) -> DataFrame:
    """As ``inspect_packets``, from the address's rows of the index alone."""
    return _latest(index.packets_of(ip), limit)


def port_size_points(packets: DataFrame) -> DataFrame:
    """Packet size against both ports, one row per packet."""
    return packets.select("size", "src_port", "dst_port")


def port_size_summary(packets: DataFrame) -> DataFrame:
    """The same points summed per port and direction, small enough to draw."""
    return (
        packets.select(F.expr("stack(2, 'src', src_port, 'dst', dst_port) AS (direction, port)"), "size")
        .groupBy("direction", "port")
        .agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    )
