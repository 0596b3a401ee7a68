"""Packet records: from raw dissected fields to the flat packet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.functions.columns import epoch_millis, flow_line, port_number
from peerscope.schema import NO_IP, PACKETS, RAW_PACKETS
from peerscope.sources.snapshots import Snapshots


def read_raw_packets(spark: SparkSession, path: str) -> DataFrame:
    """Dissected packets as landed by a capture job."""
    return spark.read.schema(RAW_PACKETS).parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """The packet table written by :func:`append_packets`; filter ``day`` to prune."""
    return spark.read.schema(PACKETS).parquet(path)


def normalize(raw: DataFrame) -> DataFrame:
    """Raw fields to :data:`PACKETS`.

    A packet without IPv4 gets the placeholder address; ports and payload come
    from the TCP layer, else from UDP, and a port that is not all digits is 0.
    """
    is_tcp = F.col("tcp_srcport").isNotNull() | F.col("tcp_dstport").isNotNull()
    return raw.select(
        "packet_id",
        "ts",
        epoch_millis(F.col("ts")).alias("ts_ms"),
        F.coalesce("ip_src", F.lit(NO_IP)).alias("src_ip"),
        F.coalesce("ip_dst", F.lit(NO_IP)).alias("dst_ip"),
        port_number(F.when(is_tcp, F.col("tcp_srcport")).otherwise(F.col("udp_srcport"))).alias("src_port"),
        port_number(F.when(is_tcp, F.col("tcp_dstport")).otherwise(F.col("udp_dstport"))).alias("dst_port"),
        F.col("highest_layer").alias("protocol"),
        F.col("frame_length").alias("size"),
        F.when(is_tcp, F.col("tcp_payload")).otherwise(F.col("udp_payload")).alias("payload"),
    )


def with_flow_line(packets: DataFrame) -> DataFrame:
    return packets.withColumn("flow", flow_line())


def packet_scan(packets: DataFrame) -> DataFrame:
    """The columns profiling reads; the payload stays on disk."""
    return packets.select("src_ip", "dst_ip", "src_port", "dst_port", "size", "protocol", "ts_ms")


def real_packets(packets: DataFrame) -> DataFrame:
    """Packets with an address on both sides."""
    return packets.filter((F.col("src_ip") != NO_IP) & (F.col("dst_ip") != NO_IP))


def append_packets(packets: DataFrame, path: str) -> None:
    """Append to the packet table, one folder per day.

    ``rebalance`` gathers each day into files of the advisory size and splits
    a day that holds most rows; sorting lets row groups be skipped by address.
    """
    _by_day(packets).write.mode("append").partitionBy("day").parquet(path)


def _by_day(packets: DataFrame) -> DataFrame:
    return packets.withColumn("day", F.to_date("ts")).hint("rebalance", "day").sortWithinPartitions("day", "src_ip")


def append_batch(packets: DataFrame, path: str, batch: int) -> None:
    """Append one numbered batch, in a folder of its own per day.

    A batch that is given again replaces itself, so a job may be retried; it counts
    once Spark has put its ``_SUCCESS`` file.
    """
    _by_day(packets).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batches/version={batch}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All complete batches of :func:`append_batch`, with their ``day``; filter it to prune."""
    schema = T.StructType([*PACKETS, T.StructField("day", T.DateType())])
    folders = [f"{path}/batches/version={b}" for b in Snapshots(spark, path).versions("batches")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/batches").parquet(*folders).select(schema.fieldNames())
