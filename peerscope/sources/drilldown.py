"""Tables that answer questions about one address without a scan of all packets.

``ends`` holds every packet once under each of its two addresses, ``conversations``
the sums of every pair of addresses, seen from each. Both are cut into buckets by a
hash of the address and sorted by it, so a lookup opens the files of one bucket and in
them the row groups of one address. The range partitions that are written go by
time as well, so an address with most packets becomes many files, not one.

A table may be added to batch by batch (``append``); ``buckets`` is chosen once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.functions.columns import clean_names, clean_ports

ENDS = T.StructType([
    T.StructField("ip_address", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("packet_id", T.LongType()),
    T.StructField("src_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()), T.StructField("size", T.LongType()), T.StructField("bucket", T.IntegerType()),
])
CONVERSATIONS = T.StructType([
    T.StructField("ip_address", T.StringType()), T.StructField("peer_ip", T.StringType()),
    T.StructField("bytes_out", T.LongType()), T.StructField("packets_out", T.LongType()),
    T.StructField("bytes_in", T.LongType()), T.StructField("packets_in", T.LongType()),
    T.StructField("protocols", T.ArrayType(T.StringType())), T.StructField("ports", T.ArrayType(T.IntegerType())),
    T.StructField("bucket", T.IntegerType()),
])
#: Bytes of a row group: what a lookup reads at least.
GROUP_BYTES = 16 * 1024 * 1024


def bucket_of(address: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(buckets)).cast("int")


def packet_ends(packets: DataFrame) -> DataFrame:
    """Every packet under each address it touches; one to oneself once."""
    kept = [f.name for f in ENDS if f.name not in ("ip_address", "bucket")]
    both = F.when(F.col("src_ip") == F.col("dst_ip"), F.array("src_ip")).otherwise(F.array("src_ip", "dst_ip"))
    return packets.select(F.explode(both).alias("ip_address"), *kept)


def conversations(packets: DataFrame) -> DataFrame:
    """What each address exchanged with each peer; a packet to oneself counts as sent.

    Sums and sets combine before the shuffle, and a pair has at most 65 536 ports.
    """
    sent, size = F.col("ip_address") == F.col("src_ip"), F.col("size")
    peer = F.when(sent, F.col("dst_ip")).otherwise(F.col("src_ip"))
    return packet_ends(packets).groupBy("ip_address", peer.alias("peer_ip")).agg(
        F.sum(F.when(sent, size).otherwise(0)).alias("bytes_out"), F.count_if(sent).alias("packets_out"),
        F.sum(F.when(sent, 0).otherwise(size)).alias("bytes_in"), F.count_if(~sent).alias("packets_in"),
        clean_names(F.collect_set("protocol")).alias("protocols"),
        clean_ports(F.collect_set("src_port"), F.collect_set("dst_port")).alias("ports"),
    )


def merge_conversations(stored: DataFrame) -> DataFrame:
    """One row per address and peer of rows that several batches have added."""
    def union(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name)

    sums = [F.sum(c).alias(c) for c in ("bytes_out", "packets_out", "bytes_in", "packets_in")]
    return stored.groupBy("ip_address", "peer_ip").agg(*sums, union("protocols"), union("ports"))


class DrillDown:
    """Both tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def append(self, packets: DataFrame, batch: int) -> None:
        """Add a batch of stored packets, which are read once for each table; a batch that is given again replaces itself."""
        self._write(packet_ends(packets), ["ts", "packet_id"], f"{self.root}/ends/batch={batch}")
        self._write(conversations(packets), ["peer_ip"], f"{self.root}/conversations/batch={batch}")

    def _write(self, rows: DataFrame, then: list[str], path: str) -> None:
        keys = ["bucket", "ip_address", *then]
        (
            rows.withColumn("bucket", bucket_of(F.col("ip_address"), self.buckets))
            .repartitionByRange(*keys).sortWithinPartitions(*keys)
            .write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(path)
        )

    def _of(self, table: str, schema: T.StructType, ip: str) -> DataFrame:
        stored = self.spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(f"{self.root}/{table}")
        at = (F.col("bucket") == bucket_of(F.lit(ip), self.buckets)) & (F.col("ip_address") == ip)
        return stored.filter(at).drop("bucket", "batch")

    def packets_of(self, ip: str) -> DataFrame:
        return self._of("ends", ENDS, ip)

    def conversations_of(self, ip: str) -> DataFrame:
        return merge_conversations(self._of("conversations", CONVERSATIONS, ip))
