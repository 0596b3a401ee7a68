"""Continuous capture: land raw packets, keep packet and flow tables current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from peerscope.operators.flows import flow_edges, merge_flow_edges
from peerscope.schema import RAW_PACKETS
from peerscope.sources.packets import normalize

FLOW_EDGES = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packets", T.LongType()),
    T.StructField("bytes", T.LongType()),
])


def watch_raw_packets(spark: SparkSession, path: str, files_per_batch: int | None = None,
                      pattern: str | None = None) -> DataFrame:
    """Raw packet files as they land in ``path``."""
    return watch(spark, path, RAW_PACKETS, files_per_batch, pattern)


def watch(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
          pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def ingest_packets(raw: DataFrame, packets_path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append normalised packets to the packet table, one folder per day.

    The file sink commits each batch once. ``drain`` stops when all that has
    landed is in the table; otherwise the query runs until it is stopped.
    """
    writer = (
        normalize(raw)
        .withColumn("day", F.to_date("ts"))
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", packets_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if drain else writer).start()


def refresh_flows(packets: DataFrame, flows_path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep the flow table current: each batch adds its own flow rows.

    A batch overwrites only its own folder, so one that is replayed after a
    failure is not counted twice.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        flow_edges(batch).write.mode("overwrite").parquet(f"{flows_path}/batch={batch_id}")

    writer = packets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def read_flows(spark: SparkSession, flows_path: str) -> DataFrame:
    """The flow table summed over all batches."""
    return merge_flow_edges(spark.read.schema(FLOW_EDGES).parquet(flows_path))
