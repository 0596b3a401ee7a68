"""Rollups per endpoint over event time, on streams and on tables.

Windows are tumbling or sliding, sessions end after a pause. On a stream a watermark
bounds the state: rows that are later than ``delay`` are dropped, and a window or
session is emitted once, when the watermark has passed its end. The same functions
roll up a table, where nothing is late.

``session_islands`` is the batch form of sessions for busy endpoints: like cadence,
it sums packets per millisecond, sorts slots of time on their own and stitches
them through their first and last instant, so no endpoint is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peerscope.operators.timing import SLOT_MS


def endpoint_packets(packets: DataFrame) -> DataFrame:
    """``(ip_address, ts, ts_ms, sent, size)`` of both ends of every packet; one to oneself counts once."""
    ends = F.when(F.col("src_ip") == F.col("dst_ip"), F.array("src_ip")).otherwise(F.array("src_ip", "dst_ip"))
    return packets.filter("ts IS NOT NULL").select(F.explode(ends).alias("ip_address"), "ts", "ts_ms", "src_ip", "size").select(
        "ip_address", "ts", "ts_ms", (F.col("ip_address") == F.col("src_ip")).alias("sent"), "size"
    )


def _sums() -> list[Column]:
    size = F.coalesce("size", F.lit(0))
    return [
        F.count("*").alias("packets"), F.sum(size).alias("bytes"),
        F.count(F.when(F.col("sent"), 1)).alias("packets_out"), F.coalesce(F.sum(F.when(F.col("sent"), size)), F.lit(0)).alias("bytes_out"),
    ]


def endpoint_windows(packets: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """``(ip_address, window_start, window_end, packets, bytes, packets_out, bytes_out)`` per window; sliding if ``slide`` is given."""
    rows = endpoint_packets(packets)
    if packets.isStreaming:
        rows = rows.withWatermark("ts", delay)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy("ip_address", window.alias("w")).agg(*_sums()).select(
        "ip_address", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "packets", "bytes", "packets_out", "bytes_out"
    )


def endpoint_sessions(packets: DataFrame, pause: str, delay: str = "10 minutes") -> DataFrame:
    """``(ip_address, session_start, session_end, packets, bytes, packets_out, bytes_out)``; a session ends ``pause`` after its last packet."""
    rows = endpoint_packets(packets)
    if packets.isStreaming:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("ip_address", F.session_window("ts", pause).alias("w")).agg(*_sums()).select(
        "ip_address", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "packets", "bytes", "packets_out", "bytes_out"
    )


def session_islands(packets: DataFrame, pause_ms: int, slot_ms: int = SLOT_MS) -> DataFrame:
    """``(ip_address, start_ms, last_ms, packets, bytes, packets_out, bytes_out)``: sessions of a table, to the millisecond.

    Islands are numbered inside their slot. An island at the edge of a slot is
    joined with that of the slot before if the pause between them is short; only
    islands, never packets, meet per endpoint.
    """
    moments = endpoint_packets(packets).groupBy("ip_address", F.expr(f"ts_ms div {slot_ms}").alias("slot"), "ts_ms").agg(*_sums())
    within = Window.partitionBy("ip_address", "slot").orderBy("ts_ms")
    breaks = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(within) > pause_ms).cast("int"), F.lit(0))
    names = ("packets", "bytes", "packets_out", "bytes_out")
    islands = (
        moments.withColumn("breaks", breaks).withColumn("island", F.sum("breaks").over(within))
        .groupBy("ip_address", "slot", "island").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), *[F.sum(c).alias(c) for c in names])
    )
    across = Window.partitionBy("ip_address").orderBy("start_ms")
    apart = F.coalesce((F.col("start_ms") - F.lag("last_ms").over(across) > pause_ms).cast("int"), F.lit(0))
    return (
        islands.withColumn("apart", apart).withColumn("session", F.sum("apart").over(across))
        .groupBy("ip_address", "session").agg(F.min("start_ms").alias("start_ms"), F.max("last_ms").alias("last_ms"), *[F.sum(c).alias(c) for c in names])
        .drop("session")
    )


def store_rollup(rollup: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append what a watermark has closed to a table; the file sink commits each batch once."""
    writer = rollup.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if drain else writer).start()
