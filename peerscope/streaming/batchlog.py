"""Tables that grow by batches and are compacted, and endpoint profiles kept current from them.

A batch of a stream is a folder of its own. Every ``compact_every`` batches the last
snapshot and the folders after it are merged into the next snapshot, so a read
touches one snapshot and fewer than ``compact_every`` folders, however long the
stream has run. A folder counts once Spark has put its ``_SUCCESS`` file: a job that
dies leaves the one before in place, a replayed batch overwrites its own folder or
is already part of a snapshot and ignored. Readers of the snapshot before the last
still find its folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from peerscope.operators.flows import flow_edges, merge_flow_edges
from peerscope.operators.profiles import traffic_profile
from peerscope.sources.packets import real_packets
from peerscope.sources.snapshots import Snapshots
from peerscope.streaming.cadence import endpoint_cadence
from peerscope.streaming.ingest import FLOW_EDGES

CADENCE = T.StructType([
    T.StructField("ip_address", T.StringType()), T.StructField("packets", T.LongType()), T.StructField("interval_mean", T.DoubleType()),
    T.StructField("interval_cv", T.DoubleType()), T.StructField("late", T.LongType()), T.StructField("last_ms", T.LongType()),
    T.StructField("closed", T.BooleanType()), T.StructField("step", T.LongType()),
])


class BatchLog:
    """A table below ``path``; ``merge`` sums up rows of several batches, and may be applied to its own results."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], compact_every: int = 32):
        self.spark, self.path, self.schema, self.merge, self.compact_every = spark, path.rstrip("/"), schema, merge, compact_every
        self._folders = Snapshots(spark, self.path)

    def snapshots(self) -> list[int]:
        """The last batch of each snapshot."""
        return self._folders.versions("snapshots")

    def batches(self, after: int, last: int | None = None) -> list[int]:
        return [b for b in self._folders.versions("batches") if b > after and (last is None or b <= last)]

    def folders(self, last: int | None = None) -> list[str]:
        """What a read touches: the newest snapshot and the batches after it."""
        snapshot = max([s for s in self.snapshots() if last is None or s <= last], default=-1)
        found = [f"{self.path}/snapshots/version={snapshot}"] if snapshot >= 0 else []
        return found + [f"{self.path}/batches/version={b}" for b in self.batches(snapshot, last)]

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store a batch, and compact if it is the last of its span."""
        if batch <= max(self.snapshots(), default=-1):
            return  # replayed, and part of a snapshot by now
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/version={batch}")
        if (batch + 1) % self.compact_every == 0:
            self.compact(batch)

    def compact(self, last: int) -> None:
        """Merge all up to batch ``last`` into a snapshot, and drop what the snapshot before held already."""
        before = self.snapshots()
        self._read(self.folders(last)).write.mode("overwrite").parquet(f"{self.path}/snapshots/version={last}")
        if before:
            self._drop([f"snapshots/version={s}" for s in before[:-1]] + [f"batches/version={b}" for b in self.batches(-1, before[-1])])

    def read(self) -> DataFrame:
        return self._read(self.folders())

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*folders))

    def _drop(self, names: list[str]) -> None:
        jvm, settings = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(settings).delete(path, True)


def flow_log(spark: SparkSession, path: str, compact_every: int = 32) -> BatchLog:
    return BatchLog(spark, path, FLOW_EDGES, merge_flow_edges, compact_every)


def cadence_log(spark: SparkSession, path: str, compact_every: int = 32) -> BatchLog:
    """The last change of every endpoint."""
    others = [f.name for f in CADENCE if f.name not in ("ip_address", "step")]

    def last(changes: DataFrame) -> DataFrame:
        newest = changes.groupBy("ip_address").agg(F.max_by(F.struct(*others, "step"), "step").alias("own"))
        return newest.select("ip_address", "own.*")

    return BatchLog(spark, path, CADENCE, last, compact_every)


def keep_flows(packets: DataFrame, log: BatchLog, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Add each batch's flow rows to the log."""
    writer = real_packets(packets).writeStream.foreachBatch(lambda batch, number: log.add(flow_edges(batch), number))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def keep_cadence(packets: DataFrame, log: BatchLog, checkpoint: str, drain: bool = False, **settings) -> StreamingQuery:
    """Add what each batch changes in the cadence of endpoints to the log."""
    writer = endpoint_cadence(real_packets(packets), **settings).writeStream.outputMode("update").foreachBatch(
        lambda batch, number: log.add(batch.withColumn("step", F.lit(number).cast("bigint")), number)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def refreshed_profiles(flows: DataFrame, cadence: DataFrame, metadata: DataFrame) -> DataFrame:
    """Endpoint profiles from the two logs, as ``endpoint_profile`` has them from all packets."""
    timed = cadence.select("ip_address", "interval_mean", "interval_cv")
    return traffic_profile(flows).join(timed, "ip_address", "left").join(metadata, "ip_address", "left").select(
        "ip_address", "org", "hostname", "location", "bytes_out", "packets_out", "out_peers", "out_ports",
        "bytes_in", "packets_in", "in_peers", "in_ports", "protocols", "interval_mean", "interval_cv",
    )
