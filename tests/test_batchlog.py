"""Batch logs: compaction, replays, profiles kept current."""

from harness import tables
from peerscope.operators import flows, profiles
from peerscope.sources.packets import real_packets
from peerscope.streaming import batchlog, ingest


def rows(df):
    return sorted(map(str, df.collect()))


def test_compaction_and_replays_change_nothing(spark, sf_dir, tmp_path):
    edges = flows.flow_edges(real_packets(tables.packets(spark, sf_dir)))
    parts = edges.randomSplit([1.0] * 8, seed=3)
    log = batchlog.flow_log(spark, str(tmp_path / "flows"), compact_every=3)
    assert log.read().count() == 0
    for number, part in enumerate(parts):
        log.add(part, number)
        for again in {number, max(number - 3, 0)}:
            log.add(parts[again], again)
        assert len(log.folders()) <= 3
    assert log.snapshots() == [2, 5] and log.batches(-1) == [3, 4, 5, 6, 7]
    assert rows(log.read()) == rows(edges.select(log.read().columns))


def test_a_batch_that_died_is_not_read(spark, sf_dir, tmp_path):
    edges = flows.flow_edges(real_packets(tables.packets(spark, sf_dir)))
    log = batchlog.flow_log(spark, str(tmp_path / "flows"))
    log.add(edges, 0)
    log.add(edges, 1)
    (tmp_path / "flows/batches/version=1/_SUCCESS").unlink()
    assert rows(log.read()) == rows(edges.select(log.read().columns))


def test_profiles_stay_current(spark, sf_dir, tmp_path):
    packets = real_packets(tables.packets(spark, sf_dir)).drop("payload")
    metadata = tables.ip_metadata(spark, sf_dir)
    landing, *paths = (str(tmp_path / n) for n in ("landing", "flows", "cadence", "p1", "p2"))
    edges, changes = batchlog.flow_log(spark, paths[0], 2), batchlog.cadence_log(spark, paths[1], 2)
    middle = packets.approxQuantile("ts_ms", [0.5], 0)[0]
    for part in (packets.filter(f"ts_ms < {middle}"), packets.filter(f"ts_ms >= {middle}")):
        part.coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.watch(spark, landing, packets.schema)
        batchlog.keep_flows(stream, edges, paths[2], drain=True).awaitTermination()
        batchlog.keep_cadence(stream, changes, paths[3], drain=True, timeout_ms=10**12).awaitTermination()
        seen = spark.read.parquet(landing)
        whole = profiles.endpoint_profile(seen, metadata, flows.flow_edges(seen)).drop("interval_mean", "interval_cv")
        fresh = batchlog.refreshed_profiles(edges.read(), changes.read(), metadata)
        assert rows(fresh.drop("interval_mean", "interval_cv")) == rows(whole)
