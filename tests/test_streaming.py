from harness import tables
from peerscope.operators import flows
from peerscope.sources.packets import normalize, read_packets
from peerscope.streaming import ingest


def test_ingest_resumes_where_it_stopped(spark, sf_dir, tmp_path):
    raw = tables.raw_packets(spark, sf_dir)
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "packets", "progress"))

    def drain():
        stream = ingest.watch_raw_packets(spark, landing, files_per_batch=1)
        ingest.ingest_packets(stream, table, progress, drain=True).awaitTermination()
        return read_packets(spark, table)

    early, late = raw.filter("packet_id < 400"), raw.filter("packet_id >= 400")
    early.repartition(2).write.parquet(landing)
    assert drain().count() == 400
    late.repartition(2).write.mode("append").parquet(landing)
    stored = drain()
    assert stored.count() == 1000
    assert stored.drop("day").exceptAll(normalize(raw)).count() == 0


def test_a_replayed_batch_is_counted_once(spark, sf_dir, tmp_path):
    packets = tables.packets(spark, sf_dir).drop("payload")
    landing, table = str(tmp_path / "landing"), str(tmp_path / "flows")
    packets.repartition(3).write.parquet(landing)
    for attempt in ("first", "again"):
        stream = ingest.watch(spark, landing, packets.schema, files_per_batch=1)
        ingest.refresh_flows(stream, table, str(tmp_path / attempt), drain=True).awaitTermination()
    merged = ingest.read_flows(spark, table)
    assert merged.exceptAll(flows.flow_edges(packets)).count() == 0
    assert merged.count() == flows.flow_edges(packets).count()
