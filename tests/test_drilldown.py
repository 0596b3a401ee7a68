"""The index gives what the views give, and a lookup reads little of it."""

import pytest
from pyspark.sql import functions as F

from harness import tables
from peerscope.plans import views
from peerscope.sources.drilldown import DrillDown

HOST = "10.0.0.1"


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return tables.stored_packets(spark, sf_dir)


@pytest.fixture(scope="module")
def index(spark, stored, tmp_path_factory):
    made = DrillDown(spark, str(tmp_path_factory.mktemp("index")), buckets=8)
    for batch in (0, 1, 1):  # the second is written twice
        made.append(stored.filter(F.col("packet_id") % 2 == batch), batch)
    return made


def test_views_agree_for_every_kind_of_address(spark, sf_dir, stored, index):
    endpoints, metadata = tables.endpoints(spark, sf_dir), tables.ip_metadata(spark, sf_dir)
    for ip in (HOST, "0.0.0.0", "10.9.0.1", "192.168.1.1"):
        assert views.indexed_packets(index, ip).collect() == views.inspect_packets(stored, ip).collect()
        assert views.indexed_peers(index, metadata, ip).collect() == views.inspect_peers(stored, metadata, ip).collect()
        assert views.indexed_totals(index, endpoints, ip).collect() == views.inspect_totals(stored, endpoints, ip).collect()


def scanned(df):
    """Metrics of the file scan that ``df`` runs."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    metrics = plan.metrics()
    return {name: metrics.apply(name).value() for name in ("numFiles", "numOutputRows", "numPartitions") if metrics.contains(name)}


def test_a_lookup_reads_one_bucket_and_few_row_groups(spark, tmp_path):
    """200 000 packets of 500 addresses, of which one holds a third."""
    packets = spark.range(200_000).select(
        F.col("id").alias("packet_id"), F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 499).cast("string")).alias("src_ip"),
        F.lit(1).alias("src_port"), F.lit("server").alias("dst_ip"), F.lit(2).alias("dst_port"), F.lit("TLS").alias("protocol"), F.lit(10).cast("long").alias("size"),
    )
    index = DrillDown(spark, str(tmp_path / "index"), buckets=4)
    # So little data would be coalesced into one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.append(packets, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(spark.read.parquet(f"{index.root}/ends").inputFiles())
    lookup = scanned(index.packets_of("7"))
    assert lookup["numPartitions"] == 1 and lookup["numFiles"] < files
    own = packets.filter("src_ip = '7'").count()
    assert index.packets_of("7").count() == own
    # Whole pages around the address are read, not the 400 000 rows of the table.
    assert lookup["numOutputRows"] < 60_000
    # No file gathers the hot address: its rows lie in several.
    hot = index.packets_of("hot").groupBy(F.input_file_name().alias("file")).count().collect()
    assert sum(r["count"] for r in hot) == 66_667
    assert len(hot) > 1 and max(r["count"] for r in hot) < 66_667


def test_packet_to_oneself_and_nulls(spark, tmp_path):
    rows = [(1, "a", "a", 5, 5, "TLS", 10), (2, "a", "b", 0, 0, "", None), (3, "b", "a", 7, 0, None, 4)]
    packets = spark.createDataFrame(rows, "packet_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size long").withColumn(
        "ts", F.timestamp_seconds("packet_id")
    )
    index = DrillDown(spark, str(tmp_path / "index"), buckets=3)
    index.append(packets, 0)
    nobody = spark.createDataFrame([], "ip_address string, org string, hostname string, location string")
    assert [r["timestamp"].second for r in views.indexed_packets(index, "a").collect()] == [3, 2, 1]
    assert views.indexed_peers(index, nobody, "a").collect() == views.inspect_peers(packets, nobody, "a").collect()
    assert index.packets_of("none").isEmpty() and index.conversations_of("none").isEmpty()
