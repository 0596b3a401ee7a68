"""Sketches stay within their stated error, however they were merged."""

import random

from pyspark.sql import functions as F

from harness import tables
from peerscope.sources.packets import real_packets
from peerscope.streaming import sketches

RANKS = {"low": 0.1, "middle": 0.5, "high": 0.99}


def made(spark, rows):
    """``(seconds, src_ip, dst_ip, size)`` as packets."""
    schema = "seconds long, src_ip string, dst_ip string, size long"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("seconds"))


def test_many_peers_and_sizes_within_the_stated_error(spark):
    """A hub with 60 000 peers; eight windows of it are merged."""
    n = 60_000
    packets = spark.range(n * 3).select(
        F.timestamp_seconds(F.col("id") % 8 * 3600).alias("ts"), F.lit("hub").alias("src_ip"),
        (F.col("id") % n).cast("string").alias("dst_ip"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("size"),
    )
    stored = sketches.endpoint_sketches(packets, "1 hour").filter("ip_address = 'hub'")
    assert stored.count() == 8
    merged = sketches.sketches_between(stored)
    found = sketches.estimates(merged, RANKS).first()
    assert found["packets"] == n * 3 and found["in_peers"] == 0
    assert abs(found["out_peers"] - n) <= 3 * 0.016 * n
    assert len(merged.first()["out_peers"]) < 8192 and len(merged.first()["sizes"]) < 16384
    for name, rank in RANKS.items():
        below, upto = packets.agg(F.avg((F.col("size") < found[name]).cast("int")), F.avg((F.col("size") <= found[name]).cast("int"))).first()
        assert below - 0.0165 <= rank <= upto + 0.0165


def test_any_range_equals_exact_counts(spark, sf_dir):
    """Counts this small are exact; the range leaves out the first and the last windows."""
    packets = real_packets(tables.packets(spark, sf_dir))
    first, end = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    stored = sketches.endpoint_sketches(packets, "1 day")
    fresh = sketches.estimates(sketches.sketches_between(sketches.endpoint_sketches(packets.filter((F.col("ts") >= first) & (F.col("ts") < end)), "1 hour")))
    assert fresh.exceptAll(sketches.estimates(sketches.sketches_between(stored, first, end))).isEmpty()
    exact = packets.filter((F.col("ts") >= first) & (F.col("ts") < end)).groupBy(F.col("src_ip").alias("ip_address")).agg(
        F.count_distinct("dst_ip").alias("out_peers")
    )
    assert exact.count() > 0
    assert exact.exceptAll(fresh.select("ip_address", "out_peers")).isEmpty()


def test_merging_in_any_order_gives_the_same_counts(spark, tmp_path):
    chance = random.Random(5)
    rows = [(chance.randrange(7200), f"a{chance.randrange(3)}", f"b{chance.randrange(40)}", chance.randrange(1500)) for _ in range(900)]
    log = sketches.sketch_log(spark, str(tmp_path / "log"), 2)
    for batch in range(3):
        log.add(sketches.endpoint_sketches(made(spark, rows[batch::3]), "1 hour"), batch)
        log.add(sketches.endpoint_sketches(made(spark, rows[batch::3]), "1 hour"), batch)  # replayed
    whole = sketches.estimates(sketches.endpoint_sketches(made(spark, rows), "1 hour"))
    kept = sketches.estimates(log.read())
    assert sorted(kept.collect()) == sorted(whole.collect())


def test_odd_packets(spark):
    """No time, no size, to oneself, and no packets at all."""
    rows = [(None, "a", "b", 1), (1, "a", "a", 7), (2, "a", "b", None)]
    found = {r["ip_address"]: r for r in sketches.estimates(sketches.sketches_between(sketches.endpoint_sketches(made(spark, rows), "1 hour")), RANKS).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["packets"], found["a"]["bytes"], found["a"]["out_peers"], found["a"]["in_peers"]) == (2, 7, 2, 1)
    assert found["a"]["middle"] == 7
    assert (found["b"]["packets"], found["b"]["bytes"], found["b"]["middle"]) == (1, 0, None)
    assert sketches.endpoint_sketches(made(spark, []), "1 hour").isEmpty()
