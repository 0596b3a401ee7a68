import datetime

import pytest
from pyspark.sql import functions as F

from harness import tables
from peerscope.plans import detection, views
from peerscope.schema import ENDPOINTS, IP_METADATA, PACKETS
from peerscope.session import materialize


def stamp(minute):
    return datetime.datetime(2024, 1, 1, 12, minute)


def stored(spark, rows):
    return spark.createDataFrame(
        [(ip, org, None, None, 1, 1, 1, [80], 0, 0, 0, [], ["X"], None, None, None, None, at) for ip, org, at in rows],
        ENDPOINTS,
    )


def packets(spark, rows):
    return spark.createDataFrame(
        [(i, stamp(0) + datetime.timedelta(seconds=t), 0, s, d, sp, dp, proto, size, None)
         for i, (t, s, d, sp, dp, proto, size) in enumerate(rows)], PACKETS
    )


def test_fetch_traffic_takes_recent_profiles_newest_first(spark):
    table = stored(spark, [("a", None, stamp(0)), ("b", "Own", stamp(1)), ("c", None, stamp(30)), ("d", None, stamp(30))])
    metadata = spark.createDataFrame([("b", "Other", "h", "l"), ("c", "Owner", "h", "l")], IP_METADATA)
    as_of = F.lit(stamp(59)) + F.expr("INTERVAL 1 MINUTE")
    rows = views.fetch_traffic(table, metadata, as_of=as_of).collect()
    # The profile of minute 0 is exactly 60 minutes old and left out.
    assert [(r["ip_address"], r["org"]) for r in rows] == [("c", "Owner"), ("d", None), ("b", "Own")]
    assert views.fetch_traffic(table, metadata, limit=1, as_of=as_of).count() == 1
    assert views.fetch_traffic(table, metadata).count() == 0


ROWS = [
    (0, "a", "b", 50000, 443, "TLS", 10), (1, "b", "a", 443, 50000, "TLS", 30), (2, "a", "a", 1, 2, "", 5),
    (3, "a", "0.0.0.0", 0, 0, "ARP", 1), (4, "c", "b", 9, 9, "X", 99),
]


def test_drill_down(spark):
    seen, table = packets(spark, ROWS), stored(spark, [("a", None, stamp(0))])
    metadata = spark.createDataFrame([("a", "Org", "h", "l"), ("b", "Peer", "ph", "pl")], IP_METADATA)
    assert views.inspect_profile(table, metadata, "a").first()["org"] == "Org"
    assert views.inspect_profile(table, metadata, "b").count() == 0
    totals = views.inspect_totals(seen, table, "a").first()
    assert (totals["packets"], totals["peers"], totals["found"]) == (4, 3, True)
    peers = views.inspect_peers(seen, metadata, "a").collect()
    assert [(r["peer_ip"], r["peer_org"], r["bytes_out"], r["packets_out"], r["bytes_in"], r["packets_in"],
             r["bytes_total"], r["protocols"], r["ports"]) for r in peers] == [
        ("b", "Peer", 10, 1, 30, 1, 40, ["TLS"], [443, 50000]),
        ("a", "Org", 5, 1, 0, 0, 5, [], [1, 2]),
        ("0.0.0.0", None, 1, 1, 0, 0, 1, ["ARP"], []),
    ]
    assert views.inspect_peers(seen, metadata, "a", limit=1).count() == 1
    latest = views.inspect_packets(seen, "a", limit=2).collect()
    assert [r["protocol"] for r in latest] == ["ARP", ""]


@pytest.mark.parametrize("ip,found", [("nobody", False), ("p", True)])
def test_totals_of_an_address_without_packets(spark, ip, found):
    totals = views.inspect_totals(packets(spark, ROWS), stored(spark, [("p", None, stamp(0))]), ip).first()
    assert (totals["packets"], totals["peers"], totals["found"]) == (0, 0, found)


def test_port_size_summary(spark):
    rows = views.port_size_summary(packets(spark, ROWS)).filter("port = 443").collect()
    assert sorted((r["direction"], r["packets"], r["bytes"], r["largest"]) for r in rows) == [
        ("dst", 1, 10, 10), ("src", 1, 30, 30),
    ]


def test_enrichment_step(spark):
    addresses = spark.createDataFrame([("a",), ("b",), ("c",)], "ip_address string")
    metadata = spark.createDataFrame([("a", "Org", None, None)], IP_METADATA)
    records = spark.createDataFrame([("b", '{"org": "New"}')], "ip_address string, record string")
    new, summary = detection.document_organizations(addresses, metadata, records)
    assert tuple(summary.first()) == (2, 1) and new.count() == 2


def test_whole_run(spark, sf_dir):
    seen, metadata = tables.stored_packets(spark, sf_dir), tables.ip_metadata(spark, sf_dir)
    endpoints, summary = detection.profile_endpoints(seen, metadata)
    assert tuple(summary.first()) == (102, 1000)
    result = detection.detect_anomalies(endpoints, metadata, seen, components=1)
    row = result.summary.first()
    assert (row["endpoints_clustered"], row["excluded_local"]) == (101, 1)
    assert (row["components"], row["min_samples"], row["eps_source"]) == (2, 4, "auto")
    scores = [r["anomaly_score"] for r in result.endpoints.collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) == 101
    assert result.verdicts.filter("is_outlier").count() == row["outliers_flagged"]
    assert result.labels.filter("cluster = -1").count() == row["outliers_flagged"]
    assert result.scatter.count() == 101 and result.curve.count() == 101
    assert row["destinations_ranked"] == 47
    fixed = detection.detect_anomalies(endpoints, metadata, seen, eps=0.5, include_local=True).summary.first()
    assert (fixed["eps"], fixed["eps_source"], fixed["knee_index"]) == (0.5, "override", None)
    assert (fixed["endpoints_clustered"], fixed["excluded_local"]) == (102, 0)


def test_too_few_endpoints_are_ranked_without_a_verdict(spark):
    seen = packets(spark, ROWS)
    metadata = spark.createDataFrame([], IP_METADATA)
    endpoints, _ = detection.profile_endpoints(seen, metadata)
    result = detection.detect_anomalies(endpoints, metadata, seen)
    assert result.labels is None and result.summary.first()["eps"] is None
    assert {r["is_outlier"] for r in result.endpoints.collect()} == {None}
    assert result.destinations.count() == 0


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packet_paths_stay_out_of_python_and_read_few_columns(spark):
    from peerscope.operators import flows, profiles, timing
    seen = materialize(packets(spark, ROWS), "packets")
    for df in (profiles.traffic_profile(flows.flow_edges(seen)), timing.endpoint_timing(seen), timing.packet_gaps(seen)):
        plan = physical_plan(df)
        assert "Python" not in plan and "payload" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = physical_plan(views.inspect_packets(seen, "a"))
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [Or(EqualTo(src_ip,a),EqualTo(dst_ip,a))]" in plan


def test_two_runs_write_back(spark, sf_dir, tmp_path):
    from peerscope.sources.snapshots import Snapshots

    store = Snapshots(spark, str(tmp_path / "store"))
    store.write("metadata", tables.ip_metadata(spark, sf_dir))
    seen = materialize(tables.packets(spark, sf_dir), "packets")
    halves = [seen.filter("packet_id % 2 = 0"), seen.filter("packet_id % 2 = 1 AND src_ip < '10.0.0.3'")]
    one = detection.store_endpoints(store, halves[0])
    assert one.first()["packets"] == halves[0].count()
    detection.store_endpoints(store, halves[0])  # a repeat changes nothing
    first = {r["ip_address"]: r for r in store.read("endpoints", ENDPOINTS).collect()}
    flags = spark.createDataFrame([(ip, k % 3 == 0) for k, ip in enumerate(sorted(first)) if k % 4], "ip_address string, is_outlier boolean")
    detection.store_verdicts(store, flags)
    verdicts = {r["ip_address"]: r["is_outlier"] for r in flags.collect()}
    detection.store_endpoints(store, halves[1])
    second = {r["ip_address"]: r for r in store.read("endpoints", ENDPOINTS).collect()}
    touched = {r[0] for r in halves[1].select(F.explode(F.array("src_ip", "dst_ip"))).filter("col != '0.0.0.0'").distinct().collect()}
    assert set(second) == set(first) | touched
    for ip, row in second.items():
        assert row["outlier"] == verdicts.get(ip)
        if ip not in touched:
            assert [row[c] for c in ("bytes_out", "in_peers", "interval_mean")] == [first[ip][c] for c in ("bytes_out", "in_peers", "interval_mean")]
    found = detection.run_detection(store, seen, block_rows=48)
    scored = {r["ip_address"]: r["is_outlier"] for r in found.verdicts.collect()}
    third = {r["ip_address"]: r["outlier"] for r in store.read("endpoints", ENDPOINTS).collect()}
    assert third == {ip: scored.get(ip, second[ip]["outlier"]) for ip in second}


def test_ablation_of_too_few_endpoints(spark):
    from peerscope.operators import evaluation

    data = spark.createDataFrame([("a",), ("b",)], "ip_address string")
    found = evaluation.ablation(data)
    assert [tuple(r)[1:] for r in found.summary.collect()] == [(None,) * 5] * 3
    assert found.outliers.count() == 0 and {r["jaccard"] for r in found.agreement.collect()} == {1.0}
