import numpy as np
import pytest

from peerscope.operators import flows, graph, profiles, reduction, timing
from peerscope.schema import ENDPOINTS, IP_METADATA, PACKETS
from peerscope.sources.packets import real_packets


def packets(spark, rows):
    """Rows (ts_ms, src, dst, dst_port, protocol, size)."""
    return spark.createDataFrame(
        [(i, None, t, s, d, 50000, p, proto, size, None) for i, (t, s, d, p, proto, size) in enumerate(rows)],
        PACKETS,
    )


def metadata(spark, rows=()):
    return spark.createDataFrame(list(rows), IP_METADATA)


def profile_of(spark, rows, ip, owners=()):
    found = profiles.endpoint_profile(packets(spark, rows), metadata(spark, owners))
    return {r["ip_address"]: r for r in found.collect()}[ip]


def test_both_directions(spark):
    rows = [(0, "a", "b", 443, "TLS", 10), (1000, "a", "c", 80, "HTTP", 20), (3000, "b", "a", 22, "SSH", 5)]
    a = profile_of(spark, rows, "a", [("a", "Org", "host", "here")])
    assert (a["bytes_out"], a["packets_out"], a["out_peers"], a["out_ports"]) == (30, 2, 2, [80, 443])
    assert (a["bytes_in"], a["packets_in"], a["in_peers"], a["in_ports"]) == (5, 1, 1, [22])
    assert a["protocols"] == ["HTTP", "SSH", "TLS"]
    assert (a["org"], a["hostname"], a["location"]) == ("Org", "host", "here")
    assert a["interval_mean"] == pytest.approx(1.5) and a["interval_cv"] == pytest.approx(1 / 3)


def test_absent_direction_is_zero_and_empty(spark):
    c = profile_of(spark, [(0, "a", "c", 80, "HTTP", 20)], "c")
    assert (c["bytes_out"], c["packets_out"], c["out_peers"], c["out_ports"]) == (0, 0, 0, [])
    assert c["org"] is None and c["interval_mean"] is None


def test_packet_to_oneself_counts_in_both_directions_but_once_in_time(spark):
    rows = [(0, "a", "a", 80, "HTTP", 7), (1000, "a", "a", 80, "HTTP", 7)]
    a = profile_of(spark, rows, "a")
    assert (a["packets_out"], a["packets_in"], a["out_peers"], a["in_peers"]) == (2, 2, 1, 1)
    assert a["interval_mean"] is None


def test_placeholder_on_one_side_drops_the_packet(spark):
    rows = [(0, "a", "0.0.0.0", 0, "ARP", 7), (1, "0.0.0.0", "b", 0, "ARP", 7), (2, "a", "b", 1, "X", 1)]
    found = profiles.endpoint_profile(packets(spark, rows), metadata(spark)).collect()
    assert {r["ip_address"]: r["packets_out"] + r["packets_in"] for r in found} == {"a": 1, "b": 1}
    assert real_packets(packets(spark, [(0, None, "b", 0, "X", 1)])).count() == 0


def test_twenty_lowest_ports(spark):
    a = profile_of(spark, [(i, "a", "b", 100 - i, "X", 1) for i in range(21)], "a")
    assert a["out_ports"] == list(range(80, 100))


@pytest.mark.parametrize("times,mean,cv", [
    ([0, 1000], None, None),
    ([0, 1000, 3000], 1.5, 1 / 3),
    ([5000, 5000, 5000], None, None),
    ([0, None, 1000], None, None),
    ([0, 1000, None, 3000], 1.5, 1 / 3),
    ([i * 90_000 for i in range(50)], 90.0, 0.0),
    ([1_700_000_000_000 + i * 86_400_000 * 30 for i in range(40)], 2_592_000.0, 0.0),
])
def test_timing(spark, times, mean, cv):
    found = timing.endpoint_timing(packets(spark, [(t, "a", "b", 1, "X", 1) for t in times])).filter(
        "ip_address = 'a'"
    ).collect()[0]
    if mean is None:
        assert found["interval_mean"] is None and found["interval_cv"] is None
    else:
        assert found["interval_mean"] == pytest.approx(mean, rel=1e-12)
        assert found["interval_cv"] == pytest.approx(cv, abs=1e-12)


@pytest.mark.parametrize("slot_ms", [1, 1000, 60_000, 600_000, 10**9])
def test_timing_across_slots_equals_numpy(spark, slot_ms):
    rng = np.random.default_rng(0)
    times = np.sort(rng.integers(0, 30_000_000, 400))
    times[100:140] = times[100] + rng.integers(0, 5, 40).cumsum()
    times = np.sort(times)
    hub = packets(spark, [(int(t), "hub", f"p{i % 7}", 1, "X", 1) for i, t in enumerate(rng.permutation(times))])
    found = {r["ip_address"]: r for r in timing.endpoint_timing(hub, slot_ms).collect()}["hub"]
    gaps = np.diff(times) / 1000.0
    assert found["interval_mean"] == pytest.approx(gaps.mean(), rel=1e-12)
    assert found["interval_cv"] == pytest.approx(gaps.std() / gaps.mean(), rel=1e-12)
    listed = timing.packet_gaps(hub, slot_ms).filter("ip_address = 'hub'").collect()
    assert sum(r["packets"] for r in listed) == 400
    assert sorted(r["gap_ms"] for r in listed if r["gap_ms"] is not None) == sorted(
        np.diff(np.unique(times)).tolist()
    )


def test_profile_from_stored_flows_of_two_captures(spark):
    rows = [(i, "a", f"b{i % 3}", i % 5, "X", i) for i in range(40)]
    both = packets(spark, rows)
    parts = flows.flow_edges(packets(spark, rows[:15])).unionByName(flows.flow_edges(packets(spark, rows[15:])))
    columns = ["ip_address", "bytes_out", "packets_out", "out_peers", "out_ports", "bytes_in", "in_peers"]
    merged = profiles.traffic_profile(flows.merge_flow_edges(parts)).select(columns)
    assert sorted(merged.collect()) == sorted(profiles.traffic_profile(flows.flow_edges(both)).select(columns).collect())


def test_description(spark):
    rows = [(0, "a", "b", 443, "TLS", 10), (1, "a", "b", 80, "HTTP", 5)]
    found = profiles.endpoint_profile(packets(spark, rows), metadata(spark, [("a", "Org", None, "x,y")]))
    text = {r["ip_address"]: r["description"] for r in reduction.with_description(found).collect()}
    assert text["a"] == (
        "IP: a | Organization: Org | Hostname: None | Location: x,y\n"
        "Outbound: 15 bytes, 2 packets to 1 peers | Ports: [80, 443]\n"
        "Inbound: 0 bytes, 0 packets from 0 peers | Ports: []\n"
        "Protocols: ['HTTP', 'TLS']\n"
    )


def endpoint(ip, bytes_out, outlier):
    return (ip, None, None, None, bytes_out, 1, 1, [], 0, 0, 0, [], [], None, None, None, outlier, None)


def test_endpoint_upsert_keeps_the_verdict(spark):
    old = spark.createDataFrame([endpoint("a", 1, True), endpoint("b", 2, False)], ENDPOINTS)
    new = spark.createDataFrame([endpoint("a", 9, None), endpoint("c", 3, None), endpoint("x", 4, None)], ENDPOINTS)
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "ip_address string")
    rows = profiles.upsert_endpoints(old, new, known).collect()
    assert sorted((r["ip_address"], r["bytes_out"], r["outlier"]) for r in rows) == [
        ("a", 9, True), ("b", 2, False), ("c", 3, None),
    ]


def test_verdicts_are_three_state(spark):
    stored = spark.createDataFrame([endpoint("a", 1, True), endpoint("b", 1, None), endpoint("c", 1, True)], ENDPOINTS)
    verdicts = spark.createDataFrame([("a", False), ("b", True)], "ip_address string, is_outlier boolean")
    rows = profiles.write_verdicts(stored, verdicts).collect()
    assert {r["ip_address"]: r["outlier"] for r in rows} == {"a": False, "b": True, "c": True}


def test_graph_nodes_and_edges(spark):
    rows = packets(spark, [(0, "a", "b", 80, "X", 1), (1, "b", "a", 50000, "X", 1), (2, "a", "a", 80, "X", 1)])
    assert {r[0] for r in graph.ip_nodes(rows).collect()} == {"a", "b"}
    assert graph.packet_edges(rows).count() == 6
    assert {tuple(r) for r in graph.port_nodes(rows).collect()} == {("a", 50000), ("a", 80), ("b", 80), ("b", 50000)}
