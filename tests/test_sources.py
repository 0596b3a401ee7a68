import datetime
import struct

import pytest

from harness import tables
from peerscope.schema import ENDPOINTS, IP_METADATA, PACKETS, RAW_PACKETS
from peerscope.sources import captures, ownership, packets
from peerscope.sources.snapshots import Snapshots


def raw(spark, **fields):
    names = RAW_PACKETS.fieldNames()
    row = dict.fromkeys(names) | {
        "packet_id": 1, "ts": datetime.datetime(2024, 1, 1, 0, 0, 0, 1999), "highest_layer": "X", "frame_length": 60,
    }
    return spark.createDataFrame([tuple((row | fields)[n] for n in names)], RAW_PACKETS)


def test_packet_without_ip_or_ports(spark):
    row = packets.normalize(raw(spark)).first()
    assert (row["src_ip"], row["dst_ip"], row["src_port"], row["dst_port"]) == ("0.0.0.0", "0.0.0.0", 0, 0)
    assert row["payload"] is None and row["ts_ms"] % 1000 == 1


def test_tcp_wins_over_udp(spark):
    row = packets.normalize(raw(
        spark, tcp_srcport="1", tcp_dstport="2", tcp_payload="aa", udp_srcport="3", udp_dstport="4", udp_payload="bb"
    )).first()
    assert (row["src_port"], row["dst_port"], row["payload"]) == (1, 2, "aa")
    row = packets.normalize(raw(spark, udp_srcport="3", udp_dstport="4", udp_payload="bb")).first()
    assert (row["src_port"], row["dst_port"], row["payload"]) == (3, 4, "bb")


@pytest.mark.parametrize("text,port", [("443", 443), ("https", 0), ("", 0), ("-1", 0), ("99999999999", 0), (" 80", 0)])
def test_port_text(spark, text, port):
    assert packets.normalize(raw(spark, tcp_srcport=text, tcp_dstport="1")).first()["src_port"] == port


def test_flow_line(spark):
    flat = packets.normalize(raw(spark, ip_src="a", ip_dst="b", tcp_srcport="1", tcp_dstport="2"))
    assert packets.with_flow_line(flat).first()["flow"] == "a:1 ➜ X(60) ➜ b:2"


def test_packet_table_round_trip(spark, tmp_path):
    flat = packets.normalize(raw(spark, ip_src="a", ip_dst="b"))
    path = str(tmp_path / "packets")
    packets.append_packets(flat, path)
    packets.append_packets(flat, path)
    stored = packets.read_packets(spark, path)
    assert stored.count() == 2
    assert stored.filter("day = '2024-01-01'").drop("day").first() == flat.first()


def frame(body, protocol=6, kind=0x0800, src=(10, 0, 0, 1), dst=(10, 0, 0, 2), vlan=False):
    ip = struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0, *src, *dst)
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return bytes(12) + tag + struct.pack(">H", kind) + (ip + body if kind == 0x0800 else body)


def tcp(sport, dport, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0, 0, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


IPV6 = struct.pack(">IHBB", 0x60000000, 8, 17, 64) + bytes(32) + struct.pack(">HHHH", 5, 53, 8, 0)
FRAMES = [
    (frame(tcp(50000, 443, b"\x17\x03")), "TLS", "10.0.0.1", 50000, 443, "17:03"),
    (frame(tcp(50000, 443)), "TCP", "10.0.0.1", 50000, 443, None),
    (frame(udp(53, 40000, b"\x01"), protocol=17, vlan=True), "DNS", "10.0.0.1", 53, 40000, "01"),
    (frame(tcp(1111, 2222, b"z")), "DATA", "10.0.0.1", 1111, 2222, "7a"),
    (frame(b"\x08\x00" + bytes(6), protocol=1), "ICMP", "10.0.0.1", 0, 0, None),
    (frame(bytes(28), kind=0x0806), "ARP", "0.0.0.0", 0, 0, None),
    (frame(IPV6, kind=0x86DD), "UDP", "0.0.0.0", 5, 53, None),
]


def pcap(order="<", magic=0xA1B2C3D4, scale=1):
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, (body, *_) in enumerate(FRAMES):
        data += struct.pack(order + "IIII", 1000 + i, 250 * scale, len(body), len(body) + 4) + body
    return data


def pcapng():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        size = struct.pack("<I", 12 + len(body))
        return struct.pack("<I", kind) + size + body + size

    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    data += block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for i, (body, *_) in enumerate(FRAMES):
        ticks = (1000 + i) * 10**9 + 250_000
        data += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(body), len(body) + 4) + body)
    return data


@pytest.mark.parametrize("content", [
    pcap(), pcap(">"), pcap("<", 0xA1B23C4D, 1000), pcapng(),
], ids=["little", "big", "nanoseconds", "pcapng"])
def test_capture_files(spark, tmp_path, content):
    (tmp_path / "one.pcap").write_bytes(content)
    rows = packets.normalize(captures.read_captures(spark, str(tmp_path))).orderBy("ts").collect()
    found = [(r["protocol"], r["src_ip"], r["src_port"], r["dst_port"], r["payload"]) for r in rows]
    assert found == [(name, src, sport, dport, payload) for _, name, src, sport, dport, payload in FRAMES]
    assert [r["size"] for r in rows] == [len(body) + 4 for body, *_ in FRAMES]
    assert [r["ts_ms"] for r in rows] == [(1000 + i) * 1000 for i in range(len(FRAMES))]
    assert len({r["packet_id"] for r in rows}) == len(rows)


def test_truncated_capture_keeps_whole_packets(spark, tmp_path):
    (tmp_path / "cut.pcap").write_bytes(pcap()[:-3])
    (tmp_path / "cut.pcapng").write_bytes(pcapng()[:-3])
    (tmp_path / "empty.pcap").write_bytes(pcap()[:24])
    assert captures.read_captures(spark, str(tmp_path)).count() == 2 * (len(FRAMES) - 1)


@pytest.mark.parametrize("record,org", [
    ('{"org": "A", "company": {"name": "B"}}', "A"),
    ('{"company": {"name": "B"}, "asn": {"name": "C"}}', "B"),
    ('{"asn": {"name": "C"}}', "C"),
    ('{"hostname": "h"}', "Unknown"),
])
def test_owner_name(spark, record, org):
    rows = ownership.resolve_records(spark.createDataFrame([("a", record)], "ip_address string, record string"))
    row = rows.first()
    assert row["org"] == org and row["location"] == "Unknown"


def test_one_owner_prefers_the_local_org(spark):
    owners = spark.createDataFrame([("a", "Zed"), ("a", "Alpha"), ("b", "Beta")], "ip_address string, org string")
    seeded = ownership.seed_local_host(ownership.seed_local_host(owners, "b"), "c")
    best = {r["ip_address"]: r["org"] for r in ownership.one_owner(seeded).collect()}
    assert best == {"a": "Alpha", "b": "YOU ARE HERE", "c": "YOU ARE HERE"}


def test_enrichment_adds_only_resolved_addresses(spark):
    addresses = spark.createDataFrame([("a",), ("b",), ("c",)], "ip_address string")
    metadata = spark.createDataFrame([("a", "Org", "h", "l"), ("b", None, "h", "l")], IP_METADATA)
    records = spark.createDataFrame(
        [("a", '{"org": "Other"}'), ("b", '{"org": "New"}')], "ip_address string, record string"
    )
    missing = ownership.undocumented(addresses, metadata)
    assert {r[0] for r in missing.collect()} == {"b", "c"}
    result = ownership.upsert_metadata(metadata, ownership.enrich(missing, records)).collect()
    assert {r["ip_address"]: r["org"] for r in result} == {"a": "Org", "b": "New"}


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "tables"))
    assert store.read("endpoints", ENDPOINTS).count() == 0
    first = spark.createDataFrame([("a", "A", None, None)], IP_METADATA)
    store.write("metadata", first, sort_by="ip_address")
    again = store.read("metadata", IP_METADATA)
    store.write("metadata", again.unionByName(first))
    assert store.read("metadata", IP_METADATA).count() == 2
    (tmp_path / "tables/metadata/version=3").mkdir()
    assert store.versions("metadata") == [1, 2]
    tables = {"metadata": IP_METADATA, "endpoints": ENDPOINTS}
    with pytest.raises(ValueError):
        store.wipe(tables, confirm="other")
    assert store.wipe(tables, confirm=store.root) == {"dropped": 2, "empty": False}
    assert store.wipe(tables, confirm=store.root) == {"dropped": 0, "empty": True}


def test_packets_are_dissected_in_parts(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(captures, "FRAMES_AT_ONCE", 3)
    files = pd.DataFrame({"path": ["one"], "content": [pcap()]})
    parts = list(captures._decode_files(iter([files])))
    assert [len(p) for p in parts] == [3, 3, 1]
    assert pd.concat(parts)["record"].tolist() == list(range(len(FRAMES)))


def one_packet(link, body, length=None):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return head + struct.pack("<IIII", 1000, 0, len(body), length or len(body)) + body


def ipv4(transport, protocol=6, fragment=0, total=None):
    total = 20 + len(transport) if total is None else total
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, total, 0, fragment, 64, protocol, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + transport


def ipv6(following, first):
    return struct.pack(">IHBB", 0x60000000, len(following), first, 64) + bytes(32) + following


TLS = tcp(50000, 443, b"\x17")
SEEN = ("TLS", 50000, 443)


@pytest.mark.parametrize("link,body,found", [
    (0, struct.pack("<I", 2) + ipv4(TLS), SEEN),
    (0, struct.pack(">I", 2) + ipv4(TLS), SEEN),
    (0, struct.pack("<I", 30) + ipv6(udp(5, 53, b"x"), 17), ("DNS", 5, 53)),
    (108, struct.pack(">I", 2) + ipv4(TLS), SEEN),
    (113, bytes(14) + b"\x08\x00" + ipv4(TLS), SEEN),
    (276, b"\x08\x00" + bytes(18) + ipv4(TLS), SEEN),
    (1, bytes(12) + b"\x88\xa8\x00\x01\x81\x00\x00\x02\x08\x00" + ipv4(TLS), SEEN),
    (101, ipv4(b"AABBCCDD", fragment=100), ("IP", 0, 0)),
    (101, ipv4(TLS, fragment=0x2000), SEEN),
    (101, ipv4(TLS, total=0), SEEN),
    (101, ipv6(bytes([60, 0]) + bytes(6) + bytes([17, 0]) + bytes(6) + udp(5, 53, b"x"), 0), ("DNS", 5, 53)),
    (101, ipv6(bytes([17, 0, 0, 8]) + bytes(4) + b"ABCDEFGH", 44), ("IPV6", 0, 0)),
], ids=["loopback", "loopback big", "loopback v6", "loop", "cooked", "cooked 2", "two tags", "later fragment",
        "first fragment", "no length", "extensions", "later v6 fragment"])
def test_link_types_and_headers(spark, tmp_path, link, body, found):
    (tmp_path / "one.pcap").write_bytes(one_packet(link, body))
    (row,) = packets.normalize(captures.read_captures(spark, str(tmp_path))).collect()
    assert (row["protocol"], row["src_port"], row["dst_port"]) == found


def test_simple_and_old_packet_blocks():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        size = struct.pack("<I", 12 + len(body))
        return struct.pack("<I", kind) + size + body + size

    body = ipv4(TLS)
    content = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0))
    content += block(3, struct.pack("<I", len(body)) + body) + block(5, bytes(12))
    content += block(2, struct.pack("<HHIIII", 0, 0, 0, 7, len(body), len(body)) + body)
    simple, old = captures._frames(content)
    assert content[simple[0]:simple[0] + simple[1]] == body == content[old[0]:old[0] + old[1]]
    assert simple[3] == captures.NO_TIME and old[3] == 7


def test_a_bad_length_fails_the_read(spark, tmp_path):
    good = one_packet(101, ipv4(TLS))
    (tmp_path / "bad.pcap").write_bytes(good + struct.pack("<IIII", 1, 0, 1 << 30, 60) + good[24:])
    with pytest.raises(Exception, match="bad.pcap.*claims 1073741824 bytes"):
        captures.read_captures(spark, str(tmp_path)).count()


def test_enrichment_does_not_depend_on_order(spark):
    records = [("a", '{"org": "B", "hostname": "x"}'), ("a", '{"org": "A", "hostname": "z"}')]
    for rows in (records, records[::-1]):
        missing = spark.createDataFrame([("a",)], "ip_address string")
        (row,) = ownership.enrich(missing, spark.createDataFrame(rows, "ip_address string, record string")).collect()
        assert (row["org"], row["hostname"]) == ("A", "z")


def test_two_writers_never_share_a_version(spark, tmp_path):
    first, second = (Snapshots(spark, str(tmp_path / "tables")) for _ in range(2))
    assert first.claim("t") == 1
    assert second.write("t", spark.range(2)) == 2  # the first has claimed 1 and is not done
    assert second.versions("t") == [2]
    assert first.write("t", spark.range(3)) == 3
    assert second.read("t", spark.range(1).schema).count() == 3


def test_a_number_taken_meanwhile_is_skipped(spark, tmp_path, monkeypatch):
    """The listing is from before the other writer's claim."""
    store, other = (Snapshots(spark, str(tmp_path / "tables")) for _ in range(2))
    assert other.claim("t") == 1
    monkeypatch.setattr(store, "_numbers", lambda name, complete: [])
    assert store.claim("t") == 2


def test_retain_keeps_the_newest(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "tables"))
    for n in range(4):
        store.write("t", spark.range(n))
    assert store.retain("t", 2) == [1, 2] and store.versions("t") == [3, 4]
    assert store.retain("t", 2) == [] and store.retain("empty") == []
    assert store.write("t", spark.range(1)) == 5
    with pytest.raises(ValueError):
        store.retain("t", 0)


def test_retried_batch_changes_nothing(spark, sf_dir, tmp_path):
    path = str(tmp_path / "packets")
    flat = packets.normalize(tables.raw_packets(spark, sf_dir))
    assert packets.read_batches(spark, path).isEmpty()
    for batch in (0, 1, 1):
        packets.append_batch(flat.filter(f"packet_id % 2 = {batch}"), path, batch)
    assert packets.read_batches(spark, path).drop("day").exceptAll(flat).isEmpty()
    assert packets.read_batches(spark, path).count() == flat.count()
    # A job that died leaves no _SUCCESS: its batch does not count until it is given again.
    (tmp_path / "packets/batches/version=1/_SUCCESS").unlink()
    assert packets.read_batches(spark, path).filter("packet_id % 2 = 1").isEmpty()
    packets.append_batch(flat.filter("packet_id % 2 = 1"), path, 1)
    assert packets.read_batches(spark, path).count() == flat.count()


def test_derived_addresses_beyond_one_octet_pass_through_captures(spark):
    """Large tables have more users than 10.0.0.0/16 has addresses; frames hold them and give them back."""
    wanted = [(1, 0, 3), (2, 63_999, 64_000), (3, 90_123, 5_000_000), (499 * 200 + 7, 4, 1), (499 * 70_000 + 7, 5, 2), (50, 9, 9)]
    rows = [(i, datetime.datetime(2024, 1, 1, 0, 0, n), user, "view", 1.0, f'{{"k": {k}}}')
            for n, (i, user, k) in enumerate(wanted)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    flat = tables.packet_rows(events).select(PACKETS.fieldNames())
    decoded = packets.normalize(captures.decode_captures(flat.coalesce(1).mapInPandas(tables._encode, "path string, content binary")))
    found = tables.with_derived_addresses(decoded)
    fields = ["ts_ms", "src_ip", "dst_ip"]
    assert sorted(map(tuple, found.select(fields).collect())) == sorted(map(tuple, flat.select(fields).collect()))
    assert found.filter("dst_ip = '10.9.0.70000' OR src_ip = '10.0.360.124'").count() == 2


@pytest.mark.parametrize("ip", ["10.0.1.256", "10.9.1.300", "11.0.0.256", "250.1.1.1"])
def test_an_address_without_a_place_is_refused(ip):
    with pytest.raises(ValueError, match="no place"):
        tables.wire_address(ip)
