"""Capture files (pcap and pcapng) as a distributed packet source.

Each file is one row of Spark's ``binaryFile`` source, so files spread over the
cluster. A file must stay below the 2 GB a binary cell can hold, as rotated
captures do; ``capture_splits`` reads larger ones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECODED = (
    "path string, record long, ts_us long, highest_layer string, ip_src string, ip_dst string, "
    "tcp_srcport string, tcp_dstport string, tcp_payload string, "
    "udp_srcport string, udp_dstport string, udp_payload string, frame_length long"
)

# Names by well-known port. Other packets are named DATA when
# they carry a payload, else after their transport.
PORT_NAMES = {
    22: "SSH", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP",
    123: "NTP", 143: "IMAP", 161: "SNMP", 443: "TLS", 853: "TLS", 1900: "SSDP",
    5353: "MDNS", 8080: "HTTP", 8443: "TLS",
}

# Link types, EtherTypes and IP protocol numbers.
LOOPBACK, ETHERNET, RAW_IP, LOOP, COOKED, COOKED_V2 = 0, 1, 101, 108, 113, 276
IPV4, ARP, IPV6 = 0x0800, 0x0806, 0x86DD
VLANS = [0x8100, 0x88A8, 0x9100]
ICMP, TCP, UDP = 1, 6, 17
HOP_BY_HOP, ROUTING, FRAGMENT, DESTINATION = 0, 43, 44, 60
LOOPBACK_IPV4, LOOPBACK_IPV6 = [2], [10, 24, 28, 30]
# At most so many tags or extension headers are followed.
MOST_TAGS, MOST_EXTENSIONS = 4, 8
# No capture cuts packets at more than this, whatever its header says.
MOST_CAPTURED = 262_144
# The time of a packet that the file gives none for.
NO_TIME = -1
# Packets dissected together; bounds what a task holds beside the file itself.
FRAMES_AT_ONCE = 50_000


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All capture files below ``path`` as raw packets with the capture's own time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_captures(files)


def decode_captures(files: DataFrame) -> DataFrame:
    """Rows ``(path, content)`` to raw packets.

    ``packet_id`` only breaks ties between packets of the same time. A file that
    ends inside a packet gives the packets before; one with an impossible length
    in it fails the read, since what follows cannot be trusted.
    """
    return packets_of(files.select("path", "content").mapInPandas(_decode_files, DECODED))


def packets_of(decoded: DataFrame) -> DataFrame:
    """:data:`DECODED` rows as raw packets."""
    return decoded.select(
        F.xxhash64("path", "record").alias("packet_id"),
        F.when(F.col("ts_us") != NO_TIME, F.timestamp_micros("ts_us")).alias("ts"),
        "highest_layer", "ip_src", "ip_dst",
        "tcp_srcport", "tcp_dstport", "tcp_payload",
        "udp_srcport", "udp_dstport", "udp_payload",
        "frame_length",
    )


def _decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            frames, done = _named(path, _frames(content)), 0
            while part := list(islice(frames, FRAMES_AT_ONCE)):
                yield dissect_frames(path, content, np.array(part, dtype=np.int64), done)
                done += len(part)


def _named(path: str, frames: Iterator[tuple]) -> Iterator[tuple]:
    """``frames``, with the file in any error."""
    try:
        yield from frames
    except (ValueError, IndexError, struct.error) as error:
        raise ValueError(f"{path}: {error}") from error


def _frames(content: bytes) -> Iterator[tuple]:
    """(offset, captured, length, time in us, link type) of each frame."""
    magic = content[:4]
    if magic == b"\x0a\x0d\x0d\x0a":
        return _pcapng_frames(content)
    if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1"):
        return _pcap_frames(content, "<", 1 if magic[0] == 0xD4 else 1000)
    if magic in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        return _pcap_frames(content, ">", 1 if magic[2] == 0xC3 else 1000)
    raise ValueError("not a pcap or pcapng file")


def _pcap_frames(content: bytes, order: str, ticks_per_us: int) -> Iterator[tuple]:
    longest, link = struct.unpack_from(order + "II", content, 16)
    longest, link = max(longest, MOST_CAPTURED), link & 0xFFFF
    header = struct.Struct(order + "IIII")
    at = 24
    while at + 16 <= len(content):
        seconds, fraction, captured, length = header.unpack_from(content, at)
        if captured > longest:
            raise ValueError(f"record at byte {at} claims {captured} bytes")
        if at + 16 + captured > len(content):
            break  # the capture was cut off inside this packet
        yield at + 16, captured, length, seconds * 1_000_000 + fraction // ticks_per_us, link
        at += 16 + captured


def _pcapng_frames(content: bytes) -> Iterator[tuple]:
    order, at, interfaces = "<", 0, []
    while at + 12 <= len(content):
        kind = struct.unpack_from(order + "I", content, at)[0]
        if kind == 0x0A0D0D0A:
            order = "<" if content[at + 8:at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        size = struct.unpack_from(order + "I", content, at + 4)[0]
        if size < 12 or size % 4:
            raise ValueError(f"block at byte {at} claims {size} bytes")
        if at + size > len(content):
            break  # the capture was cut off inside this block
        if kind == 1:
            link, longest = struct.unpack_from(order + "HxxI", content, at + 8)
            interfaces.append((link, _ticks_per_second(content, order, at + 16, at + size - 4), longest or MOST_CAPTURED))
        elif kind == 6:
            interface, high, low, captured, length = struct.unpack_from(order + "IIIII", content, at + 8)
            link, ticks, _ = interfaces[interface]
            yield at + 28, _fitting(captured, size - 32, at), length, ((high << 32) | low) * 1_000_000 // ticks, link
        elif kind == 2:  # the packet block of old files
            interface, high, low, captured, length = struct.unpack_from(order + "HxxIIII", content, at + 8)
            link, ticks, _ = interfaces[interface]
            yield at + 28, _fitting(captured, size - 32, at), length, ((high << 32) | low) * 1_000_000 // ticks, link
        elif kind == 3:  # a simple packet block has no time, and is of the first interface
            length = struct.unpack_from(order + "I", content, at + 8)[0]
            link, _, longest = interfaces[0]
            yield at + 12, min(length, longest, size - 16), length, NO_TIME, link
        at += size


def _fitting(captured: int, room: int, at: int) -> int:
    if captured > room:
        raise ValueError(f"block at byte {at} claims {captured} bytes of packet")
    return captured


def _ticks_per_second(content: bytes, order: str, at: int, end: int) -> int:
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", content, at)
        if code == 9:
            exponent = content[at + 4]
            return 2 ** (exponent & 0x7F) if exponent & 0x80 else 10**exponent
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def dissect_frames(path: str, content: bytes, frames: np.ndarray, first_record: int) -> pd.DataFrame:
    """Header fields of many frames at once."""
    octets = np.frombuffer(content, dtype=np.uint8)
    start, captured, length, time, link = frames.T

    def octet(at: np.ndarray) -> np.ndarray:
        # A cut-off header may point past the end; its fields are not used.
        return octets[np.minimum(at, len(octets) - 1)].astype(np.int64)

    def pair(at: np.ndarray) -> np.ndarray:
        return octet(at) * 256 + octet(at + 1)

    ethernet = link == ETHERNET
    family = np.where(link == LOOPBACK, octet(start) + octet(start + 3), octet(start + 3))  # either byte order
    loop = (link == LOOPBACK) | (link == LOOP)
    # Where the EtherType is, and where what it names begins.
    type_at = start + np.select([ethernet, link == COOKED], [12, 14], 0)
    network = start + np.select([ethernet, loop, link == COOKED, link == COOKED_V2], [14, 4, 16, 20], 0)
    kind = np.where(ethernet | (link == COOKED) | (link == COOKED_V2), pair(type_at), 0)
    for _ in range(MOST_TAGS):
        tagged = np.isin(kind, VLANS)
        kind = np.where(tagged, pair(network + 2), kind)
        network = network + np.where(tagged, 4, 0)
    kind = np.where(loop, np.select([np.isin(family, LOOPBACK_IPV4), np.isin(family, LOOPBACK_IPV6)], [IPV4, IPV6], 0), kind)
    first = octet(network)
    version = first >> 4
    raw = link == RAW_IP
    kind = np.where(raw & (version == 4), IPV4, np.where(raw & (version == 6), IPV6, kind))
    end = start + captured
    is_v4 = (kind == IPV4) & (network + 20 <= end)
    is_v6 = (kind == IPV6) & (network + 40 <= end)

    protocol = np.where(is_v4, octet(network + 9), np.where(is_v6, octet(network + 6), -1))
    transport = network + np.where(is_v4, (first & 15) * 4, 40)
    # Only the first fragment has a transport header.
    later = is_v4 & (pair(network + 6) & 0x1FFF != 0)
    for _ in range(MOST_EXTENSIONS):
        extended = is_v6 & np.isin(protocol, [HOP_BY_HOP, ROUTING, FRAGMENT, DESTINATION]) & (transport + 8 <= end)
        fragment = extended & (protocol == FRAGMENT)
        later |= fragment & (pair(transport + 2) >> 3 != 0)
        step = np.where(fragment, 8, (octet(transport + 1) + 1) * 8)
        protocol = np.where(extended, octet(transport), protocol)
        transport = transport + np.where(extended, step, 0)
    protocol = np.where(later, -1, protocol)
    stated = np.where(is_v4, pair(network + 2), pair(network + 4))
    # The sending host leaves the length 0 where its network card cuts the packet.
    packet_end = np.where(stated == 0, end, network + np.where(is_v4, stated, 40 + stated))
    is_tcp = (protocol == TCP) & (transport + 20 <= end)
    is_udp = (protocol == UDP) & (transport + 8 <= end)
    has_ports = is_tcp | is_udp
    source, target = pair(transport), pair(transport + 2)
    data_offset = octet(transport + 12) >> 4
    body = transport + np.where(is_tcp, data_offset * 4, 8)
    carries = has_ports & (packet_end > body)

    def address(at: np.ndarray) -> list:
        parts = [octet(at + i) for i in range(4)]
        return [
            f"{a}.{b}.{c}.{d}" if ok else None for a, b, c, d, ok in zip(*parts, is_v4)
        ]

    def text(values: np.ndarray, keep: np.ndarray) -> list:
        return [str(v) if k else None for v, k in zip(values, keep)]

    names = [
        _layer_name(k, p, s, t, c)
        for k, p, s, t, c in zip(
            kind.tolist(), np.where(has_ports | (protocol == ICMP), protocol, -1).tolist(),
            source.tolist(), target.tolist(), carries.tolist(),
        )
    ]
    payload = [
        content[b:min(e, p)].hex(":") or None if c else None
        for b, e, p, c in zip(body.tolist(), end.tolist(), packet_end.tolist(), carries.tolist())
    ]
    return pd.DataFrame({
        "path": path,
        "record": first_record + np.arange(len(frames)),
        "ts_us": time,
        "highest_layer": names,
        "ip_src": address(network + 12),
        "ip_dst": address(network + 16),
        "tcp_srcport": text(source, is_tcp),
        "tcp_dstport": text(target, is_tcp),
        "tcp_payload": [p if k else None for p, k in zip(payload, is_tcp)],
        "udp_srcport": text(source, is_udp),
        "udp_dstport": text(target, is_udp),
        "udp_payload": [p if k else None for p, k in zip(payload, is_udp)],
        "frame_length": length,
    })


def _layer_name(kind: int, protocol: int, source: int, target: int, carries: bool) -> str:
    if kind == ARP:
        return "ARP"
    if protocol in (TCP, UDP):
        if carries:
            return PORT_NAMES.get(target) or PORT_NAMES.get(source) or "DATA"
        return "TCP" if protocol == TCP else "UDP"
    if protocol == ICMP:
        return "ICMP"
    return {IPV4: "IP", IPV6: "IPV6"}.get(kind, "DATA")
