"""Splits of a capture give what one walk over the file gives."""

import random
import struct

import pytest

from peerscope.sources import capture_splits, captures

RECORD_STRUCT = {"<": struct.Struct("<IIII"), ">": struct.Struct(">IIII")}


def udp(body: bytes) -> bytes:
    """An Ethernet frame with IPv4 and UDP around ``body``."""
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28 + len(body), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return bytes(12) + b"\x08\x00" + ip + struct.pack(">HHHH", 5000, 53, 8 + len(body), 0) + body


def records(frames, order="<", first=1_700_000_000):
    return b"".join(RECORD_STRUCT[order].pack(first + i, i % 1000, len(f), len(f)) + f for i, f in enumerate(frames))


def pcap(frames, order="<"):
    return struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + records(frames, order)


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.pcap").write_bytes(content)
    return str(folder)


def same(spark, folder, split_bytes):
    whole = captures.read_captures(spark, folder).collect()
    split = capture_splits.read_large_captures(spark, folder, split_bytes).collect()
    key = lambda row: row["packet_id"]
    assert sorted(split, key=key) == sorted(whole, key=key)
    return len(whole)


@pytest.mark.parametrize("split_bytes", [100, 1000, 1 << 30])
def test_equal_to_one_walk(spark, tmp_path, split_bytes):
    chance = random.Random(1)
    frames = [udp(chance.randbytes(chance.choice([0, 3, 40, 700, 3000]))) for _ in range(60)]
    folder = put(tmp_path / "caps", small=pcap(frames), big_endian=pcap(frames[:20], ">"), empty=pcap([]))
    assert same(spark, folder, split_bytes) == 80


@pytest.mark.parametrize("split_bytes", [256, 5000])
def test_a_capture_inside_packets_misleads_no_split(spark, tmp_path, split_bytes):
    """Payloads hold long chains of plausible records, one after the other."""
    inner = records([udp(bytes(20))] * 40)
    folder = put(tmp_path / "caps", nested=pcap([udp(inner), udp(inner[7:]), udp(bytes(30)), udp(inner)]))
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    guessed = capture_splits._walk(
        files.selectExpr("path", "length", f"explode(sequence(0L, length - 1, {split_bytes}L)) AS lower")
        .selectExpr("*", f"least(lower + {split_bytes}, length) AS upper", "-1L AS start")
    )
    assert guessed.agg({"records": "sum"}).first()[0] != 4  # the guesses alone are wrong
    assert same(spark, folder, split_bytes) == 4


def test_cut_off_broken_and_other_files(spark, tmp_path):
    frames = [udp(bytes([n]) * 50) for n in range(30)]
    whole = pcap(frames)
    assert same(spark, put(tmp_path / "cut", cut=whole[:-20], head=whole[:24] + whole[24:30]), 500) == 29
    at = 24 + 10 * (16 + len(frames[0]))
    broken = whole[:at + 8] + struct.pack("<I", 1 << 31) + whole[at + 12:]
    with pytest.raises(Exception, match=f"impossible record at byte {at}"):
        capture_splits.read_large_captures(spark, put(tmp_path / "broken", broken=broken), 500)
    with pytest.raises(Exception, match="not a pcap file"):
        capture_splits.read_large_captures(spark, put(tmp_path / "text", text=b"no capture, but long enough to have a head"), 500)


def test_windows_smaller_than_the_split(spark, tmp_path, monkeypatch):
    """A walk over many windows, with records over their borders, counts each record once."""
    frames = [udp(bytes(n % 90 * (20 if n % 50 == 7 else 1))) for n in range(400)]  # some larger than a window
    path = put(tmp_path / "caps", a=pcap(frames)) + "/a.pcap"
    monkeypatch.setattr(capture_splits, "WINDOW_BYTES", 300)
    length = len(pcap(frames))
    with capture_splits._open(f"file:{path}") as file:
        shape = capture_splits._shape(file, path)
        pieces = list(capture_splits._pieces(file, shape, 24, length, length))
    assert sum(len(f) for _, f, _ in pieces) == 400 and pieces[-1][2] == length and len(pieces) > 100
