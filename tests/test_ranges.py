"""Most specific ranges against Python's ipaddress."""

import ipaddress
import random

import pytest

from peerscope.sources import ranges

RANGES = [
    ("0.0.0.0/0", "everyone"), ("10.0.0.0/8", "ten"), ("10.1.0.0/16", "b"), ("10.1.0.0/16", "a"), ("10.1.2.0/24", None), ("10.1.2.3", "one"),
    ("10.1.2.3/32", "two"), ("10.1.2.77/25", "host bits"), ("10.0.255.250-10.1.0.9", "span"), ("10.1.0.3-10.1.0.3", "single"),
    ("255.255.255.255/32", "last"), ("0.0.0.0-255.255.255.254", "most"), ("128.0.0.0/1", "half"), ("1.2.3.4-1.2.3.0", "backwards"),
    ("10.0.0.0/33", "bad"), ("10.0.0", "bad"), ("300.1.1.1/8", "bad"), ("::1/64", "bad"), (None, "bad"), ("", "bad"), ("10.0.0.0/8/9", "bad"), ("01.2.3.4", "bad"),
]


def bounds(text):
    try:
        if "-" in text:
            first, last = (int(ipaddress.IPv4Address(x)) for x in text.split("-"))
            return (first, last) if first <= last else None
        own = ipaddress.IPv4Network(text, strict=False)
        return int(own[0]), int(own[-1])
    except (ValueError, TypeError):
        return None


def brute(address, rows):
    try:
        number = int(ipaddress.IPv4Address(address))
    except ValueError:
        return None
    found = [
        (b[1] - b[0] + 1, org is None, org or "", text, org) for text, org in rows if (b := bounds(text)) and b[0] <= number <= b[1]
    ]
    return (min(found)[4], min(found)[3]) if found else None


@pytest.mark.parametrize("seed", range(3))
def test_most_specific_range(spark, seed):
    chooser = random.Random(seed)
    rows = list(RANGES) if seed else RANGES[1:11]
    for _ in range(60):
        first = chooser.randrange(1 << 32)
        last = min(first + chooser.choice([0, 1, 5, 1000, 70_000, 1 << 25]), (1 << 32) - 1)
        rows.append((f"{ipaddress.IPv4Address(first)}-{ipaddress.IPv4Address(last)}", f"r{chooser.randrange(9)}"))
    edges = [e + d for text, _ in rows if text and (b := bounds(text)) for e in b for d in (-1, 0, 1)]
    addresses = [str(ipaddress.IPv4Address(e)) for e in edges if 0 <= e < 1 << 32] + ["nonsense", "1.2.3", "256.1.1.1", "10.1.2.3"]
    table = spark.createDataFrame([(a,) for a in addresses], "ip_address string")
    given = spark.createDataFrame([(*r, f"at {r[0]}") for r in rows], "range string, org string, location string")
    found = {r["ip_address"]: (r["org"], r["range"]) for r in ranges.match_ranges(table, given).collect()}
    expected = {a: b for a in addresses if (b := brute(a, rows)) is not None}
    assert found == expected
    assert all(r["location"] == f"at {r['range']}" for r in ranges.match_ranges(table, given).collect())


def test_blocks_make_up_their_range(spark):
    given = spark.createDataFrame([("10.0.255.250-10.1.0.9",), ("0.0.0.0-255.255.255.255",), ("0.0.0.1-255.255.255.254",)], "range string")
    rows = ranges.blocks(given, "range").collect()
    for text in {r["range"] for r in rows}:
        spans = sorted((r["prefix"] << (32 - r["bits"]), 1 << (32 - r["bits"])) for r in rows if r["range"] == text)
        first, last = bounds(text)
        assert spans[0][0] == first and sum(n for _, n in spans) == last - first + 1 and len(spans) <= 62
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_no_ranges(spark):
    table = spark.createDataFrame([("10.0.0.1",)], "ip_address string")
    given = spark.createDataFrame([], "range string, org string, location string")
    assert ranges.match_ranges(table, given).count() == 0


def test_documented_addresses_stay(spark):
    metadata = spark.createDataFrame([("10.0.0.1", "known", "h", "l")], "ip_address string, org string, hostname string, location string")
    missing = spark.createDataFrame([("10.1.2.3",), ("11.0.0.1",)], "ip_address string")
    given = spark.createDataFrame([("10.0.0.0/8", "ten", "there")], "range string, org string, location string")
    rows = ranges.document_ranges(metadata, missing, given).collect()
    assert sorted(tuple(r) for r in rows) == [("10.0.0.1", "known", "h", "l"), ("10.1.2.3", "ten", None, "there")]
