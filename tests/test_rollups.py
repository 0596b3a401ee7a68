"""Windows, sessions and cadence on streams and tables."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from harness import tables
from peerscope.operators import timing
from peerscope.sources.packets import real_packets
from peerscope.streaming import cadence, ingest, windows

START = datetime(2024, 5, 1, 23, 50)


def packet_table(spark, rows):
    """``(seconds after START, from, to, size)`` as packets."""
    table = [(k, START + timedelta(seconds=s), a, b, n) for k, (s, a, b, n) in enumerate(rows)]
    made = spark.createDataFrame(table, "packet_id bigint, ts timestamp, src_ip string, dst_ip string, size bigint")
    return made.withColumn("ts_ms", F.unix_millis("ts")).select("packet_id", "ts", "ts_ms", "src_ip", "dst_ip", "size")


def stream_of(spark, path, parts):
    """A stream that takes ``parts`` one after the other."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return ingest.watch(spark, path, parts[0].schema, files_per_batch=1)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def parts(spark):
    # Across midnight. A batch drops what is behind the watermark that the batch before it began with,
    # so the third one drops what is more than the delay before 3600 s.
    first = [(0, "a", "b", 10), (200, "a", "b", 20), (300, "b", "a", 5), (900, "a", "a", 7), (3600, "c", "d", 1)]
    third = [(1000, "a", "b", 1000), (3100, "a", "b", 40), (9000, "e", "f", 3)]
    return [packet_table(spark, rows) for rows in (first, [(3700, "a", "b", 2)], third)]


def in_time(parts):
    return parts[0].unionByName(parts[1]).unionByName(parts[2].filter("size != 1000"))


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_windows_close_behind_the_watermark(spark, tmp_path, parts, slide):
    stream = stream_of(spark, str(tmp_path / "landing"), parts)
    rolled = windows.endpoint_windows(stream, "10 minutes", slide, "10 minutes")
    windows.store_rollup(rolled, str(tmp_path / "out"), str(tmp_path / "progress"), drain=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    # Windows that end behind the last watermark are still open.
    usable = in_time(parts)
    watermark = START + timedelta(seconds=9000 - 600)
    closed = windows.endpoint_windows(usable, "10 minutes", slide).filter(F.col("window_end") <= F.lit(watermark))
    names = ("ip_address", "window_start", "window_end", "packets", "bytes", "packets_out", "bytes_out")
    assert rows_of(stored, *names) == rows_of(closed, *names) and stored.count() > 8


def test_sessions_close_and_cross_midnight(spark, tmp_path, parts):
    stream = stream_of(spark, str(tmp_path / "landing"), parts)
    rolled = windows.endpoint_sessions(stream, "10 minutes", "10 minutes")
    windows.store_rollup(rolled, str(tmp_path / "out"), str(tmp_path / "progress"), drain=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    a = rows_of(stored.filter("ip_address = 'a'"), "session_start", "session_end", "packets", "bytes", "packets_out", "bytes_out")
    at = [START + timedelta(seconds=s) for s in (0, 1500, 3100, 4300)]
    assert a == [(at[0], at[1], 4, 42, 3, 37), (at[2], at[3], 2, 42, 2, 42)]
    usable = in_time(parts)
    islands = windows.session_islands(usable, 600_000, slot_ms=240_000)
    closed = islands.filter(F.col("last_ms") + 600_000 <= F.unix_millis(F.lit(START + timedelta(seconds=8400))))
    names = ("ip_address", "packets", "bytes", "packets_out", "bytes_out")
    assert rows_of(stored.withColumn("first", F.unix_millis("session_start")), "first", *names) == rows_of(closed, "start_ms", *names)


@pytest.mark.parametrize("slot_ms", [1, 1000, 600_000, 10**9])
def test_islands_do_not_depend_on_slots(spark, sf_dir, slot_ms):
    packets = real_packets(tables.packets(spark, sf_dir))
    rows = [(r["ip_address"], r["ts_ms"]) for r in windows.endpoint_packets(packets).select("ip_address", "ts_ms").collect()]
    pause, expected = 3_000_000, []
    for ip in {ip for ip, _ in rows}:
        own = np.sort([t for i, t in rows if i == ip])
        for part in np.split(own, np.flatnonzero(np.diff(own) > pause) + 1):
            expected.append((ip, int(part[0]), int(part[-1]), len(part)))
    found = windows.session_islands(packets, pause, slot_ms)
    assert rows_of(found, "ip_address", "start_ms", "last_ms", "packets") == sorted(expected)


def test_cadence_equals_the_batch_operator_after_a_restart(spark, sf_dir, tmp_path):
    packets = real_packets(tables.packets(spark, sf_dir)).select("packet_id", "ts", "ts_ms", "src_ip", "dst_ip", "size").cache()
    middle = packets.approxQuantile("ts_ms", [0.3, 0.6], 0)
    parts = [packets.filter(f"ts_ms < {middle[0]}"), packets.filter(f"ts_ms >= {middle[0]} AND ts_ms < {middle[1]}"), packets.filter(f"ts_ms >= {middle[1]}")]
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))
    for some in (parts[:2], parts[2:]):  # the second run goes on from the checkpoint of the first
        stream = stream_of(spark, landing, some)
        cadence.store_cadence(cadence.endpoint_cadence(stream, timeout_ms=10**12), out, progress, drain=True).awaitTermination()
    found = {r["ip_address"]: r for r in cadence.latest_cadence(spark.read.parquet(out)).collect()}
    expected = timing.endpoint_timing(packets).collect()
    assert len(found) == len(expected)
    for r in expected:
        own = found[r["ip_address"]]
        assert own["late"] == 0
        for name in ("interval_mean", "interval_cv"):
            assert own[name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-9)), r


@pytest.mark.parametrize(("delay", "closed", "late"), [("2 hours", False, 2), ("1 second", True, 0)])
def test_cadence_closes_silent_endpoints(spark, tmp_path, parts, delay, closed, late):
    out = str(tmp_path / "out")
    stream = stream_of(spark, str(tmp_path / "landing"), parts)
    changes = cadence.endpoint_cadence(stream, timeout_ms=1_800_000, delay=delay)
    cadence.store_cadence(changes, out, str(tmp_path / "progress"), drain=True).awaitTermination()
    rows = {r["ip_address"]: r for r in cadence.latest_cadence(spark.read.parquet(out)).collect()}
    # The packets at 1000 s and 3100 s come after one at 3700 s; with a short delay the watermark drops them before.
    assert rows["c"]["closed"] is closed and (rows["a"]["packets"], rows["a"]["late"]) == (5, late)


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_endpoints_of_a_bucket_share_a_state_and_nothing_else(spark, tmp_path, monkeypatch, parts, buckets):
    monkeypatch.setattr(cadence, "BUCKETS", buckets)
    out = str(tmp_path / "out")
    # The last batch has packets of a nameless endpoint and of h, while four others of the bucket have been silent for too long.
    stream = stream_of(spark, str(tmp_path / "landing"), [*parts, packet_table(spark, [(9100, None, "h", 1), (9200, None, "h", 1)])])
    changes = cadence.endpoint_cadence(stream, timeout_ms=1_800_000, delay="1 second")
    query = cadence.store_cadence(changes, out, str(tmp_path / "progress"), drain=True)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= min(buckets, 4)
    stored = spark.read.parquet(out)
    assert {r[:5] for r in stored.select("step", "ip_address", "packets", "late", "closed").collect()} == {
        (0, "a", 4, 0, False), (0, "b", 3, 0, False), (0, "c", 1, 0, False), (0, "d", 1, 0, False), (1, "a", 5, 0, False), (1, "b", 4, 0, False),
        (2, "e", 1, 0, False), (2, "f", 1, 0, False), (3, None, 2, 0, False), (3, "h", 2, 0, False),
        (3, "a", 5, 0, True), (3, "b", 4, 0, True), (3, "c", 1, 0, True), (3, "d", 1, 0, True),
    }
    last = {r["ip_address"]: r for r in cadence.latest_cadence(stored).collect()}
    gaps = [200, 100, 600, 2800]
    assert last["a"]["interval_mean"] == 925 and last["a"]["interval_cv"] == pytest.approx(np.std(gaps) / np.mean(gaps))
    assert last["h"]["interval_mean"] is None and last["h"]["last_ms"] - last["a"]["last_ms"] == 5_500_000


def test_squares_are_exact():
    far = 10**12
    state = cadence.advance(None, np.array([0, far]))
    state = cadence.advance(state, np.array([far - 5, 2 * far + 1]))
    assert state == (3, 0, 2 * far + 1, str(far**2 + (far + 1) ** 2), 1)
    assert cadence.measures(state)[0] == (2 * far + 1) / 2 / 1000
    assert cadence.measures((2, 0, 5, "25", 0)) == (None, None)
