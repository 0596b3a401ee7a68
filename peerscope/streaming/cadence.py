"""Cadence per endpoint on a stream, from five numbers of state.

The state of an endpoint is its number of packets, first and last instant, and the
sum of the squared gaps between them as a decimal text, so it is exact however long
the stream runs. A batch sorts its own packets of an endpoint; one that is earlier
than the last instant of the state comes too late to be placed and is counted as
``late`` instead. An endpoint that is silent for ``timeout`` leaves the state, which
ends its row with ``closed``.

Endpoints share ``BUCKETS`` groups by the hash of their address, whose states are
kept and updated together: a call of Python and its frames cost more than the
packets of a quiet endpoint, and come once per bucket and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from peerscope.schema import MIN_TIMING_PACKETS
from peerscope.streaming.windows import endpoint_packets

# Part of a stream's checkpoint, as the state of a bucket is found by its number.
BUCKETS = 4096
# The endpoints of a bucket, and until when each may be silent.
STATE = ("ip_address array<string>, packets array<bigint>, first array<bigint>, last array<bigint>, squares array<string>, "
         "late array<bigint>, deadline array<bigint>")
RESULT = "ip_address string, packets bigint, interval_mean double, interval_cv double, late bigint, last_ms bigint, closed boolean"


def advance(state: tuple | None, instants: np.ndarray) -> tuple:
    """The state after the sorted ``instants`` of a batch."""
    packets, first, last, squares, late = state or (0, None, None, "0", 0)
    usable = instants if last is None else instants[instants >= last]
    late += len(instants) - len(usable)
    if not len(usable):
        return packets, first, last, squares, late
    gaps = np.diff(usable if last is None else np.append(last, usable))
    # Gaps below 2**31 ms have squares that a 64-bit sum of a few holds; Python's integers hold all.
    total = int(squares) + sum(int(g) * int(g) for g in gaps[gaps > 0].tolist())
    return packets + len(usable), int(usable[0]) if first is None else first, int(usable[-1]), str(total), late


def measures(state: tuple) -> tuple[float | None, float | None]:
    """Mean gap in seconds and its coefficient of variation, null as in the batch operator."""
    packets, first, last, squares, _ = state
    if packets < MIN_TIMING_PACKETS or last == first:
        return None, None
    gaps, span = packets - 1, last - first
    return span / gaps / 1000.0, max(gaps * int(squares) - span * span, 0) ** 0.5 / span


def _by_endpoint(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, np.ndarray]]:
    """The sorted instants of every address."""
    columns = [(f["ip_address"].to_numpy(object), f["ts_ms"].to_numpy(np.int64)) for f in frames]
    addresses, instants = (np.concatenate(c) for c in zip(*columns))
    codes, own = pd.factorize(addresses, use_na_sentinel=False)
    order = np.lexsort((instants, codes))
    parts = np.split(instants[order], np.flatnonzero(np.diff(codes[order])) + 1)
    return zip((None if pd.isna(ip) else ip for ip in own), parts)


def _update(frames: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int) -> Iterator[pd.DataFrame]:
    watermark = state.getCurrentWatermarkMs()
    known = {ip: tuple(own) for ip, *own in zip(*state.get)} if state.exists else {}
    changed = {}
    if not state.hasTimedOut:
        for ip, instants in _by_endpoint(frames):
            now = advance(known[ip][:-1] if ip in known else None, instants)
            changed[ip] = now, False
            known[ip] = *now, max(now[2] + timeout_ms, watermark + 1)
    for ip in [ip for ip, own in known.items() if own[-1] < watermark]:
        changed[ip] = known.pop(ip)[:-1], True
    if known:
        columns = [list(c) for c in zip(*((ip, *own) for ip, own in known.items()))]
        state.update(tuple(columns))
        state.setTimeoutTimestamp(min(columns[-1]))
    else:
        state.remove()
    states, closed = zip(*changed.values())
    means, variations = zip(*map(measures, states))
    yield pd.DataFrame({
        "ip_address": list(changed), "packets": [s[0] for s in states], "interval_mean": pd.array(means, "Float64"),
        "interval_cv": pd.array(variations, "Float64"), "late": [s[4] for s in states], "last_ms": [s[2] for s in states], "closed": list(closed),
    })


def endpoint_cadence(packets: DataFrame, timeout_ms: int = 7 * 86_400_000, delay: str = "10 minutes") -> DataFrame:
    """A row of ``RESULT`` for every endpoint that a batch changes; its latest row is its cadence so far."""
    bucket = F.pmod(F.xxhash64("ip_address"), F.lit(BUCKETS)).alias("bucket")
    rows = endpoint_packets(packets).withWatermark("ts", delay).select(bucket, "ip_address", "ts", "ts_ms")

    def update(key, frames, state):
        return _update(frames, state, timeout_ms)

    return rows.groupBy("bucket").applyInPandasWithState(update, RESULT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def store_cadence(cadence: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep what each batch changed in a folder of its own, which a replay overwrites."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("step", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = cadence.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def latest_cadence(changes: DataFrame) -> DataFrame:
    """The last row of every endpoint."""
    columns = ["ip_address", "packets", "interval_mean", "interval_cv", "late", "last_ms", "closed"]
    return changes.groupBy("ip_address").agg(F.max_by(F.struct(*columns[1:]), F.col("step")).alias("own")).select("ip_address", "own.*")
