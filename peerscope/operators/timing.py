"""Packet cadence per endpoint, without sorting an endpoint in one task.

A busy endpoint may appear in every packet. Its packets are summed per
millisecond before anything is shuffled, its stream is cut into time slots, each
slot is sorted on its own, and slots are then stitched together through their
first and last instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.schema import MIN_TIMING_PACKETS

# A sort meets at most one row per millisecond of a slot.
SLOT_MS = 600_000
SPLIT_BITS = 20


def instants(packets: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """``(ip_address, slot, ts_ms, packets)`` of every endpoint and millisecond;
    a packet to oneself counts once. Sums combine before the shuffle."""
    own = F.when(F.col("src_ip") == F.col("dst_ip"), F.array("src_ip")).otherwise(F.array("src_ip", "dst_ip"))
    return (
        packets.filter("ts_ms IS NOT NULL")
        .select(F.explode(own).alias("ip_address"), "ts_ms")
        .groupBy("ip_address", F.expr(f"ts_ms div {slot_ms}").alias("slot"), "ts_ms")
        .agg(F.count("*").alias("packets"))
    )


def packet_gaps(packets: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """The gap in ms before each instant at which an endpoint had packets.

    ``packets`` is the number of packets at that instant: the first follows
    ``gap_ms`` after the previous instant (null for the endpoint's first), the
    others follow with gap 0.
    """
    within = Window.partitionBy("ip_address", "slot").orderBy("ts_ms")
    across = Window.partitionBy("ip_address").orderBy("slot")
    moments = instants(packets, slot_ms)
    earlier = (
        moments.groupBy("ip_address", "slot")
        .agg(F.max("ts_ms").alias("last"))
        .withColumn("previous_last", F.lag("last").over(across))
        .drop("last")
    )
    return (
        moments.withColumn("previous", F.lag("ts_ms").over(within))
        .join(earlier, ["ip_address", "slot"])
        .select(
            "ip_address", "ts_ms", "packets",
            (F.col("ts_ms") - F.coalesce("previous", "previous_last")).alias("gap_ms"),
        )
    )


def endpoint_timing(packets: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Mean gap in seconds and its coefficient of variation per endpoint.

    Null with fewer than three packets or when all fall on one instant. Squared
    gaps are summed exactly, so the variance of a regular beacon does not drown
    in rounding: gaps between slots are split into two halves whose products
    fit a LONG, and put together in DECIMAL once per endpoint. The squares
    inside a slot are below 2^39, so a LONG holds those of a hundred years.
    """
    within = Window.partitionBy("ip_address", "slot").orderBy("ts_ms")
    across = Window.partitionBy("ip_address").orderBy("slot")
    gap = F.col("ts_ms") - F.col("previous")
    parts = (
        instants(packets, slot_ms)
        .withColumn("previous", F.lag("ts_ms").over(within))
        .groupBy("ip_address", "slot")
        .agg(
            F.sum("packets").alias("packets"),
            F.min("ts_ms").alias("first"),
            F.max("ts_ms").alias("last"),
            F.coalesce(F.sum(gap * gap), F.lit(0)).alias("squares"),
        )
    )
    border = F.coalesce(F.col("first") - F.lag("last").over(across), F.lit(0))
    high, low = F.shiftright("border", SPLIT_BITS), F.col("border").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    totals = (
        parts.withColumn("border", border)
        .groupBy("ip_address")
        .agg(
            F.sum("packets").alias("packets"),
            (F.max("last") - F.min("first")).alias("span"),
            F.sum(high * high).alias("high_squares"),
            F.sum(high * low).alias("products"),
            F.sum(low * low + F.col("squares")).alias("low_squares"),
        )
    )

    def whole(column: Column, digits: int) -> Column:
        return column.cast(f"decimal({digits},0)")

    squares = whole(
        whole(F.col("high_squares"), 19) * whole(F.lit(1 << 2 * SPLIT_BITS), 13)
        + whole(F.col("products"), 19) * whole(F.lit(2 << SPLIT_BITS), 7)
        + whole(F.col("low_squares"), 19),
        24,
    )
    gaps = F.col("packets") - 1
    span = whole(F.col("span"), 18)
    # gaps^2 * variance, in ms^2
    spread = (whole(gaps, 14) * squares - span * span).cast("double")
    timed = (F.col("packets") >= MIN_TIMING_PACKETS) & (F.col("span") > 0)
    return totals.select(
        "ip_address",
        F.when(timed, F.col("span") / gaps / F.lit(1000.0)).alias("interval_mean"),
        F.when(timed, F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("span")).alias("interval_cv"),
    )
