"""Owners of address ranges: the most specific range that holds an address.

Ownership data comes as CIDR blocks or as first and last address, nested and
overlapping. A range is cut into the aligned blocks that make it up, at most two of
each prefix length, so an address finds its ranges by equality: its own prefix of
every length. No range is compared with an address.

Blocks of up to ``SHORT`` bits, such as the one of all addresses, would be hot
keys. They are spread over the 2**16 blocks of that length, where only the most
specific counts, so their table has a fixed bound and is broadcast. A longer
block has at most 2**15 addresses.

Of ranges of one size the one with the lowest owner wins. What is not an IPv4
address or range matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.sources.ownership import upsert_metadata

BITS, SHORT = 32, 16
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def address_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = [F.regexp_extract(text, ADDRESS, k + 1).cast("bigint") for k in range(4)]
    return F.when(text.rlike(ADDRESS), sum((p * (1 << (24 - 8 * k)) for k, p in enumerate(parts)), F.lit(0)))


def _width(bits: Column) -> Column:
    """Addresses in a block of a prefix length."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(BITS) - bits)


def range_bounds(text: Column) -> tuple[Column, Column]:
    """First and last number of ``a.b.c.d``, ``a.b.c.d/bits`` (host bits are ignored) or ``first-last``; null if it is none."""
    block, dash = F.split(text, "/"), F.split(text, "-")
    bits = F.when(F.size(block) == 1, F.lit(BITS)).when(
        (F.size(block) == 2) & block[1].rlike("^([12]?[0-9]|3[0-2])$"), block[1].cast("int")
    )
    size = _width(bits)
    network = address_number(block[0]) - F.pmod(address_number(block[0]), size)
    is_span = F.size(dash) == 2
    first = F.when(is_span, address_number(dash[0])).otherwise(network)
    last = F.when(is_span, address_number(F.element_at(dash, 2))).otherwise(network + size - 1)
    right = first <= last
    return F.when(right, first), F.when(right, last)


def blocks(ranges: DataFrame, text: str) -> DataFrame:
    """``ranges`` with ``(bits, prefix, size)`` for each aligned block of the range in column ``text``; ``size`` is the range's."""
    first, last = range_bounds(F.col(text))
    bounded = ranges.withColumns({"first": first, "last": last}).filter("first IS NOT NULL").withColumn("size", F.col("last") - F.col("first") + 1)
    leveled = bounded.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(BITS))))

    def inside(bits: Column) -> tuple[Column, Column]:
        """The blocks of a length that lie in the range: from the first up to the second."""
        return F.call_function("div", F.col("first") + _width(bits) - 1, _width(bits)), F.call_function("div", F.col("last") + 1, _width(bits))

    low, high = inside(F.col("bits"))
    low_up, high_up = inside(F.greatest(F.col("bits") - 1, F.lit(0)))
    ends = F.when(low < high, F.array_distinct(F.array(low, high - 1))).otherwise(F.array().cast("array<bigint>"))
    part = leveled.withColumns({"low_up": low_up, "high_up": high_up}).withColumn("prefix", F.explode(ends))
    # A block whose parent lies in the range as well is part of that.
    parent = F.shiftright("prefix", 1)
    whole_parent = (F.col("bits") > 0) & (F.col("low_up") <= parent) & (parent < F.col("high_up"))
    return part.filter(~whole_parent).drop("first", "last", "low_up", "high_up")


def match_ranges(addresses: DataFrame, ranges: DataFrame, text: str = "range") -> DataFrame:
    """``(ip_address, ...)``: the columns of the most specific of ``ranges`` for each address that has one.

    ``ranges`` has the range in ``text``, an ``org`` and any other columns.
    """
    columns = list(ranges.columns)
    order = [F.col("size"), F.col("org").isNull(), F.col("org"), F.col(text)]
    best = F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c) for c in columns if c not in ("org", text)])).alias("best")
    cut = blocks(ranges.select(*columns), text)
    short, long = cut.filter(F.col("bits") <= SHORT), cut.filter(F.col("bits") > SHORT)
    # At most 2**16 rows, whatever the ranges.
    spread = (
        short.withColumn("first", F.expr(f"shiftleft(prefix, {SHORT} - bits)"))
        .withColumn("prefix", F.explode(F.expr(f"sequence(first, first + shiftleft(1L, {SHORT} - bits) - 1)")))
        .groupBy("prefix").agg(best)
    )
    one_each = long.groupBy("bits", "prefix").agg(best)
    numbered = addresses.select("ip_address").distinct().withColumn("number", address_number(F.col("ip_address"))).filter("number IS NOT NULL")
    by_length = numbered.withColumn("bits", F.explode(F.sequence(F.lit(SHORT + 1), F.lit(BITS)))).withColumn(
        "prefix", F.expr(f"shiftright(number, {BITS} - bits)")
    )
    found = by_length.join(one_each, ["bits", "prefix"]).select("ip_address", "best").unionByName(
        numbered.withColumn("prefix", F.shiftright("number", BITS - SHORT)).join(F.broadcast(spread), "prefix").select("ip_address", "best")
    )
    chosen = found.groupBy("ip_address").agg(F.min("best").alias("best"))
    named = {"org": "o2", text: "o3"}
    return chosen.select("ip_address", *[F.col("best").getField(named.get(c, c)).alias(c) for c in columns])


def enrich_from_ranges(missing: DataFrame, ranges: DataFrame, text: str = "range") -> DataFrame:
    """Metadata rows of the ``missing`` addresses that lie in a range: its ``org`` and ``location``, and no host name."""
    found = match_ranges(missing, ranges.select(text, "org", "location"), text)
    return found.select("ip_address", "org", F.lit(None).cast("string").alias("hostname"), "location")


def document_ranges(metadata: DataFrame, missing: DataFrame, ranges: DataFrame, text: str = "range") -> DataFrame:
    """``metadata`` with an owner for each ``missing`` address that lies in a range."""
    return upsert_metadata(metadata, enrich_from_ranges(missing, ranges, text))
