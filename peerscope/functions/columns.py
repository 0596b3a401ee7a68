"""Column expressions of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerscope.schema import NO_PORT, UNKNOWN


def port_number(raw: Column) -> Column:
    """The port as INT where the text is all digits, else 0."""
    return F.coalesce(F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")), F.lit(NO_PORT))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded down."""
    return F.unix_millis(ts)


def flow_line() -> Column:
    """One readable line per packet."""
    return F.format_string(
        "%s:%d ➜ %s(%d) ➜ %s:%d", "src_ip", "src_port", "protocol", "size", "dst_ip", "dst_port"
    )


def touches(ip: str) -> Column:
    """The packet was sent or received by ``ip``."""
    return (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)


def peer_of(ip: str) -> Column:
    return F.when(F.col("src_ip") == ip, F.col("dst_ip")).otherwise(F.col("src_ip"))


def known(value: Column) -> Column:
    """``value``, with null and the empty string read as unknown."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(UNKNOWN))


def owner_name(record: Column) -> Column:
    """Owner in a JSON ownership record: org, else company, else AS name."""
    return F.coalesce(
        F.get_json_object(record, "$.org"),
        F.get_json_object(record, "$.company.name"),
        F.get_json_object(record, "$.asn.name"),
        F.lit(UNKNOWN),
    )


def record_field(record: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(record, f"$.{field}"), F.lit(UNKNOWN))


def clean_ports(sent_from: Column, sent_to: Column) -> Column:
    """Ports of both lists, sorted, without null and the 0 placeholder."""
    return F.array_sort(F.filter(F.array_union(sent_from, sent_to), lambda p: p != NO_PORT))


def clean_names(names: Column) -> Column:
    return F.array_sort(F.filter(names, lambda n: n != ""))


def _or_none(value: str) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit("None"))


def _numbers(ports: str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", F.col(ports).cast("array<string>")), F.lit("]"))


def _names(names: str) -> Column:
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.concat_ws(", ", quoted), F.lit("]"))


def endpoint_description() -> Column:
    """The four-line profile text that is embedded."""
    return F.concat(
        F.lit("IP: "), F.col("ip_address"), F.lit(" | Organization: "), _or_none("org"),
        F.lit(" | Hostname: "), _or_none("hostname"), F.lit(" | Location: "), _or_none("location"),
        F.lit("\nOutbound: "), F.col("bytes_out").cast("string"), F.lit(" bytes, "),
        F.col("packets_out").cast("string"), F.lit(" packets to "),
        F.col("out_peers").cast("string"), F.lit(" peers | Ports: "), _numbers("out_ports"),
        F.lit("\nInbound: "), F.col("bytes_in").cast("string"), F.lit(" bytes, "),
        F.col("packets_in").cast("string"), F.lit(" packets from "),
        F.col("in_peers").cast("string"), F.lit(" peers | Ports: "), _numbers("in_ports"),
        F.lit("\nProtocols: "), _names("protocols"), F.lit("\n"),
    )


def timestamp_text(ts: Column) -> Column:
    """Timestamp as text, for JSON readers."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
