"""Anomaly scores with the features that explain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.stats import Scale, robust_scales
from peerscope.operators.features import NUMERIC, UNITS, feature_columns
from peerscope.schema import LOCAL_ORG, NO_IP, REASON_THRESHOLD, UNKNOWN

# Which way a feature's traffic flows, seen from the endpoint.
FLOW = {
    "bytes_out": "out",
    "packets_out": "out",
    "bytes_in": "in",
    "packets_in": "in",
    "bytes_out_in_ratio": "out",
    "packets_out_in_ratio": "out",
    "bytes_per_peer": "out",
}

# The same flow in words, seen from the capture host.
REMOTE_WORDS = {
    "out": "remote → host: traffic the capture host downloaded (NOT host exfil)",
    "in": "host → remote: traffic the capture host sent to this IP (outbound-from-host signal)",
}
LOCAL_WORDS = {
    "out": "host → network: traffic the capture host sent out (outbound-from-host signal)",
    "in": "network → host: traffic the capture host received (download)",
}

# Features, units and wording of the host's own uploads.
HOST_UNITS = {"upload_bytes": "bytes", "upload_packets": "packets", "upload_download_ratio": "ratio"}
HOST_WORDS = {
    "upload_bytes": "host → remote: data the capture host sent out (outbound from host)",
    "upload_packets": "host → remote: packets the capture host sent out (outbound from host)",
    "upload_download_ratio": "host sent more to this peer than it received (exfil-shaped when high)",
}

REASON = (
    "array<struct<feature:string,value:double,unit:string,robust_z:double,"
    "direction:string,host_relative:string>>"
)


def _words(feature: str) -> str:
    """SQL for the wording of a feature; null if it has no direction."""
    if feature not in FLOW:
        return "CAST(NULL AS STRING)"
    flow = FLOW[feature]
    return f"IF(org = '{LOCAL_ORG}', '{LOCAL_WORDS[flow]}', '{REMOTE_WORDS[flow]}')"


def _with_z(rows: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    """``rows`` with the robust z of each column as ``z_<column>``."""
    return rows.withColumns({f"z_{c}": s.apply(c) for c, s in scales.items()})


def _norm(columns: list[str]) -> Column:
    return F.expr(f"sqrt({' + '.join(f'z_{c} * z_{c}' for c in columns)})")


def _reasons(units: dict[str, str], words: dict[str, str]) -> Column:
    """The features past the threshold, strongest first, ties in feature order."""
    cited = ", ".join(
        f"""IF(abs(z_{c}) >= {REASON_THRESHOLD}D, named_struct(
            'strength', -abs(round(z_{c}, 2)), 'place', {place},
            'feature', '{c}', 'value', round(CAST({c} AS DOUBLE), 4), 'unit', '{units[c]}',
            'robust_z', round(z_{c}, 2), 'direction', IF(z_{c} > 0, 'high', 'low'),
            'host_relative', {words[c]}), NULL)"""
        for place, c in enumerate(units)
    )
    return F.expr(f"""transform(array_sort(array_compact(array({cited}))), r -> named_struct(
        'feature', r.feature, 'value', r.value, 'unit', r.unit, 'robust_z', r.robust_z,
        'direction', r.direction, 'host_relative', r.host_relative))""").cast(REASON)


def score_endpoints(data: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``anomaly_score``, ``reasons`` and ``is_outlier`` of every clustering input.

    The score is the Euclidean norm of the robust z values and does not depend
    on a clustering. ``labels`` ``(ip_address, cluster)`` decide ``is_outlier``
    (null without them). Cadence columns are returned as measured; reasons use
    them after imputation.
    """
    raw = F.struct("bytes_out", "packets_out", "bytes_in", "packets_in", "interval_mean", "interval_cv")
    rows = data.select(
        "ip_address", "org", "hostname", "location", raw.alias("raw"),
        *[v.alias(c) for c, v in feature_columns(data).items()],
    )
    words = {c: _words(c) for c in NUMERIC}
    scored = _with_z(rows, robust_scales(rows, NUMERIC)).select(
        "ip_address", "org", "hostname", "location", "raw.*",
        F.round(_norm(NUMERIC), 4).alias("anomaly_score"),
        _reasons(UNITS, words).alias("reasons"),
    )
    if labels is None:
        return scored.withColumn("is_outlier", F.lit(None).cast("boolean"))
    verdicts = labels.select("ip_address", (F.col("cluster") == -1).alias("is_outlier"))
    return scored.join(verdicts, "ip_address", "left")


def explode_reasons(scored: DataFrame) -> DataFrame:
    """One row per cited feature with its place in the endpoint's list."""
    return scored.select("ip_address", F.posexplode("reasons").alias("place", "reason")).select(
        "ip_address", (F.col("place") + 1).alias("place"), "reason.*"
    )


def host_outbound_flows(packets: DataFrame, hosts: DataFrame) -> DataFrame:
    """What the capture host sent to and got from each address it sent to.

    Pass stored ``hosts``: the addresses of one machine are a tiny table, and
    its size lets Catalyst mark packets without shuffling them.
    """
    sent_by = hosts.select(F.col("ip_address").alias("src_ip"), F.lit(True).alias("from_host"))
    sent_to = hosts.select(F.col("ip_address").alias("dst_ip"), F.lit(True).alias("to_host"))
    marked = packets.join(sent_by, "src_ip", "left").join(sent_to, "dst_ip", "left")
    outbound = F.col("from_host").isNotNull()
    exchanged = marked.filter("(from_host IS NOT NULL) != (to_host IS NOT NULL)").select(
        F.when(outbound, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip_address"),
        outbound.alias("outbound"),
        "size",
    )
    up, down = F.col("outbound"), ~F.col("outbound")
    return (
        exchanged.filter(F.col("ip_address") != NO_IP)
        .groupBy("ip_address")
        .agg(
            F.sum(F.when(up, F.col("size")).otherwise(0)).alias("upload_bytes"),
            F.count_if(up).alias("upload_packets"),
            F.sum(F.when(down, F.col("size")).otherwise(0)).alias("download_bytes"),
            F.count_if(down).alias("download_packets"),
        )
        .filter("upload_packets > 0")
    )


def describe_destinations(flows: DataFrame, metadata: DataFrame) -> DataFrame:
    return flows.join(metadata, "ip_address", "left").select(
        "ip_address",
        *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("org", "hostname", "location")],
        "upload_bytes", "upload_packets", "download_bytes", "download_packets",
    )


def score_host_outbound(destinations: DataFrame) -> DataFrame:
    """Score the host's destinations on its own uploads, as endpoints are scored.

    Pass stored rows: the scales read them before the result does.
    """
    rows = destinations.withColumn(
        "upload_download_ratio", F.col("upload_bytes") / (F.col("download_bytes") + F.lit(1.0))
    )
    columns = list(HOST_UNITS)
    words = {c: f"'{HOST_WORDS[c]}'" for c in columns}
    return _with_z(rows, robust_scales(rows, columns)).select(
        "ip_address", "org", "hostname", "location",
        "upload_bytes", "upload_packets", "download_bytes", "download_packets",
        F.round("upload_download_ratio", 4).alias("upload_download_ratio"),
        F.round(_norm(columns), 4).alias("outbound_score"),
        _reasons(HOST_UNITS, words).alias("reasons"),
    )
