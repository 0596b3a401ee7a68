"""Behavioural features of endpoints and their scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.columns import known
from peerscope.functions.stats import Scale, exact_medians, robust_scales, standard_scales
from peerscope.schema import LOCAL_ORG

# The names of the features, and below the formulas of the ratios.
BASE = ["bytes_out", "bytes_in", "packets_out", "packets_in", "out_peers", "in_peers"]
TIMING = ["interval_mean", "interval_cv"]


def _per(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(1.0))


# Denominators are shifted by one, since traffic may flow one way only.
RATIOS = {
    "bytes_out_in_ratio": lambda: _per(F.col("bytes_out"), F.col("bytes_in")),
    "packets_out_in_ratio": lambda: _per(F.col("packets_out"), F.col("packets_in")),
    "bytes_per_packet": lambda: _per(
        F.col("bytes_out") + F.col("bytes_in"), F.col("packets_out") + F.col("packets_in")
    ),
    "bytes_per_peer": lambda: _per(F.col("bytes_out"), F.col("out_peers")),
}

NUMERIC = BASE + list(RATIOS) + TIMING

# The unit of each feature.
UNITS = {
    "bytes_out": "bytes",
    "bytes_in": "bytes",
    "packets_out": "packets",
    "packets_in": "packets",
    "out_peers": "peers",
    "in_peers": "peers",
    "bytes_out_in_ratio": "ratio",
    "packets_out_in_ratio": "ratio",
    "bytes_per_packet": "bytes/packet",
    "bytes_per_peer": "bytes/peer",
    "interval_mean": "seconds",
    "interval_cv": "ratio",
}


def _described(endpoints: DataFrame, metadata: DataFrame) -> DataFrame:
    """Embedded endpoints with owner, host name and location filled in."""
    owner = metadata.select(
        "ip_address",
        F.col("org").alias("owner_org"),
        F.col("hostname").alias("owner_hostname"),
        F.col("location").alias("owner_location"),
    )
    joined = endpoints.filter("embedding IS NOT NULL").join(owner, "ip_address", "left")
    return joined.select(
        "ip_address",
        known(F.coalesce("org", "owner_org")).alias("org"),
        known(F.coalesce("hostname", "owner_hostname")).alias("hostname"),
        known(F.coalesce("location", "owner_location")).alias("location"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in BASE],
        *TIMING,
        "embedding",
    )


def clustering_input(endpoints: DataFrame, metadata: DataFrame, include_local: bool = False) -> DataFrame:
    """The endpoints to score: embedded ones, without the capture host.

    The endpoint's own owner comes first, then the metadata's, then unknown.
    """
    described = _described(endpoints, metadata)
    return described if include_local else described.filter(F.col("org") != LOCAL_ORG)


def excluded_local(endpoints: DataFrame, metadata: DataFrame, include_local: bool = False) -> DataFrame:
    """How many embedded endpoints :func:`clustering_input` leaves out."""
    left_out = F.lit(False) if include_local else F.col("org") == LOCAL_ORG
    return _described(endpoints, metadata).agg(F.count_if(left_out).alias("excluded_local"))


def shape_ratios(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("ip_address", *[ratio().alias(name) for name, ratio in RATIOS.items()])


def feature_columns(data: DataFrame) -> dict[str, Column]:
    """The 12 features as columns over ``data``; a missing cadence becomes the
    median one.

    Pass stored rows: the medians read ``data`` before a result does.
    """
    medians = exact_medians(data, TIMING)
    return {
        **{c: F.col(c).cast("double") for c in BASE},
        **{name: ratio() for name, ratio in RATIOS.items()},
        **{c: F.coalesce(c, F.lit(medians[c] or 0.0)) for c in TIMING},
    }


def numeric_features(data: DataFrame) -> DataFrame:
    """One column per feature of :func:`feature_columns`."""
    return data.select("ip_address", *[v.alias(c) for c, v in feature_columns(data).items()])


def _scaled(features: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return features.select(
        "ip_address",
        *[scale.apply(c).alias(c) for c, scale in scales.items()],
    )


def robust_z(features: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Robust z of log1p of each column, 0 for a constant one."""
    return _scaled(features, robust_scales(features, columns))


def standardized(features: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """log1p of each column at mean 0 and population deviation 1."""
    return _scaled(features, standard_scales(features, columns))


def as_points(scaled: DataFrame, columns: list[str] = NUMERIC, weight: float = 1.0) -> DataFrame:
    """``(ip_address, features)`` with the columns as one array."""
    return scaled.select(
        "ip_address", F.array(*[F.col(c) * F.lit(float(weight)) for c in columns]).alias("features")
    )
