"""The processing steps over stored tables, each with a one-row summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.operators.blocks import BLOCK_ROWS
from peerscope.operators.evaluation import cluster_points
from peerscope.operators.features import clustering_input, excluded_local
from peerscope.operators.graph import ip_nodes
from peerscope.operators.profiles import endpoint_profile, upsert_endpoints, write_verdicts
from peerscope.operators.reduction import MIN_COMPONENTS, blended_points, hash_vectors, plane, with_vectors
from peerscope.operators.scoring import (
    describe_destinations, host_outbound_flows, score_endpoints, score_host_outbound,
)
from peerscope.schema import ENDPOINTS, IP_METADATA
from peerscope.session import materialize, temporary_tables
from peerscope.sources.ownership import enrich, host_ips, undocumented, upsert_metadata
from peerscope.sources.snapshots import Snapshots


def document_organizations(addresses: DataFrame, metadata: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add the owners of undocumented addresses that have an ownership record.

    Returns the new metadata and the summary; an address without a record is
    scanned but not added.
    """
    missing = materialize(undocumented(addresses, metadata), "missing")
    added = materialize(enrich(missing, records), "added")
    summary = missing.agg(F.count("*").alias("addresses_scanned")).select(
        "addresses_scanned",
        F.coalesce(added.agg(F.count("*").alias("n")).scalar(), F.lit(0)).alias("organizations_added"),
    )
    return upsert_metadata(metadata, added), summary


def profile_endpoints(
    packets: DataFrame, metadata: DataFrame, encode: Callable[[DataFrame], DataFrame] = hash_vectors,
    profiled_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Profile and embed every address. Returns endpoint rows and the summary.

    ``encode`` turns profiles into ``(ip_address, embedding)``.
    """
    profiles = materialize(endpoint_profile(packets, metadata), "profiles")
    stamp = F.current_timestamp() if profiled_at is None else profiled_at
    endpoints = materialize(
        with_vectors(profiles, encode(profiles))
        .withColumns({"outlier": F.lit(None).cast("boolean"), "profiled_at": stamp})
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENDPOINTS]),
        "endpoints",
    )
    summary = packets.agg(F.count("*").alias("packets")).select(
        endpoints.filter("embedding IS NOT NULL").agg(F.count("*").alias("n")).scalar().alias("endpoints_embedded"),
        "packets",
    )
    return endpoints, summary


def store_organizations(store: Snapshots, addresses: DataFrame, records: DataFrame) -> DataFrame:
    """Enrich the stored metadata and write it back. Returns the summary."""
    with temporary_tables(store.spark):
        metadata, summary = document_organizations(addresses, store.read("metadata", IP_METADATA), records)
        summary = materialize(summary, "summary", keep=True)
        store.write("metadata", metadata, sort_by="ip_address")
    return summary


def store_endpoints(store: Snapshots, packets: DataFrame, **options) -> DataFrame:
    """Profile the addresses of ``packets`` and merge them into the stored endpoints.

    Verdicts of earlier runs stay, as do endpoints that did not occur again.
    A run may be repeated. Returns the summary.
    """
    with temporary_tables(store.spark):
        fresh, summary = profile_endpoints(packets, store.read("metadata", IP_METADATA), **options)
        summary = materialize(summary, "summary", keep=True)
        store.write("endpoints", upsert_endpoints(store.read("endpoints", ENDPOINTS), fresh, ip_nodes(packets)), sort_by="ip_address")
    return summary


def store_verdicts(store: Snapshots, verdicts: DataFrame) -> None:
    """Stamp ``(ip_address, is_outlier)`` on the stored endpoints; those not scored keep what they have."""
    store.write("endpoints", write_verdicts(store.read("endpoints", ENDPOINTS), verdicts), sort_by="ip_address")


def run_detection(store: Snapshots, packets: DataFrame, **options) -> Detection:
    """Cluster and score the stored endpoints, and write the verdicts back."""
    found = detect_anomalies(store.read("endpoints", ENDPOINTS), store.read("metadata", IP_METADATA), packets, **options)
    store_verdicts(store, found.verdicts)
    return found


@dataclass(frozen=True)
class Detection:
    """Result of :func:`detect_anomalies`.

    ``endpoints`` and ``destinations`` are ranked by score; ``labels``,
    ``curve`` and ``scatter`` are None when there were too few endpoints to
    cluster.
    """

    endpoints: DataFrame
    destinations: DataFrame
    verdicts: DataFrame
    summary: DataFrame
    labels: DataFrame | None
    curve: DataFrame | None
    scatter: DataFrame | None


SUMMARY = (
    "endpoints_clustered long, outliers_flagged long, excluded_local long, clusters long, "
    "eps double, eps_source string, knee_index long, min_samples int, components int, "
    "feature_weight double, pca_variance array<double>, pca_variance_total double, "
    "destinations_ranked long, destinations_flagged long"
)


def detect_anomalies(
    endpoints: DataFrame, metadata: DataFrame, packets: DataFrame, components: int = 2, whiten: bool = False,
    eps: float | None = None, feature_weight: float = 1.0, include_local: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> Detection:
    """Cluster and score all embedded endpoints, and score the host's uploads.

    With fewer than ``2 * components`` endpoints nothing is clustered; they are
    still ranked, with a null verdict.
    """
    components = max(components, MIN_COMPONENTS)
    min_samples = 2 * components
    data = materialize(clustering_input(endpoints, metadata, include_local), "clustering")
    labels = curve = scatter = radius = None
    explained: list[float] = []
    found = data.count()
    if found >= min_samples:
        space = blended_points(data, components, whiten, feature_weight)
        points = materialize(space.points, "points")
        clustering = cluster_points(points, min_samples, eps, block_rows)
        labels, curve, radius = clustering.labels, clustering.curve, clustering.radius
        scatter = plane(points, clustering.dims).join(labels, "ip_address")
        explained = space.explained
    scored = materialize(score_endpoints(data, labels), "scored")
    # Stored, so that its true size decides how packets are joined with it.
    hosts = materialize(host_ips(metadata), "hosts")
    flows = materialize(describe_destinations(host_outbound_flows(packets, hosts), metadata), "destinations")
    destinations = materialize(score_host_outbound(flows), "outbound")

    counts = scored.agg(F.count_if("is_outlier").alias("flagged")).first()
    outbound = destinations.agg(
        F.count("*").alias("ranked"), F.count_if(F.size("reasons") > 0).alias("flagged")
    ).first()
    clusters = None if labels is None else labels.agg(F.max("cluster")).first()[0] + 1
    row = (
        found, counts["flagged"], excluded_local(endpoints, metadata, include_local).first()[0], clusters,
        radius and round(radius.eps, 4), radius and radius.source, radius and radius.knee_index,
        min_samples, components, float(feature_weight),
        [round(v, 4) for v in explained], round(float(sum(explained)), 4),
        outbound["ranked"], outbound["flagged"],
    )
    return Detection(
        endpoints=scored.orderBy(F.desc("anomaly_score"), "ip_address"),
        destinations=destinations.orderBy(F.desc("outbound_score"), "ip_address"),
        verdicts=scored.filter("is_outlier IS NOT NULL").select("ip_address", "is_outlier"),
        summary=data.sparkSession.createDataFrame([row], SUMMARY),
        labels=labels, curve=curve, scatter=scatter,
    )
