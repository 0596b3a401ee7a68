"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harness import tables
from harness.tables import HOST
from peerscope.functions import columns, stats
from peerscope.functions.ranking import with_global_rank
from peerscope.operators import (
    bounded_silhouette, clusters, evaluation, features, flows, graph, knee, neighbours, profiles, reduction, scoring, timing,
)
from peerscope.operators.blocks import prepare
from peerscope.plans import detection, views
from peerscope.session import materialize, new_path
from peerscope.sources import capture_splits, captures, drilldown, ownership, packets, ranges
from peerscope.streaming import batchlog, cadence, ingest, sketches, windows

EPS, MIN_SAMPLES = 0.53, 4
# Small blocks, so that searches go over many of them at every size of the tables.
BLOCK_ROWS = 48

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable values: rounded doubles, arrays as text, timestamps as text."""
    def value(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, digits)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        elif isinstance(field.dataType, T.TimestampType):
            column = columns.timestamp_text(column)
        return column.alias(field.name)

    return df.select(*[value(f) for f in df.schema])


def clustering_data(spark: SparkSession, sf: str, embedded: bool = False) -> DataFrame:
    return materialize(
        features.clustering_input(tables.endpoints(spark, sf, embedded), tables.ip_metadata(spark, sf)), "data"
    )


def numeric_space(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(reduction.numeric_points(clustering_data(spark, sf)), "points")


# Sources

@query
def packets_normalized(spark, sf):
    return packets.normalize(tables.raw_packets(spark, sf)).drop("ts")


@query
def packet_flow_line(spark, sf):
    return packets.with_flow_line(tables.packets(spark, sf)).select("packet_id", "flow")


@query
def pcap_import(spark, sf):
    raw = captures.decode_captures(tables.captures(spark, sf))
    return tables.with_derived_addresses(packets.normalize(raw)).select(
        "ts_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size"
    )


@query
def pcap_split_import(spark, sf):
    """The capture files from storage, each cut into splits of 16 KB."""
    folder = new_path(spark, "captures")
    tables.capture_files(spark, sf, folder)
    raw = capture_splits.read_large_captures(spark, folder, split_bytes=16 * 1024)
    return tables.with_derived_addresses(packets.normalize(raw)).select(
        "ts_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size"
    )


@query
def stream_ingest(spark, sf):
    landing, table, checkpoint = (new_path(spark, n) for n in ("landing", "packets", "progress"))
    tables.raw_packets(spark, sf).repartition(4).write.parquet(landing)
    raw = ingest.watch_raw_packets(spark, landing, files_per_batch=2)
    ingest.ingest_packets(raw, table, checkpoint, drain=True).awaitTermination()
    return packets.read_packets(spark, table).drop("ts", "day")


def _landed(spark, sf):
    """Packets as a stream of two batches, the second all later than the first."""
    seen = packets.real_packets(tables.packets(spark, sf)).drop("payload")
    landing = new_path(spark, "landing")
    middle = seen.agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).cast("bigint")).first()[0]
    for part in (seen.filter(F.col("ts_ms") < middle), seen.filter(F.col("ts_ms") >= middle)):
        part.repartition(2).write.mode("append").parquet(landing)
    return ingest.watch(spark, landing, seen.schema, files_per_batch=2)


def _rolled_up(spark, rollup):
    out, checkpoint = (new_path(spark, n) for n in ("rollup", "progress"))
    windows.store_rollup(rollup, out, checkpoint, drain=True).awaitTermination()
    return spark.read.schema(rollup.schema).parquet(out)


_SUMS = ("packets", "bytes", "packets_out", "bytes_out")


@query
def stream_endpoint_windows(spark, sf):
    stream = _landed(spark, sf)
    kinds = {"tumbling": None, "sliding": "2 hours"}
    rolled = [
        _rolled_up(spark, windows.endpoint_windows(stream, "6 hours", slide)).withColumn("kind", F.lit(kind)) for kind, slide in kinds.items()
    ]
    return rolled[0].unionByName(rolled[1]).select(
        "kind", "ip_address", F.unix_millis("window_start").alias("start_ms"), F.unix_millis("window_end").alias("end_ms"), *_SUMS
    )


@query
def stream_sessions(spark, sf):
    rolled = _rolled_up(spark, windows.endpoint_sessions(_landed(spark, sf), "8 hours"))
    return rolled.select("ip_address", F.unix_millis("session_start").alias("start_ms"), F.unix_millis("session_end").alias("end_ms"), *_SUMS)


@query
def session_islands(spark, sf):
    return windows.session_islands(packets.real_packets(tables.stored_packets(spark, sf)), 8 * 3_600_000)


@query
def stream_cadence(spark, sf):
    out, checkpoint = (new_path(spark, n) for n in ("cadence", "progress"))
    changes = cadence.endpoint_cadence(_landed(spark, sf), timeout_ms=400 * 86_400_000)
    cadence.store_cadence(changes, out, checkpoint, drain=True).awaitTermination()
    latest = cadence.latest_cadence(spark.read.schema(f"{cadence.RESULT}, step int").parquet(out))
    return plain(latest.select("ip_address", "interval_mean", "interval_cv"))


@query
def refreshed_profiles(spark, sf):
    flow_path, cadence_path, *checkpoints = (new_path(spark, n) for n in ("flows", "cadence", "progress", "progress"))
    stream = _landed(spark, sf)
    edges, changes = batchlog.flow_log(spark, flow_path, 2), batchlog.cadence_log(spark, cadence_path, 2)
    batchlog.keep_flows(stream, edges, checkpoints[0], drain=True).awaitTermination()
    batchlog.keep_cadence(stream, changes, checkpoints[1], drain=True, timeout_ms=400 * 86_400_000).awaitTermination()
    return plain(batchlog.refreshed_profiles(materialize(edges.read(), "flows"), changes.read(), tables.ip_metadata(spark, sf)))


@query
def sketched_peers(spark, sf):
    """Sketches that a stream has stored in two batches, merged over all windows: exact sums, and whether the estimated
    peers are within five standard errors of the exact counts."""
    path, checkpoint = (new_path(spark, n) for n in ("sketches", "progress"))
    log = sketches.sketch_log(spark, path, 2)
    sketches.keep_sketches(_landed(spark, sf), log, checkpoint, "6 hours", drain=True).awaitTermination()
    found = sketches.estimates(sketches.sketches_between(log.read()))
    exact = tables.endpoints(spark, sf).select("ip_address", F.col("out_peers").alias("sent_to"), F.col("in_peers").alias("got_from"))
    return found.join(exact, "ip_address").select(
        "ip_address", "packets", "bytes",
        (F.abs(F.col("out_peers") - F.col("sent_to")) <= 0.08 * F.col("sent_to")).alias("out_within"),
        (F.abs(F.col("in_peers") - F.col("got_from")) <= 0.08 * F.col("got_from")).alias("in_within"),
    )


@query
def packet_scan(spark, sf):
    return packets.packet_scan(tables.packets(spark, sf))


@query
def ip_metadata_scan(spark, sf):
    owners = tables.owners(spark, sf)
    nodes = graph.ip_nodes(tables.packets(spark, sf))
    return ownership.ip_metadata(
        nodes,
        ownership.seed_local_host(owners.select("ip_address", "org"), HOST),
        owners.select("ip_address", "hostname", "location"),
    )


@query
def clustering_input(spark, sf):
    data = features.clustering_input(tables.endpoints(spark, sf), tables.ip_metadata(spark, sf))
    return plain(data.drop("embedding"))


@query
def embedded_only(spark, sf):
    """Endpoints that received more than they sent are not embedded yet."""
    vector = F.when(F.col("packets_in") <= F.col("packets_out"), F.col("embedding"))
    endpoints = tables.endpoints(spark, sf).withColumn("embedding", vector)
    return plain(features.clustering_input(endpoints, tables.ip_metadata(spark, sf)).drop("embedding"))


@query
def owner_fallback(spark, sf):
    """Every second packet count comes without an owner of its own, and a region is missing in the metadata."""
    endpoints = tables.endpoints(spark, sf)
    for c in ("org", "hostname", "location"):
        endpoints = endpoints.withColumn(c, F.when(F.col("packets_out") % 2 == 0, F.col(c)))
    metadata = tables.ip_metadata(spark, sf).filter("location <> 'ASIA'")
    return plain(features.clustering_input(endpoints, metadata, include_local=True).drop("embedding"))


@query
def seeded_host(spark, sf):
    """An address that another owner holds becomes a local host."""
    seeded = ownership.seed_local_host(tables.owners(spark, sf).select("ip_address", "org"), "10.0.0.2")
    hosts = tables.owners(spark, sf).select("ip_address", "hostname", "location")
    return ownership.host_ips(ownership.ip_metadata(graph.ip_nodes(tables.packets(spark, sf)), seeded, hosts))


@query
def port_size_points(spark, sf):
    return views.port_size_points(tables.packets(spark, sf))


@query
def port_size_summary(spark, sf):
    return views.port_size_summary(tables.packets(spark, sf))


# Sinks and table maintenance

@query
def ip_nodes(spark, sf):
    return graph.ip_nodes(tables.packets(spark, sf))


@query
def port_nodes(spark, sf):
    return graph.port_nodes(tables.packets(spark, sf))


@query
def packet_edges(spark, sf):
    return graph.packet_edges(tables.packets(spark, sf))


@query
def ip_metadata_upsert(spark, sf):
    metadata = tables.ip_metadata(spark, sf)
    missing = ownership.undocumented(graph.ip_nodes(tables.packets(spark, sf)), metadata)
    added = ownership.enrich(missing, tables.ownership_records(spark, sf))
    return ownership.upsert_metadata(metadata, added)


@query
def batch_append(spark, sf):
    """Packets in three batches, the second of which is appended twice."""
    path, flat = new_path(spark, "packets"), packets.normalize(tables.raw_packets(spark, sf))
    for batch in (0, 1, 2, 1):
        packets.append_batch(flat.filter(F.col("packet_id") % 3 == batch), path, batch)
    return packets.read_batches(spark, path).drop("ts", "day")


@query
def metadata_replace(spark, sf):
    """Records that name a company replace what is known; those without an owner add addresses."""
    records = tables.ownership_records(spark, sf).filter(~F.col("record").contains('"org":') & ~F.col("record").contains('"asn":'))
    return ownership.upsert_metadata(tables.ip_metadata(spark, sf), ownership.resolve_records(records))


@query
def endpoint_replace(spark, sf):
    """All fields of profiles of TLS packets, replaced by those of the others; verdicts stay, unknown addresses do not come in."""
    everything = materialize(tables.packets(spark, sf), "packets")
    metadata, web = tables.ip_metadata(spark, sf), F.col("protocol") == "TLS"
    earlier = profiles.endpoint_profile(everything.filter(web), metadata).withColumn("outlier", F.col("bytes_out") > F.col("bytes_in"))
    later = profiles.endpoint_profile(everything.filter(~web), metadata)
    in_graph = graph.ip_nodes(everything).filter(~F.col("ip_address").startswith("10.9."))
    return plain(profiles.upsert_endpoints(materialize(earlier, "earlier"), materialize(later, "later"), in_graph))


@query
def verdict_replace(spark, sf):
    """Verdicts that were all true: the scored endpoints get theirs, the others stay true."""
    endpoints = tables.endpoints(spark, sf).withColumn("outlier", F.lit(True))
    data = materialize(features.clustering_input(endpoints, tables.ip_metadata(spark, sf)), "data")
    verdicts = scoring.score_endpoints(data).select("ip_address", (F.size("reasons") > 0).alias("is_outlier"))
    return profiles.write_verdicts(endpoints, verdicts).select("ip_address", "outlier")


@query
def endpoint_upsert(spark, sf):
    everything = materialize(tables.packets(spark, sf), "packets")
    metadata = tables.ip_metadata(spark, sf)
    web = F.col("protocol") == "TLS"
    kept = ["ip_address", "bytes_out", "packets_out", "bytes_in", "packets_in", "protocols"]
    earlier = profiles.endpoint_profile(everything.filter(web), metadata).select(kept).withColumn(
        "outlier", F.col("bytes_out") > F.col("bytes_in")
    )
    later = profiles.endpoint_profile(everything.filter(~web), metadata).select(kept)
    return plain(profiles.upsert_endpoints(earlier, later, graph.ip_nodes(everything)))


@query
def outlier_writeback(spark, sf):
    endpoints = tables.endpoints(spark, sf)
    data = materialize(features.clustering_input(endpoints, tables.ip_metadata(spark, sf)), "data")
    verdicts = scoring.score_endpoints(data).select("ip_address", (F.size("reasons") > 0).alias("is_outlier"))
    return profiles.write_verdicts(endpoints, verdicts).select("ip_address", "outlier")


@query
def capture_entity_counts(spark, sf):
    return graph.entity_counts(
        tables.packets(spark, sf), tables.owners(spark, sf).select("ip_address", "org"), tables.endpoints(spark, sf)
    )


@query
def run_summary(spark, sf):
    everything, metadata = materialize(tables.packets(spark, sf), "packets"), tables.ip_metadata(spark, sf)
    enriched, scanned = detection.document_organizations(
        graph.ip_nodes(everything), metadata, tables.ownership_records(spark, sf)
    )
    endpoints = tables.endpoints(spark, sf)
    data = materialize(features.clustering_input(endpoints, metadata), "data")
    hosts = materialize(ownership.host_ips(metadata), "hosts")
    destinations = scoring.describe_destinations(scoring.host_outbound_flows(everything, hosts), metadata)
    outbound = scoring.score_host_outbound(materialize(destinations, "destinations"))

    def number(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    return scanned.select(
        "addresses_scanned", "organizations_added",
        number(everything).alias("packets_captured"),
        number(endpoints.filter("embedding IS NOT NULL")).alias("endpoints_embedded"),
        number(data).alias("endpoints_clustered"),
        features.excluded_local(endpoints, metadata).scalar().alias("excluded_local"),
        number(outbound).alias("destinations_ranked"),
        number(outbound.filter("size(reasons) > 0")).alias("destinations_flagged"),
    )


# Filters, joins, enrichment

@query
def real_packets(spark, sf):
    return packets.real_packets(tables.packets(spark, sf)).drop("ts", "payload")


@query
def excluded_local(spark, sf):
    return features.excluded_local(tables.endpoints(spark, sf), tables.ip_metadata(spark, sf))


@query
def host_ips(spark, sf):
    return tables.host_ips(spark, sf)


@query
def undocumented_ips(spark, sf):
    return ownership.undocumented(graph.ip_nodes(tables.packets(spark, sf)), tables.ip_metadata(spark, sf))


@query
def enrich_organizations(spark, sf):
    missing = ownership.undocumented(graph.ip_nodes(tables.packets(spark, sf)), tables.ip_metadata(spark, sf))
    return ownership.enrich(missing, tables.ownership_records(spark, sf))


@query
def enrich_cidr(spark, sf):
    missing = ownership.undocumented(graph.ip_nodes(tables.packets(spark, sf)), tables.ip_metadata(spark, sf))
    return ranges.match_ranges(missing, tables.address_ranges(spark, sf))


@query
def org_name_resolution(spark, sf):
    return ownership.resolve_records(tables.ownership_records(spark, sf))


# Profiles and timing

@query
def flow_edges(spark, sf):
    return flows.flow_edges(tables.packets(spark, sf))


@query
def outbound_profile(spark, sf):
    return plain(profiles.outbound_profile(tables.packets(spark, sf)))


@query
def inbound_profile(spark, sf):
    return plain(profiles.inbound_profile(tables.packets(spark, sf)))


@query
def endpoint_profile(spark, sf):
    return plain(tables.profiles(spark, sf))


@query
def endpoint_timing(spark, sf):
    return plain(timing.endpoint_timing(packets.real_packets(tables.stored_packets(spark, sf))))


@query
def packet_gaps(spark, sf):
    return timing.packet_gaps(packets.real_packets(tables.stored_packets(spark, sf)))


@query
def endpoint_description(spark, sf):
    return reduction.with_description(tables.profiles(spark, sf)).select("ip_address", "description")


@query
def incremental_profile(spark, sf):
    landing, table, checkpoint = (new_path(spark, n) for n in ("landing", "flows", "progress"))
    tables.packets(spark, sf).drop("payload").repartition(4).write.parquet(landing)
    stream = ingest.watch(spark, landing, tables.PACKETS, files_per_batch=1)
    ingest.refresh_flows(packets.real_packets(stream), table, checkpoint, drain=True).awaitTermination()
    edges = materialize(ingest.read_flows(spark, table), "flows")
    return plain(profiles.traffic_profile(edges))


# Features and scores

@query
def shape_ratios(spark, sf):
    return plain(features.shape_ratios(tables.profiles(spark, sf)))


@query
def numeric_features(spark, sf):
    return plain(features.numeric_features(clustering_data(spark, sf)))


@query
def feature_location_scale(spark, sf):
    rows = features.numeric_features(clustering_data(spark, sf))
    spreads = stats.log_spread(rows, features.NUMERIC)
    return plain(spark.createDataFrame(
        [(name, s.median, s.mad, s.std) for name, s in spreads.items()],
        "feature string, median double, mad double, std double",
    ))


@query
def robust_z(spark, sf):
    return plain(features.robust_z(features.numeric_features(clustering_data(spark, sf))))


@query
def standardized_features(spark, sf):
    return plain(features.standardized(features.numeric_features(clustering_data(spark, sf))))


@query
def anomaly_scores(spark, sf):
    return plain(scoring.score_endpoints(clustering_data(spark, sf)).drop("reasons", "is_outlier"))


@query
def anomaly_reasons(spark, sf):
    return scoring.explode_reasons(scoring.score_endpoints(clustering_data(spark, sf)))


@query
def endpoint_ranking(spark, sf):
    scored = scoring.score_endpoints(clustering_data(spark, sf)).select("ip_address", "anomaly_score")
    return with_global_rank(scored, [F.desc("anomaly_score"), "ip_address"], "place")


@query
def host_outbound_flows(spark, sf):
    return scoring.host_outbound_flows(
        tables.packets(spark, sf), materialize(tables.host_ips(spark, sf), "hosts")
    )


def _outbound(spark, sf):
    metadata = tables.ip_metadata(spark, sf)
    hosts = materialize(ownership.host_ips(metadata), "hosts")
    found = scoring.host_outbound_flows(tables.packets(spark, sf), hosts)
    return scoring.score_host_outbound(materialize(scoring.describe_destinations(found, metadata), "destinations"))


@query
def host_outbound(spark, sf):
    scored = _outbound(spark, sf).withColumn("reasons", F.size("reasons"))
    return with_global_rank(scored, [F.desc("outbound_score"), "ip_address"], "place")


@query
def host_outbound_reasons(spark, sf):
    return scoring.explode_reasons(_outbound(spark, sf))


# Text vectors

@query
def embedding_join(spark, sf):
    joined = tables.endpoints(spark, sf, embedded=True)
    return joined.filter("embedding IS NOT NULL").select(
        "ip_address", F.size("embedding").alias("width"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v), 4).alias("total"),
    )


@query
def endpoint_embedding(spark, sf):
    stored = materialize(tables.profiles(spark, sf), "profiles")
    return reduction.hash_vectors(stored)


@query
def embedding_pca(spark, sf):
    return reduction.reduce_vectors(clustering_data(spark, sf, embedded=True), 2).points


@query
def pca_variance(spark, sf):
    explained = reduction.reduce_vectors(clustering_data(spark, sf, embedded=True), 2).explained
    return spark.createDataFrame(
        [(i + 1, v) for i, v in enumerate(explained)], "component int, explained double"
    )


@query
def blended_features(spark, sf):
    return reduction.blended_points(clustering_data(spark, sf, embedded=True), 2).points


def _lengths(points: DataFrame) -> DataFrame:
    """Squared lengths: what of all components together does not depend on their signs or on turns among equal ones."""
    return plain(points.select("ip_address", F.aggregate("features", F.lit(0.0), lambda total, v: total + v * v).alias("length")), 4)


def _width(data: DataFrame) -> int:
    return data.agg(F.max(F.size("embedding"))).first()[0]


@query
def pca_lengths(spark, sf):
    """Of all components together: centred lengths, which a rotation keeps."""
    data = clustering_data(spark, sf, embedded=True)
    return _lengths(reduction.reduce_vectors(data, _width(data)).points)


@query
def blend_lengths(spark, sf):
    """Text vectors by all components beside numbers at half their scale."""
    data = clustering_data(spark, sf, embedded=True)
    return _lengths(reduction.blended_points(data, _width(data), weight=0.5).points)


# Neighbours, clusters, evaluation

@query
def eps_neighbors(spark, sf):
    return neighbours.eps_neighbours(prepare(numeric_space(spark, sf)), EPS, BLOCK_ROWS)


@query
def k_distance(spark, sf):
    return plain(neighbours.k_distances(prepare(numeric_space(spark, sf)), MIN_SAMPLES, BLOCK_ROWS))


@query
def k_distance_curve(spark, sf):
    curve = neighbours.k_distance_curve(neighbours.k_distances(prepare(numeric_space(spark, sf)), MIN_SAMPLES, BLOCK_ROWS))
    return plain(curve.select("place", "k_distance"))


@query
def recommended_eps(spark, sf):
    curve = neighbours.k_distance_curve(neighbours.k_distances(prepare(numeric_space(spark, sf)), MIN_SAMPLES, BLOCK_ROWS))
    radius = knee.recommend_eps(materialize(curve, "curve"))
    return plain(spark.createDataFrame(
        [(radius.eps, radius.knee_index, radius.source)], "eps double, knee_index long, eps_source string"
    ))


@query
def dbscan_labels(spark, sf):
    return clusters.dbscan(prepare(numeric_space(spark, sf)), EPS, MIN_SAMPLES, BLOCK_ROWS)


@query
def silhouette(spark, sf):
    points = numeric_space(spark, sf)
    labels = materialize(clusters.dbscan(prepare(points), EPS, MIN_SAMPLES, BLOCK_ROWS), "labels")
    score = evaluation.silhouette(points, labels, BLOCK_ROWS)
    return plain(spark.createDataFrame([(score,)], "silhouette double"))


def _labels(spark, sf):
    return materialize(clusters.dbscan(prepare(numeric_space(spark, sf)), EPS, MIN_SAMPLES, BLOCK_ROWS), "labels")


@query
def cluster_run_counts(spark, sf):
    return evaluation.cluster_counts(_labels(spark, sf))


@query
def noise_list(spark, sf):
    return evaluation.outlier_sets({"numeric-only": _labels(spark, sf)})


@query
def silhouette_bounds(spark, sf):
    """The pruned silhouette, exact at tolerance 0, and whether the bounds of a tolerance hold it and are as narrow as stated."""
    points = materialize(numeric_space(spark, sf), "points")
    labels = materialize(clusters.dbscan(prepare(points), EPS, MIN_SAMPLES, BLOCK_ROWS), "labels")
    exact = bounded_silhouette.estimate_silhouette(points, labels, 0.0, BLOCK_ROWS)
    rough = bounded_silhouette.estimate_silhouette(points, labels, 0.05, BLOCK_ROWS)
    row = (None, rough is None, True)  # below two clusters neither has a value
    if exact is not None:
        holds = rough.low - 1e-9 <= exact.silhouette <= rough.high + 1e-9
        row = (exact.silhouette, holds, rough.high - rough.low <= 2 * 0.05 + 1e-9)
    return plain(spark.createDataFrame([row], "silhouette double, holds boolean, narrow boolean"))


def _ablation(spark, sf):
    return evaluation.ablation(clustering_data(spark, sf, embedded=True), block_rows=BLOCK_ROWS)


@query
def ablation_summary(spark, sf):
    return _ablation(spark, sf).summary


@query
def ablation_outliers(spark, sf):
    return _ablation(spark, sf).outliers


@query
def ablation_agreement(spark, sf):
    return _ablation(spark, sf).agreement


@query
def ablation_jaccard(spark, sf):
    """Overlap of three outlier sets that SQL can build: endpoints cited for
    their volume, their shape and their cadence."""
    reasons = scoring.explode_reasons(scoring.score_endpoints(clustering_data(spark, sf)))
    groups = {"volume": features.BASE, "shape": list(features.RATIOS), "cadence": features.TIMING}
    condition = F.when(F.col("feature").isin(groups["volume"]), "volume").when(
        F.col("feature").isin(groups["shape"]), "shape"
    ).otherwise("cadence")
    return evaluation.jaccard(
        reasons.select(condition.alias("condition"), "ip_address").distinct(), list(groups)
    )


# Streaming and the whole runs

def _detection(spark, sf):
    return detection.detect_anomalies(
        tables.endpoints(spark, sf, embedded=True), tables.ip_metadata(spark, sf), tables.packets(spark, sf),
        block_rows=BLOCK_ROWS,
    )


@query
def anomaly_detection(spark, sf):
    return _detection(spark, sf).endpoints


@query
def detection_summary(spark, sf):
    return _detection(spark, sf).summary


@query
def cluster_scatter(spark, sf):
    return _detection(spark, sf).scatter


# Read views

@query
def fetch_traffic(spark, sf):
    endpoints = tables.endpoints(spark, sf)
    newest = endpoints.agg(F.max("profiled_at").alias("at")).scalar()
    return plain(views.fetch_traffic(endpoints, tables.ip_metadata(spark, sf), as_of=newest))


@query
def inspect_profile(spark, sf):
    return plain(views.inspect_profile(tables.endpoints(spark, sf), tables.ip_metadata(spark, sf), HOST))


@query
def inspect_totals(spark, sf):
    return views.inspect_totals(tables.packets(spark, sf), tables.endpoints(spark, sf), HOST)


@query
def inspect_peers(spark, sf):
    return plain(views.inspect_peers(tables.packets(spark, sf), tables.ip_metadata(spark, sf), HOST))


@query
def inspect_packets(spark, sf):
    return plain(views.inspect_packets(tables.packets(spark, sf), HOST))


def _indexed(spark, sf):
    """The drill-down tables, built from two batches."""
    index = drilldown.DrillDown(spark, new_path(spark, "drilldown"), buckets=16)
    seen = tables.stored_packets(spark, sf)
    for batch in (0, 1):
        index.append(seen.filter(F.col("packet_id") % 2 == batch), batch)
    return index


@query
def indexed_totals(spark, sf):
    return views.indexed_totals(_indexed(spark, sf), tables.endpoints(spark, sf), HOST)


@query
def indexed_peers(spark, sf):
    return plain(views.indexed_peers(_indexed(spark, sf), tables.ip_metadata(spark, sf), HOST))


@query
def indexed_packets(spark, sf):
    return plain(views.indexed_packets(_indexed(spark, sf), HOST))
