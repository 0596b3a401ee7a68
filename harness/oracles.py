"""DuckDB SQL giving the same rows as the queries of the same name."""

from __future__ import annotations

HOST, LOCAL = "10.0.0.1", "YOU ARE HERE"
EPS, MIN_SAMPLES = 0.53, 4

BASE = ["bytes_out", "bytes_in", "packets_out", "packets_in", "out_peers", "in_peers"]
RATIOS = ["bytes_out_in_ratio", "packets_out_in_ratio", "bytes_per_packet", "bytes_per_peer"]
TIMING = ["interval_mean", "interval_cv"]
NUMERIC = BASE + RATIOS + TIMING


def ip(n: str) -> str:
    return f"'10.0.' || ({n}) // 250 || '.' || (({n}) % 250 + 1)"


def joined_text(expression: str) -> str:
    return f"coalesce(array_to_string({expression}, ','), '')"


CTES: dict[str, str] = {}

CTES["k_events"] = """
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
"""

CTES["packets"] = f"""
  SELECT event_id AS packet_id, ts, epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN event_id % 50 = 0 THEN '0.0.0.0' ELSE {ip('user_id')} END AS src_ip,
    CASE WHEN event_id % 50 = 0 THEN '0.0.0.0'
         WHEN event_id % 499 = 7 THEN '10.9.0.' || event_id // 499
         ELSE {ip('k')} END AS dst_ip,
    CAST(CASE WHEN event_id % 50 = 0 THEN 0 ELSE 49152 + event_id % 500 END AS INTEGER) AS src_port,
    CAST(CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_type = 'click' THEN 443
              WHEN event_type = 'view' THEN 80 WHEN event_type = 'purchase' THEN 8443
              WHEN event_type = 'signup' THEN 22 ELSE 1024 + k END AS INTEGER) AS dst_port,
    CASE WHEN event_id % 50 = 0 THEN 'ARP' WHEN event_type IN ('click', 'purchase') THEN 'TLS'
         WHEN event_type = 'view' THEN 'HTTP' WHEN event_type = 'signup' THEN 'SSH' ELSE 'DATA' END AS protocol,
    CAST(40 + floor(value * 100) AS BIGINT) AS size
  FROM k_events
"""

CTES["normalized"] = """
  SELECT packet_id, ts_ms, src_ip, dst_ip, src_port,
    CASE WHEN dst_port = 22 THEN 0 ELSE dst_port END AS dst_port, protocol, size,
    CASE WHEN protocol <> 'ARP' THEN 'size=' || size END AS payload
  FROM packets
"""

CTES["metadata"] = f"""
  SELECT {ip('c_custkey')} AS ip_address,
    CASE WHEN {ip('c_custkey')} = '{HOST}' THEN '{LOCAL}' ELSE n_name END AS org,
    c_name AS hostname, r_name AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_acctbal >= 0
"""

CTES["resolved"] = f"""
  SELECT {ip('c_custkey')} AS ip_address,
    CASE WHEN c_acctbal < 0 THEN 'Unknown' ELSE n_name END AS org,
    CASE WHEN c_acctbal >= 3000 AND c_acctbal < 6000 THEN 'Unknown' ELSE c_name END AS hostname,
    CASE WHEN c_acctbal >= 3000 THEN r_name ELSE 'Unknown' END AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

CTES["ends"] = """
  SELECT src_ip AS ip_address, src_port AS port, 'SENT' AS relation, packet_id FROM packets
  UNION ALL
  SELECT dst_ip, dst_port, 'RECEIVED', packet_id FROM packets
"""

CTES["both_ends"] = """
  SELECT src_ip AS ip_address, packet_id, epoch_us(ts) AS micros, ts_ms, size, true AS sent
  FROM packets WHERE src_ip <> '0.0.0.0' AND dst_ip <> '0.0.0.0'
  UNION ALL
  SELECT dst_ip, packet_id, epoch_us(ts), ts_ms, size, false
  FROM packets WHERE src_ip <> '0.0.0.0' AND dst_ip <> '0.0.0.0' AND src_ip <> dst_ip
"""

# Ten dot nothing is number 167772160, ten dot nine 168361984.
CTES["address_ranges"] = """
  SELECT CASE r_regionkey WHEN 0 THEN '0.0.0.0/0' WHEN 1 THEN '10.0.0.0/8'
      ELSE '10.0.' || (r_regionkey * 4 - 8) || '.250-10.0.' || (r_regionkey * 4) || '.128' END AS range, r_name AS org, 'region' AS location,
    CASE r_regionkey WHEN 0 THEN 0 WHEN 1 THEN 167772160 ELSE 167772160 + (r_regionkey * 4 - 8) * 256 + 250 END AS first,
    CASE r_regionkey WHEN 0 THEN 4294967295 WHEN 1 THEN 184549375 ELSE 167772160 + r_regionkey * 4 * 256 + 128 END AS last
  FROM region
  UNION ALL
  SELECT '10.0.' || n_nationkey || '.7/24', n_name, 'nation', 167772160 + n_nationkey * 256, 167772160 + n_nationkey * 256 + 255 FROM nation
  UNION ALL
  SELECT '10.' || CASE WHEN s_suppkey % 3 = 0 THEN '9.0.' ELSE '0.' || (s_suppkey % 7) || '.' END || (s_suppkey * 16 % 256) || '/28', s_name, 'supplier',
    base + s_suppkey * 16 % 256, base + s_suppkey * 16 % 256 + 15
  FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 168361984 ELSE 167772160 + s_suppkey % 7 * 256 END AS base FROM supplier)
"""

CTES["missing"] = """
  SELECT DISTINCT ip_address FROM ends WHERE ip_address NOT IN (SELECT ip_address FROM metadata)
"""

CTES["real_packets"] = """
  SELECT * FROM packets WHERE src_ip <> '0.0.0.0' AND dst_ip <> '0.0.0.0'
"""

CTES["directed"] = """
  SELECT src_ip AS ip_address, true AS outbound, dst_ip AS peer, dst_port, protocol, size, ts FROM real_packets
  UNION ALL
  SELECT dst_ip, false, src_ip, dst_port, protocol, size, ts FROM real_packets
"""

CTES["traffic"] = f"""
  SELECT ip_address,
    CAST(coalesce(sum(size) FILTER (outbound), 0) AS BIGINT) AS bytes_out,
    count(*) FILTER (outbound) AS packets_out,
    count(DISTINCT peer) FILTER (outbound) AS out_peers,
    {joined_text("list_sort(list(DISTINCT dst_port) FILTER (outbound))[1:20]")} AS out_ports,
    CAST(coalesce(sum(size) FILTER (NOT outbound), 0) AS BIGINT) AS bytes_in,
    count(*) FILTER (NOT outbound) AS packets_in,
    count(DISTINCT peer) FILTER (NOT outbound) AS in_peers,
    {joined_text("list_sort(list(DISTINCT dst_port) FILTER (NOT outbound))[1:20]")} AS in_ports,
    {joined_text("list_sort(list(DISTINCT protocol))")} AS protocols,
    max(ts) AS last_seen
  FROM directed GROUP BY ip_address
"""

CTES["stream_rows"] = """
  SELECT unnest(list_distinct([src_ip, dst_ip])) AS ip_address, ts_ms FROM real_packets
"""

CTES["moments"] = """
  SELECT ip_address, ts_ms, count(*) AS packets,
    ts_ms - lag(ts_ms) OVER (PARTITION BY ip_address ORDER BY ts_ms) AS gap_ms
  FROM stream_rows GROUP BY ip_address, ts_ms
"""

CTES["gaps"] = """
  SELECT ip_address, (ts_ms - lag(ts_ms) OVER (PARTITION BY ip_address ORDER BY ts_ms)) / 1000.0 AS gap
  FROM stream_rows
"""

CTES["timing"] = """
  SELECT ip_address,
    CASE WHEN count(*) >= 3 AND span > 0 THEN span / (count(*) - 1) / 1000.0 END AS interval_mean,
    CASE WHEN count(*) >= 3 AND span > 0 THEN stddev_pop(gap) / avg(gap) END AS interval_cv
  FROM gaps JOIN (SELECT ip_address, max(ts_ms) - min(ts_ms) AS span FROM stream_rows GROUP BY ip_address)
    USING (ip_address)
  GROUP BY ip_address, span
"""

CTES["profiles"] = """
  SELECT ip_address, org, hostname, location, bytes_out, packets_out, out_peers, out_ports,
    bytes_in, packets_in, in_peers, in_ports, protocols, interval_mean, interval_cv, last_seen
  FROM traffic LEFT JOIN timing USING (ip_address) LEFT JOIN metadata USING (ip_address)
"""

CTES["data"] = f"""
  SELECT ip_address, coalesce(org, 'Unknown') AS org, coalesce(hostname, 'Unknown') AS hostname,
    coalesce(location, 'Unknown') AS location, bytes_out, bytes_in, packets_out, packets_in,
    out_peers, in_peers, interval_mean, interval_cv
  FROM profiles WHERE coalesce(org, 'Unknown') <> '{LOCAL}'
"""

RATIO_SQL = """
    CAST(bytes_out AS DOUBLE) / (bytes_in + 1.0::DOUBLE) AS bytes_out_in_ratio,
    CAST(packets_out AS DOUBLE) / (packets_in + 1.0::DOUBLE) AS packets_out_in_ratio,
    CAST(bytes_out + bytes_in AS DOUBLE) / (packets_out + packets_in + 1.0::DOUBLE) AS bytes_per_packet,
    CAST(bytes_out AS DOUBLE) / (out_peers + 1.0::DOUBLE) AS bytes_per_peer
"""

CTES["features"] = f"""
  SELECT ip_address, org, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in BASE)}, {RATIO_SQL},
    coalesce(interval_mean, (SELECT median(interval_mean) FROM data), 0.0) AS interval_mean,
    coalesce(interval_cv, (SELECT median(interval_cv) FROM data), 0.0) AS interval_cv
  FROM data
"""

CTES["long_features"] = "\n  UNION ALL ".join(
    f"SELECT ip_address, org, {i} AS place, '{c}' AS feature, {c} AS v, ln(1 + {c}) AS x FROM features"
    for i, c in enumerate(NUMERIC)
)

CTES["centres"] = """
  SELECT feature, median(x) AS median, stddev_pop(x) AS std, avg(x) AS mean FROM long_features GROUP BY feature
"""

CTES["spreads"] = """
  SELECT feature, any_value(c.median) AS median, median(abs(x - c.median)) AS mad,
    any_value(c.std) AS std, any_value(c.mean) AS mean
  FROM long_features JOIN centres c USING (feature) GROUP BY feature
"""

CTES["z"] = """
  SELECT ip_address, org, place, feature, v,
    CASE WHEN 1.4826 * mad > 1e-9 THEN (x - median) / (1.4826 * mad)
         WHEN std > 1e-9 THEN (x - median) / std ELSE 0.0 END AS z,
    CASE WHEN std > 1e-12 THEN (x - mean) / std ELSE 0.0 END AS standard
  FROM long_features JOIN spreads USING (feature)
"""

CTES["scores"] = """
  SELECT ip_address, round(sqrt(sum(z * z)), 4) AS anomaly_score FROM z GROUP BY ip_address
"""

# Fixed values, as in the operators.
FLOW = {
    "bytes_out": "out", "packets_out": "out", "bytes_in": "in", "packets_in": "in",
    "bytes_out_in_ratio": "out", "packets_out_in_ratio": "out", "bytes_per_peer": "out",
}
# Fixed values, as in the operators.
UNITS = {
    "bytes_out": "bytes", "bytes_in": "bytes", "packets_out": "packets", "packets_in": "packets",
    "out_peers": "peers", "in_peers": "peers", "bytes_out_in_ratio": "ratio", "packets_out_in_ratio": "ratio",
    "bytes_per_packet": "bytes/packet", "bytes_per_peer": "bytes/peer",
    "interval_mean": "seconds", "interval_cv": "ratio",
}
# Fixed values, as in the operators.
REMOTE = {
    "out": "remote → host: traffic the capture host downloaded (NOT host exfil)",
    "in": "host → remote: traffic the capture host sent to this IP (outbound-from-host signal)",
}


def cases(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


CTES["reasons"] = f"""
  SELECT ip_address, feature, round(v, 4) AS value, {cases('feature', UNITS)} AS unit,
    round(z, 2) AS robust_z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction,
    {cases('feature', {f: REMOTE[d] for f, d in FLOW.items()})} AS host_relative,
    row_number() OVER (PARTITION BY ip_address ORDER BY abs(round(z, 2)) DESC, place) AS rank
  FROM z WHERE abs(z) >= 2.5
"""

CTES["exchanged"] = f"""
  SELECT CASE WHEN src_ip = '{HOST}' THEN dst_ip ELSE src_ip END AS ip_address, src_ip = '{HOST}' AS up, size
  FROM packets WHERE (src_ip = '{HOST}') <> (dst_ip = '{HOST}')
    AND EXISTS (SELECT 1 FROM metadata WHERE org = '{LOCAL}' AND ip_address = '{HOST}')
"""

CTES["uploads"] = """
  SELECT ip_address,
    CAST(coalesce(sum(size) FILTER (up), 0) AS BIGINT) AS upload_bytes, count(*) FILTER (up) AS upload_packets,
    CAST(coalesce(sum(size) FILTER (NOT up), 0) AS BIGINT) AS download_bytes,
    count(*) FILTER (NOT up) AS download_packets
  FROM exchanged WHERE ip_address <> '0.0.0.0' GROUP BY ip_address HAVING count(*) FILTER (up) > 0
"""

CTES["destinations"] = """
  SELECT ip_address, coalesce(org, 'Unknown') AS org, coalesce(hostname, 'Unknown') AS hostname,
    coalesce(location, 'Unknown') AS location, upload_bytes, upload_packets, download_bytes, download_packets,
    CAST(upload_bytes AS DOUBLE) / (download_bytes + 1.0::DOUBLE) AS upload_download_ratio
  FROM uploads LEFT JOIN metadata USING (ip_address)
"""

# Fixed values, as in the operators.
HOST_UNITS = {"upload_bytes": "bytes", "upload_packets": "packets", "upload_download_ratio": "ratio"}
# Fixed values, as in the operators.
HOST_WORDS = {
    "upload_bytes": "host → remote: data the capture host sent out (outbound from host)",
    "upload_packets": "host → remote: packets the capture host sent out (outbound from host)",
    "upload_download_ratio": "host sent more to this peer than it received (exfil-shaped when high)",
}

CTES["long_uploads"] = "\n  UNION ALL ".join(
    f"SELECT ip_address, {i} AS place, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, ln(1 + {c}) AS x FROM destinations"
    for i, c in enumerate(HOST_UNITS)
)
CTES["upload_centres"] = """
  SELECT feature, median(x) AS median, stddev_pop(x) AS std FROM long_uploads GROUP BY feature
"""
CTES["upload_z"] = """
  SELECT ip_address, place, feature, v,
    CASE WHEN 1.4826 * mad > 1e-9 THEN (x - median) / (1.4826 * mad)
         WHEN std > 1e-9 THEN (x - median) / std ELSE 0.0 END AS z
  FROM long_uploads JOIN (
    SELECT feature, any_value(c.median) AS median, any_value(c.std) AS std, median(abs(x - c.median)) AS mad
    FROM long_uploads JOIN upload_centres c USING (feature) GROUP BY feature
  ) USING (feature)
"""
CTES["upload_reasons"] = f"""
  SELECT ip_address, feature, round(v, 4) AS value, {cases('feature', HOST_UNITS)} AS unit,
    round(z, 2) AS robust_z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction,
    {cases('feature', HOST_WORDS)} AS host_relative,
    row_number() OVER (PARTITION BY ip_address ORDER BY abs(round(z, 2)) DESC, place) AS rank
  FROM upload_z WHERE abs(z) >= 2.5
"""

CTES["points"] = """
  SELECT ip_address, row_number() OVER (ORDER BY ip_address) AS pid, p FROM (
    SELECT ip_address, list(standard ORDER BY place) AS p FROM z GROUP BY ip_address
  )
"""

CTES["near_points"] = """
  SELECT a.pid AS a, b.pid AS b, list_distance(a.p, b.p) AS d FROM points a, points b
"""

CTES["k_nearest"] = f"""
  SELECT a AS pid, max(d) AS k_distance FROM (
    SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS n FROM near_points
  ) WHERE n <= {MIN_SAMPLES} GROUP BY a HAVING count(*) = {MIN_SAMPLES}
"""

CTES["curve"] = """
  SELECT row_number() OVER (ORDER BY k_distance) - 1 AS place, k_distance FROM k_nearest
"""

CTES["differences"] = """
  SELECT rows - 1 - place AS step, rows,
    1 - (k_distance - low) / (high - low) - (rows - 1 - place) / (rows - 1) AS rise
  FROM curve, (SELECT count(*) AS rows, min(k_distance) AS low, max(k_distance) AS high FROM curve)
"""

CTES["extrema"] = """
  SELECT *, rise >= coalesce(before, rise) AND rise >= coalesce(after, rise) AS is_top,
    rise <= coalesce(before, rise) AND rise <= coalesce(after, rise) AS is_dip
  FROM (
    SELECT step, rows, rise, lag(rise) OVER (ORDER BY step) AS before, lead(rise) OVER (ORDER BY step) AS after
    FROM differences
  )
"""

CTES["thresholds"] = """
  SELECT step, rows, after,
    max(CASE WHEN is_top THEN step END) OVER (ORDER BY step) AS top,
    last_value(CASE WHEN is_dip THEN 0.0 WHEN is_top THEN rise - 1.0 / (rows - 1) END IGNORE NULLS)
      OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS threshold
  FROM extrema
"""

CTES["knee"] = """
  SELECT min_by(rows - 1 - top, step) AS knee_index FROM thresholds WHERE top IS NOT NULL AND after < threshold
"""

CTES["cores"] = f"""
  SELECT a AS pid FROM near_points WHERE d <= {EPS} GROUP BY a HAVING count(*) >= {MIN_SAMPLES}
"""

CTES["links"] = f"""
  SELECT a, b FROM near_points JOIN cores x ON a = x.pid JOIN cores y ON b = y.pid WHERE d <= {EPS}
"""

CTES["reached(root, pid)"] = """
  SELECT pid, pid FROM cores
  UNION
  SELECT root, b FROM reached JOIN links ON a = reached.pid
"""

CTES["core_labels"] = """
  SELECT pid, dense_rank() OVER (ORDER BY root) - 1 AS cluster
  FROM (SELECT pid, min(root) AS root FROM reached GROUP BY pid)
"""

CTES["labels"] = f"""
  SELECT ip_address, points.pid, p, coalesce(c.cluster, border.cluster, -1) AS cluster
  FROM points LEFT JOIN core_labels c USING (pid)
  LEFT JOIN (
    SELECT a AS pid, min(cluster) AS cluster FROM near_points JOIN core_labels ON b = core_labels.pid
    WHERE d <= {EPS} GROUP BY a
  ) border USING (pid)
"""

CTES["cluster_distances"] = """
  SELECT a.pid, a.cluster, b.cluster AS other, sum(d) AS total, count(*) AS size
  FROM near_points JOIN labels a ON near_points.a = a.pid JOIN labels b ON near_points.b = b.pid
  WHERE a.cluster >= 0 AND b.cluster >= 0 GROUP BY ALL
"""

CTES["silhouettes"] = """
  SELECT pid, max(CASE WHEN cluster = other AND size > 1 THEN total / (size - 1) END) AS inner_distance,
    min(CASE WHEN cluster <> other THEN total / size END) AS nearest
  FROM cluster_distances GROUP BY pid
"""

CTES["text_lengths"] = """
  SELECT ip_address, sum((v - mean) * (v - mean)) AS length FROM (
    SELECT ip_address, v, avg(v) OVER (PARTITION BY axis) AS mean FROM (
      SELECT ip_address, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS axis FROM data
      JOIN (SELECT ip_address, row_number() OVER (ORDER BY ip_address) - 1 AS vec_id FROM profiles) USING (ip_address)
      JOIN embeddings USING (vec_id)
    )
  ) GROUP BY ip_address
"""

ORDER = list(CTES)


def sql(body: str) -> str:
    """``body`` with the CTEs it needs, in order."""
    import re

    def words(text: str) -> set[str]:
        return set(re.findall(r"[a-z_]+", text))

    needed: set[str] = set()
    pending = words(body)
    while pending:
        name = pending.pop()
        for key in ORDER:
            if key.split("(")[0] == name and key not in needed:
                needed.add(key)
                pending |= words(CTES[key]) - {name}
    parts = [f"{key} AS MATERIALIZED ({CTES[key]})" for key in ORDER if key in needed]
    recursive = "RECURSIVE " if any("(" in key for key in needed) else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def wide(column: str) -> str:
    return ", ".join(f"round(max({column}) FILTER (feature = '{c}'), 6) AS {c}" for c in NUMERIC)


TEXT_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
PROFILE = """ip_address, org, hostname, location, bytes_out, packets_out, out_peers, out_ports,
  bytes_in, packets_in, in_peers, in_ports, protocols,
  round(interval_mean, 6) AS interval_mean, round(interval_cv, 6) AS interval_cv"""
VIEW = f"{PROFILE}, CAST(NULL AS BOOLEAN) AS outlier, {TEXT_TS.format('last_seen')} AS timestamp"


def direction(own: str, peer: str) -> str:
    return sql(f"""
      SELECT {own} AS ip_address, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS packets,
        count(DISTINCT {peer}) AS peers, {joined_text("list_sort(list(DISTINCT dst_port))[1:20]")} AS ports,
        {joined_text("list_sort(list(DISTINCT protocol))")} AS protocols
      FROM real_packets GROUP BY {own}""")


def half(name: str, condition: str) -> str:
    return f"""
      SELECT ip_address, CAST(coalesce(sum(size) FILTER (outbound), 0) AS BIGINT) AS bytes_out,
        count(*) FILTER (outbound) AS packets_out,
        CAST(coalesce(sum(size) FILTER (NOT outbound), 0) AS BIGINT) AS bytes_in,
        count(*) FILTER (NOT outbound) AS packets_in, {joined_text("list_sort(list(DISTINCT protocol))")} AS protocols
      FROM directed WHERE {condition} GROUP BY ip_address"""


PROFILE_COLUMNS = [
    "ip_address", "org", "hostname", "location", "bytes_out", "packets_out", "out_peers", "out_ports",
    "bytes_in", "packets_in", "in_peers", "in_ports", "protocols", "interval_mean", "interval_cv",
]


def profile_of(condition: str) -> str:
    """Profiles of the packets that meet ``condition``."""
    kept = f"real_packets AS MATERIALIZED ({CTES['real_packets']} AND {condition})"
    return sql(f"SELECT {PROFILE} FROM profiles").replace(f"real_packets AS MATERIALIZED ({CTES['real_packets']})", kept)


REASON_COLUMNS = "ip_address, CAST(rank AS INTEGER) AS place, feature, value, unit, robust_z, direction, host_relative"
TOUCHES = f"(src_ip = '{HOST}' OR dst_ip = '{HOST}')"
PEER = f"CASE WHEN src_ip = '{HOST}' THEN dst_ip ELSE src_ip END"


def overlap(a: str, b: str) -> str:
    return f"""
      SELECT '{a} vs {b}' AS pair, CASE WHEN count(*) FILTER ({a} OR {b}) > 0
        THEN round(CAST(count(*) FILTER ({a} AND {b}) AS DOUBLE) / count(*) FILTER ({a} OR {b}), 4)
        ELSE 1.0 END AS jaccard FROM cited"""


def in_list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


ORACLES: dict[str, str] = {
    "packets_normalized": sql("SELECT * FROM normalized"),
    "packet_flow_line": sql("""
      SELECT packet_id, src_ip || ':' || src_port || ' ➜ ' || protocol || '(' || size || ') ➜ '
        || dst_ip || ':' || dst_port AS flow FROM packets"""),
    "pcap_import": sql("""
      SELECT ts_ms, src_ip, dst_ip, src_port, dst_port,
        CASE WHEN size = 40 AND protocol <> 'ARP' THEN 'TCP' ELSE protocol END AS protocol, size + 14 AS size
      FROM packets"""),
    "stream_ingest": sql("SELECT * FROM normalized"),
    "stream_endpoint_windows": sql("""
      SELECT kind, ip_address, s AS start_ms, s + 21600000 AS end_ms, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes,
        count(*) FILTER (sent) AS packets_out, CAST(coalesce(sum(size) FILTER (sent), 0) AS BIGINT) AS bytes_out
      FROM (SELECT 'tumbling' AS kind, *, ts_ms // 21600000 * 21600000 AS s FROM both_ends
            UNION ALL SELECT 'sliding', *, (ts_ms // 7200000 - unnest([0, 1, 2])) * 7200000 FROM both_ends)
      WHERE s + 21600000 <= (SELECT max(ts_ms) - 600000 FROM both_ends)
      GROUP BY kind, ip_address, s"""),
    "stream_sessions": sql("""
      SELECT ip_address, min(micros) // 1000 AS start_ms, (max(micros) + 28800000000) // 1000 AS end_ms, count(*) AS packets,
        CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (sent) AS packets_out, CAST(coalesce(sum(size) FILTER (sent), 0) AS BIGINT) AS bytes_out
      FROM (SELECT *, sum(CASE WHEN pause > 28800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY ip_address ORDER BY micros, packet_id) AS session
            FROM (SELECT *, micros - lag(micros) OVER (PARTITION BY ip_address ORDER BY micros, packet_id) AS pause FROM both_ends))
      GROUP BY ip_address, session
      HAVING max(micros) + 28800000000 <= (SELECT (max(ts_ms) - 600000) * 1000 FROM both_ends)"""),
    "session_islands": sql("""
      SELECT ip_address, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes,
        count(*) FILTER (sent) AS packets_out, CAST(coalesce(sum(size) FILTER (sent), 0) AS BIGINT) AS bytes_out
      FROM (SELECT *, sum(CASE WHEN pause > 28800000 THEN 1 ELSE 0 END) OVER (PARTITION BY ip_address ORDER BY ts_ms, packet_id) AS session
            FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY ip_address ORDER BY ts_ms, packet_id) AS pause FROM both_ends))
      GROUP BY ip_address, session"""),
    "refreshed_profiles": sql(f"SELECT {PROFILE} FROM profiles"),
    "stream_cadence": sql(f"SELECT ip_address, {rounded(TIMING)} FROM timing"),
    "enrich_cidr": sql("""
      SELECT ip_address, range, org, location
      FROM (SELECT ip_address, a[1] * 16777216 + a[2] * 65536 + a[3] * 256 + a[4] AS number
            FROM (SELECT ip_address, CAST(string_split(ip_address, '.') AS BIGINT[]) AS a FROM missing))
      JOIN address_ranges ON number BETWEEN first AND last
      QUALIFY row_number() OVER (PARTITION BY ip_address ORDER BY last - first, org, range) = 1"""),
    "sketched_peers": sql("""
      SELECT ip_address, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, true AS out_within, true AS in_within
      FROM both_ends GROUP BY ip_address"""),
    "packet_scan": sql("SELECT src_ip, dst_ip, src_port, dst_port, size, protocol, ts_ms FROM packets"),
    "ip_metadata_scan": sql(f"""
      SELECT ip_address, CASE WHEN ip_address = '{HOST}' THEN '{LOCAL}' ELSE org END AS org, hostname, location
      FROM (SELECT DISTINCT ip_address FROM ends) LEFT JOIN metadata USING (ip_address)"""),
    "clustering_input": sql(f"""
      SELECT ip_address, org, hostname, location, {', '.join(BASE)}, {rounded(TIMING)} FROM data"""),
    "embedded_only": sql(f"""
      SELECT ip_address, org, hostname, location, {', '.join(BASE)}, {rounded(TIMING)} FROM data WHERE packets_in <= packets_out"""),
    "owner_fallback": sql(f"""
      SELECT ip_address, {', '.join(
          f"CASE WHEN packets_out % 2 = 0 OR location <> 'ASIA' THEN coalesce({c}, 'Unknown') ELSE 'Unknown' END AS {c}"
          for c in ('org', 'hostname', 'location'))}, {', '.join(BASE)}, {rounded(TIMING)}
      FROM profiles"""),
    "seeded_host": sql(f"SELECT DISTINCT ip_address FROM ends WHERE ip_address IN ('{HOST}', '10.0.0.2')"),
    "port_size_points": sql("SELECT size, src_port, dst_port FROM packets"),
    "port_size_summary": sql("""
      SELECT CASE relation WHEN 'SENT' THEN 'src' ELSE 'dst' END AS direction, port, count(*) AS packets,
        CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest
      FROM ends JOIN packets USING (packet_id) GROUP BY relation, port"""),
    "ip_nodes": sql("SELECT DISTINCT ip_address FROM ends"),
    "port_nodes": sql("SELECT DISTINCT ip_address, port FROM ends"),
    "packet_edges": sql("SELECT ip_address, port, relation, packet_id FROM ends"),
    "ip_metadata_upsert": sql("""
      SELECT * FROM metadata UNION ALL SELECT resolved.* FROM resolved JOIN missing USING (ip_address)"""),
    "batch_append": sql("SELECT * FROM normalized"),
    "metadata_replace": sql("""
      SELECT * FROM (WITH replacing AS (SELECT * FROM resolved WHERE org = 'Unknown' OR hostname = 'Unknown')
        SELECT * FROM replacing UNION ALL SELECT * FROM metadata WHERE ip_address NOT IN (SELECT ip_address FROM replacing))"""),
    "endpoint_replace": f"""
      SELECT {', '.join(f'CASE WHEN new.ip_address IS NOT NULL THEN new.{c} ELSE old.{c} END AS {c}' for c in PROFILE_COLUMNS)},
        old.bytes_out > old.bytes_in AS outlier
      FROM ({profile_of("protocol = 'TLS'")}) old
      FULL JOIN (SELECT * FROM ({profile_of("protocol <> 'TLS'")}) WHERE ip_address NOT LIKE '10.9.%') new ON old.ip_address = new.ip_address""",
    "verdict_replace": sql("""
      SELECT ip_address, CASE WHEN ip_address IN (SELECT ip_address FROM data)
        THEN ip_address IN (SELECT ip_address FROM reasons) ELSE true END AS outlier FROM profiles"""),
    "endpoint_upsert": sql(f"""
      SELECT ip_address,
        {', '.join(f'CASE WHEN new.ip_address IS NOT NULL THEN new.{c} ELSE old.{c} END AS {c}'
                   for c in ['bytes_out', 'packets_out', 'bytes_in', 'packets_in', 'protocols'])},
        old.bytes_out > old.bytes_in AS outlier
      FROM ({half('old', "protocol = 'TLS'")}) old FULL JOIN ({half('new', "protocol <> 'TLS'")}) new USING (ip_address)"""),
    "outlier_writeback": sql("""
      SELECT ip_address, CASE WHEN ip_address IN (SELECT ip_address FROM data)
        THEN ip_address IN (SELECT ip_address FROM reasons) END AS outlier FROM profiles"""),
    "capture_entity_counts": sql("""
      SELECT 'PACKET' AS kind, count(*) AS entities FROM packets
      UNION ALL SELECT 'IP_ADDRESS', count(*) FROM (SELECT ip_address FROM ends UNION SELECT ip_address FROM metadata)
      UNION ALL SELECT 'PORT', count(*) FROM (SELECT DISTINCT ip_address, port FROM ends)
      UNION ALL SELECT 'ORGANIZATION', count(DISTINCT org) FROM metadata
      UNION ALL SELECT 'ENDPOINT', count(*) FROM profiles"""),
    "run_summary": sql(f"""
      SELECT (SELECT count(*) FROM missing) AS addresses_scanned,
        (SELECT count(*) FROM missing JOIN resolved USING (ip_address)) AS organizations_added,
        (SELECT count(*) FROM packets) AS packets_captured,
        (SELECT count(*) FROM profiles) AS endpoints_embedded,
        (SELECT count(*) FROM data) AS endpoints_clustered,
        (SELECT count(*) FROM profiles WHERE org = '{LOCAL}') AS excluded_local,
        (SELECT count(*) FROM destinations) AS destinations_ranked,
        (SELECT count(DISTINCT ip_address) FROM upload_reasons) AS destinations_flagged"""),
    "real_packets": sql("""
      SELECT packet_id, ts_ms, src_ip, dst_ip, src_port, dst_port, protocol, size FROM real_packets"""),
    "excluded_local": sql(f"SELECT count(*) AS excluded_local FROM profiles WHERE org = '{LOCAL}'"),
    "host_ips": sql(f"SELECT ip_address FROM metadata WHERE org = '{LOCAL}'"),
    "undocumented_ips": sql("SELECT ip_address FROM missing"),
    "enrich_organizations": sql("SELECT resolved.* FROM resolved JOIN missing USING (ip_address)"),
    "org_name_resolution": sql("SELECT * FROM resolved"),
    "flow_edges": sql("""
      SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes
      FROM packets GROUP BY ALL"""),
    "outbound_profile": direction("src_ip", "dst_ip"),
    "inbound_profile": direction("dst_ip", "src_ip"),
    "endpoint_profile": sql(f"SELECT {PROFILE} FROM profiles"),
    "endpoint_timing": sql(f"SELECT ip_address, {rounded(TIMING)} FROM timing"),
    "packet_gaps": sql("SELECT ip_address, ts_ms, packets, gap_ms FROM moments"),
    "endpoint_description": sql("""
      SELECT ip_address, 'IP: ' || ip_address || ' | Organization: ' || coalesce(org, 'None')
        || ' | Hostname: ' || coalesce(hostname, 'None') || ' | Location: ' || coalesce(location, 'None')
        || chr(10) || 'Outbound: ' || bytes_out || ' bytes, ' || packets_out || ' packets to ' || out_peers
        || ' peers | Ports: [' || replace(out_ports, ',', ', ') || ']'
        || chr(10) || 'Inbound: ' || bytes_in || ' bytes, ' || packets_in || ' packets from ' || in_peers
        || ' peers | Ports: [' || replace(in_ports, ',', ', ') || ']'
        || chr(10) || 'Protocols: [''' || replace(protocols, ',', ''', ''') || ''']' || chr(10) AS description
      FROM profiles"""),
    "incremental_profile": sql("""
      SELECT ip_address, bytes_out, packets_out, out_peers, out_ports, bytes_in, packets_in, in_peers, in_ports,
        protocols FROM traffic"""),
    "shape_ratios": sql(f"SELECT ip_address, {rounded(RATIOS)} FROM (SELECT ip_address, {RATIO_SQL} FROM profiles)"),
    "numeric_features": sql(f"SELECT ip_address, {rounded(NUMERIC)} FROM features"),
    "feature_location_scale": sql(f"SELECT feature, {rounded(['median', 'mad', 'std'])} FROM spreads"),
    "robust_z": sql(f"SELECT ip_address, {wide('z')} FROM z GROUP BY ip_address"),
    "standardized_features": sql(f"SELECT ip_address, {wide('standard')} FROM z GROUP BY ip_address"),
    "anomaly_scores": sql(f"""
      SELECT ip_address, org, hostname, location, bytes_out, packets_out, bytes_in, packets_in,
        {rounded(TIMING)}, anomaly_score FROM data JOIN scores USING (ip_address)"""),
    "anomaly_reasons": sql(f"SELECT {REASON_COLUMNS} FROM reasons"),
    "endpoint_ranking": sql("""
      SELECT ip_address, anomaly_score, row_number() OVER (ORDER BY anomaly_score DESC, ip_address) - 1 AS place
      FROM scores"""),
    "host_outbound_flows": sql("SELECT * FROM uploads"),
    "host_outbound": sql("""
      SELECT *, row_number() OVER (ORDER BY outbound_score DESC, ip_address) - 1 AS place FROM (
        SELECT ip_address, org, hostname, location, upload_bytes, upload_packets, download_bytes, download_packets,
          round(upload_download_ratio, 4) AS upload_download_ratio,
          round(sqrt(sum(z * z)), 4) AS outbound_score,
          CAST(count(*) FILTER (abs(z) >= 2.5) AS INTEGER) AS reasons
        FROM destinations JOIN upload_z USING (ip_address) GROUP BY ALL)"""),
    "host_outbound_reasons": sql(f"SELECT {REASON_COLUMNS} FROM upload_reasons"),
    "embedding_join": sql("""
      SELECT ip_address, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total
      FROM (SELECT ip_address, row_number() OVER (ORDER BY ip_address) - 1 AS vec_id FROM profiles)
      JOIN embeddings USING (vec_id)"""),
    "eps_neighbors": sql(f"""
      SELECT ip_address, count(*) AS neighbours FROM near_points JOIN points ON a = pid
      WHERE d <= {EPS} GROUP BY ip_address"""),
    "k_distance": sql("SELECT ip_address, round(k_distance, 6) AS k_distance FROM k_nearest JOIN points USING (pid)"),
    "k_distance_curve": sql("SELECT place, round(k_distance, 6) AS k_distance FROM curve"),
    "recommended_eps": sql("""
      SELECT round(coalesce(k_distance, (SELECT median(k_distance) FROM curve)), 6) AS eps, knee_index,
        'auto' AS eps_source FROM knee LEFT JOIN curve ON place = knee_index"""),
    "dbscan_labels": sql("SELECT ip_address, cluster FROM labels"),
    "silhouette": sql("""
      SELECT round(avg(coalesce((nearest - inner_distance) / greatest(inner_distance, nearest), 0.0)), 6) AS silhouette
      FROM silhouettes"""),
    "pca_lengths": sql("SELECT ip_address, round(length, 4) AS length FROM text_lengths"),
    "blend_lengths": sql("""
      SELECT ip_address, round(any_value(length) + 0.25 * sum(standard * standard), 4) AS length
      FROM text_lengths JOIN z USING (ip_address) GROUP BY ip_address"""),
    "cluster_run_counts": sql("""
      SELECT count(*) AS points, count(*) FILTER (cluster >= 0) AS clustered, count(*) FILTER (cluster < 0) AS outliers,
        count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters
      FROM labels"""),
    "noise_list": sql("SELECT 'numeric-only' AS condition, ip_address FROM labels WHERE cluster < 0"),
    "silhouette_bounds": sql("""
      SELECT round(avg(coalesce((nearest - inner_distance) / greatest(inner_distance, nearest), 0.0)), 6) AS silhouette,
        true AS holds, true AS narrow
      FROM silhouettes"""),
    "ablation_jaccard": sql(f"""
      SELECT * FROM (WITH cited AS (
        SELECT ip_address, bool_or(feature IN {in_list(BASE)}) AS volume,
          bool_or(feature IN {in_list(RATIOS)}) AS shape, bool_or(feature IN {in_list(TIMING)}) AS cadence
        FROM reasons GROUP BY ip_address)
      {overlap('volume', 'shape')} UNION ALL {overlap('volume', 'cadence')} UNION ALL {overlap('shape', 'cadence')})"""),
    "fetch_traffic": sql(f"""
      SELECT {VIEW} FROM profiles WHERE last_seen > (SELECT max(last_seen) FROM profiles) - INTERVAL 60 MINUTE
      ORDER BY last_seen DESC, ip_address LIMIT 100"""),
    "inspect_profile": sql(f"SELECT {VIEW} FROM profiles WHERE ip_address = '{HOST}'"),
    "inspect_totals": sql(f"""
      SELECT '{HOST}' AS ip_address, count(*) AS packets, count(DISTINCT {PEER}) AS peers,
        count(*) > 0 OR EXISTS (SELECT 1 FROM profiles WHERE ip_address = '{HOST}') AS found
      FROM packets WHERE {TOUCHES}"""),
    "inspect_peers": sql(f"""
      SELECT peer_ip, org AS peer_org, hostname AS peer_hostname, location AS peer_location, bytes_out, packets_out,
        bytes_in, packets_in, bytes_total, protocols, ports
      FROM (
        SELECT {PEER} AS peer_ip,
          CAST(coalesce(sum(size) FILTER (src_ip = '{HOST}'), 0) AS BIGINT) AS bytes_out,
          count(*) FILTER (src_ip = '{HOST}') AS packets_out,
          CAST(coalesce(sum(size) FILTER (src_ip <> '{HOST}'), 0) AS BIGINT) AS bytes_in,
          count(*) FILTER (src_ip <> '{HOST}') AS packets_in,
          CAST(sum(size) AS BIGINT) AS bytes_total,
          {joined_text("list_sort(list(DISTINCT protocol))")} AS protocols,
          {joined_text("list_sort(list_distinct(list_concat(list(src_port) FILTER (src_port <> 0), list(dst_port) FILTER (dst_port <> 0))))")} AS ports
        FROM packets WHERE {TOUCHES} GROUP BY 1
      ) LEFT JOIN metadata ON peer_ip = ip_address
      ORDER BY bytes_total DESC, peer_ip LIMIT 50"""),
    "inspect_packets": sql(f"""
      SELECT src_ip, src_port, dst_ip, dst_port, protocol, size, {TEXT_TS.format('ts')} AS timestamp
      FROM packets WHERE {TOUCHES} ORDER BY ts DESC, packet_id DESC LIMIT 20"""),
}

ORACLES["pcap_split_import"] = ORACLES["pcap_import"]
# The index gives what the views over all packets give.
for view in ("totals", "peers", "packets"):
    ORACLES[f"indexed_{view}"] = ORACLES[f"inspect_{view}"]
