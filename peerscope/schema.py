"""Table schemas and the values that are part of the data model."""

from pyspark.sql import types as T

# Markers stored in the tables.
NO_IP = "0.0.0.0"          # packet without an IP layer
NO_PORT = 0                # packet without a transport port
UNKNOWN = "Unknown"        # owner, host name or location not known
LOCAL_ORG = "YOU ARE HERE"  # owner of the capture host

# Limits.
MIN_TIMING_PACKETS = 3
PORTS_KEPT = 20
REASON_THRESHOLD = 2.5
FETCH_MINUTES = 60
FETCH_ROWS = 100
PEER_ROWS = 50
PACKET_ROWS = 20

RAW_PACKETS = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("highest_layer", T.StringType()),
    T.StructField("ip_src", T.StringType()),
    T.StructField("ip_dst", T.StringType()),
    T.StructField("tcp_srcport", T.StringType()),
    T.StructField("tcp_dstport", T.StringType()),
    T.StructField("tcp_payload", T.StringType()),
    T.StructField("udp_srcport", T.StringType()),
    T.StructField("udp_dstport", T.StringType()),
    T.StructField("udp_payload", T.StringType()),
    T.StructField("frame_length", T.LongType()),
])

PACKETS = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("payload", T.StringType()),
])

IP_METADATA = T.StructType([
    T.StructField("ip_address", T.StringType()),
    T.StructField("org", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("location", T.StringType()),
])

ENDPOINTS = T.StructType([
    T.StructField("ip_address", T.StringType()),
    T.StructField("org", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("bytes_out", T.LongType()),
    T.StructField("packets_out", T.LongType()),
    T.StructField("out_peers", T.LongType()),
    T.StructField("out_ports", T.ArrayType(T.IntegerType())),
    T.StructField("bytes_in", T.LongType()),
    T.StructField("packets_in", T.LongType()),
    T.StructField("in_peers", T.LongType()),
    T.StructField("in_ports", T.ArrayType(T.IntegerType())),
    T.StructField("protocols", T.ArrayType(T.StringType())),
    T.StructField("interval_mean", T.DoubleType()),
    T.StructField("interval_cv", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("outlier", T.BooleanType()),
    T.StructField("profiled_at", T.TimestampType()),
])
