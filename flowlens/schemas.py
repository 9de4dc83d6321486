"""Input and output schemas (explicit DDL; nothing is inferred)."""

from pyspark.sql import types as T

# Flow-log record columns in on-disk field order; the text reader binds by position.
FLOW_FIELDS = [
    ("version", T.IntegerType()),
    ("account_id", T.StringType()),
    ("interface_id", T.StringType()),
    ("srcaddr", T.StringType()),
    ("dstaddr", T.StringType()),
    ("srcport", T.IntegerType()),
    ("dstport", T.IntegerType()),
    ("protocol", T.LongType()),
    ("packets", T.LongType()),
    ("bytes", T.LongType()),
    ("start", T.LongType()),
    ("end", T.LongType()),
    ("action", T.StringType()),
    ("log_status", T.StringType()),
    ("vpc_id", T.StringType()),
    ("subnet_id", T.StringType()),
    ("flow_direction", T.StringType()),
]
FLOW_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in FLOW_FIELDS])
FLOW_COLUMNS = [n for n, _ in FLOW_FIELDS]

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ip", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("window_minutes", T.IntegerType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("as_of_epoch", T.LongType()),
])

PROBE_SCHEMA = T.StructType([
    T.StructField("probe_id", T.LongType()),
    T.StructField("probed_at", T.LongType()),
    T.StructField("tool", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("raw", T.StringType()),
])

DNS_RECORD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
])

HOP = T.StructType([
    T.StructField("n", T.IntegerType()),
    T.StructField("ip", T.StringType()),
    T.StructField("rtt_ms", T.DoubleType()),
    T.StructField("timed_out", T.BooleanType()),
])
