"""Small hand-made inputs for decision and acceptance tests."""

import datetime as dt

from flowlens.schemas import FLOW_COLUMNS, FLOW_SCHEMA, PROBE_SCHEMA, REQUEST_SCHEMA
from pyspark.sql import types as T

T0 = 1704103200  # 2024-01-01T10:00:00Z


def day(epoch):
    return dt.datetime.fromtimestamp(epoch, dt.timezone.utc).strftime("%Y/%m/%d")


def flow(src, dst, dport, action, start, proto=6, direction="ingress", sport=40000, eni="eni-a", nbytes=60):
    return {"version": 2, "account_id": "1", "interface_id": eni, "srcaddr": src, "dstaddr": dst,
            "srcport": sport, "dstport": dport, "protocol": proto, "packets": 1, "bytes": nbytes,
            "start": start, "end": start + 60, "action": action, "log_status": "OK", "vpc_id": "v",
            "subnet_id": "s", "flow_direction": direction}


def flows_df(spark, items):
    schema = T.StructType(FLOW_SCHEMA.fields + [T.StructField("day", T.StringType())])
    rows = [tuple(f[c] for c in FLOW_COLUMNS) + (day(f["start"]),) for f in items]
    return spark.createDataFrame(rows, schema)


def request(rid, ip=None, direction="to", port=None, protocol=None, action="ALL", window_minutes=None,
            start_time=None, end_time=None, as_of=T0 + 3600):
    return (rid, ip, direction, port, protocol, action, window_minutes, start_time, end_time, as_of)


def requests_df(spark, items):
    return spark.createDataFrame(items, REQUEST_SCHEMA)


def probes_df(spark, items):
    return spark.createDataFrame(items, PROBE_SCHEMA)
