"""Parse probe captures (dig, ncat, ping, traceroute) as one Spark job.

Captures are rows; each parser is a set of column expressions over ``raw``
(split into lines with ``split``, matched with ``filter``/``transform``), so a
whole table of captures is parsed in one pass on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import columns as C
from flowlens.operators.requests import normalise_max_hops

# FIXED VALUES: the tool-output patterns a capture must match for the findings to
# agree with the reference behaviour (dig status / answer rows / server / query
# time, ping summary and rtt line, traceroute hop line and answered hop).
# Line breaks as a text-splitting reader sees them (CRLF counts once).
NEWLINE_RE = r"\r\n|[\n\r\x0B\f\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
WS = r"[ \t\n\x0B\f\r]"
DNS_STATUS_RE = r"status:\s*(\w+)"
RECORD_RE = r"^(\S+)\s+(\d+)\s+IN\s+(A|AAAA|CNAME)\s+(\S+)$"
RESOLVER_RE = r";;\s*SERVER:\s*([0-9.]+)"
QUERY_MS_RE = r";;\s*Query time:\s*(\d+)\s*msec"
PING_RE = r"(\d+)\s+packets transmitted,\s*(\d+)\s+received,\s*([\d.]+)%\s+packet loss"
RTT_RE = r"rtt min/avg/max/\w+\s*=\s*[\d.]+/([\d.]+)/"
HOP_LINE_RE = r"^\s*(\d+)\s+(.*)$"
HOP_ANSWER_RE = r"^([0-9.]+)\s+([\d.]+)\s*ms"

TOOLS = ("resolve_dns", "tcp_reachability", "ping_host", "traceroute_host")


def split_lines(raw: Column) -> Column:
    return F.split(raw, NEWLINE_RE)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def extract(c: Column, pattern: str, group: int) -> Column:
    """First match of ``pattern``; NULL (not '') when it does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# ---------------------------------------------------------------- DNS

def dns_columns(raw: Column, host: Column) -> dict[str, Column]:
    stripped = F.transform(split_lines(raw), strip)
    recs = F.transform(
        F.filter(stripped, lambda l: l.rlike(RECORD_RE)),
        lambda l: F.struct(
            F.regexp_replace(F.regexp_extract(l, RECORD_RE, 1), r"\.+$", "").alias("name"),
            F.regexp_extract(l, RECORD_RE, 2).try_cast("int").alias("ttl"),
            F.regexp_extract(l, RECORD_RE, 3).alias("type"),
            F.regexp_replace(F.regexp_extract(l, RECORD_RE, 4), r"\.+$", "").alias("value")))
    return {
        "dns_status": extract(raw, DNS_STATUS_RE, 1),
        "records": recs,
        "resolver": extract(raw, RESOLVER_RE, 1),
        "query_ms": extract(raw, QUERY_MS_RE, 1).try_cast("int"),
    }


def parse_dns(df: DataFrame) -> DataFrame:
    """F1-F4 (+U1): one row per DNS capture."""
    cols = dns_columns(F.col("raw"), F.col("host"))
    out = df.select("*", *[v.alias(k) for k, v in cols.items()])
    out = out.withColumn("resolved_ip", F.try_element_at("records", F.lit(1)).getField("value"))
    return out.withColumn("finding_id", C.finding_id(F.lit("dns"), F.col("host"), F.col("dns_status"),
                                                      F.col("resolved_ip")))


# ---------------------------------------------------------------- TCP

def tcp_verdict(raw: Column) -> Column:
    low = F.lower(raw)
    return (F.when(low.contains("connected to"), "OPEN")
             .when(low.contains("refused"), "CONNECTION_REFUSED")
             .when(low.contains("timeout") | low.contains("timed out"), "CONNECTION_TIMEOUT")
             .otherwise("UNKNOWN"))


def tcp_evidence(raw: Column) -> Column:
    lines = F.filter(F.transform(split_lines(raw), strip),
                     lambda s: s.startswith("Ncat:") & ~s.contains("Version"))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.substring(strip(raw), 1, 200))


def parse_tcp(df: DataFrame) -> DataFrame:
    """F5-F7 (+U1): one row per TCP capture."""
    out = df.select("*", tcp_verdict(F.col("raw")).alias("verdict"), tcp_evidence(F.col("raw")).alias("evidence"))
    return out.select(
        "*",
        F.concat_ws(":", F.col("host"), F.col("port").cast("string")).alias("target"),
        (F.col("verdict") == "OPEN").alias("reachable"),
        C.advice(K.TCP_ADVICE, F.col("verdict"), C.fact("port", F.col("port"))).alias("remediation_hint"),
        C.finding_id(F.lit("tcp"), F.col("host"), F.col("port"), F.col("verdict")).alias("finding_id"))


# ---------------------------------------------------------------- ping

def parse_ping(df: DataFrame) -> DataFrame:
    """F8-F9 (+U1): counters are NULL when the summary line does not match."""
    raw = F.col("raw")
    out = df.select(
        "*",
        extract(raw, PING_RE, 1).try_cast("int").alias("packets_sent"),
        extract(raw, PING_RE, 2).try_cast("int").alias("packets_received"),
        extract(raw, PING_RE, 3).try_cast("double").alias("loss_pct"),
        extract(raw, RTT_RE, 1).try_cast("double").alias("rtt_avg_ms"))
    reachable = F.coalesce(F.col("packets_received") > 0, F.lit(False))
    out = out.withColumn("reachable", reachable)
    v = (F.when(F.col("reachable") & (F.coalesce(F.col("loss_pct"), F.lit(0.0)) == 0), "ALIVE")
          .when(F.col("reachable"), "PARTIAL_LOSS").otherwise("NO_RESPONSE"))
    return out.withColumn("verdict", v).withColumn(
        "finding_id", C.finding_id(F.lit("ping"), F.col("host"), F.col("packets_received"), F.col("loss_pct")))


# ---------------------------------------------------------------- traceroute

def hops_column(raw: Column) -> Column:
    # one array per step, so that no step's expression is worked out again for every field of the next
    def parts(line: Column) -> Column:
        return F.struct(F.regexp_extract(line, HOP_LINE_RE, 1).try_cast("int").alias("n"), strip(F.regexp_extract(line, HOP_LINE_RE, 2)).alias("rest"))

    def judged(p: Column) -> Column:
        star = (p["rest"] == "*") | p["rest"].startswith("* ")
        return F.struct(p["n"].alias("n"), p["rest"].alias("rest"), (~star & p["rest"].rlike(HOP_ANSWER_RE)).alias("answered"))

    def hop(p: Column) -> Column:
        return F.struct(
            p["n"].alias("n"),
            F.when(p["answered"], F.regexp_extract(p["rest"], HOP_ANSWER_RE, 1)).alias("ip"),
            F.when(p["answered"], F.regexp_extract(p["rest"], HOP_ANSWER_RE, 2).try_cast("double")).alias("rtt_ms"),
            (~p["answered"]).alias("timed_out"))
    lines = F.filter(split_lines(raw), lambda l: l.rlike(HOP_LINE_RE))
    return F.transform(F.transform(F.transform(lines, parts), judged), hop)


def parse_trace(df: DataFrame) -> DataFrame:
    """F10-F11 (+U1): hops, hop_count, last responding hop, REACHED/INCOMPLETE."""
    out = df.select("*", hops_column(F.col("raw")).alias("hops"))
    last_answer = F.try_element_at(F.filter("hops", lambda h: ~h["timed_out"]), F.lit(-1)).getField("n")
    last = F.try_element_at("hops", F.lit(-1))
    out = out.select(
        "*",
        F.size("hops").alias("hop_count"),
        last_answer.alias("last_responding_hop"),
        F.when((F.size("hops") > 0) & ~last.getField("timed_out"), "REACHED").otherwise("INCOMPLETE").alias("verdict"))
    return out.withColumn("finding_id", C.finding_id(F.lit("trace"), F.col("host"), F.col("hop_count"),
                                                      F.col("last_responding_hop")))


# ---------------------------------------------------------------- S5, F12, F13

def probe_source(runs: DataFrame) -> DataFrame:
    """Captured text is stdout followed by stderr."""
    return runs.withColumn("raw", F.concat(F.coalesce(F.col("stdout"), F.lit("")),
                                           F.coalesce(F.col("stderr"), F.lit(""))))


def gate(runs: DataFrame) -> DataFrame:
    """F12 + V3/V4/V9: validate tool, arguments and run status of each capture.

    DNS needs Success; the other tools also accept Failed (their exit code is
    non-zero when the target is down, yet the output is valid).
    """
    host_bad = ~C.is_host(F.col("host"))
    port_bad = (F.col("tool") == "tcp_reachability") & ~C.is_port(F.col("port"))
    run_ok = F.when(F.col("tool") == "resolve_dns", F.col("run_status") == "Success").otherwise(
        F.col("run_status").isin("Success", "Failed"))
    detail = F.coalesce(
        F.when(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)),
               C.fault("tool UNKNOWN", F.col("tool"))),
        F.when(host_bad, C.fault("host INVALID", F.col("host"))),
        F.when(port_bad, C.fault("port OUT_OF_RANGE", F.col("port"))),
        F.when(~F.coalesce(run_ok, F.lit(False)),
               C.fault("run_status INCOMPLETE", F.col("run_status"))))
    out = runs.select("*", detail.alias("detail"))
    return out.withColumn("status", F.when(F.col("detail").isNull(), "OK").otherwise("TOOL_ERROR"))


def normalise_probe_args(runs: DataFrame) -> DataFrame:
    """V9 with V3/V4: normalised arguments of each run."""
    return runs.select("probe_id", "tool", "host", "port",
                       C.is_host(F.col("host")).alias("host_ok"),
                       F.when(F.col("tool") == "tcp_reachability", C.is_port(F.col("port"))).alias("port_ok"),
                       F.when(F.col("tool") == "traceroute_host",
                              normalise_max_hops(F.col("max_hops"))).alias("max_hops"))


# Fields of each tool's finding as JSON, in order.
JSON_FIELDS = {
    "resolve_dns": ("tool", "host", "dns_status", "resolved_ip", "records", "resolver", "query_ms", "finding_id"),
    "tcp_reachability": ("tool", "target", "host", "port", "reachable", "verdict", "evidence", "remediation_hint", "finding_id"),
    "ping_host": ("tool", "host", "packets_sent", "packets_received", "loss_pct", "rtt_avg_ms", "reachable", "verdict", "finding_id"),
    "traceroute_host": ("tool", "host", "hops", "hop_count", "last_responding_hop", "verdict", "finding_id"),
}
ERROR_FIELDS = ("tool", "host", "status", "detail")


def full_probe_findings(runs: DataFrame) -> DataFrame:
    """every capture parsed in a single pass, with all fields of its tool (NULL for those of the others).

    DNS reports its status in ``verdict`` (the reference names it dns_status).
    Rows that fail the gate keep status TOOL_ERROR and a NULL verdict.
    """
    g = gate(probe_source(runs))
    raw, host, tool = F.col("raw"), F.col("host"), F.col("tool")
    ok = F.col("status") == "OK"
    is_dns, is_tcp, is_ping, is_trace = (ok & (tool == t) for t in JSON_FIELDS)
    parsed = {
        **{k: F.when(is_dns, v) for k, v in dns_columns(raw, host).items()},
        "tcp_verdict": F.when(is_tcp, tcp_verdict(raw)), "evidence": F.when(is_tcp, tcp_evidence(raw)),
        "packets_sent": F.when(is_ping, extract(raw, PING_RE, 1).try_cast("int")),
        "packets_received": F.when(is_ping, extract(raw, PING_RE, 2).try_cast("int")),
        "loss_pct": F.when(is_ping, extract(raw, PING_RE, 3).try_cast("double")),
        "rtt_avg_ms": F.when(is_ping, extract(raw, RTT_RE, 1).try_cast("double")),
        "hops": F.when(is_trace, hops_column(raw)),
    }
    stage = g.select("probe_id", "probed_at", "tool", "host", "port", "status", "detail", *[v.alias(k) for k, v in parsed.items()])
    reach = F.coalesce(F.col("packets_received") > 0, F.lit(False))
    ping_v = (F.when(reach & (F.coalesce(F.col("loss_pct"), F.lit(0.0)) == 0), "ALIVE")
               .when(reach, "PARTIAL_LOSS").otherwise("NO_RESPONSE"))
    n_hops = F.size("hops")
    last_answer = F.try_element_at(F.filter("hops", lambda h: ~h["timed_out"]), F.lit(-1)).getField("n")
    trace_v = F.when((n_hops > 0) & ~F.try_element_at("hops", F.lit(-1)).getField("timed_out"),
                     "REACHED").otherwise("INCOMPLETE")
    resolved = F.try_element_at("records", F.lit(1)).getField("value")
    verdict = (F.when(~ok, F.lit(None).cast("string"))
                .when(tool == "resolve_dns", F.col("dns_status"))
                .when(tool == "tcp_reachability", F.col("tcp_verdict"))
                .when(tool == "ping_host", ping_v)
                .when(tool == "traceroute_host", trace_v))
    fid = (F.when(~ok, F.lit(None).cast("string"))
            .when(tool == "resolve_dns", C.finding_id(F.lit("dns"), host, F.col("dns_status"), resolved))
            .when(tool == "tcp_reachability", C.finding_id(F.lit("tcp"), host, F.col("port"), F.col("tcp_verdict")))
            .when(tool == "ping_host", C.finding_id(F.lit("ping"), host, F.col("packets_received"), F.col("loss_pct")))
            .when(tool == "traceroute_host", C.finding_id(F.lit("trace"), host, n_hops, last_answer)))
    return stage.select(
        "probe_id", "probed_at", "tool", "host", "port", "status", "detail", verdict.alias("verdict"), fid.alias("finding_id"),
        "dns_status", resolved.alias("resolved_ip"), "records", "resolver", "query_ms",
        F.when(is_tcp, F.concat_ws(":", host, F.col("port").cast("string"))).alias("target"), "evidence",
        F.when(is_tcp, F.col("tcp_verdict") == "OPEN").when(is_ping, reach).alias("reachable"),
        F.when(is_tcp, C.advice(K.TCP_ADVICE, F.col("tcp_verdict"), C.fact("port", F.col("port")))).alias("remediation_hint"),
        "packets_sent", "packets_received", "loss_pct", "rtt_avg_ms", "hops", F.when(is_trace, n_hops).alias("hop_count"),
        last_answer.alias("last_responding_hop"))


def probe_findings(runs: DataFrame) -> DataFrame:
    """The fields of F13 that the diagnoses read; the others are never computed."""
    return full_probe_findings(runs).select("probe_id", "probed_at", "tool", "host", "port", "status", "detail", "verdict", "resolved_ip",
                                            "finding_id")


def probe_finding_json(findings: DataFrame) -> DataFrame:
    """S7 for the four probe tools: each finding with its own tool's fields (NULLs written), an error row with its detail."""
    def text(fields):
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    json = F.when(F.col("status") != "OK", text(ERROR_FIELDS))
    for tool, fields in JSON_FIELDS.items():
        json = json.when(F.col("tool") == tool, text(fields))
    return findings.select("probe_id", json.alias("json"))
