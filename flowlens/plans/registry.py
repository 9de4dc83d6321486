"""The registered queries: key -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; parameters below are questions, never row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import columns as C
from flowlens.operators import answers as AN
from flowlens.operators import blocks as BL
from flowlens.operators import changepoint as CP
from flowlens.operators import diagnose as DG
from flowlens.operators import filters as P
from flowlens.operators import flows as FL
from flowlens.operators import incidents as IC
from flowlens.operators import paths as PA
from flowlens.operators import prefixes as PX
from flowlens.operators import probes as PB
from flowlens.operators import requests as RQ
from flowlens.operators import stitch as ST
from flowlens.operators import timeindex
from flowlens.plans import params as PR
from flowlens.session import materialise, scratch_path
from flowlens.sources import fixtures
from flowlens.sources import flowlogs as FLG
from flowlens.sources import inputs as IN
from flowlens.streaming import flowstream as XS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


FLAT_FINDING = ["request_id", "status", "detail", "tool", "focus_ip", "direction", "dstport", "protocol",
                "action", "window_start", "window_end", "window_minutes", "accepts", "rejects",
                "first_reject", "last_reject", "last_reject_end", "verdict", "remediation_hint", "finding_id",
                "was_clipped"]


def _valid(spark, sf):
    """The valid questions, written: as a plan, the test of their status would be done where the events are read, in few tasks."""
    return materialise(RQ.validate_requests(IN.requests(spark, sf)), "validated-questions").filter(F.col("status") == "OK")


def _groups(spark, sf):
    return FL.flow_groups(BL.match_groups(IN.flows(spark, sf), _valid(spark, sf)))


# ---------------------------------------------------------------- P1-P8, R1
@register("flt_day")
def flt_day(spark, sf):
    return IN.flows(spark, sf).filter(P.day_in(PR.FILTER_DAYS))


@register("flt_window")
def flt_window(spark, sf):
    return IN.flows(spark, sf).filter(P.in_window(PR.FILTER_LO, PR.FILTER_HI))


@register("flt_focus_to")
def flt_focus_to(spark, sf):
    return IN.flows(spark, sf).filter(P.focus(PR.FOCUS_TO_IP, "to"))


@register("flt_focus_from")
def flt_focus_from(spark, sf):
    return IN.flows(spark, sf).filter(P.focus(PR.FOCUS_FROM_IP, "from"))


@register("flt_port")
def flt_port(spark, sf):
    return IN.flows(spark, sf).filter(P.port_eq(PR.FILTER_PORT))


@register("flt_protocol")
def flt_protocol(spark, sf):
    return IN.flows(spark, sf).filter(P.protocol_eq(PR.FILTER_PROTOCOL))


@register("flt_action")
def flt_action(spark, sf):
    return IN.flows(spark, sf).filter(P.action_eq(PR.FILTER_ACTION))


@register("flt_all_dims")
def flt_all_dims(spark, sf):
    pred = P.scope_predicate(days=PR.FILTER_DAYS, lo=PR.ALL_DIMS_LO, hi=PR.ALL_DIMS_HI, ip=PR.FOCUS_TO_IP,
                             direction="to", port=PR.FILTER_PORT, protocol=K.PROTOCOLS["TCP"],
                             action="ALL")
    return IN.flows(spark, sf).filter(pred)


@register("proj_peer")
def proj_peer(spark, sf):
    f = IN.flows(spark, sf)
    to = f.filter(P.focus(PR.FOCUS_TO_IP, "to")).select(
        F.lit("to").alias("direction"), P.peer_column("to").alias("peer"), "dstport", "action", "start")
    fr = f.filter(P.focus(PR.FOCUS_FROM_IP, "from")).select(
        F.lit("from").alias("direction"), P.peer_column("from").alias("peer"), "dstport", "action", "start")
    return to.unionByName(fr)


# ---------------------------------------------------------------- V1-V9
@register("validate_requests")
def validate_requests(spark, sf):
    return RQ.validate_requests(IN.requests(spark, sf))


@register("hostile_requests")
def hostile_requests(spark, sf):
    """V1 over questions with times no clock shows, odd spaces, unknown values and windows over the limit."""
    return RQ.validate_requests(spark.sql(fixtures.HOSTILE.replace("<REQUESTS>", "{requests}"),
                                          requests=IN.requests(spark, sf)))


@register("valid_ips")
def valid_ips(spark, sf):
    f = IN.flows(spark, sf)
    vals = (IN.requests(spark, sf).select(F.col("ip").alias("value"))
            .unionByName(f.select(F.col("srcaddr").alias("value")))
            .unionByName(f.select(F.col("dstaddr").alias("value")))
            .unionByName(IN.probes(spark, sf).select(F.col("host").alias("value")))
            .filter(F.col("value").isNotNull()).distinct())
    return vals.select("value", C.is_ip(F.col("value")).alias("is_ip"),
                       C.is_ipv4(F.col("value")).alias("is_ipv4"))


@register("valid_ports")
def valid_ports(spark, sf):
    r = IN.requests(spark, sf)
    return r.select("request_id", "port", C.is_port(F.col("port")).alias("port_ok"))


def _host_candidates(spark, sf):
    e = IN.table(spark, sf, "events")
    return (IN.probes(spark, sf).select(F.col("host").alias("value"))
            .unionByName(e.select(F.col("props").alias("value")))
            .unionByName(e.select(F.concat(F.lit("-"), F.col("event_type")).alias("value")))
            .unionByName(e.select(F.col("event_type").alias("value")))
            .unionByName(IN.requests(spark, sf).select(F.col("ip").alias("value")))
            .filter(F.col("value").isNotNull()).distinct())


@register("valid_hosts")
def valid_hosts(spark, sf):
    return _host_candidates(spark, sf).select("value", C.is_host(F.col("value")).alias("host_ok"))


@register("normalise_requests")
def normalise_requests(spark, sf):
    r = IN.requests(spark, sf)
    return r.select("request_id",
                    RQ.normalise_direction(F.col("direction")).alias("direction"),
                    RQ.normalise_action(F.col("action")).alias("action"),
                    C.protocol_number(F.col("protocol")).alias("protocol"),
                    RQ.normalise_window(F.col("window_minutes")).alias("window_minutes"))


@register("parse_times")
def parse_times(spark, sf):
    r = IN.requests(spark, sf)
    return r.select("request_id", "start_time", "end_time",
                    C.parse_epoch(F.col("start_time")).alias("start_epoch"),
                    C.parse_epoch(F.col("end_time")).alias("end_epoch"))


@register("resolve_windows")
def resolve_windows(spark, sf):
    v = RQ.valid_requests(IN.requests(spark, sf))
    return v.select("request_id", "explicit", "lo", "hi", "was_clipped", "window_minutes")


@register("window_days")
def window_days(spark, sf):
    return RQ.window_days(RQ.valid_requests(IN.requests(spark, sf)))


@register("scope_echo")
def scope_echo(spark, sf):
    v = RQ.valid_requests(IN.requests(spark, sf))
    return v.select("request_id", F.col("ip").alias("focus_ip"), "direction", F.col("port").alias("dstport"),
                    "protocol", "action", C.iso(F.col("lo")).alias("window_start"),
                    C.iso(F.col("hi")).alias("window_end"), "window_minutes")


# ---------------------------------------------------------------- A1-A8, K1-K3, J1
@register("flow_groups")
def flow_groups(spark, sf):
    return _groups(spark, sf)


@register("flow_totals")
def flow_totals(spark, sf):
    return FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf), nested=False).filter(
        F.col("status") == "OK").select("request_id", "accepts", "rejects")


@register("reject_span")
def reject_span(spark, sf):
    t = FL.totals(_groups(spark, sf)).filter(F.col("rejects") > 0)
    return t.select("request_id", C.iso(F.col("first_reject_epoch")).alias("first_reject"),
                    C.iso(F.col("last_reject_epoch")).alias("last_reject"))


@register("peer_rollup")
def peer_rollup(spark, sf):
    return FL.peer_rollup(_groups(spark, sf))


@register("port_rollup")
def port_rollup(spark, sf):
    return FL.port_rollup(_groups(spark, sf))


@register("groups_topn")
def groups_topn(spark, sf):
    return FL.top_groups(_groups(spark, sf), PR.TOP_GROUPS_N).select(
        "request_id", "rank", "peer", "dstport", "action", "cnt")


@register("top_peers")
def top_peers(spark, sf):
    return FL.top_k(FL.peer_rollup(_groups(spark, sf)), "peer").select(
        "request_id", "rank", "peer", "flows", "rejects")


@register("top_ports")
def top_ports(spark, sf):
    return FL.top_k(FL.port_rollup(_groups(spark, sf)), "dstport").select(
        "request_id", "rank", "dstport", "flows")


@register("flow_verdict")
def flow_verdict(spark, sf):
    return FL.flow_verdict(spark, IN.flows(spark, sf), nested=False, **PR.MAIN_SCOPE).select(*FLAT_FINDING)


@register("flow_verdict_hint")
def flow_verdict_hint(spark, sf):
    b = FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf), nested=False)
    return b.filter(F.col("status") == "OK").select("request_id", "verdict", "remediation_hint")


@register("batch_flow_verdicts")
def batch_flow_verdicts(spark, sf):
    return FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf), nested=False).select(
        *FLAT_FINDING)


@register("requests_without_flows")
def requests_without_flows(spark, sf):
    valid = RQ.valid_requests(IN.requests(spark, sf))
    seen = timeindex.totals(IN.flows(spark, sf), valid)
    return valid.join(seen.select("request_id"), "request_id", "left_anti").select("request_id", "ip", "direction",
                                                                                "port", "lo", "hi")


# ---------------------------------------------------------------- F1-F13, S5, V9


def _tool(spark, sf, tool):
    return IN.probes(spark, sf).filter(F.col("tool") == tool)


@register("dns_findings")
def dns_findings(spark, sf):
    d = PB.parse_dns(_tool(spark, sf, "resolve_dns"))
    return d.select("probe_id", "host", "dns_status", "resolved_ip", "resolver", "query_ms",
                    F.size("records").alias("n_records"), "finding_id")


@register("dns_records")
def dns_records(spark, sf):
    d = PB.parse_dns(_tool(spark, sf, "resolve_dns"))
    return d.select("probe_id", F.posexplode("records").alias("pos", "rec")).select(
        "probe_id", (F.col("pos") + 1).alias("pos"), "rec.name", "rec.ttl", "rec.type", "rec.value")


@register("tcp_findings")
def tcp_findings(spark, sf):
    t = PB.parse_tcp(_tool(spark, sf, "tcp_reachability"))
    return t.select("probe_id", "host", "port", "target", "reachable", "verdict", "evidence",
                    "remediation_hint", "finding_id")


@register("ping_findings")
def ping_findings(spark, sf):
    p = PB.parse_ping(_tool(spark, sf, "ping_host"))
    return p.select("probe_id", "host", "packets_sent", "packets_received", "loss_pct", "rtt_avg_ms",
                    "reachable", "verdict", "finding_id")


@register("trace_hops")
def trace_hops(spark, sf):
    t = PB.parse_trace(_tool(spark, sf, "traceroute_host"))
    return t.select("probe_id", F.posexplode("hops").alias("pos", "h")).select(
        "probe_id", (F.col("pos") + 1).alias("pos"), "h.n", "h.ip", "h.rtt_ms", "h.timed_out")


@register("trace_findings")
def trace_findings(spark, sf):
    t = PB.parse_trace(_tool(spark, sf, "traceroute_host"))
    return t.select("probe_id", "host", "hop_count", "last_responding_hop", "verdict", "finding_id")


@register("probe_source")
def probe_source(spark, sf):
    return PB.probe_source(IN.probe_runs(spark, sf)).select("probe_id", "tool", "host", "port", "run_status", "raw")


@register("probe_errors")
def probe_errors(spark, sf):
    return PB.gate(PB.probe_source(IN.probe_runs(spark, sf))).select("probe_id", "tool", "run_status", "status",
                                                                       "detail")


@register("normalise_probe_args")
def normalise_probe_args(spark, sf):
    return PB.normalise_probe_args(IN.probe_runs(spark, sf))


@register("probe_findings")
def probe_findings(spark, sf):
    return PB.probe_findings(IN.probe_runs(spark, sf))


@register("probe_finding_json")
def probe_finding_json(spark, sf):
    return PB.probe_finding_json(PB.full_probe_findings(IN.probe_runs(spark, sf)))


@register("finding_ids")
def finding_ids(spark, sf):
    """U1 over every capture: the id text parts and the id."""
    p = PB.probe_findings(IN.probe_runs(spark, sf)).filter(F.col("status") == "OK")
    return p.select("probe_id", "tool", "finding_id")


@register("iso_times")
def iso_times(spark, sf):
    f = IN.flows(spark, sf)
    return f.select("interface_id", "srcport", "start", C.iso(F.col("start")).alias("start_iso"),
                    C.iso(F.col("end")).alias("end_iso"))


# ---------------------------------------------------------------- J2, J3, M1-M11


@register("direction_correlation")
def direction_correlation(spark, sf):
    return DG.direction_correlation(IN.flows(spark, sf))


@register("blast_radius")
def blast_radius(spark, sf):
    return DG.blast_radius(IN.flows(spark, sf))


@register("port_comparison")
def port_comparison(spark, sf):
    return DG.port_comparison(IN.probes(spark, sf))


@register("dns_gate")
def dns_gate(spark, sf):
    return DG.dns_gate(IN.probes(spark, sf))


@register("dns_to_flow")
def dns_to_flow(spark, sf):
    return DG.dns_to_requests(IN.probes(spark, sf))


@register("boundary_class")
def boundary_class(spark, sf):
    return DG.boundary_sources(IN.flows(spark, sf))


@register("noise_split")
def noise_split(spark, sf):
    return DG.noise_split(_groups(spark, sf))


@register("live_vs_forensic")
def live_vs_forensic(spark, sf):
    return DG.live_vs_forensic(IN.flows(spark, sf), IN.requests(spark, sf), IN.probes(spark, sf))


@register("root_cause")
def root_cause(spark, sf):
    r = DG.root_cause(IN.flows(spark, sf), IN.requests(spark, sf), IN.probes(spark, sf))
    return r.select("request_id", "host", "root_cause", F.concat_ws(",", "evidence").alias("evidence"))


@register("host_flow_verdicts")
def host_flow_verdicts(spark, sf):
    return DG.host_flow_verdicts(IN.flows(spark, sf), IN.probes(spark, sf))


@register("path_break")
def path_break(spark, sf):
    return DG.path_break(IN.probes(spark, sf))


@register("conclusions")
def conclusions(spark, sf):
    r = DG.conclusions(IN.flows(spark, sf), IN.requests(spark, sf), IN.probes(spark, sf))
    return r.withColumn("evidence", F.concat_ws(",", "evidence"))


@register("reject_episodes")
def reject_episodes(spark, sf):
    return DG.reject_episodes(IN.flows(spark, sf))


@register("no_data_reason")
def no_data_reason(spark, sf):
    return DG.no_data_reason(FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf), nested=False))


@register("all_clear")
def all_clear(spark, sf):
    return _all_clear(spark, IN.flows(spark, sf), IN.requests(spark, sf))


def _all_clear(spark, flows, requests):
    path = scratch_path(spark, "seen-sources")
    FLG.write_seen_sources(flows, path)  # as ingest leaves it
    return DG.all_clear(flows, requests, sources=spark.read.parquet(path))


# ---------------------------------------------------------------- the same operators over a crowded three hours


def _busy_groups(spark, sf):
    return FL.flow_groups(FL.match_flows(IN.busy_flows(spark, sf), RQ.valid_requests(IN.busy_requests(spark, sf))))


@register("busy_batch_flow_verdicts")
def busy_batch_flow_verdicts(spark, sf):
    return FL.batch_flow_verdicts(IN.busy_flows(spark, sf), IN.busy_requests(spark, sf), nested=False).select(*FLAT_FINDING)


@register("busy_groups_topn")
def busy_groups_topn(spark, sf):
    return FL.top_groups(_busy_groups(spark, sf), PR.TOP_GROUPS_N).select("request_id", "rank", "peer", "dstport", "action", "cnt")


@register("busy_top_peers")
def busy_top_peers(spark, sf):
    return FL.top_k(FL.peer_rollup(_busy_groups(spark, sf)), "peer").select("request_id", "rank", "peer", "flows", "rejects")


@register("busy_top_ports")
def busy_top_ports(spark, sf):
    return FL.top_k(FL.port_rollup(_busy_groups(spark, sf)), "dstport").select("request_id", "rank", "dstport", "flows")


@register("busy_all_clear")
def busy_all_clear(spark, sf):
    return _all_clear(spark, IN.busy_flows(spark, sf), IN.busy_requests(spark, sf))


@register("busy_requests_without_flows")
def busy_requests_without_flows(spark, sf):
    valid = RQ.valid_requests(IN.busy_requests(spark, sf))
    seen = timeindex.totals(IN.busy_flows(spark, sf), valid)
    return valid.join(seen.select("request_id"), "request_id", "left_anti").select("request_id", "ip", "direction", "port", "lo", "hi")


@register("all_findings")
def all_findings(spark, sf):
    fv = FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf), nested=False)
    a = fv.filter(F.col("status") == "OK").select(
        F.lit("request").alias("source"), F.col("request_id").alias("source_id"), "tool", "verdict", "finding_id")
    b = PB.probe_findings(IN.probe_runs(spark, sf)).filter(F.col("status") == "OK").select(
        F.lit("probe").alias("source"), F.col("probe_id").alias("source_id"), "tool", "verdict", "finding_id")
    return a.unionByName(b)


# ---------------------------------------------------------------- investigations over time, addresses and both directions


@register("return_path")
def return_path(spark, sf):
    return ST.return_path(IN.two_way_flows(spark, sf))


@register("boundary_prefix")
def boundary_prefix(spark, sf):
    table = spark.createDataFrame(PR.PREFIXES, "prefix string, label string")
    return PX.longest_prefix(IN.addresses(spark, sf), table, "PUBLIC")


@register("intermittent_cause")
def intermittent_cause(spark, sf):
    return CP.intermittent_causes(IN.flows(spark, sf), _valid(spark, sf))


@register("incidents")
def incidents(spark, sf):
    return IC.incidents(DG.reject_episodes(IN.flows(spark, sf)).filter("action = 'REJECT'"), PR.STANDING_S)


@register("failing_segment")
def failing_segment(spark, sf):
    return PA.failing_segment(IN.traces(spark, sf)).drop("round")


@register("stale_address_flows")
def stale_address_flows(spark, sf):
    return AN.stale_address_flows(IN.flows(spark, sf), IN.probes(spark, sf))


# ---------------------------------------------------------------- S1-S8, X1-X2


def _flow_text(spark, sf):
    root = scratch_path(spark, "flow-text")
    FLG.write_flow_text(IN.flows(spark, sf), root)
    return root


@register("flow_text_roundtrip")
def flow_text_roundtrip(spark, sf):
    return FLG.read_flow_text(spark, _flow_text(spark, sf))


@register("flows_by_day")
def flows_by_day(spark, sf):
    f = FLG.read_flow_text(spark, _flow_text(spark, sf))
    return f.groupBy("day").agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(F.col("action") == "ACCEPT", 1)).alias("accepts"),
        F.count(F.when(F.col("action") == "REJECT", 1)).alias("rejects"),
        F.count(F.when(F.col("log_status") == "NODATA", 1)).alias("nodata"),
        F.count_distinct("dstaddr").alias("destinations"))


@register("flow_ingest_late")
def flow_ingest_late(spark, sf):
    """Two deliveries, each with records of the other's days, loaded in turn, the first twice; read by name."""
    root, table = scratch_path(spark, "deliveries"), scratch_path(spark, "flows-table")
    f = IN.flows(spark, sf).withColumn("day", C.day_of(F.col("start") + 1200))
    even = F.substring("day", 10, 1).cast("int") % 2 == 0
    FLG.write_flow_text(f.filter(even), f"{root}/even")
    FLG.write_flow_text(f.filter(~even), f"{root}/odd")
    for delivery in ("even", "odd", "even"):
        FLG.ingest_flow_text(spark, f"{root}/{delivery}", table)
    FLG.register_flows(FLG.read_flows_table(spark, table), "vpc_flow_logs")
    return spark.table("vpc_flow_logs")


@register("flow_ingest_corrected")
def flow_ingest_corrected(spark, sf):
    """Folders delivered with records of wrong days, then once more as they should be; nothing of the first load stays."""
    root, table = scratch_path(spark, "deliveries"), scratch_path(spark, "flows-table")
    f = IN.flows(spark, sf).withColumn("day", C.day_of(F.col("start") + 1200))
    shift = F.when(F.col("start") % 5 == 0, 86400 * 40).when(F.col("start") % 5 == 1, -86400 * 3).otherwise(0)
    FLG.write_flow_text(f.withColumn("start", F.col("start") + shift), f"{root}/first")
    FLG.write_flow_text(f, f"{root}/corrected")
    for delivery in ("first", "corrected"):
        FLG.ingest_flow_text(spark, f"{root}/{delivery}", table)
    return FLG.read_flows_table(spark, table)


def _streamed(spark, sf):
    """Two deliveries, each picked up by its own run of the stream; the table and the stored sizes."""
    root, table, sizes, ck = (scratch_path(spark, x) for x in ("deliveries", "flows-table", "day-sizes", "ingest-ck"))
    f = IN.flows(spark, sf)
    half = F.col("srcport") % 2 == 0
    for name, part in (("first", f.filter(half)), ("second", f.filter(~F.coalesce(half, F.lit(False))))):
        FLG.write_flow_text(part, f"{root}/{name}")
        XS.ingest_stream(spark, root, table, sizes, ck, files=256)
    return table, sizes


@register("flow_ingest_stream")
def flow_ingest_stream(spark, sf):
    return FLG.read_flows_table(spark, _streamed(spark, sf)[0])


@register("stream_day_sizes")
def stream_day_sizes(spark, sf):
    return XS.stored_day_bytes(spark, _streamed(spark, sf)[1])


@register("findings_sink")
def findings_sink(spark, sf):
    path = scratch_path(spark, "findings")
    f = FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf), nested=False)
    FLG.write_findings(f.select(*FLAT_FINDING), path)
    return spark.read.parquet(path)


@register("requests_from_json")
def requests_from_json(spark, sf):
    return FLG.requests_from_json(FLG.arguments_json(IN.requests(spark, sf)))


@register("finding_json")
def finding_json(spark, sf):
    f = FL.batch_flow_verdicts(IN.flows(spark, sf), IN.requests(spark, sf))
    return FLG.finding_json(f.select("request_id", "tool", FL.scope_struct(f), "accepts", "rejects",
                                     "first_reject", "last_reject", "last_reject_end", "top_peers",
                                     "top_ports", "verdict",
                                     "remediation_hint", "finding_id", "status", "detail"))


def _day_bytes(spark, sf):
    """The stored tally of a table, as ingest leaves it."""
    path = scratch_path(spark, "day-bytes")
    FLG.write_day_bytes(IN.flows(spark, sf), path)
    return spark.read.parquet(path)


@register("scan_budget")
def scan_budget(spark, sf):
    """S8 per question, from the stored sizes of its days."""
    v = materialise(RQ.validate_requests(IN.requests(spark, sf)), "validated-questions")
    return FLG.question_budget(_day_bytes(spark, sf), v)


@register("budgeted_verdicts")
def budgeted_verdicts(spark, sf):
    """R3 with the bytes scanned; questions over the budget of the key stop before the scan."""
    f, per_day = IN.flows(spark, sf), _day_bytes(spark, sf)
    v = materialise(RQ.validate_requests(IN.requests(spark, sf)), "validated-questions")
    kept = materialise(FLG.within_budget(per_day, v, PR.KEY_BUDGET_BYTES), "questions-in-budget")
    out = FL.findings(kept, None, nested=False, tally=timeindex.totals(f, kept.filter(F.col("status") == "OK")))
    b = FLG.question_budget(per_day, v, PR.KEY_BUDGET_BYTES).select("request_id", "bytes_scanned", "over_budget")
    return out.join(b, "request_id", "left").select("request_id", "status", "detail", "verdict", "accepts", "rejects",
                                                    "bytes_scanned", "over_budget")


@register("scan_budget_files")
def scan_budget_files(spark, sf):
    root = _flow_text(spark, sf)
    days = [r["day"] for r in RQ.window_days(RQ.valid_requests(IN.requests(spark, sf))).select("day").distinct()
            .collect()]
    return FLG.scan_budget(spark, root, days)


def _events_glob(sf):
    return f"{sf.rstrip('/')}/events*.parquet"


@register("stream_minute_counts")
def stream_minute_counts(spark, sf):
    sink, ck = scratch_path(spark, "x1-sink"), scratch_path(spark, "x1-ck")
    XS.run_available(XS.minute_counts(XS.flows_stream(spark, _events_glob(sf))), sink, ck)
    return spark.read.parquet(sink)


@register("stream_reject_sessions")
def stream_reject_sessions(spark, sf):
    sink, ck = scratch_path(spark, "x2-sink"), scratch_path(spark, "x2-ck")
    XS.run_available(XS.reject_sessions(XS.flows_stream(spark, _events_glob(sf))), sink, ck)
    return spark.read.parquet(sink)
