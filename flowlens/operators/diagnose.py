"""Combine flow verdicts and probe findings into diagnoses.

The investigation guide states these rules in prose; each is a DataFrame job
here (conditional aggregates, joins on request/host keys, as-of matching).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import columns as C
from flowlens.operators import blocks
from flowlens.operators import flows as FL
from flowlens.operators import probes as PB
from flowlens.operators.temporal import asof_latest, broadcast_if_small, episodes
from flowlens.session import materialise

MAX_BROADCAST_ROWS = 1_000_000


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def as_runs(probes: DataFrame) -> DataFrame:
    """Captures that all ran cleanly, in the shape the run gate expects."""
    return probes.select("*", F.col("raw").alias("stdout"), F.lit("").alias("stderr"),
                         F.lit("Success").alias("run_status"), F.lit(None).cast("int").alias("max_hops"))


# ---------------------------------------------------------------- M1
def _scoped(flows: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Flows with an action, optionally limited to [lo, hi] on ``start``.

    The bounds become literal filters: day-partition pruning plus row-group
    skipping on ``start`` (the day key is derived from ``start``).
    """
    f = flows.filter(F.col("action").isNotNull())
    if lo is not None and hi is not None:
        f = f.filter(F.col("start").between(lo, hi)
                     & F.col("day").between(C.day_of(F.lit(lo)), C.day_of(F.lit(hi))))
    return f


def direction_correlation(flows: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """M1: per (srcaddr, dstaddr, dstport), what the sender and the receiver saw.

    One aggregate with conditional counts (a single shuffle, partial
    aggregation first) instead of two aggregates and an outer join. ``lo``/``hi``
    scope it to an incident window; by default the whole table.
    """
    f = _scoped(flows, lo, hi)
    eg, ing = F.col("flow_direction") == "egress", F.col("flow_direction") == "ingress"
    rej, acc = F.col("action") == "REJECT", F.col("action") == "ACCEPT"
    g = f.groupBy("srcaddr", "dstaddr", "dstport").agg(
        _count_if(eg).alias("sent"), _count_if(eg & rej).alias("sent_rejected"),
        _count_if(ing & acc).alias("arrived_ok"), _count_if(ing & rej).alias("arrived_rejected"))
    label = (F.when(F.col("arrived_rejected") > 0, "DEST_FILTER").when(F.col("arrived_ok") > 0, "DELIVERED")
              .when(F.col("sent") > 0, "NEVER_ARRIVED").otherwise("UNKNOWN"))
    return g.withColumn("correlation", label)


# ---------------------------------------------------------------- M2
def blast_radius(flows: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """M2: per destination, how many peers and ports are rejected (optionally in [lo, hi])."""
    f = _scoped(flows, lo, hi)
    rej = F.col("action") == "REJECT"
    # distinct (destination, peer) and (destination, port) are counted as groups: a raw flow is never multiplied
    peers = f.groupBy("dstaddr", "srcaddr").agg(F.max(rej.cast("int")).alias("bad"))
    peers = peers.groupBy("dstaddr").agg(F.count("srcaddr").alias("peers"), F.count(F.when(F.col("bad") == 1, F.col("srcaddr"))).alias("rejected_peers"))
    ports = f.filter(rej).groupBy("dstaddr", "dstport").agg(F.lit(1).alias("one")).groupBy(F.col("dstaddr").alias("d")).agg(
        F.count("dstport").alias("n_ports"))
    g = peers.join(ports, F.col("dstaddr").eqNullSafe(F.col("d")), "left").select(
        "dstaddr", "peers", "rejected_peers", F.coalesce("n_ports", F.lit(0)).cast("bigint").alias("rejected_ports"))
    peer_label = (F.when(F.col("rejected_peers") == 0, "NONE")
                   .when(F.col("rejected_peers") == F.col("peers"), "GLOBAL").otherwise("PER_SOURCE"))
    port_label = (F.when(F.col("rejected_ports") == 0, "NONE")
                   .when(F.col("rejected_ports") == 1, "TARGETED_RULE").otherwise("BROAD_OUTAGE"))
    return g.select("*", peer_label.alias("peer_scope"), port_label.alias("port_scope"))


# ---------------------------------------------------------------- M3
def parsed(probes: DataFrame) -> DataFrame:
    """All captures parsed once (F13) with the columns the diagnoses need."""
    return PB.probe_findings(as_runs(probes))


def port_comparison(probes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """M3: per host, how many ports were last seen open, timing out or refused, and whether the
    last ping was answered (any reply counts). Only the latest capture of a port counts, so one
    port that changed state is not two ports that differ."""
    pf = (parsed(probes) if findings is None else findings).filter(
        (F.col("status") == "OK") & F.col("tool").isin("tcp_reachability", "ping_host"))
    tcp, ping = F.col("tool") == "tcp_reachability", F.col("tool") == "ping_host"
    last = pf.groupBy("host", "tool", F.when(tcp, F.col("port")).alias("port")).agg(
        F.max_by("verdict", F.struct("probed_at", "probe_id")).alias("verdict"))
    v = F.col("verdict")
    g = last.groupBy("host").agg(
        _count_if(tcp & (v == "OPEN")).alias("tcp_open"),
        _count_if(tcp & (v == "CONNECTION_TIMEOUT")).alias("tcp_timeout"),
        _count_if(tcp & (v == "CONNECTION_REFUSED")).alias("tcp_refused"),
        _count_if(ping & v.isin("ALIVE", "PARTIAL_LOSS")).alias("ping_alive"))
    o, t, r, a = (F.col(c) > 0 for c in ("tcp_open", "tcp_timeout", "tcp_refused", "ping_alive"))
    diag = (F.when(o & t, "PER_PORT_BLOCK").when(t & a, "PER_PORT_BLOCK").when(t, "ROUTE_OR_HOST")
             .when(r, "LISTENER_DOWN").when(o, "OPEN").otherwise("INCONCLUSIVE"))
    return g.withColumn("diagnosis", diag)


# ---------------------------------------------------------------- M4, J2
def _dns(probes: DataFrame, findings: DataFrame | None) -> DataFrame:
    pf = parsed(probes) if findings is None else findings
    return pf.filter((F.col("status") == "OK") & (F.col("tool") == "resolve_dns")).withColumnRenamed(
        "verdict", "dns_status")


def dns_latest(probes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Per host: latest DNS capture by (probed_at, probe_id), and answer history."""
    d = _dns(probes, findings)
    order = F.struct("probed_at", "probe_id")
    return d.groupBy("host").agg(
        F.count(F.lit(1)).alias("captures"),
        F.max_by(F.struct("probe_id", "dns_status", "resolved_ip", "finding_id"), order).alias("latest"),
        F.count_distinct(F.when(F.col("dns_status") == "NOERROR", F.col("resolved_ip"))).alias("answers"))


def dns_gate(probes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """M4: DNS_FAULT / OK / PUBLIC_ANSWER / INCONCLUSIVE from the latest capture."""
    g = dns_latest(probes, findings)
    st, ip = F.col("latest.dns_status"), F.col("latest.resolved_ip")
    cls = C.boundary_class(ip)
    gate = (F.when(st.isin("NXDOMAIN", "SERVFAIL"), "DNS_FAULT")
             .when((st == "NOERROR") & cls.isin("IN_VPC", "PRIVATE_OTHER"), "OK")
             .when((st == "NOERROR") & (cls == "PUBLIC"), "PUBLIC_ANSWER")
             .otherwise("INCONCLUSIVE"))
    return g.select("host", "captures", F.col("latest.probe_id").alias("latest_probe_id"),
                    st.alias("latest_status"), ip.alias("latest_ip"),
                    F.col("latest.finding_id").alias("dns_finding_id"), "answers",
                    (F.col("answers") > 1).alias("answer_changed"), gate.alias("gate"))


def host_of_ip(probes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Address -> host: hosts whose DNS answer was that IP literal (smallest name wins)."""
    d = _dns(probes, findings)
    d = d.filter((F.col("dns_status") == "NOERROR") & C.is_ip(F.col("resolved_ip")))
    return d.groupBy(F.col("resolved_ip").alias("ip")).agg(F.min("host").alias("host"))


def dns_to_requests(probes: DataFrame) -> DataFrame:
    """Host questions (each TCP capture) -> IP questions via the latest IP answer.

    The latest capture per host by (probed_at, probe_id) among those whose
    first answer is an IP literal (a CNAME target or no answer does not count).
    """
    d = PB.parse_dns(probes.filter(F.col("tool") == "resolve_dns")).filter(C.is_ip(F.col("resolved_ip")))
    latest = d.groupBy("host").agg(F.max_by(F.struct("resolved_ip", "probe_id"),
                                            F.struct("probed_at", "probe_id")).alias("a"))
    q = probes.filter(F.col("tool") == "tcp_reachability").select(
        F.col("probe_id").alias("question_id"), "host", "port", F.col("probed_at").alias("as_of_epoch"))
    return q.join(latest, "host", "left").select(
        "question_id", "host", "port", "as_of_epoch", F.col("a.resolved_ip").alias("ip"),
        F.col("a.probe_id").alias("dns_probe_id"))


def host_flow_verdicts(flows: DataFrame, probes: DataFrame) -> DataFrame:
    """Ask by host: each TCP capture asks about its host and port at its time, through the address
    that DNS gave last at or before that time.

    Without such an address the row says NO_ADDRESS and asks nothing: it never becomes a question
    about the port alone. Captures without a host or time have no address either.
    """
    q = probes.filter(F.col("tool") == "tcp_reachability").select(
        F.col("probe_id").alias("request_id"), "host", "port", F.col("probed_at").alias("as_of_epoch"))
    dns = PB.parse_dns(probes.filter(F.col("tool") == "resolve_dns")).filter(
        (F.col("dns_status") == "NOERROR") & C.is_ip(F.col("resolved_ip"))).select(
        "host", "probed_at", "probe_id", "resolved_ip")
    q = materialise(asof_latest(q, dns, by=["host"], left_id="request_id", left_time="as_of_epoch",
                                right_time="probed_at", tie="probe_id", payload=["resolved_ip"], name="dns")
                    .select("request_id", "host", "port", "as_of_epoch", F.col("dns.resolved_ip").alias("ip"),
                            F.col("dns.probe_id").alias("dns_probe_id")), "host-questions")
    null = F.lit(None).cast("string")
    asked = q.filter(F.col("ip").isNotNull()).select(
        "request_id", "ip", F.lit("to").alias("direction"), "port", F.lit("TCP").alias("protocol"),
        F.lit("ALL").alias("action"), F.lit(None).cast("int").alias("window_minutes"),
        null.alias("start_time"), null.alias("end_time"), "as_of_epoch")
    v = FL.batch_flow_verdicts(flows, asked, nested=False).select(
        "request_id", "status", "detail", "verdict", "accepts", "rejects", "first_reject", "finding_id")
    return q.join(v, "request_id", "left").select(
        "request_id", "host", "port", "as_of_epoch", "ip", "dns_probe_id",
        F.coalesce("status", F.lit("NO_ADDRESS")).alias("status"), "detail", "verdict", "accepts", "rejects",
        "first_reject", "finding_id")


def path_break(probes: DataFrame) -> DataFrame:
    """Where the path of a timed-out TCP capture ends: the last traceroute to its host at or before its time.

    AT_HOST: the trace reached the host, so the port is filtered there. IN_PATH: hops answered up to
    ``last_hop``. NO_HOP: no hop answered. NO_TRACE: the host was not traced before.
    """
    tcp = PB.parse_tcp(probes.filter(F.col("tool") == "tcp_reachability")).filter(
        F.col("verdict") == "CONNECTION_TIMEOUT").select("probe_id", "host", "port", "probed_at",
                                                         F.col("finding_id").alias("tcp_finding_id"))
    answered = F.try_element_at(F.filter("hops", lambda h: ~h["timed_out"]), F.lit(-1))
    trace = PB.parse_trace(probes.filter(F.col("tool") == "traceroute_host")).select(
        "host", F.col("probed_at").alias("traced_at"), F.col("probe_id").alias("trace_probe_id"),
        "last_responding_hop", answered.getField("ip").alias("last_ip"), "hop_count",
        F.col("verdict").alias("trace_verdict"))
    j = asof_latest(tcp, trace, by=["host"], left_id="probe_id", left_time="probed_at", right_time="traced_at",
                    tie="trace_probe_id", payload=["last_responding_hop", "last_ip", "hop_count", "trace_verdict"],
                    name="trace")
    t = F.col("trace")
    place = (F.when(t.isNull(), "NO_TRACE").when(F.col("trace.trace_verdict") == "REACHED", "AT_HOST")
              .when(F.col("trace.last_responding_hop").isNotNull(), "IN_PATH").otherwise("NO_HOP"))
    return j.select("probe_id", "host", "port", "probed_at", "tcp_finding_id", F.col("trace.trace_probe_id").alias("trace_probe_id"),
                    F.col("trace.hop_count").alias("hop_count"), F.col("trace.last_responding_hop").alias("last_hop"),
                    F.col("trace.last_ip").alias("last_ip"), place.alias("breaks"))


# ---------------------------------------------------------------- M5, M9
def boundary_sources(flows: DataFrame) -> DataFrame:
    """M5 per source address."""
    return flows.filter(F.col("srcaddr").isNotNull()).groupBy("srcaddr").agg(
        F.count(F.lit(1)).alias("flows")).withColumn("boundary", C.boundary_class(F.col("srcaddr")))


def noise_split(groups: DataFrame) -> DataFrame:
    """M9: per question, flows and rejects by boundary class of the peer."""
    return groups.groupBy("request_id", C.boundary_class(F.col("peer")).alias("boundary")).agg(
        F.sum("cnt").cast("bigint").alias("flows"),
        F.sum(F.when(F.col("action") == "REJECT", F.col("cnt")).otherwise(0)).cast("bigint").alias("rejects"))


# ---------------------------------------------------------------- M6 (J3), M10, M11
def live_vs_forensic(flows: DataFrame, requests: DataFrame, probes: DataFrame,
                     verdicts: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """M6: latest live TCP capture (as-of the question time) against the flow verdict.

    A probe answers for the address it reached, so only questions *to* an address have one.
    """
    return _live(flows, requests, probes, verdicts, findings).drop("as_of_epoch")


def _live(flows: DataFrame, requests: DataFrame, probes: DataFrame,
          verdicts: DataFrame | None, findings: DataFrame | None) -> DataFrame:
    if verdicts is None:
        verdicts = FL.batch_flow_verdicts(flows, requests, nested=False)
    pf = parsed(probes) if findings is None else findings
    v = verdicts.filter(F.col("status") == "OK").select(
        "request_id", "focus_ip", "direction", "dstport", "as_of_epoch", "verdict", "rejects",
        F.col("finding_id").alias("flow_finding_id"))
    hosts = host_of_ip(probes, pf)
    q = v.join(hosts, (v["focus_ip"] == hosts["ip"]) & (v["direction"] == "to"), "left").drop("ip")
    tcp = pf.filter((F.col("status") == "OK") & (F.col("tool") == "tcp_reachability")).select(
        "host", F.col("port").alias("dstport"), "probed_at", "probe_id", F.col("verdict").alias("live"),
        F.col("finding_id").alias("tcp_finding_id"))
    m = asof_latest(q, tcp, by=["host", "dstport"], left_id="request_id", left_time="as_of_epoch",
                    right_time="probed_at", tie="probe_id", payload=["live", "tcp_finding_id"], name="probe")
    live, fv, rej = F.col("probe.live"), F.col("verdict"), F.col("rejects")
    outcome = (F.when(F.col("probe").isNull(), "NO_LIVE_PROBE")
                .when(live == "CONNECTION_REFUSED", "LISTENER_DOWN")
                .when((live == "OPEN") & (rej > 0), "RESOLVED_INCIDENT")
                .when((live == "CONNECTION_TIMEOUT") & (rej > 0), "ONGOING_BLOCK")
                .when((live == "CONNECTION_TIMEOUT") & (fv == "NO_DATA"), "TOO_RECENT_OR_NOT_ARRIVED")
                .when((live == "OPEN") & (fv == "ALL_ACCEPT"), "HEALTHY")
                .otherwise("INCONCLUSIVE"))
    return m.select("request_id", "focus_ip", "dstport", "host", F.col("verdict").alias("flow_verdict"), "rejects",
                    F.col("probe.probe_id").alias("probe_id"), live.alias("live_verdict"),
                    F.col("probe.tcp_finding_id").alias("tcp_finding_id"), "flow_finding_id",
                    outcome.alias("outcome"), "as_of_epoch")


def no_data_reason(verdicts: DataFrame, lag_s: int = K.RECENT_LAG_S) -> DataFrame:
    """NO_DATA whose window ends within the delivery lag is TOO_RECENT."""
    nd = verdicts.filter((F.col("status") == "OK") & (F.col("verdict") == "NO_DATA"))
    return nd.select("request_id", "window_hi", "as_of_epoch",
                     F.when(F.col("as_of_epoch") - F.col("window_hi") < lag_s, "TOO_RECENT")
                      .otherwise("NO_TRAFFIC").alias("reason"))


def all_clear(flows: DataFrame, requests: DataFrame, verdicts: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """For 'from' questions, hand off when the source never shows up or all is accepted.

    "Seen" is looked up in ``sources`` (``seen_sources``, stored at ingest): no flow is read for it. Without that table it is
    a semi join with the flows streamed against the (size-checked) set of question addresses, then a distinct.
    """
    if verdicts is None:
        verdicts = FL.batch_flow_verdicts(flows, requests, nested=False)
    q = verdicts.filter((F.col("status") == "OK") & (F.col("direction") == "from") & F.col("focus_ip").isNotNull())
    ips = q.select(F.col("focus_ip").alias("ip")).distinct()
    table = flows if sources is None else sources
    seen = (table.select(F.col("srcaddr").alias("ip"))
                 .join(broadcast_if_small(ips, MAX_BROADCAST_ROWS), "ip")
                 .distinct().withColumn("seen", F.lit(True)))
    j = q.join(seen, q["focus_ip"] == seen["ip"], "left")
    s = F.coalesce(F.col("seen"), F.lit(False))
    reason = (F.when(~s, "NEVER_SEEN").when(F.col("verdict") == "ALL_ACCEPT", "ALL_ACCEPT")
               .otherwise("AWS_SIDE_EVIDENCE"))
    return j.select("request_id", F.col("focus_ip").alias("source"), s.alias("seen"), "verdict",
                    reason.alias("reason"), reason.isin("NEVER_SEEN", "ALL_ACCEPT").alias("hand_off"))


# ---------------------------------------------------------------- M7
def never_arrived(flows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Questions in whose window some sender's flows to an address and port left and none arrived (M1's label).

    The flows are those of the question's own addresses, port, protocol and window, accepted or
    not, in the block of its window (``blocks``): no pair is made. A question on all actions whose verdict is NO_DATA has no flow with one.
    """
    asked = verdicts.filter((F.col("status") == "OK") & ~((F.col("verdict") == "NO_DATA") & (F.col("action") == "ALL"))).select(
        "request_id", F.col("focus_ip").alias("ip"), "direction", F.col("dstport").alias("port"), "protocol",
        F.lit("ALL").alias("action"), F.col("window_lo").alias("lo"), F.col("window_hi").alias("hi"))
    alone, others = blocks.asked_once(asked)
    never = blocks.never_arrived(flows, alone)
    if others is None:
        return never
    pairs = (FL.match_flows(flows, others).filter(F.col("action").isNotNull())
             .groupBy("request_id", "peer", "focus", "dstport")
             .agg(_count_if(F.col("flow_direction") == "egress").alias("sent"),
                  _count_if(F.col("flow_direction") == "ingress").alias("arrived")))
    return never.unionByName(pairs.filter((F.col("sent") > 0) & (F.col("arrived") == 0)).select("request_id").distinct())


NETWORK_ISSUE = {"ONGOING_BLOCK": "YES", "NEVER_ARRIVED": "YES", "RESOLVED_INCIDENT": "RESOLVED", "DNS_FAULT": "NO",
                 "LISTENER_DOWN": "NO", "HEALTHY": "NO", "INCONCLUSIVE": "UNKNOWN"}


def conclusions(flows: DataFrame, requests: DataFrame, probes: DataFrame) -> DataFrame:
    """One conclusion per valid question: is it the network, the cause and its evidence, the reject span,
    the boundary class of the address asked about, and the advice of the flow verdict."""
    verdicts = materialise(FL.batch_flow_verdicts(flows, requests, nested=False), "flow-verdicts")
    label = F.create_map(*[F.lit(x) for kv in NETWORK_ISSUE.items() for x in kv])
    v = verdicts.select("request_id", "focus_ip", "verdict", "first_reject", "last_reject", "remediation_hint")
    return root_cause(flows, requests, probes, verdicts).join(v, "request_id").select(
        "request_id", "host", "focus_ip", C.boundary_class(F.col("focus_ip")).alias("boundary"), "verdict", "root_cause",
        F.try_element_at(label, F.col("root_cause")).alias("network_issue"), "evidence", "first_reject", "last_reject",
        "remediation_hint")


def root_cause(flows: DataFrame, requests: DataFrame, probes: DataFrame,
               verdicts: DataFrame | None = None) -> DataFrame:
    """M7: first matching rule, in order DNS_FAULT, LISTENER_DOWN, RESOLVED_INCIDENT,
    ONGOING_BLOCK, NEVER_ARRIVED, HEALTHY, INCONCLUSIVE, with the finding ids used.

    All evidence is of the question: the last DNS and TCP captures at or before its time, for its
    host and port, and the flows of its scope and window.
    """
    if verdicts is None:
        verdicts = materialise(FL.batch_flow_verdicts(flows, requests, nested=False), "flow-verdicts")
    # Captures are parsed once and shared by the DNS lookup, the address -> host map and the live probe.
    pf = materialise(parsed(probes), "probe-findings")
    live = _live(flows, requests, probes, verdicts, pf)
    dns = _dns(probes, pf).select("host", "probed_at", "probe_id", "dns_status", F.col("finding_id").alias("dns_finding_id"))
    j = asof_latest(live, dns, by=["host"], left_id="request_id", left_time="as_of_epoch", right_time="probed_at",
                    tie="probe_id", payload=["dns_status", "dns_finding_id"], name="dns")
    o = F.col("outcome")
    decided = (F.when(F.col("dns.dns_status").isin("NXDOMAIN", "SERVFAIL"), "DNS_FAULT")
                .when(o.isin("LISTENER_DOWN", "RESOLVED_INCIDENT", "ONGOING_BLOCK"), o))
    j = materialise(j.withColumn("decided", decided), "cause-evidence")
    # only the questions that no earlier rule decides look at single flows
    open_ids = j.filter(F.col("decided").isNull()).select("request_id")
    arrival = never_arrived(flows, verdicts.join(open_ids, "request_id", "left_semi"))
    j = j.join(arrival.withColumn("never_arrived", F.lit(True)), "request_id", "left")
    cause = (F.when(F.col("decided").isNotNull(), F.col("decided"))
              .when(F.coalesce(F.col("never_arrived"), F.lit(False)), "NEVER_ARRIVED")
              .when(o == "HEALTHY", "HEALTHY")
              .otherwise("INCONCLUSIVE"))
    evidence = F.array_compact(F.array("dns.dns_finding_id", "tcp_finding_id", "flow_finding_id"))
    return j.select("request_id", "host", cause.alias("root_cause"), evidence.alias("evidence"))


# ---------------------------------------------------------------- M8
EPISODE_ORDER = ["start", "srcaddr", "srcport", "interface_id", "action"]


def reject_episodes(flows: DataFrame, chunk_s: int = 600) -> DataFrame:
    """M8: runs of the same action per (dstaddr, dstport) in time order.

    Window partitions are (dstaddr, dstport, 10-minute chunk): a destination
    that holds a third of all records is still cut into many small sorts; the
    per-key stitching window sees one summary row per chunk.
    """
    f = (flows.filter(F.col("action").isin("ACCEPT", "REJECT") & F.col("dstaddr").isNotNull()
                      & F.col("dstport").isNotNull())
              .withColumn("is_reject", F.col("action") == "REJECT"))
    e = episodes(f, key=["dstaddr", "dstport"], order=EPISODE_ORDER, value="is_reject", time="start",
                 chunk_s=chunk_s)
    return e.select("dstaddr", "dstport", "episode",
                    F.when(F.col("is_reject"), "REJECT").otherwise("ACCEPT").alias("action"),
                    "started", "stopped", F.col("n").alias("n_flows"))

