"""SURVEY 3.3 chain on a five-row flow set and four captures.

NOERROR -> ALIVE -> :80 OPEN -> :5432 CONNECTION_TIMEOUT -> PERSISTENT_REJECT,
and the root-cause job names the ongoing block with its evidence ids.
"""

from flowlens.operators import diagnose as DG
from flowlens.operators import flows as FL
from flowlens.operators.diagnose import as_runs
from flowlens.operators.probes import probe_findings
from tests.helpers import T0, flow, flows_df, probes_df, request, requests_df

HOST, IP, CLIENT = "db.corp.internal", "10.20.0.208", "10.20.0.5"


def _inputs(spark):
    flows = flows_df(spark, [
        flow(CLIENT, IP, 5432, "REJECT", T0 + 60),
        flow(CLIENT, IP, 5432, "REJECT", T0 + 120),
        flow(CLIENT, IP, 5432, "REJECT", T0 + 180, direction="egress", eni="eni-src"),
        flow(CLIENT, IP, 80, "ACCEPT", T0 + 200),
        flow("198.51.100.7", IP, 80, "REJECT", T0 + 240),
    ])
    probes = probes_df(spark, [
        (1, T0 + 300, "resolve_dns", HOST, None,
         f";; ->>HEADER<<- opcode: QUERY, status: NOERROR, id: 1\n{HOST}. 60 IN A {IP}\n;; SERVER: 10.20.0.2#53(10.20.0.2)"),
        (2, T0 + 310, "ping_host", HOST, None,
         "4 packets transmitted, 4 received, 0% packet loss, time 3004ms\nrtt min/avg/max/mdev = 0.1/0.2/0.3/0.05 ms"),
        (3, T0 + 320, "tcp_reachability", HOST, 80, "Ncat: Version 7.93\nNcat: Connected to 10.20.0.208:80."),
        (4, T0 + 330, "tcp_reachability", HOST, 5432, "Ncat: Version 7.93\nNcat: TIMEOUT."),
    ])
    reqs = requests_df(spark, [request(1, ip=IP, port=5432, window_minutes=60, as_of=T0 + 900)])
    return flows, probes, reqs


def test_chain(spark):
    flows, probes, reqs = _inputs(spark)
    pf = {r["probe_id"]: r["verdict"] for r in probe_findings(as_runs(probes)).collect()}
    assert pf == {1: "NOERROR", 2: "ALIVE", 3: "OPEN", 4: "CONNECTION_TIMEOUT"}
    v = FL.batch_flow_verdicts(flows, reqs).first()
    assert v["verdict"] == "PERSISTENT_REJECT" and v["rejects"] == 3
    assert v["top_peers"][0]["peer"] == CLIENT
    gate = DG.dns_gate(probes).first()
    assert gate["gate"] == "OK" and gate["latest_ip"] == IP
    ports = DG.port_comparison(probes).first()
    assert ports["diagnosis"] == "PER_PORT_BLOCK"
    live = DG.live_vs_forensic(flows, reqs, probes).first()
    assert (live["host"], live["live_verdict"], live["outcome"]) == (HOST, "CONNECTION_TIMEOUT", "ONGOING_BLOCK")
    rc = DG.root_cause(flows, reqs, probes).first()
    assert rc["root_cause"] == "ONGOING_BLOCK"
    assert rc["evidence"] == [gate["dns_finding_id"], live["tcp_finding_id"], v["finding_id"]]


def test_direction_and_blast(spark):
    flows, _, _ = _inputs(spark)
    corr = {(r["srcaddr"], r["dstport"]): r["correlation"] for r in DG.direction_correlation(flows).collect()}
    assert corr[(CLIENT, 5432)] == "DEST_FILTER" and corr[(CLIENT, 80)] == "DELIVERED"
    b = DG.blast_radius(flows).first()
    assert (b["peers"], b["rejected_peers"], b["rejected_ports"]) == (2, 2, 2)
    assert (b["peer_scope"], b["port_scope"]) == ("GLOBAL", "BROAD_OUTAGE")


def test_resolved_incident_and_noise(spark):
    flows, probes, _ = _inputs(spark)
    later = probes_df(spark, [(5, T0 + 5000, "tcp_reachability", HOST, 5432, "Ncat: Connected to x:5432.")])
    reqs = requests_df(spark, [request(1, ip=IP, port=5432, start_time=str(T0), end_time=str(T0 + 600),
                                       as_of=T0 + 6000),
                               request(2, ip=IP, port=80, window_minutes=60, as_of=T0 + 900)])
    live = {r["request_id"]: r["outcome"] for r in DG.live_vs_forensic(flows, reqs, probes.unionByName(later)).collect()}
    assert live[1] == "RESOLVED_INCIDENT"
    groups = FL.flow_groups(FL.match_flows(flows, FL.validate_requests(reqs).filter("status = 'OK'")))
    noise = {(r["request_id"], r["boundary"]): r["rejects"] for r in DG.noise_split(groups).collect()}
    assert noise[(2, "PUBLIC")] == 1 and noise[(2, "IN_VPC")] == 0


def test_all_clear_and_no_data_reason(spark):
    flows, _, _ = _inputs(spark)
    reqs = requests_df(spark, [request(1, ip="10.99.0.1", direction="from", window_minutes=60, as_of=T0 + 900),
                               request(2, ip=CLIENT, direction="from", port=80, window_minutes=60, as_of=T0 + 900),
                               request(3, ip=IP, port=22, window_minutes=60, as_of=T0 + 900),
                               request(4, ip=IP, port=22, start_time=str(T0), end_time=str(T0 + 60),
                                       as_of=T0 + 86400)])
    ac = {r["request_id"]: r["reason"] for r in DG.all_clear(flows, reqs).collect()}
    assert ac == {1: "NEVER_SEEN", 2: "ALL_ACCEPT"}
    v = FL.batch_flow_verdicts(flows, reqs, nested=False)
    nd = {r["request_id"]: r["reason"] for r in DG.no_data_reason(v).collect()}
    assert nd[3] == "TOO_RECENT" and nd[4] == "NO_TRAFFIC"


def test_scoped_correlation(spark):
    flows, _, _ = _inputs(spark)
    early = {(r["srcaddr"], r["dstport"]) for r in DG.direction_correlation(flows, T0, T0 + 150).collect()}
    assert early == {(CLIENT, 5432)}
    b = DG.blast_radius(flows, T0 + 200, T0 + 300).first()
    assert (b["peers"], b["rejected_peers"], b["rejected_ports"]) == (2, 1, 1)


def _delivered(spark, extra_flows=(), extra_probes=()):
    """An accepted flow to an open port, and what else happened."""
    flows = flows_df(spark, [flow(CLIENT, IP, 5432, "ACCEPT", T0 + 60), flow(CLIENT, IP, 5432, "ACCEPT", T0 + 60, direction="egress"),
                             *extra_flows])
    probes = probes_df(spark, [
        (1, T0 + 300, "resolve_dns", HOST, None, f";; ->>HEADER<<- opcode: QUERY, status: NOERROR, id: 1\n{HOST}. 60 IN A {IP}"),
        (2, T0 + 320, "tcp_reachability", HOST, 5432, "Ncat: Connected to 10.20.0.208:5432."), *extra_probes])
    reqs = requests_df(spark, [request(1, ip=IP, port=5432, window_minutes=60, as_of=T0 + 900)])
    return DG.root_cause(flows, reqs, probes).first()["root_cause"]


def test_old_flows_of_another_source_are_no_evidence(spark):
    assert _delivered(spark) == "HEALTHY"
    other = flow("10.20.0.77", IP, 5432, "ACCEPT", T0 - 20 * 86400, direction="egress")
    assert _delivered(spark, [other]) == "HEALTHY"
    lost = flow("10.20.0.77", IP, 5432, "ACCEPT", T0 + 90, direction="egress")
    assert _delivered(spark, [lost]) == "NEVER_ARRIVED"


def test_another_port_or_a_later_lookup_is_no_evidence(spark):
    refused = (3, T0 - 11 * 86400, "tcp_reachability", HOST, 80, "Ncat: Connection refused.")
    later = (4, T0 + 5000, "resolve_dns", HOST, None, ";; ->>HEADER<<- opcode: QUERY, status: NXDOMAIN, id: 1")
    assert _delivered(spark, extra_probes=[refused, later]) == "HEALTHY"
    before = (4, T0 + 400, "resolve_dns", HOST, None, ";; ->>HEADER<<- opcode: QUERY, status: NXDOMAIN, id: 1")
    assert _delivered(spark, extra_probes=[before]) == "DNS_FAULT"


def test_one_port_that_changed_is_not_two_ports(spark):
    rows = [(1, T0, "tcp_reachability", HOST, 5432, "Ncat: Connected to x:5432."),
            (2, T0 + 60, "tcp_reachability", HOST, 5432, "Ncat: TIMEOUT.")]
    assert DG.port_comparison(probes_df(spark, rows)).first()["diagnosis"] == "ROUTE_OR_HOST"
    two = [*rows, (3, T0 + 70, "tcp_reachability", HOST, 80, "Ncat: Connected to x:80.")]
    assert DG.port_comparison(probes_df(spark, two)).first()["diagnosis"] == "PER_PORT_BLOCK"


def test_a_source_is_not_looked_up_as_a_probed_host(spark):
    flows, probes, _ = _inputs(spark)
    reqs = requests_df(spark, [request(1, ip=IP, direction="from", port=5432, window_minutes=60, as_of=T0 + 900)])
    assert DG.live_vs_forensic(flows, reqs, probes).first()["outcome"] == "NO_LIVE_PROBE"
