"""Golden rows for the four capture parsers (F1-F11), incl. D17 and D18."""

from pyspark.sql import functions as F

from flowlens.operators import probes as PB
from flowlens.schemas import PROBE_SCHEMA

DIG_NOERROR = """; <<>> DiG 9.18 <<>> db.corp.internal A
;; ->>HEADER<<- opcode: QUERY, status: NOERROR, id: 4242
;; ANSWER SECTION:
db.corp.internal.\t60\tIN\tCNAME\tdb-1.corp.internal.
db-1.corp.internal.   60   IN   A    10.20.0.208

;; Query time: 3 msec
;; SERVER: 10.20.0.2#53(10.20.0.2) (UDP)
"""
DIG_NX = ";; ->>HEADER<<- opcode: QUERY, status: NXDOMAIN, id: 1\r\n;; Query time: 12 msec\r\n;; SERVER: 10.20.0.2#53(10.20.0.2)"


def _frame(spark, rows):
    return spark.createDataFrame(rows, PROBE_SCHEMA)


def test_dns_records_cname_first(spark):
    df = _frame(spark, [(1, 100, "resolve_dns", "db.corp.internal", None, DIG_NOERROR),
                        (2, 101, "resolve_dns", "nx.corp.internal", None, DIG_NX)])
    out = {r["probe_id"]: r for r in PB.parse_dns(df).collect()}
    a = out[1]
    assert a["dns_status"] == "NOERROR"
    assert [tuple(x) for x in a["records"]] == [
        ("db.corp.internal", 60, "CNAME", "db-1.corp.internal"),
        ("db-1.corp.internal", 60, "A", "10.20.0.208")]
    assert a["resolved_ip"] == "db-1.corp.internal"  # first record, even a CNAME
    assert a["resolver"] == "10.20.0.2" and a["query_ms"] == 3
    b = out[2]
    assert b["dns_status"] == "NXDOMAIN" and b["records"] == [] and b["resolved_ip"] is None
    assert b["query_ms"] == 12


def test_tcp_verdicts_and_evidence(spark):
    raws = {
        1: "Ncat: Version 7.93 ( https://nmap.org/ncat )\nNcat: Connected to 10.20.0.208:80.\nNcat: 0 bytes sent",
        2: "Ncat: Version 7.93\nNcat: Connection refused.",
        3: "Ncat: Version 7.93\nNcat: TIMEOUT.",
        4: "connect to host: Operation timed out",
        5: "  something odd happened  ",
        6: "Ncat: Version 7.93 ( x )\nNcat: Network is unreachable.",
    }
    df = _frame(spark, [(k, 0, "tcp_reachability", "h", 5432, v) for k, v in raws.items()])
    out = {r["probe_id"]: r for r in PB.parse_tcp(df).collect()}
    assert out[1]["verdict"] == "OPEN" and out[1]["reachable"]
    assert out[1]["evidence"] == "Ncat: Connected to 10.20.0.208:80."
    assert out[2]["verdict"] == "CONNECTION_REFUSED"
    assert out[3]["verdict"] == "CONNECTION_TIMEOUT" and out[3]["evidence"] == "Ncat: TIMEOUT."
    assert out[4]["verdict"] == "CONNECTION_TIMEOUT"
    assert out[4]["evidence"] == "connect to host: Operation timed out"  # no Ncat line: first 200 chars
    assert out[5]["verdict"] == "UNKNOWN" and out[5]["evidence"] == "something odd happened"
    assert out[6]["verdict"] == "UNKNOWN" and out[6]["evidence"] == "Ncat: Network is unreachable."
    assert out[1]["target"] == "h:5432"


def test_ping_counters(spark):
    raws = {
        1: "4 packets transmitted, 4 received, 0% packet loss, time 3004ms\nrtt min/avg/max/mdev = 0.1/0.25/1.9/0.05 ms",
        2: "4 packets transmitted, 3 received, 25% packet loss, time 3004ms",
        3: "4 packets transmitted, 0 received, 100% packet loss, time 3060ms",
        4: "4 packets transmitted, 0 received, +4 errors, 100% packet loss, time 3060ms",  # D17
    }
    df = _frame(spark, [(k, 0, "ping_host", "h", None, v) for k, v in raws.items()])
    out = {r["probe_id"]: r for r in PB.parse_ping(df).collect()}
    assert (out[1]["verdict"], out[1]["rtt_avg_ms"], out[1]["loss_pct"]) == ("ALIVE", 0.25, 0.0)
    assert (out[2]["verdict"], out[2]["packets_received"]) == ("PARTIAL_LOSS", 3)
    assert out[3]["verdict"] == "NO_RESPONSE" and out[3]["packets_sent"] == 4
    assert out[4]["verdict"] == "NO_RESPONSE" and out[4]["packets_sent"] is None  # D17: counters NULL


def test_traceroute_hops(spark):
    raws = {
        1: "traceroute to x (10.0.0.9), 8 hops max\n 1  10.20.0.1  0.345 ms\n 2  *\n 3  10.0.0.9  1.5 ms !X",
        2: "traceroute to x\n 1  10.20.0.1  0.3 ms\n 2  * * *",
        3: "no route",
        4: " 1  * 10.0.0.1  2 ms\n 2  host.example (10.0.0.2)  1 ms",
    }
    df = _frame(spark, [(k, 0, "traceroute_host", "h", None, v) for k, v in raws.items()])
    out = {r["probe_id"]: r for r in PB.parse_trace(df).collect()}
    h1 = [tuple(h) for h in out[1]["hops"]]
    assert h1 == [(1, "10.20.0.1", 0.345, False), (2, None, None, True), (3, "10.0.0.9", 1.5, False)]
    assert out[1]["verdict"] == "REACHED" and out[1]["last_responding_hop"] == 3  # D18: !X ignored
    assert out[2]["verdict"] == "INCOMPLETE" and out[2]["last_responding_hop"] == 1 and out[2]["hop_count"] == 2
    assert out[3]["hop_count"] == 0 and out[3]["verdict"] == "INCOMPLETE" and out[3]["last_responding_hop"] is None
    assert [h["timed_out"] for h in out[4]["hops"]] == [True, True]


def test_single_pass_matches_per_tool(spark):
    from flowlens.operators.diagnose import as_runs
    from flowlens.sources import inputs as IN
    from tests.conftest import SF_SMALL
    p = IN.probes(spark, SF_SMALL)
    one = {r["probe_id"]: (r["verdict"], r["finding_id"]) for r in PB.probe_findings(as_runs(p)).collect()}
    per = {}
    for r in PB.parse_dns(p.filter("tool = 'resolve_dns'")).collect():
        per[r["probe_id"]] = (r["dns_status"], r["finding_id"])
    for fn, tool in ((PB.parse_tcp, "tcp_reachability"), (PB.parse_ping, "ping_host"),
                     (PB.parse_trace, "traceroute_host")):
        for r in fn(p.filter(f"tool = '{tool}'")).collect():
            per[r["probe_id"]] = (r["verdict"], r["finding_id"])
    assert one == per


def test_run_gate(spark):
    from pyspark.sql import functions as F
    rows = [(1, 0, "resolve_dns", "h", None, "x", "", "Failed", None),
            (2, 0, "tcp_reachability", "h", 5432, "", "Ncat: TIMEOUT.", "Failed", None),
            (3, 0, "ping_host", "-bad", None, "", "", "Success", None),
            (4, 0, "tcp_reachability", "h", 70000, "", "", "Success", None),
            (5, 0, "traceroute_host", "h", None, "", "", "TimedOut", 99)]
    df = spark.createDataFrame(rows, "probe_id long, probed_at long, tool string, host string, port int, "
                                     "stdout string, stderr string, run_status string, max_hops int")
    out = {r["probe_id"]: r for r in PB.gate(PB.probe_source(df)).collect()}
    assert out[1]["status"] == "TOOL_ERROR"          # DNS needs Success
    assert out[2]["status"] == "OK"                  # ncat exits non-zero on timeout
    assert out[3]["detail"].startswith("host INVALID")
    assert out[4]["detail"].startswith("port OUT_OF_RANGE")
    assert out[5]["status"] == "TOOL_ERROR"
    args = {r["probe_id"]: r["max_hops"] for r in PB.normalise_probe_args(df).collect()}
    assert args[5] == 8 and args[1] is None
    assert PB.probe_source(df).filter(F.col("probe_id") == 2).first()["raw"] == "Ncat: TIMEOUT."


def test_a_hop_line_is_taken_apart_once(spark):  # a session must be there to build columns
    """Fields of a hop share the text behind its number and whether it answered; nothing is extracted per field again."""
    assert str(PB.hops_column(F.col("raw"))).count("regexp_extract(") <= 4
