"""Questions by host, path break, conclusions and the scan budget on hand-made inputs."""

import pytest

from flowlens import session
from flowlens.operators import diagnose as DG
from flowlens.operators import requests as RQ
from flowlens.sources import flowlogs as FLG
from tests.helpers import T0, flow, flows_df, probes_df, request, requests_df
from tests.test_acceptance import HOST, IP, _inputs

TIMEOUT = "Ncat: TIMEOUT."


def test_host_question_uses_the_answer_of_its_time(spark):
    flows, probes, _ = _inputs(spark)
    later = probes_df(spark, [
        (5, T0 + 900, "resolve_dns", HOST, None, f"status: NOERROR\n{HOST}. 60 IN A 10.20.9.9"),
        (6, T0 + 100, "tcp_reachability", HOST, 5432, TIMEOUT),     # before any answer
        (7, T0 + 950, "tcp_reachability", HOST, 5432, TIMEOUT),     # after the address changed
        (8, T0 + 950, "tcp_reachability", None, 5432, TIMEOUT)])
    r = {x["request_id"]: x for x in DG.host_flow_verdicts(flows, probes.unionByName(later)).collect()}
    assert set(r) == {3, 4, 6, 7, 8}
    assert (r[4]["ip"], r[4]["status"], r[4]["verdict"], r[4]["rejects"]) == (IP, "OK", "PERSISTENT_REJECT", 3)
    assert (r[7]["ip"], r[7]["verdict"]) == ("10.20.9.9", "NO_DATA")
    assert r[6]["status"] == r[8]["status"] == "NO_ADDRESS" and r[6]["verdict"] is None


def test_path_break_labels(spark):
    def trace(pid, at, host, text):
        return (pid, at, "traceroute_host", host, None, text)

    probes = probes_df(spark, [
        trace(1, T0, "a", " 1  10.0.0.1  0.5 ms\n 2  10.0.0.2  0.9 ms"),
        trace(2, T0, "b", " 1  10.0.0.1  0.5 ms\n 2  * * *"),
        trace(3, T0, "c", " 1  * * *\n 2  * * *"),
        trace(4, T0 + 99, "d", " 1  10.0.0.1  0.5 ms"),
        *[(10 + i, T0 + 50, "tcp_reachability", h, 5432, TIMEOUT) for i, h in enumerate("abcd")],
        (20, T0 + 50, "tcp_reachability", "a", 80, "Ncat: Connected to 10.0.0.2:80.")])
    r = {x["host"]: (x["breaks"], x["last_hop"], x["last_ip"]) for x in DG.path_break(probes).collect()}
    assert r == {"a": ("AT_HOST", 2, "10.0.0.2"), "b": ("IN_PATH", 1, "10.0.0.1"),
                 "c": ("NO_HOP", None, None), "d": ("NO_TRACE", None, None)}


def test_conclusion_names_issue_and_span(spark):
    flows, probes, reqs = _inputs(spark)
    c = DG.conclusions(flows, reqs, probes).collect()
    assert len(c) == 1
    assert (c[0]["network_issue"], c[0]["root_cause"], c[0]["boundary"]) == ("YES", "ONGOING_BLOCK", "IN_VPC")
    assert c[0]["first_reject"] == "2024-01-01T10:01:00Z" and len(c[0]["evidence"]) == 3


def test_budget_counts_text_bytes_and_stops_the_question(spark):
    f = flow("10.20.0.1", "10.20.1.1", 443, "ACCEPT", T0)
    f["vpc_id"] = None
    flows = flows_df(spark, [f, f])
    line = " ".join("-" if v is None else str(v) for v in f.values()) + "\n"
    v = RQ.validate_requests(requests_df(spark, [request(1, port=443), request(2), request(3, port=443, as_of=T0 - 864000)]))
    b = {r["request_id"]: (r["days"], r["bytes_scanned"], r["over_budget"])
         for r in FLG.question_budget(FLG.day_bytes(flows), v, cap=len(line)).collect()}
    assert b == {1: (1, 2 * len(line), True), 3: (1, 0, False)}
    s = {r["request_id"]: r for r in FLG.within_budget(FLG.day_bytes(flows), v, cap=len(line)).collect()}
    assert s[1]["detail"] == f"scan OVER_BUDGET '{2 * len(line)}'" and s[2]["detail"] == "scope EMPTY"
    assert s[3]["status"] == "OK" and s[3]["detail"] is None


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())
