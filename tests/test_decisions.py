"""Behaviour decisions D1-D18, one test each where testable."""

from pyspark.sql import functions as F

from flowlens.operators import flows as FL
from flowlens.operators import requests as RQ
from tests.helpers import T0, flow, flows_df, request, requests_df


def _verdicts(spark, flows, reqs, **kw):
    out = FL.batch_flow_verdicts(flows_df(spark, flows), requests_df(spark, reqs), **kw)
    return {r["request_id"]: r for r in out.collect()}


def test_minimum_slice_persistent_reject(spark):
    f = [flow("10.20.0.5", "10.20.1.1", 5432, "REJECT", T0 + 60 * i) for i in range(3)]
    out = FL.flow_verdict(spark, flows_df(spark, f), ip="10.20.1.1", port=5432, window_minutes=60,
                          as_of_epoch=T0 + 600).first()
    assert out["verdict"] == "PERSISTENT_REJECT" and out["rejects"] == 3 and out["accepts"] == 0
    assert out["first_reject"] == "2024-01-01T10:00:00Z" and out["last_reject"] == "2024-01-01T10:02:00Z"
    assert out["last_reject_end"] == "2024-01-01T10:03:00Z"   # D4: the last reject's end
    assert [tuple(p) for p in out["top_peers"]] == [("10.20.0.5", 3, 3)]
    assert [tuple(p) for p in out["top_ports"]] == [(5432, 3)]


def test_d1_exact_totals_vs_legacy_cut(spark):
    f = [flow(f"10.20.0.{i}", "10.20.1.1", 5432, "REJECT", T0 + i) for i in range(1, 6)]
    f += [flow("10.20.0.9", "10.20.1.1", 5432, "ACCEPT", T0 + 10)]
    f += [flow("10.20.0.1", "10.20.1.1", 5432, "REJECT", T0 + 20)]
    r = [request(1, ip="10.20.1.1", window_minutes=60)]
    exact = _verdicts(spark, f, r)[1]
    assert (exact["verdict"], exact["accepts"], exact["rejects"]) == ("INTERMITTENT", 1, 6)
    legacy = _verdicts(spark, f, r, legacy_group_limit=2)[1]
    assert legacy["last_reject_end"] is not None
    # the two largest groups are rejects only: the lone accept is lost
    assert (legacy["verdict"], legacy["accepts"]) == ("PERSISTENT_REJECT", 0)


def test_d2_fixed_tie_break(spark):
    f = [flow(f"10.20.0.{i}", "10.20.1.1", 5432, "ACCEPT", T0 + i) for i in (9, 3, 7, 1)]
    out = _verdicts(spark, f, [request(1, ip="10.20.1.1", window_minutes=60)])[1]
    assert [p["peer"] for p in out["top_peers"]] == ["10.20.0.1", "10.20.0.3", "10.20.0.7", "10.20.0.9"]


def test_d3_rank_by_count_not_bytes(spark):
    f = [flow("10.20.0.1", "10.20.1.1", 5432, "ACCEPT", T0, nbytes=10 ** 9)]
    f += [flow("10.20.0.2", "10.20.1.1", 5432, "ACCEPT", T0 + i) for i in range(2)]
    out = _verdicts(spark, f, [request(1, ip="10.20.1.1", window_minutes=60)])[1]
    assert out["top_peers"][0]["peer"] == "10.20.0.2"


def test_d5_window_on_start_only(spark):
    f = [flow("10.20.0.1", "10.20.1.1", 5432, "REJECT", T0 - 30)]  # starts before, ends inside
    out = _verdicts(spark, f, [request(1, ip="10.20.1.1", start_time=str(T0 + 60), end_time=str(T0 + 600))])[1]
    assert out["verdict"] == "NO_DATA"


def test_d6_reject_filter_gives_reject_or_nodata(spark):
    f = [flow("10.20.0.1", "10.20.1.1", 5432, "ACCEPT", T0), flow("10.20.0.2", "10.20.1.1", 5432, "REJECT", T0)]
    out = _verdicts(spark, f, [request(1, ip="10.20.1.1", action="REJECT", window_minutes=60),
                               request(2, ip="10.20.1.2", action="REJECT", window_minutes=60)])
    assert out[1]["verdict"] == "PERSISTENT_REJECT" and out[2]["verdict"] == "NO_DATA"


def test_d7_other_action_counts_for_tops_only(spark):
    f = [flow("10.20.0.1", "10.20.1.1", 5432, None, T0)]
    out = _verdicts(spark, f, [request(1, ip="10.20.1.1", window_minutes=60)])[1]
    assert out["verdict"] == "NO_DATA" and [tuple(p) for p in out["top_peers"]] == [("10.20.0.1", 1, 0)]


def test_d8_padding_then_cap(spark):
    r = [request(1, ip="10.20.1.1", start_time=str(T0), end_time=str(T0 + 10800)),   # explicit 180 min
         request(2, ip="10.20.1.1", start_time=str(T0 - 86400)),                       # old start, no end
         request(3, ip="10.20.1.1", start_time=str(T0), end_time=str(T0 + 600))]
    v = {x["request_id"]: x for x in RQ.validate_requests(requests_df(spark, r)).collect()}
    assert (v[1]["lo"], v[1]["hi"], v[1]["was_clipped"]) == (T0 + 60 + 60 - 60, T0 + 10860, True)
    assert v[1]["hi"] - v[1]["lo"] == 10800
    assert v[2]["hi"] == T0 + 3600 + 60 and v[2]["hi"] - v[2]["lo"] == 10800
    assert (v[3]["lo"], v[3]["hi"], v[3]["was_clipped"]) == (T0 - 60, T0 + 660, False)


def test_d9_short_incident_echo(spark):
    r = [request(1, ip="10.20.1.1", start_time=str(T0), end_time=str(T0 + 180))]
    v = RQ.validate_requests(requests_df(spark, r)).first()
    assert v["window_minutes"] == 5


def test_d10_scoped_ipv6_refused_and_v1_order(spark):
    r = [request(1, ip="fe80::1%' OR '1'='1", port=5432),
         request(2, ip="db.corp.internal", port=70000),     # ip checked before port
         request(3, port=70000, protocol="GRE"),            # port before protocol
         request(4, protocol="gre"),
         request(5),                                        # focus guard
         request(6, port=5432, start_time="yesterday", end_time="bad"),
         request(7, port=5432, start_time=str(T0 + 10), end_time=str(T0)),
         request(8, ip="", port=5432),                      # empty ip = none
         request(9, port=5432, direction="sideways", action="reject", protocol="udp")]
    v = {x["request_id"]: x for x in RQ.validate_requests(requests_df(spark, r)).collect()}
    assert v[1]["detail"].startswith("ip NOT_LITERAL")
    assert v[2]["detail"] == "ip NOT_LITERAL 'db.corp.internal'"
    assert v[3]["detail"] == "port OUT_OF_RANGE '70000'"
    assert v[4]["detail"].startswith("protocol UNKNOWN")
    assert v[5]["detail"] == "scope EMPTY"
    assert v[6]["detail"].startswith("start_time UNREADABLE")
    assert v[7]["detail"] == "start_time AFTER_END"
    assert v[8]["status"] == "OK" and v[8]["ip"] is None
    assert (v[9]["direction"], v[9]["action"], v[9]["protocol"]) == ("to", "ALL", 17)


def test_d12_focus_guard_action_only(spark):
    v = RQ.validate_requests(requests_df(spark, [request(1, action="REJECT")])).first()
    assert v["status"] == "TOOL_ERROR"


def test_d15_two_enis_count_twice(spark):
    f = [flow("10.20.0.1", "10.20.1.1", 5432, "ACCEPT", T0, eni="eni-a", direction="egress"),
         flow("10.20.0.1", "10.20.1.1", 5432, "ACCEPT", T0, eni="eni-b", direction="ingress")]
    out = _verdicts(spark, f, [request(1, ip="10.20.1.1", window_minutes=60)])[1]
    assert out["accepts"] == 2


def test_lookback_window_defaults(spark):
    r = [request(1, port=1, window_minutes=0), request(2, port=1, window_minutes=500),
         request(3, port=1, window_minutes=None), request(4, port=1, window_minutes=15)]
    v = {x["request_id"]: x["hi"] - x["lo"] for x in RQ.validate_requests(requests_df(spark, r)).collect()}
    assert v == {1: 3600, 2: 10800, 3: 3600, 4: 900}


def test_window_days_cross_midnight(spark):
    r = [request(1, port=1, start_time="2024-01-01T23:30:00Z", end_time="2024-01-02T00:30:00Z")]
    d = RQ.window_days(RQ.valid_requests(requests_df(spark, r))).select("day").collect()
    assert sorted(x["day"] for x in d) == ["2024/01/01", "2024/01/02"]


def test_request_without_match_kept(spark):
    out = _verdicts(spark, [], [request(1, ip="10.20.1.1", window_minutes=60), request(2)])
    assert out[1]["verdict"] == "NO_DATA" and out[1]["accepts"] == 0 and out[1]["top_peers"] == []
    assert out[2]["status"] == "TOOL_ERROR" and out[2]["verdict"] is None
    assert F is not None


def test_missing_as_of(spark):
    r = [request(1, port=1, window_minutes=60, as_of=None),
         request(2, port=1, start_time=str(T0), as_of=None),
         request(3, port=1, start_time=str(T0), end_time=str(T0 + 60), as_of=None)]
    v = {x["request_id"]: x for x in RQ.validate_requests(requests_df(spark, r)).collect()}
    assert v[1]["detail"] == v[2]["detail"] == "as_of_epoch MISSING"
    assert v[3]["status"] == "OK"


def test_d11_textual_by_default_canonical_on_request(spark):
    f = [flow("2001:db8::5", "2001:db8::1", 5432, "REJECT", T0)]
    r = [request(1, ip="2001:DB8:0:0:0:0:0:1", port=5432, window_minutes=60)]
    flows = flows_df(spark, f)
    textual = FL.batch_flow_verdicts(flows, requests_df(spark, r)).first()
    assert textual["verdict"] == "NO_DATA"                    # D11: other spelling misses
    canon = FL.batch_flow_verdicts(flows, requests_df(spark, r), canonical=True).first()
    assert canon["verdict"] == "PERSISTENT_REJECT" and canon["focus_ip"] == "2001:db8::1"
