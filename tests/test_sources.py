"""S1-S8 and X1/X2 on small inputs."""

import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowlens.operators import requests as RQ
from flowlens.plans.registry import QUERIES
from flowlens.sources import flowlogs as FLG
from flowlens.sources import inputs as IN
from tests.conftest import SF_SMALL
from tests.helpers import T0, flow, flows_df, request, requests_df

SAMPLE = """version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status vpc-id subnet-id flow-direction
2 123456789012 eni-0a 10.20.0.5 10.20.0.9 40001 5432 6 1 60 1704070800 1704070860 REJECT OK vpc-1 subnet-1 ingress
2 123456789012 eni-0a - - - - - - - 1704070800 1704070860 - NODATA vpc-1 subnet-1 -
"""


def _layout(root):
    for d, gz in (("2024/01/01", True), ("2024/01/02", False)):
        path = os.path.join(root, "AWSLogs", "vpcflowlogs", d)
        os.makedirs(path)
        if gz:
            with gzip.open(os.path.join(path, "part.log.gz"), "wt") as fh:
                fh.write(SAMPLE)
        else:
            with open(os.path.join(path, "part.log"), "w") as fh:
                fh.write(SAMPLE)
    return os.path.join(root, "AWSLogs", "vpcflowlogs")


def test_read_plain_day_layout(spark):
    root = _layout(tempfile.mkdtemp(prefix="flowlens-src-"))
    paths = FLG.day_paths(spark, root, ["2024/01/01", "2024/01/03"])   # missing day skipped
    assert len(paths) == 1
    df = FLG.read_flow_text(spark, paths)
    rows = df.orderBy("action").collect()
    assert [r["day"] for r in rows] == ["2024/01/01", "2024/01/01"]
    nodata = [r for r in rows if r["log_status"] == "NODATA"][0]
    assert nodata["srcaddr"] is None and nodata["dstport"] is None and nodata["action"] is None
    assert rows[1]["dstport"] == 5432 and rows[1]["protocol"] == 6
    both = FLG.read_flow_text(spark, root + "/*/*/*")
    assert sorted(r["day"] for r in both.select("day").distinct().collect()) == ["2024/01/01", "2024/01/02"]
    budget = FLG.scan_budget(spark, root, ["2024/01/01", "2024/01/02", "2024/01/05"]).first()
    assert budget["files"] == 2 and budget["days"] == 2 and not budget["over_budget"]
    assert FLG.scan_budget(spark, root, ["2024/01/02"], cap=10).first()["over_budget"]


def test_text_roundtrip_and_json(spark):
    rt = QUERIES["flow_text_roundtrip"](spark, SF_SMALL)
    from flowlens.sources import inputs as IN
    from collections import Counter
    assert Counter(tuple(r) for r in rt.collect()) == Counter(tuple(r) for r in IN.flows(spark, SF_SMALL).collect())
    js = [r["json"] for r in QUERIES["finding_json"](spark, SF_SMALL).collect()]
    ok = [j for j in js if '"status":"OK"' in j]
    assert ok and all('"scope":{' in j and '"top_peers":[' in j for j in ok)
    assert all('"top_peers":null' in j for j in js if '"status":"TOOL_ERROR"' in j)
    parsed = QUERIES["requests_from_json"](spark, SF_SMALL)
    assert parsed.count() == IN.requests(spark, SF_SMALL).count()


def test_stream_equals_batch_behind_watermark(spark):
    from flowlens.sources import inputs as IN
    s = QUERIES["stream_minute_counts"](spark, SF_SMALL)
    f = IN.flows(spark, SF_SMALL)
    wm = f.agg(F.max("start")).first()[0] - 1200
    b = (f.withColumn("minute_start", F.floor(F.col("start") / 60) * 60)
          .filter(F.col("minute_start") + 60 <= wm)
          .groupBy("minute_start").agg(F.count("*").alias("flows")))
    assert sorted((r[0], r[1]) for r in s.select("minute_start", "flows").collect()) == \
        sorted((r[0], r[1]) for r in b.collect())


def _deliver(root, folder, *records):
    path = os.path.join(root, *folder.split("/"))
    os.makedirs(path)
    with open(os.path.join(path, "a.log"), "w") as fh:
        fh.write(SAMPLE.splitlines()[0] + "\n" + "".join(
            f"2 1 eni-a 10.20.0.5 10.20.0.9 40001 5432 6 1 60 {t} {t + 60} REJECT OK v s ingress\n" for t in records))
    return path


def test_ingest_keeps_a_day_that_gets_a_late_record(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ing-")
    table = os.path.join(root, "table")
    first = _deliver(root, "logs/2024/01/01", *range(1704100000, 1704100010))
    second = _deliver(root, "logs/2024/01/02", 1704153590, 1704153700)   # the first of them is of 2024/01/01
    want = sorted([("2024/01/01", t) for t in [*range(1704100000, 1704100010), 1704153590]] + [("2024/01/02", 1704153700)])
    for path in (first, second, first, second):
        FLG.ingest_flow_text(spark, path, table)
    FLG.register_flows(FLG.read_flows_table(spark, table), "loaded_flows")
    assert sorted(tuple(r) for r in spark.sql("SELECT day, start FROM loaded_flows").collect()) == want


def test_ingest_refuses_a_path_without_a_day(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ing-")
    with pytest.raises(Exception, match="no day in the object path"):
        FLG.ingest_flow_text(spark, _deliver(root, "undated", 1704100000), os.path.join(root, "table"))


def test_json_port_and_times(spark):
    rows = [(1, '{"port": "5432"}'), (2, '{"port": 99999999999}'), (3, '{"port": 54.5}'), (4, '{"port": 5432}'),
            (5, '{"port": 80, "start_time": 1704067200.7, "end_time": 1704067800}'), (6, '{"port": null, "protocol": "TCP"}'),
            (7, "not json")]
    v = RQ.validate_requests(FLG.requests_from_json(
        spark.createDataFrame([(i, j, 1704070800) for i, j in rows], "request_id long, arguments string, as_of_epoch long")))
    got = {r["request_id"]: r for r in v.collect()}
    assert [got[i]["status"] for i in range(1, 8)] == ["TOOL_ERROR"] * 3 + ["OK"] * 3 + ["TOOL_ERROR"]
    assert got[4]["port"] == 5432 and got[5]["start_epoch"] == 1704067200 and got[5]["end_epoch"] == 1704067800


def test_a_bad_question_does_not_stop_a_batch(spark):
    v = QUERIES["hostile_requests"](spark, SF_SMALL).collect()
    assert {r["status"] for r in v} == {"OK", "TOOL_ERROR"}
    assert {r["explicit"] for r in v if r["was_clipped"]} == {True, False}


def test_continuous_stream_runs(spark):
    from flowlens.session import scratch_path
    from flowlens.streaming import flowstream as XS
    sink, ck = scratch_path(spark, "xc-sink"), scratch_path(spark, "xc-ck")
    q = XS.start_continuous(XS.minute_counts(XS.flows_stream(spark, f"{SF_SMALL}/events*.parquet")), sink, ck,
                            every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = QUERIES["stream_minute_counts"](spark, SF_SMALL)
    assert spark.read.parquet(sink).count() == batch.count()


def test_a_corrected_delivery_leaves_no_stale_rows(spark, tmp_path):
    noon, table = T0 + 86400, str(tmp_path / "table")

    def deliver(name, items):
        """One folder 2024/01/02 as delivered, with records of any day."""
        df = flows_df(spark, items).withColumn("day", F.lit("2024/01/02"))
        FLG.write_flow_text(df, f"{tmp_path}/{name}")
        FLG.ingest_flow_text(spark, f"{tmp_path}/{name}", table)
        return sorted((r["start"], r["day"]) for r in FLG.read_flows_table(spark, table).collect())

    late = flow("10.0.0.1", "10.1.0.1", 80, "ACCEPT", noon - 86400)
    kept = flow("10.0.0.2", "10.1.0.1", 80, "ACCEPT", noon)
    assert deliver("first", [late, kept]) == [(noon - 86400, "2024/01/01"), (noon, "2024/01/02")]
    # another folder with a record of the first day: it must survive the correction of this one
    other = flows_df(spark, [flow("10.0.0.3", "10.1.0.1", 80, "REJECT", noon - 86400 + 5)])
    FLG.write_flow_text(other, f"{tmp_path}/other")
    FLG.ingest_flow_text(spark, f"{tmp_path}/other", table)
    assert deliver("corrected", [kept]) == [(noon - 86400 + 5, "2024/01/01"), (noon, "2024/01/02")]
    assert deliver("again", [kept]) == [(noon - 86400 + 5, "2024/01/01"), (noon, "2024/01/02")]


def test_budgets_read_the_stored_sizes_only(spark, tmp_path):
    from flowlens.operators import requests as RQ
    f = flows_df(spark, [flow("10.0.0.1", "10.1.0.1", 80, "ACCEPT", T0 + 86400 * (k % 2) + k) for k in range(10)])
    FLG.write_day_bytes(f, str(tmp_path / "sizes"))
    sizes = spark.read.parquet(str(tmp_path / "sizes"))
    assert {r["day"]: r["records"] for r in sizes.collect()} == {"2024/01/01": 5, "2024/01/02": 5}
    budget = FLG.question_budget(sizes, RQ.validate_requests(requests_df(spark, [request(1, ip="10.1.0.1", as_of=T0 + 60)])))
    read = budget.inputFiles()
    assert read and all("/sizes/" in x for x in read)


def test_json_of_the_four_tools(spark):
    import json

    from flowlens.operators import probes as PB
    runs = IN.probe_runs(spark, SF_SMALL)
    full = PB.full_probe_findings(runs)
    found = [(r["status"], json.loads(r["json"])) for r in PB.probe_finding_json(full).join(full.select("probe_id", "status"), "probe_id").collect()]
    for status, j in found:
        assert tuple(j) == (PB.JSON_FIELDS[j["tool"]] if status == "OK" else PB.ERROR_FIELDS)
    assert {j["tool"] for s, j in found if s == "OK"} == set(PB.JSON_FIELDS) and any(s != "OK" for s, _ in found)
    hops = [j["hops"] for s, j in found if s == "OK" and j["tool"] == "traceroute_host"]
    assert all(set(h) == {"n", "ip", "rtt_ms", "timed_out"} for hs in hops for h in hs)


def test_blast_radius_multiplies_no_flow(spark):
    f = flows_df(spark, [flow("a", "d", 80, "REJECT", T0), flow("a", "d", 80, "ACCEPT", T0), flow("b", "d", 443, "ACCEPT", T0), flow(None, "d", 22, "REJECT", T0),
                         flow("a", None, 22, "REJECT", T0), flow("a", "e", None, "REJECT", T0), flow("a", "g", 1, None, T0)])
    from flowlens.operators import diagnose as DG
    out = DG.blast_radius(f)
    got = {r["dstaddr"]: (r["peers"], r["rejected_peers"], r["rejected_ports"], r["peer_scope"], r["port_scope"]) for r in out.collect()}
    assert got == {"d": (2, 1, 2, "PER_SOURCE", "BROAD_OUTAGE"), None: (1, 1, 1, "GLOBAL", "TARGETED_RULE"), "e": (1, 1, 0, "GLOBAL", "NONE")}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_task_gets_a_bounded_number_of_rows(spark, monkeypatch, tmp_path):
    """One file of many rows: tasks grow in number, not in rows."""
    from flowlens.sources import inputs as IN
    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(IN, "PART_ROWS", 100)
    df = IN.spread(spark.read.parquet(str(tmp_path / "t")))
    assert df.rdd.getNumPartitions() == 20 and df.count() == 2000
