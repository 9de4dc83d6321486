"""Labels and cuts that the thin fixture never reaches, the seen table, and sessions closed by other traffic."""

from pyspark.sql import functions as F

from flowlens.operators import diagnose as DG
from flowlens.plans.registry import QUERIES
from flowlens.session import scratch_path
from flowlens.sources import flowlogs as FLG
from flowlens.sources import inputs as IN
from flowlens.streaming import flowstream as XS
from tests.conftest import SF_MID
from tests.helpers import T0, flow, flows_df, request, requests_df


def test_labels_and_cuts_occur(spark):
    verdicts = QUERIES["busy_batch_flow_verdicts"](spark, SF_MID)
    assert {r["verdict"] for r in verdicts.select("verdict").distinct().collect()} == {"PERSISTENT_REJECT", "INTERMITTENT", "ALL_ACCEPT", "NO_DATA"}
    reasons = {r["reason"] for r in QUERIES["busy_all_clear"](spark, SF_MID).select("reason").distinct().collect()}
    assert {"NEVER_SEEN", "AWS_SIDE_EVIDENCE"} <= reasons
    f, q = IN.busy_flows(spark, SF_MID), IN.busy_requests(spark, SF_MID)
    from flowlens.operators import flows as FL
    from flowlens.operators import requests as RQ
    groups = FL.flow_groups(FL.match_flows(f, RQ.valid_requests(q)))
    most = groups.groupBy("request_id").agg(F.count("*").alias("g"), F.count_distinct("dstport").alias("p"), F.count_distinct("peer").alias("n")).agg(
        F.max("g"), F.max("p"), F.max("n")).first()
    assert most[0] > 20 and most[1] > 10 and most[2] > 10


def test_all_clear_reads_the_seen_table(spark):
    f = flows_df(spark, [flow("10.0.0.1", "10.1.0.1", 80, "ACCEPT", T0), flow("10.0.0.2", "10.1.0.1", 80, "REJECT", T0 - 5 * 86400),
                         flow(None, "10.1.0.1", 80, "REJECT", T0)])
    q = requests_df(spark, [request(1, ip="10.0.0.1", direction="from", as_of=T0 + 600), request(2, ip="10.0.0.2", direction="from", as_of=T0 + 600),
                            request(3, ip="10.0.0.3", direction="from", as_of=T0 + 600)])
    path = scratch_path(spark, "seen")
    FLG.write_seen_sources(f, path)
    sources = spark.read.parquet(path)
    want = {1: "ALL_ACCEPT", 2: "AWS_SIDE_EVIDENCE", 3: "NEVER_SEEN"}
    assert {r["request_id"]: r["reason"] for r in DG.all_clear(f, q).collect()} == want
    assert {r["request_id"]: r["reason"] for r in DG.all_clear(f, q, sources=sources).collect()} == want
    from flowlens.operators import flows as FL
    from flowlens.session import materialise
    verdicts = materialise(FL.batch_flow_verdicts(f, q, nested=False), "verdicts")
    out = DG.all_clear(None, q, verdicts, sources)  # no flows at all: only the seen table can answer
    assert {r["request_id"]: r["reason"] for r in out.collect()} == want


def test_a_block_that_stopped_closes_without_another_reject(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def arrive(items):
        flows_df(spark, items).withColumn("start_ts", F.timestamp_seconds("start")).coalesce(1).write.mode("append").parquet(src)

    arrive([flow("a", "d", 80, "REJECT", T0 + k) for k in (0, 60, 200)])

    def run():
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        XS.run_available(XS.reject_sessions(stream), sink, ck)
        return [(r["dstaddr"], r["rejects"], r["last_start"]) for r in spark.read.parquet(sink).collect()]

    assert run() == []
    arrive([flow("b", "e", 443, "ACCEPT", T0 + 7200)])  # only accepted traffic elsewhere; the job starts anew from its checkpoint
    assert run() == [("d", 3, T0 + 200)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root, table, sizes, ck = (str(tmp_path / x) for x in ("in", "table", "sizes", "ck"))

    def state():
        return (sorted((r["srcaddr"], r["start"], r["day"]) for r in FLG.read_flows_table(spark, table).collect()),
                sorted((r["day"], r["records"], r["day_bytes"]) for r in XS.stored_day_bytes(spark, sizes).collect()))

    first = flows_df(spark, [flow("10.0.0.1", "10.1.0.1", 80, "ACCEPT", T0), flow("10.0.0.2", "10.1.0.1", 80, "REJECT", T0 - 86400)])
    FLG.write_flow_text(first, f"{root}/a")
    XS.ingest_stream(spark, root, table, sizes, ck)
    one = state()
    assert len(one[0]) == 2 and [x[1] for x in one[1]] == [1, 1]
    XS.ingest_stream(spark, root, table, sizes, ck)  # nothing new
    XS.load_batch(first, 0, table, sizes)  # the batch once more, as after a restart before its commit
    assert state() == one
    FLG.write_flow_text(flows_df(spark, [flow("10.0.0.3", "10.1.0.1", 80, "REJECT", T0 + 5)]), f"{root}/b")
    XS.ingest_stream(spark, root, table, sizes, ck)
    rows_, days = state()
    assert len(rows_) == 3 and sum(x[1] for x in days) == 3 and len(days) == 2
