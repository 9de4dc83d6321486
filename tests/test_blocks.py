"""Blocks (J1 without pairs for lists, causes and arrivals) against the matched pairs."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import blocks as BL
from flowlens.operators import changepoint as CP
from flowlens.operators import diagnose as DG
from flowlens.operators import flows as FL
from flowlens.plans.registry import QUERIES
from tests.conftest import SF_SMALL, rows
from tests.test_timeindex import random_flows, random_questions

GROUP = ["request_id", "peer", "dstport", "action", "cnt", "total_bytes", "first_seen", "last_seen", "last_end"]


def odd(spark):
    """Flows without bytes or an end, some of another day's folder; questions that come twice, with other windows, or without an id."""
    f, q = random_flows(spark), random_questions(spark)
    f = f.withColumn("bytes", F.when(F.col("start") % 3 > 0, F.col("bytes"))).withColumn("end", F.when(F.col("start") % 2 > 0, F.col("end")))
    f = f.withColumn("day", F.when(F.col("start") % 29 == 0, "2023/12/31").otherwise(F.col("day")))
    f = f.withColumn("flow_direction", F.when(F.col("start") % 5 < 2, "egress").when(F.col("start") % 5 < 4, "ingress"))
    q = q.unionByName(q.filter("request_id % 7 = 0")).unionByName(q.filter("request_id % 9 = 0").withColumn("lo", F.col("lo") - 900))
    return f, q.withColumn("request_id", F.when(F.col("request_id") % 13 > 0, F.col("request_id")))


def never_arrived_of_pairs(f, q):
    pairs = FL.match_flows(f, q.withColumn("action", F.lit("ALL"))).filter("action is not null").groupBy("request_id", "peer", "focus", "dstport").agg(
        F.count_if(F.col("flow_direction") == "egress").alias("sent"), F.count_if(F.col("flow_direction") == "ingress").alias("arrived"))
    return rows(pairs.filter("sent > 0 and arrived = 0").select("request_id").distinct())


@pytest.mark.parametrize("make", [odd, lambda spark: (random_flows(spark), random_questions(spark))])
def test_answers_equal_those_of_the_pairs(spark, make):
    f, q = make(spark)
    pairs = FL.match_flows(f, q)
    assert rows(FL.flow_groups(BL.match_groups(f, q)), *GROUP) == rows(FL.flow_groups(pairs), *GROUP)
    want = CP.intermittent_cause(pairs)
    assert rows(CP.intermittent_causes(f, q), *want.columns) == rows(want)
    assert want.count() > 20
    verdicts = q.select("request_id", "status", F.lit("INTERMITTENT").alias("verdict"), "action", F.col("ip").alias("focus_ip"), "direction",
                        F.col("port").alias("dstport"), "protocol", F.col("lo").alias("window_lo"), F.col("hi").alias("window_hi"))
    assert rows(DG.never_arrived(f, verdicts).distinct()) == never_arrived_of_pairs(f, q)


def test_no_question_and_no_flow(spark):
    f, q = random_flows(spark, 20), random_questions(spark, 20)
    for flows, asked in ((f, q.limit(0)), (f.limit(0), q)):
        assert FL.flow_groups(BL.match_groups(flows, asked)).count() == 0
        assert CP.intermittent_causes(flows, asked).count() == 0


def test_no_pair_of_question_and_flow_is_made(spark, monkeypatch):
    """A crowd of questions on the same flows: the blocks' answers never come from the join of J1."""
    f, q = random_flows(spark), random_questions(spark)
    monkeypatch.setattr(FL, "match_flows", None)
    monkeypatch.setattr(CP, "match_flows", None)
    assert FL.flow_groups(BL.match_groups(f, q)).count() > 900
    assert CP.intermittent_causes(f, q).count() > 20


# ---------------------------------------------------------------- the registered queries on the fixture


@pytest.mark.parametrize("key", ["flow_groups", "reject_span", "peer_rollup", "port_rollup", "groups_topn", "top_peers", "top_ports", "noise_split"])
def test_group_queries_make_no_pairs(spark, monkeypatch, key):
    monkeypatch.setattr(FL, "match_flows", None)
    assert QUERIES[key](spark, SF_SMALL).columns[0] == "request_id"


def test_intermittent_cause_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(FL, "match_flows", None)
    monkeypatch.setattr(CP, "match_flows", None, raising=False)
    assert QUERIES["intermittent_cause"](spark, SF_SMALL).columns[0] == "request_id"


@pytest.mark.parametrize("key", ["root_cause", "conclusions"])
def test_conclusions_make_no_pairs(spark, monkeypatch, key):
    monkeypatch.setattr(FL, "match_flows", None)
    assert QUERIES[key](spark, SF_SMALL).columns[0] == "request_id"
