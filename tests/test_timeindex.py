"""Running tallies (J1 without pairs) against the totals of the matched pairs."""

import random

from pyspark.sql import functions as F

from flowlens.operators import flows as FL
from flowlens.operators import timeindex as TI
from flowlens.sources import inputs as IN
from tests.conftest import SF_MID, SF_SMALL, rows
from tests.helpers import T0, flow, flows_df

COLS = ["request_id", "accepts", "rejects", "first_reject_epoch", "last_reject_epoch", "last_reject_end_epoch"]
SCOPE = ("request_id bigint, ip string, direction string, port int, protocol bigint, action string, lo bigint, hi bigint, "
         "status string")


def random_flows(spark, n=1500):
    rng = random.Random(11)
    out = []
    for _ in range(n):
        f = flow(rng.choice(["10.0.0.1", "10.0.0.2", "10.0.0.3", None]), rng.choice(["10.1.0.1", "10.1.0.1", "10.1.0.2"]), rng.choice([80, 443, None]),
                 rng.choice(["ACCEPT", "REJECT", "reject", "OTHER", None]), T0 + rng.randrange(0, 5 * 3600), proto=rng.choice([6, 17, None]))
        f["end"] = f["start"] + rng.choice([0, 60, 4000])  # the latest end need not be that of the last record
        out.append(f)
    return flows_df(spark, out)


def random_questions(spark, n=400):
    rng, out = random.Random(12), []
    for i in range(n):
        lo = T0 + rng.randrange(-600, 5 * 3600)
        lo -= rng.choice([0, lo % 3600, lo % 60])
        hi = lo + rng.choice([0, 1, 3, 19, 59, 60, 119, 240, 1199, 3599, 3600, 3601, 7200, 10800, 40000])
        ip = rng.choice([None, "10.1.0.1", "10.0.0.1", "9.9.9.9"])
        out.append((i, ip, rng.choice(["to", "from"]), rng.choice([None, 80, 443]), rng.choice([None, 6, 17]),
                    rng.choice(["ALL", "ALL", "ACCEPT", "REJECT"]), lo, hi, "OK"))
    return spark.createDataFrame(out, SCOPE).filter("ip is not null or port is not null or protocol is not null")


def test_totals_equal_those_of_the_pairs(spark):
    f, q = random_flows(spark), random_questions(spark)
    pairs = FL.match_flows(f, q)
    want = FL.totals_from_matched(pairs).join(pairs.groupBy("request_id").agg(F.count("*").alias("flows")), "request_id")
    assert rows(TI.totals(f, q), *COLS, "flows") == rows(want, *COLS, "flows")


def test_totals_of_the_fixture(spark):
    from flowlens.operators import requests as RQ
    f, q = IN.flows(spark, SF_MID), RQ.valid_requests(IN.requests(spark, SF_MID))
    assert rows(TI.totals(f, q), *COLS) == rows(FL.totals_from_matched(FL.match_flows(f, q)), *COLS)


def test_a_window_is_a_few_pieces_and_a_second_of_a_scope_one_row(spark):
    q = random_questions(spark).filter("hi - lo <= 10800")
    per = TI.pieces(TI.question_scopes(q)).groupBy("request_id").count().agg(F.max("count")).first()[0]
    assert per <= 6
    hot = flows_df(spark, [flow(f"10.0.{k % 250}.{k // 250}", "10.1.0.1", 80, "REJECT", T0 + k % 7) for k in range(3000)])
    kinds = ["to+port+ALL"]
    wanted = spark.createDataFrame([("to+port+ALL|10.1.0.1|80|-",)], "scope string")
    cells = TI.seconds(hot, kinds, wanted, T0, T0 + 100)
    assert cells.count() == 7 and cells.agg(F.sum("rej")).first()[0] == 3000


def test_no_pair_of_question_and_flow(spark):
    """Rows of the join of pieces and tallies grow with the questions, whatever the flows."""
    from flowlens.operators import requests as RQ
    for sf in (SF_SMALL, SF_MID):
        q = RQ.valid_requests(IN.requests(spark, sf))
        n, parts = q.count(), TI.pieces(TI.question_scopes(q)).count()
        assert n <= parts <= 5 * n
    plan = TI.totals(IN.flows(spark, SF_SMALL), RQ.valid_requests(IN.requests(spark, SF_SMALL)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_question_or_no_flow(spark):
    q, f = random_questions(spark), random_flows(spark, 50)
    assert TI.totals(f, q.limit(0)).count() == 0 and TI.totals(f.limit(0), q).count() == 0
