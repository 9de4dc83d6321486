"""As-of join and episodes against brute force, with a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators.temporal import asof_latest, episodes


def test_asof_latest_brute_force(spark):
    rnd = random.Random(7)
    right = [(rnd.choice(["h0", "h0", "h0", "h1", "h2", None]), rnd.choice([80, 5432]), rnd.randint(0, 40000),
              i, f"v{i}") for i in range(600)]
    left = [(q, rnd.choice(["h0", "h1", "h2", "h3", None]), rnd.choice([80, 5432]), rnd.randint(0, 42000))
            for q in range(300)]
    R = spark.createDataFrame(right, "host string, port int, t long, pid long, v string")
    L = spark.createDataFrame(left, "qid long, host string, port int, at long")
    out = asof_latest(L, R, by=["host", "port"], left_id="qid", left_time="at", right_time="t", tie="pid",
                      payload=["v"], name="m", bucket_s=3600)
    got = {r["qid"]: (r["m"]["pid"] if r["m"] else None) for r in out.collect()}
    exp = {}
    for qid, h, p, at in left:
        cands = [(t, pid) for (hh, pp, t, pid, _) in right if h is not None and hh == h and pp == p and t <= at]
        exp[qid] = max(cands)[1] if cands else None
    assert got == exp


def test_episodes_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(2000):
        k = rnd.choice(["a", "a", "a", "b", "c"])
        rows.append((k, rnd.randint(0, 5 * 3600), f"s{rnd.randint(0, 5)}", i, rnd.choice(["ACCEPT", "REJECT"])))
    df = spark.createDataFrame(rows, "k string, start long, src string, sp long, action string")
    got = episodes(df, key=["k"], order=["start", "src", "sp"], value="action", time="start", chunk_s=600)
    w = Window.partitionBy("k").orderBy("start", "src", "sp")
    b = (df.withColumn("new", F.when(F.lag("action").over(w) == F.col("action"), 0).otherwise(1))
           .withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .groupBy("k", "episode").agg(F.first("action").alias("action"), F.min("start").alias("started"),
                                        F.max("start").alias("stopped"), F.count("*").alias("n")))
    cols = ["k", "episode", "action", "started", "stopped", "n"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in b.select(*cols).collect())
