"""What an INTERMITTENT verdict means (A6/A7): a change in time, or a difference between ports or peers.

Three explanations are compared by how many accept / reject records they get wrong. Time: the best single split second, with
records before it accepted and from it on rejected (BLOCKED_FROM) or the other way round (OPENED_FROM). Ports and peers: every
port (peer) has the action of most of its records. The one with the fewest wrong records is the label, TIME before PORT before PEER
at equal numbers; MIXED when even that leaves more than half of the smaller action's records unexplained.

Of the pairs of J1 (``intermittent_cause``), the records of a question are reduced to counts per second, port and peer by partial aggregation; sums per chunk of seconds
carry the running counts, so no window holds more than a chunk's seconds or a question's chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.blocks import asked_once, causes
from flowlens.operators.flows import match_flows
from flowlens.session import materialise

CHUNK_S = 600


def tallies(matched: DataFrame) -> DataFrame:
    """Counts per (question, second), (question, port) and (question, peer): one aggregate; ``by`` tells them apart."""
    m = matched.filter(F.col("action").isin("ACCEPT", "REJECT")).select(
        "request_id", F.col("start").alias("second"), "dstport", "peer", F.when(F.col("action") == "REJECT", 1).otherwise(0).alias("bad"))
    g = m.groupingSets([["request_id", "second"], ["request_id", "dstport"], ["request_id", "peer"]], "request_id", "second", "dstport", "peer").agg(
        F.grouping_id("request_id", "second", "dstport", "peer").alias("gid"), F.sum(F.lit(1) - F.col("bad")).alias("acc"), F.sum("bad").alias("rej"))
    return g.select("request_id", F.when(F.col("gid") == 3, "TIME").when(F.col("gid") == 5, "PORT").otherwise("PEER").alias("by"), "second", "acc", "rej")


def best_splits(seconds: DataFrame, chunk_s: int = CHUNK_S) -> DataFrame:
    """Per question the split (second, direction) with the fewest wrong records; at equal numbers the earliest, BLOCKED_FROM first.

    A split lies before one of the question's seconds but not before its first (that would split nothing).
    """
    s = seconds.withColumn("chunk", F.floor(F.col("second") / chunk_s))
    chunks = s.groupBy("request_id", "chunk").agg(F.sum("acc").alias("c_acc"), F.sum("rej").alias("c_rej"))
    wq = Window.partitionBy("request_id").orderBy("chunk")
    before, whole = wq.rowsBetween(Window.unboundedPreceding, -1), wq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = chunks.select("request_id", "chunk", F.coalesce(F.sum("c_acc").over(before), F.lit(0)).alias("b_acc"),
                           F.coalesce(F.sum("c_rej").over(before), F.lit(0)).alias("b_rej"),
                           F.sum("c_acc").over(whole).alias("accepts"), F.sum("c_rej").over(whole).alias("rejects"))
    w = Window.partitionBy("request_id", "chunk").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("request_id", "chunk", "second", F.coalesce(F.sum("acc").over(w), F.lit(0)).alias("i_acc"),
                 F.coalesce(F.sum("rej").over(w), F.lit(0)).alias("i_rej")).join(chunks, ["request_id", "chunk"])
    acc, rej = F.col("b_acc") + F.col("i_acc"), F.col("b_rej") + F.col("i_rej")
    blocked = F.struct((rej + F.col("accepts") - acc).alias("wrong"), "second", F.lit(0).alias("turn"))
    opened = F.struct((acc + F.col("rejects") - rej).alias("wrong"), "second", F.lit(1).alias("turn"))
    best = s.filter(acc + rej > 0).groupBy("request_id").agg(F.min(F.least(blocked, opened)).alias("b"))
    return best.select("request_id", F.col("b.wrong").alias("time_wrong"), F.col("b.second").alias("split_second"),
                       F.when(F.col("b.turn") == 0, "BLOCKED_FROM").otherwise("OPENED_FROM").alias("turn"))


def intermittent_cause(matched: DataFrame, chunk_s: int = CHUNK_S) -> DataFrame:
    """One row per question with both actions in ``matched`` (the pairs of J1)."""
    t = materialise(tallies(matched), "cause-tallies")
    wrong = F.least("acc", "rej")
    sums = t.groupBy("request_id").agg(
        F.sum(F.when(F.col("by") == "TIME", F.col("acc"))).alias("accepts"), F.sum(F.when(F.col("by") == "TIME", F.col("rej"))).alias("rejects"),
        F.sum(F.when(F.col("by") == "PORT", wrong)).alias("port_wrong"), F.sum(F.when(F.col("by") == "PEER", wrong)).alias("peer_wrong"))
    both = sums.filter("accepts > 0 and rejects > 0").join(best_splits(t.filter("by = 'TIME'"), chunk_s), "request_id", "left")
    return _labelled(both)


def intermittent_causes(flows: DataFrame, valid: DataFrame, chunk_s: int = CHUNK_S) -> DataFrame:
    """``intermittent_cause`` of J1 without its pairs: the evidence of a question comes from the block of its window (``blocks``)."""
    alone, others = asked_once(valid)
    out = _labelled(causes(flows, alone))
    return out if others is None else out.unionByName(intermittent_cause(match_flows(flows, others), chunk_s))


def _labelled(both: DataFrame) -> DataFrame:
    # all records in one second: no split exists and time explains nothing
    time_wrong = F.coalesce("time_wrong", F.least("accepts", "rejects"))
    least = F.least(time_wrong, "port_wrong", "peer_wrong")
    label = (F.when(2 * least > F.least("accepts", "rejects"), "MIXED").when(time_wrong == least, "TIME")
              .when(F.col("port_wrong") == least, "PORT").otherwise("PEER"))
    return both.select("request_id", "accepts", "rejects", time_wrong.alias("time_wrong"), "port_wrong", "peer_wrong", "split_second", "turn",
                       label.alias("label"), least.alias("wrong"))
