"""Flow verdicts for one question or a table of them.

Verdicts without lists come from the running tallies of ``timeindex`` and join no flow with a question.

Plan shape (batch with peer and port lists): one flow scan -> equi-join on (day, hour, class, key) with
the question buckets (broadcast when their size is proven small) -> one
grouping-sets aggregate of the matched pairs into peer-level and port-level
tallies (partial aggregation, one shuffle) -> totals, top peers and top ports
(row_number <= 10 plans as WindowGroupLimit: partial top-k before the shuffle)
-> joined back to the questions on request_id, so questions without flows stay
NO_DATA and invalid ones keep their error row.
"""

from __future__ import annotations

import datetime as dt
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import columns as C
from flowlens.operators import filters as P
from flowlens.operators import timeindex
from flowlens.operators.requests import validate_requests
from flowlens.operators.temporal import broadcast_if_small
from flowlens.session import materialise as write_and_read

# Largest number of question buckets we broadcast (about 100 bytes each, so
# about 100 MB shipped to every executor); past it J1 is a shuffle join.
MAX_BROADCAST_BUCKETS = 1_000_000


def _is(action: str) -> Column:
    return F.upper(F.col("action")) == action


# ---------------------------------------------------------------- J1: match

def question_buckets(v: DataFrame) -> DataFrame:
    """Each valid question once per UTC hour its window touches (at most 4).

    Adds the join class: D (ip, to), S (ip, from), P (port only), R (protocol only).
    """
    hour = F.explode(F.sequence(F.floor(F.col("lo") / K.HOUR_S), F.floor(F.col("hi") / K.HOUR_S)))
    cls = (F.when(F.col("ip").isNotNull() & (F.col("direction") == "to"), "D")
            .when(F.col("ip").isNotNull(), "S")
            .when(F.col("port").isNotNull(), "P")
            .otherwise("R"))
    return (v.select("request_id", "ip", "direction", "port", "protocol", "action", "lo", "hi",
                     cls.alias("cls"), hour.alias("q_hour"))
             .withColumn("q_day", C.day_of(F.col("q_hour") * K.HOUR_S)))


# Join key of each class on the flow side and on the question side.
_CLASS_KEY = {"D": ("dstaddr", "ip"), "S": ("srcaddr", "ip"), "P": ("dstport", "port"),
              "R": ("protocol", "protocol")}


def match_flows(flows: DataFrame, valid: DataFrame,
                max_broadcast: int = MAX_BROADCAST_BUCKETS) -> DataFrame:
    """All (question, flow) pairs that satisfy the question's predicates.

    Output: request_id, peer, focus (the other address), dstport, action, flow_direction, bytes, start, end.

    Plan: one scan of the flows. Each flow row carries one join key per class
    of question present (to-address, from-address, port, protocol), and is
    equi-joined on (day, hour, class, key) with the question buckets; the
    optional predicates and the exact window are residual conditions. Each flow
    meets a question in exactly one bucket, so nothing is counted twice.

    One small action over the questions gives the bucket count per class (the
    proof that the question side may be broadcast) and the overall time bounds,
    which become literal filters on the flow scan (row-group skipping and day
    pruning). With broadcast, flows are never shuffled; only the partial
    aggregates after the join are. Past the bound it is a shuffle join on the
    same keys, where AQE splits skewed (hot address) partitions.
    """
    # The buckets feed the stats job and the join: materialise them once in
    # the shared checkpoint folder (also cuts the lineage, so the status
    # filter is not re-inlined into the join side).
    b = write_and_read(question_buckets(valid), "question-buckets")
    stats = b.groupBy("cls").agg(F.count("*").alias("n"), F.min("lo").alias("lo"),
                                 F.max("hi").alias("hi")).collect()
    fl = flows.select("day", "start", "end", "srcaddr", "dstaddr", "dstport", "protocol", "action", "bytes",
                      "flow_direction")
    if not stats:
        return fl.limit(0).select(F.lit(None).cast("bigint").alias("request_id"),
                                  F.col("srcaddr").alias("peer"), F.col("dstaddr").alias("focus"), "dstport", "action",
                                  "flow_direction", "bytes", "start", "end")
    classes = sorted(r["cls"] for r in stats)
    n = sum(r["n"] for r in stats)
    lo, hi = min(r["lo"] for r in stats), max(r["hi"] for r in stats)

    side = b.filter(F.col("cls").isin(*classes)).select(
        "request_id", "direction", "port", "protocol", "action", "lo", "hi", "q_day", "q_hour", "cls",
        reduce(lambda acc, c: acc.when(F.col("cls") == c, F.col(_CLASS_KEY[c][1]).cast("string")),
               classes[1:], F.when(F.col("cls") == classes[0],
                                   F.col(_CLASS_KEY[classes[0]][1]).cast("string"))).alias("q_key"))
    broadcast_side = n <= max_broadcast
    if broadcast_side:
        side = F.broadcast(side)

    keys = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(_CLASS_KEY[c][0]).cast("string").alias("key"))
                     for c in classes])
    f = (fl.filter(F.col("start").between(lo, hi)
                   & F.col("day").between(C.day_of(F.lit(lo)), C.day_of(F.lit(hi))))
           .select("*", F.floor(F.col("start") / K.HOUR_S).alias("f_hour"),
                   F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("fk")))
    if not broadcast_side:
        # Shuffle-join path: drop flows whose (class, key) no question asks about
        # before they are shuffled. The distinct keys are far fewer than the
        # buckets; they are broadcast only when a bounded count proves it.
        wanted = side.select(F.col("cls").alias("w_cls"), F.col("q_key").alias("w_key")).distinct()
        wanted = broadcast_if_small(wanted, max_broadcast)
        f = f.join(wanted, (F.col("fk.cls") == F.col("w_cls")) & (F.col("fk.key") == F.col("w_key")),
                   "left_semi")
    f, q = f.alias("f"), side.alias("q")
    c = F.col
    cond = ((c("f.day") == c("q.q_day")) & (c("f.f_hour") == c("q.q_hour"))
            & (c("f.fk.cls") == c("q.cls")) & (c("f.fk.key") == c("q.q_key"))
            & c("f.start").between(c("q.lo"), c("q.hi"))
            & P.optional_eq(c("f.dstport"), c("q.port"))
            & P.optional_eq(c("f.protocol"), c("q.protocol"))
            & ((c("q.action") == "ALL") | (c("f.action") == c("q.action"))))
    return f.join(q, cond, "inner").select(
        c("q.request_id").alias("request_id"),
        F.when(c("q.direction") == "to", c("f.srcaddr")).otherwise(c("f.dstaddr")).alias("peer"),
        F.when(c("q.direction") == "to", c("f.dstaddr")).otherwise(c("f.srcaddr")).alias("focus"),
        c("f.flow_direction").alias("flow_direction"),
        c("f.dstport").alias("dstport"), c("f.action").alias("action"), c("f.bytes").alias("bytes"),
        c("f.start").alias("start"), c("f.end").alias("end"))


# ---------------------------------------------------------------- A1-A5, K1-K3

def flow_groups(matched: DataFrame) -> DataFrame:
    """A1: per question, group by (peer, dstport, action); of the pairs of J1 or of the tallies of ``blocks.match_groups``."""
    if "cnt" in matched.columns:
        return matched.groupBy("request_id", "peer", "dstport", "action").agg(
            F.sum("cnt").cast("bigint").alias("cnt"), F.sum("bytes").cast("bigint").alias("total_bytes"), F.min("start").alias("first_seen"),
            F.max("last_start").alias("last_seen"), F.max("end").alias("last_end"))
    return matched.groupBy("request_id", "peer", "dstport", "action").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("bytes").cast("bigint").alias("total_bytes"),
        F.min("start").alias("first_seen"),
        F.max("start").alias("last_seen"),
        F.max("end").alias("last_end"))


def top_groups(groups: DataFrame, n: int = K.LEGACY_GROUP_LIMIT) -> DataFrame:
    """K1: the n largest groups per question (count desc, then keys ascending)."""
    w = Window.partitionBy("request_id").orderBy(
        F.desc("cnt"), F.asc_nulls_last("peer"), F.asc_nulls_last("dstport"), F.asc_nulls_last("action"))
    return groups.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def totals(groups: DataFrame) -> DataFrame:
    """A2 + A3: accept / reject totals and the reject span per question."""
    return groups.groupBy("request_id").agg(
        F.sum(F.when(_is("ACCEPT"), F.col("cnt")).otherwise(0)).cast("bigint").alias("accepts"),
        F.sum(F.when(_is("REJECT"), F.col("cnt")).otherwise(0)).cast("bigint").alias("rejects"),
        F.min(F.when(_is("REJECT"), F.col("first_seen"))).alias("first_reject_epoch"),
        F.max(F.when(_is("REJECT"), F.col("last_seen"))).alias("last_reject_epoch"),
        F.max(F.when(_is("REJECT"), F.col("last_end"))).alias("last_reject_end_epoch"))


def peer_rollup(groups: DataFrame) -> DataFrame:
    """A4: flows and rejects per (question, peer); NULL peer is a legal key."""
    return groups.groupBy("request_id", "peer").agg(
        F.sum("cnt").cast("bigint").alias("flows"),
        F.sum(F.when(_is("REJECT"), F.col("cnt")).otherwise(0)).cast("bigint").alias("rejects"))


def port_rollup(groups: DataFrame) -> DataFrame:
    """A5: flows per (question, dstport); NULL ports are skipped."""
    return (groups.filter(F.col("dstport").isNotNull())
                  .groupBy("request_id", "dstport")
                  .agg(F.sum("cnt").cast("bigint").alias("flows")))


def top_k(rollup: DataFrame, key: str, n: int = K.TOP_N) -> DataFrame:
    """K2 / K3: rank by flows desc, key asc (NULL last); keep the first n."""
    w = Window.partitionBy("request_id").orderBy(F.desc("flows"), F.asc_nulls_last(key))
    return rollup.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _nest(top: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Collect at most n ranked rows per question into an ordered array."""
    arr = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return top.groupBy("request_id").agg(
        F.transform(arr, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


# ---------------------------------------------------------------- A6-A8

def verdict(accepts: Column, rejects: Column) -> Column:
    """A6."""
    return (F.when((accepts == 0) & (rejects == 0), "NO_DATA")
             .when(accepts == 0, "PERSISTENT_REJECT")
             .when(rejects > 0, "INTERMITTENT")
             .otherwise("ALL_ACCEPT"))


def hint(v: Column, accepts: Column, rejects: Column, first_reject: Column) -> Column:
    """Likely cause and next check as codes, with the totals and the first reject."""
    return C.advice(K.FLOW_ADVICE, v, C.fact("accepted", accepts), C.fact("rejected", rejects),
                    C.fact("first_reject", first_reject))


def rollups(matched: DataFrame) -> DataFrame:
    """Peer-level and port-level tallies of matched flows in one aggregate.

    Grouping sets (request, peer) and (request, dstport) share one partial
    aggregation and one shuffle; ``gid`` tells them apart (1: peer, 2: port).
    NULL peer and NULL port are real groups.
    """
    rej, acc = _is("REJECT"), _is("ACCEPT")
    return matched.groupingSets([["request_id", "peer"], ["request_id", "dstport"]],
                                "request_id", "peer", "dstport").agg(
        F.count(F.lit(1)).alias("flows"),
        F.count(F.when(acc, 1)).alias("accepts"),
        F.count(F.when(rej, 1)).alias("rejects"),
        F.min(F.when(rej, F.col("start"))).alias("first_reject_epoch"),
        F.max(F.when(rej, F.col("start"))).alias("last_reject_epoch"),
        F.max(F.when(rej, F.col("end"))).alias("last_reject_end_epoch"),
        F.grouping_id().alias("gid"))


def totals_from_matched(matched: DataFrame) -> DataFrame:
    """A2 + A3 straight from matched flows (one partial aggregate per question)."""
    rej, acc = _is("REJECT"), _is("ACCEPT")
    return matched.groupBy("request_id").agg(
        F.count(F.when(acc, 1)).alias("accepts"),
        F.count(F.when(rej, 1)).alias("rejects"),
        F.min(F.when(rej, F.col("start"))).alias("first_reject_epoch"),
        F.max(F.when(rej, F.col("start"))).alias("last_reject_epoch"),
        F.max(F.when(rej, F.col("end"))).alias("last_reject_end_epoch"))


def findings(vreq: DataFrame, matched: DataFrame | None, nested: bool = True,
             legacy_group_limit: int | None = None, share: bool = True, tally: DataFrame | None = None) -> DataFrame:
    """One finding row per question in ``vreq`` (all statuses).

    ``matched`` holds the (question, flow) pairs of J1. Without nesting only
    totals are needed: one aggregate, or ``tally``, the totals themselves. With nesting, the peer and port tallies
    come from one grouping-sets aggregate, written once to the checkpoint
    folder and read by its three consumers (totals, top peers, top ports).
    ``legacy_group_limit=500`` reproduces the old behaviour where everything
    comes from the 500 largest (peer, port, action) groups only (D1).
    ``share=False`` lets each consumer recompute the rollup instead of writing
    it, which is cheaper when ``matched`` comes from a very selective scan.
    """
    if tally is not None:
        t = tally
    elif legacy_group_limit is not None:
        g = top_groups(flow_groups(matched), legacy_group_limit).drop("rank")
        t = totals(g)
        tp_src, tq_src = peer_rollup(g), port_rollup(g)
    elif nested:
        r = write_and_read(rollups(matched), "flow-rollups") if share else rollups(matched)
        by_port = r.filter(F.col("gid") == 2)
        t = by_port.groupBy("request_id").agg(
            F.sum("accepts").cast("bigint").alias("accepts"), F.sum("rejects").cast("bigint").alias("rejects"),
            F.min("first_reject_epoch").alias("first_reject_epoch"),
            F.max("last_reject_epoch").alias("last_reject_epoch"),
            F.max("last_reject_end_epoch").alias("last_reject_end_epoch"))
        tp_src = r.filter(F.col("gid") == 1).select("request_id", "peer", "flows", "rejects")
        tq_src = by_port.filter(F.col("dstport").isNotNull()).select("request_id", "dstport", "flows")
    else:
        t = totals_from_matched(matched)
    out = vreq.join(t, "request_id", "left")
    if nested:
        tp = _nest(top_k(tp_src, "peer"), ["peer", "flows", "rejects"], "top_peers")
        tq = _nest(top_k(tq_src, "dstport"), ["dstport", "flows"], "top_ports")
        out = out.join(tp, "request_id", "left").join(tq, "request_id", "left")
    ok = F.col("status") == "OK"
    acc = F.when(ok, F.coalesce(F.col("accepts"), F.lit(0).cast("bigint")))
    rej = F.when(ok, F.coalesce(F.col("rejects"), F.lit(0).cast("bigint")))
    v = F.when(ok, verdict(acc, rej))
    cols = [
        "request_id", "status", "detail",
        F.lit("flow_log_query").alias("tool"),
        F.col("ip").alias("focus_ip"), "direction", F.col("port").alias("dstport"), "protocol", "action",
        F.when(ok, C.iso(F.col("lo"))).alias("window_start"),
        F.when(ok, C.iso(F.col("hi"))).alias("window_end"),
        F.when(ok, F.col("window_minutes")).alias("window_minutes"),
        acc.alias("accepts"), rej.alias("rejects"),
        C.iso(F.col("first_reject_epoch")).alias("first_reject"),
        C.iso(F.col("last_reject_epoch")).alias("last_reject"),
        C.iso(F.col("last_reject_end_epoch")).alias("last_reject_end"),
        v.alias("verdict"),
        hint(v, acc, rej, C.iso(F.col("first_reject_epoch"))).alias("remediation_hint"),
        F.when(ok, C.finding_id(F.lit("flowlog"), F.col("ip"), F.col("direction"), F.col("port"),
                                F.col("protocol"), v, rej, acc)).alias("finding_id"),
        F.when(ok, F.col("was_clipped")).alias("was_clipped"),
        F.col("lo").alias("window_lo"), F.col("hi").alias("window_hi"), "as_of_epoch",
    ]
    if nested:
        empty_p = F.array().cast("array<struct<peer:string,flows:bigint,rejects:bigint>>")
        empty_q = F.array().cast("array<struct<dstport:int,flows:bigint>>")
        cols += [F.when(ok, F.coalesce(F.col("top_peers"), empty_p)).alias("top_peers"),
                 F.when(ok, F.coalesce(F.col("top_ports"), empty_q)).alias("top_ports")]
    return out.select(*cols)


def scope_struct(df: DataFrame) -> Column:
    """R2: the question as asked plus the window actually used."""
    return F.struct(*[F.col(c) for c in ("focus_ip", "direction", "dstport", "protocol", "action",
                                          "window_start", "window_end", "window_minutes")]).alias("scope")


def batch_flow_verdicts(flows: DataFrame, requests: DataFrame, nested: bool = True,
                        legacy_group_limit: int | None = None, canonical: bool = False) -> DataFrame:
    """J1 + A8 for a whole table of questions; invalid ones keep their error row.

    ``canonical=True`` compares canonical address text (D11); use it with flows
    written by ``write_flows_table(..., canonical_addresses=True)``.
    """
    # Validated questions feed the join side and the final join: write them
    # once (small next to the flows); the status filter then reaches the scan.
    vreq = write_and_read(validate_requests(requests, canonical=canonical), "validated-questions")
    valid = vreq.filter(F.col("status") == "OK")
    if not nested and legacy_group_limit is None:
        return findings(vreq, None, nested=False, tally=timeindex.totals(flows, valid))
    return findings(vreq, match_flows(flows, valid), nested=nested, legacy_group_limit=legacy_group_limit)


# ---------------------------------------------------------------- one question

def scope_frame(spark: SparkSession, request_id: int = 0, ip=None, direction="to", port=None,
                protocol=None, action="ALL", window_minutes=None, start_time=None,
                end_time=None, as_of_epoch=None) -> DataFrame:
    """One question as a one-row table. ``as_of_epoch`` defaults to the caller's clock,
    taken once here and passed as a value (never read inside a query)."""
    from flowlens.schemas import REQUEST_SCHEMA
    if as_of_epoch is None:
        as_of_epoch = int(time.time())
    row = (request_id, ip, direction, port, protocol, action, window_minutes,
           None if start_time is None else str(start_time),
           None if end_time is None else str(end_time), as_of_epoch)
    return spark.createDataFrame([row], REQUEST_SCHEMA)


def scoped_flows(flows: DataFrame, v) -> DataFrame:
    """Flows of one validated question, with literal predicates (pushdown)."""
    d0 = dt.datetime.fromtimestamp(v["lo"], dt.timezone.utc).date()
    d1 = dt.datetime.fromtimestamp(v["hi"], dt.timezone.utc).date()
    days = [(d0 + dt.timedelta(days=i)).strftime("%Y/%m/%d") for i in range((d1 - d0).days + 1)]
    pred = P.scope_predicate(days=days, lo=v["lo"], hi=v["hi"], ip=v["ip"], direction=v["direction"],
                             port=v["port"], protocol=v["protocol"], action=v["action"])
    return flows.filter(pred)


def flow_verdict(spark: SparkSession, flows: DataFrame, nested: bool = True,
                 legacy_group_limit: int | None = None, **scope) -> DataFrame:
    """A8 for one question given as keyword arguments (as the reference tool takes them).

    The question is validated by the same column logic as the batch form; its
    resolved window and values then become literal filters on the flow scan.
    """
    vreq = validate_requests(scope_frame(spark, **scope))
    v = vreq.first()
    if v["status"] != "OK":
        empty = flows.limit(0).select(F.lit(None).cast("bigint").alias("request_id"),
                                      F.col("srcaddr").alias("peer"), "dstport", "action",
                                      F.col("bytes"), F.col("start"), F.col("end"))
        return findings(vreq, empty, nested=nested)
    matched = scoped_flows(flows, v).select(
        F.lit(v["request_id"]).cast("bigint").alias("request_id"),
        P.peer_column(v["direction"]).alias("peer"), "dstport", "action", "bytes", "start", "end")
    # An address pins the scan to a few row groups of a day (literal filters on a
    # table sorted by address and time): recomputing it beats writing the rollup.
    return findings(vreq, matched, nested=nested, legacy_group_limit=legacy_group_limit,
                    share=v["ip"] is None)
