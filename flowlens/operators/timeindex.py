"""Running tallies of flows, so that a question is a few look-ups and never meets a flow.

A *scope* is what a question asks for apart from its window: address and side, port, protocol, action. Flows are reduced to
one row per asked scope and second. Time is cut into blocks of ``BLOCKS`` seconds, each nested in the next longer
one; a window takes the longest block length at which both its ends lie in different blocks, so that it is the rest of one
block, whole blocks, and the beginning of another. Inside each (scope, block) running tallies from the block's begin and
from its end are taken at the asked seconds only, once per second however many questions ask it. All tallies (counts, first
and last reject, latest end) add up over the pieces of a window; nothing has to be subtracted, so a maximum is as exact as a sum.

Sizes: a question has at most four pieces at the limit of 180 minutes; a (scope, block) partition has at most one row per second and
end of window. The rows grow with flows plus questions, not with their pairs, and a scope that holds a third of all flows
is reduced by partial aggregation to one row per second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators.temporal import broadcast_if_small
from flowlens.session import materialise

BLOCKS = (3600, 1200, 240, 60, 20, 4, 1)
MAX_BROADCAST_SCOPES = 1_000_000
TOTALS = ("request_id bigint, flows bigint, accepts bigint, rejects bigint, first_reject_epoch bigint, last_reject_epoch bigint, "
          "last_reject_end_epoch bigint")
NONE = "-"


def _question_kind() -> Column:
    """Which parts of a scope a question fixes: side of its address, port, protocol, action."""
    return F.concat_ws("+", F.when(F.col("ip").isNotNull(), F.col("direction")).otherwise("any"),
                       F.when(F.col("port").isNotNull(), "port"), F.when(F.col("protocol").isNotNull(), "protocol"), F.col("action"))


def question_scopes(valid: DataFrame) -> DataFrame:
    """(request_id, kind, scope, lo, hi) of valid questions."""
    kind = _question_kind()
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in ("ip", "port", "protocol")]
    return valid.select("request_id", kind.alias("kind"), F.concat_ws("|", kind, *parts).alias("scope"), "lo", "hi")


def _flow_scope(kind: str) -> Column:
    """The scope of this kind that a flow belongs to; NULL when it lacks a part or has another action."""
    side, *rest = kind.split("+")
    addr = {"to": F.col("dstaddr"), "from": F.col("srcaddr"), "any": F.lit(NONE)}[side]
    port = F.col("dstport").cast("string") if "port" in rest else F.lit(NONE)
    protocol = F.col("protocol").cast("string") if "protocol" in rest else F.lit(NONE)
    scope = F.concat(F.lit(kind + "|"), addr, F.lit("|"), port, F.lit("|"), protocol)
    return scope if rest[-1] == "ALL" else F.when(F.col("action") == rest[-1], scope)


def pieces(scoped: DataFrame) -> DataFrame:
    """(request_id, scope, size, block, side, second): the parts of each window; side S runs to the block's end, P from its begin."""
    lo, hi = F.col("lo"), F.col("hi")
    size = F.lit(1)
    for s in reversed(BLOCKS):
        size = F.when(F.floor(lo / s) != F.floor(hi / s), F.lit(s)).otherwise(size)
    q = scoped.select("request_id", "scope", "lo", "hi", size.cast("bigint").alias("size"))
    first, last = F.floor(lo / F.col("size")), F.floor(hi / F.col("size"))

    def piece(side, block, second):
        return F.struct(F.lit(side).alias("side"), block.cast("bigint").alias("block"), second.cast("bigint").alias("second"))

    ends = F.when(first == last, F.array(piece("P", last, hi))).otherwise(F.array(piece("S", first, lo), piece("P", last, hi)))
    whole = F.when(last - first > 1, F.transform(F.sequence(first + 1, F.greatest(last - 1, first + 1)),
                                                 lambda b: piece("P", b, (b + 1) * F.col("size") - 1)))
    none = F.array().cast("array<struct<side:string,block:bigint,second:bigint>>")
    return q.select("request_id", "scope", "size", F.explode(F.concat(ends, F.coalesce(whole, none))).alias("p")).select(
        "request_id", "scope", "size", "p.block", "p.side", "p.second")


def seconds(flows: DataFrame, kinds: list[str], wanted: DataFrame, lo: int, hi: int) -> DataFrame:
    """(scope, second, n, acc, rej, rej_end): flows of the wanted scopes, one row per second."""
    f = flows.filter(F.col("start").between(lo, hi) & F.col("day").between(C.day_of(F.lit(lo)), C.day_of(F.lit(hi))))
    f = f.select("start", "end", "action", F.explode(F.array_compact(F.array(*[_flow_scope(k) for k in kinds]))).alias("scope"))
    asked = broadcast_if_small(wanted, MAX_BROADCAST_SCOPES)
    rej, acc = F.upper("action") == "REJECT", F.upper("action") == "ACCEPT"
    return f.join(asked, "scope", "left_semi").groupBy("scope", F.col("start").alias("second")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(acc, 1)).alias("acc"), F.count(F.when(rej, 1)).alias("rej"),
        F.max(F.when(rej, F.col("end"))).alias("rej_end"))


def running(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Tallies of each point (scope, size, block, side, second) over the cells from its block's begin (P) or to its end (S)."""
    key = ["scope", "size", "block"]
    empty = [F.lit(None).cast("bigint").alias(c) for c in ("n", "acc", "rej", "rej_end")]
    rows = cells.select(*key, "second", F.lit("C").alias("side"), "n", "acc", "rej", "rej_end").unionByName(
        points.select(*key, "second", "side", *empty))
    point = F.col("side") != "C"
    frames = {"P": Window.partitionBy(*key).orderBy(F.asc("second"), point), "S": Window.partitionBy(*key).orderBy(F.desc("second"), point)}
    rejected = F.when(F.col("rej") > 0, F.col("second"))
    tallies = {"flows": F.sum("n"), "accepts": F.sum("acc"), "rejects": F.sum("rej"), "first_reject_epoch": F.min(rejected),
               "last_reject_epoch": F.max(rejected), "last_reject_end_epoch": F.max("rej_end")}
    for side, w in frames.items():
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.select("*", F.struct(*[agg.over(w).alias(name) for name, agg in tallies.items()]).alias(side))
    return rows.filter(point).select(*key, "side", "second", F.when(F.col("side") == "P", F.col("P")).otherwise(F.col("S")).alias("t")).select(
        *key, "side", "second", "t.*").filter("flows > 0")


def totals(flows: DataFrame, valid: DataFrame) -> DataFrame:
    """A2 + A3 per valid question that has a flow (all flows count in ``flows``, whatever their action)."""
    q = materialise(question_scopes(valid), "question-scopes")
    kinds = q.groupBy("kind").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row per kind: 36 at most
    if not kinds:
        return flows.sparkSession.createDataFrame([], TOTALS)
    parts = materialise(pieces(q), "question-pieces")
    base = seconds(flows, sorted(r["kind"] for r in kinds), q.select("scope").distinct(), min(r["lo"] for r in kinds), max(r["hi"] for r in kinds))
    sizes = broadcast_if_small(parts.select("scope", "size").distinct(), MAX_BROADCAST_SCOPES)
    cells = base.join(sizes, "scope").withColumn("block", F.floor(F.col("second") / F.col("size")).cast("bigint"))
    key = ["scope", "size", "block", "side", "second"]
    found = running(cells, parts.select(*key).distinct())
    return parts.join(found, key).groupBy("request_id").agg(
        F.sum("flows").alias("flows"), F.sum("accepts").alias("accepts"), F.sum("rejects").alias("rejects"),
        F.min("first_reject_epoch").alias("first_reject_epoch"), F.max("last_reject_epoch").alias("last_reject_epoch"),
        F.max("last_reject_end_epoch").alias("last_reject_end_epoch"))
