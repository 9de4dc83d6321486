"""J1 without pairs for lists, splits and arrivals: questions and flows of one key meet in blocks of time.

A question lies in the block of ``BLOCK_S`` seconds where its window begins; a flow goes to every block whose questions may reach
it (two, as windows end at 180 minutes). Both sides are dealt by (class, key, block), the join classes of ``flows.match_flows``. Inside
a block the flows of each scope (direction, port, protocol, action) are sorted by group and second once; a window is then two
look-ups per group, and every tally is a difference of running sums or a maximum over a range: the work grows with flows, questions
and groups of the answers, not with pairs of question and flow. A block holds the flows of one key and two blocks of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators.temporal import broadcast_if_small
from flowlens.session import materialise

BLOCK_S = 10_800
PART_QUESTIONS = 10_000
MAX_BROADCAST_CELLS = 1_000_000
STEP = 500_000  # look-ups at a time
# Join key of each class on the flow side and on the question side.
CLASS_KEY = {"D": ("dstaddr", "ip"), "S": ("srcaddr", "ip"), "P": ("dstport", "port"), "R": ("protocol", "protocol")}
CELL = ["cls", "key", "block"]


def parts(n_questions: int, spark) -> int:
    """Partitions for this many questions and what they find."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_questions // PART_QUESTIONS))


def in_blocks(flows: DataFrame, valid: DataFrame, answer: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
              columns: list[str]) -> DataFrame:
    """``answer(questions, flows)`` of every block; of the flows only ``columns`` and the scope's own are sent."""
    spark = flows.sparkSession
    cls = (F.when(F.col("ip").isNotNull() & (F.col("direction") == "to"), "D").when(F.col("ip").isNotNull(), "S")
            .when(F.col("port").isNotNull(), "P").otherwise("R"))
    key = reduce(lambda acc, c: acc.when(F.col("cls") == c, F.col(CLASS_KEY[c][1]).cast("string")), "DSP", F).otherwise(F.col("protocol").cast("string"))
    q = valid.filter("lo <= hi").select(*[c for c in valid.columns if c in ("request_id", "copies")], "ip", "direction", "port", "protocol", "action",
                                        "lo", "hi", cls.alias("cls")).withColumn("key", key).filter(F.col("key").isNotNull())
    q = materialise(q.withColumn("block", F.floor(F.col("lo") / BLOCK_S)).drop("ip"), "block-questions")
    stats = q.groupBy("cls").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                 F.max(F.col("hi") - F.col("lo")).alias("span")).collect()  # four rows at most
    if not stats:
        return spark.createDataFrame([], schema)
    lo, hi, span = min(r["lo"] for r in stats), max(r["hi"] for r in stats), max(r["span"] for r in stats)
    n = parts(sum(r["n"] for r in stats), spark)
    keys = F.array(*[F.struct(F.lit(r["cls"]).alias("cls"), F.col(CLASS_KEY[r["cls"]][0]).cast("string").alias("key")) for r in stats])
    start = F.col("start")
    f = flows.filter(start.between(lo, hi) & F.col("day").between(C.day_of(F.lit(lo)), C.day_of(F.lit(hi))) & (F.col("day") == C.day_of(start)))
    sent = list(dict.fromkeys(["start", "dstport", "protocol", "action", *columns]))
    f = f.select(*sent, F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("k")).select(
        *sent, "k.*", F.explode(F.sequence(F.floor((start - span) / BLOCK_S), F.floor(start / BLOCK_S))).alias("block"))
    f = f.join(broadcast_if_small(q.select(*CELL).distinct(), MAX_BROADCAST_CELLS), CELL, "left_semi")
    return q.repartition(n, *CELL).groupBy(*CELL).cogroup(f.repartition(n, *CELL).groupBy(*CELL)).applyInArrow(
        lambda questions, found: answer(questions, found) if questions.num_rows and found.num_rows else empty(schema), schema)


# ---------------------------------------------------------------- arrays of one block


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def empty(schema: str) -> pa.Table:
    return pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in schema.split(", "))]).empty_table()


def together(chunks: list[dict], schema: str) -> pa.Table:
    """The rows of all chunks."""
    want = empty(schema).schema
    return pa.concat_tables([want.empty_table(), *[pa.table({n: pa.array(c[n]) for n in want.names}).cast(want) for c in chunks]])


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(number of each row's value, the values); null is a value."""
    d = column.combine_chunks().dictionary_encode()
    values = d.dictionary
    return d.indices.fill_null(len(values)).to_numpy(zero_copy_only=False).astype(np.int64), pa.concat_arrays([values, pa.nulls(1, values.type)])


def numbers(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy()


def scopes(q: pa.Table, f: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(direction, questions, flows) of each scope asked in the block that has flows."""
    asked: dict[tuple, list[int]] = {}
    for i, scope in enumerate(zip(*(q.column(c).to_pylist() for c in ("direction", "port", "protocol", "action")))):
        asked.setdefault(scope, []).append(i)
    for (direction, port, protocol, action), rows in asked.items():
        keep = np.ones(f.num_rows, bool)
        for c, v in (("dstport", port), ("protocol", protocol), ("action", None if action == "ALL" else action)):
            if v is not None:
                keep &= pc.fill_null(pc.equal(f.column(c), pa.scalar(v, f.schema.field(c).type)), False).to_numpy()
        if keep.any():
            yield direction, np.array(rows), np.flatnonzero(keep)


def ranges(group: np.ndarray, n_groups: int, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) for each question and group: places in rows sorted by (group, start) that lie in [lo, hi]."""
    base, width = int(start.min()), int(start.max() - start.min()) + 2
    place = group * width + (start - base)
    g = np.arange(n_groups) * width
    return (np.searchsorted(place, g + np.clip(lo - base, 0, width - 1)[:, None], "left"),
            np.searchsorted(place, g + np.clip(hi - base, -1, width - 2)[:, None], "right"))


def range_max(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximum of values[first:end], each with a row at least, from maxima over 1, 2, 4, ... rows."""
    out = np.empty(len(first), np.int64)
    level = np.frexp(end - first)[1] - 1  # the longest power of two inside
    k = 0
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(values[first[at]], values[end[at] - (1 << k)])
        k += 1
        if not len(level) or k > level.max():
            return out
        half = 1 << (k - 1)
        values = np.maximum(values[:-half], values[half:])


def steps(rows: np.ndarray, n_groups: int) -> Iterator[np.ndarray]:
    size = max(1, STEP // n_groups)
    return (rows[i:i + size] for i in range(0, len(rows), size))


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


# ---------------------------------------------------------------- A1


GROUPS = "request_id long, peer string, dstport int, action string, cnt long, bytes long, start long, last_start long, end long"
NO_END = -(1 << 62)


def block_groups(q: pa.Table, f: pa.Table) -> pa.Table:
    """Tallies per question and (peer, dstport, action, protocol asked or not) of its flows."""
    lo, hi = numbers(q.column("lo")), numbers(q.column("hi"))
    start, byte, end = numbers(f.column("start")), numbers(f.column("bytes")), numbers(f.column("end"), NO_END)
    has_bytes = f.column("bytes").is_valid().to_numpy().astype(np.int64)
    peers = {"to": codes(f.column("srcaddr")), "from": codes(f.column("dstaddr"))}
    (port, ports), (action, actions) = codes(f.column("dstport")), codes(f.column("action"))
    out = []
    for direction, asking, at in scopes(q, f):
        peer, names = peers["to" if direction == "to" else "from"]
        group, number = np.unique((peer[at] * len(ports) + port[at]) * len(actions) + action[at], return_inverse=True)
        order = np.lexsort((start[at], number))
        at, number = at[order], number[order]
        s, e, total, known = start[at], end[at], running(byte[at]), running(has_bytes[at])
        for rows in steps(asking, len(group)):
            first, last = ranges(number, len(group), s, lo[rows], hi[rows])
            i, g = np.nonzero(last > first)
            a, b = first[i, g], last[i, g]
            latest, found = range_max(e, a, b), group[g]
            out.append({"request_id": q.column("request_id").take(pa.array(rows[i])).combine_chunks(), "peer": names.take(pa.array(found // (len(ports) * len(actions)))),
                        "dstport": ports.take(pa.array(found // len(actions) % len(ports))), "action": actions.take(pa.array(found % len(actions))),
                        "cnt": b - a, "bytes": pa.array(total[b] - total[a], mask=known[b] == known[a]), "start": s[a], "last_start": s[b - 1],
                        "end": pa.array(latest, mask=latest == NO_END)})
    return together(out, GROUPS)


def match_groups(flows: DataFrame, valid: DataFrame) -> DataFrame:
    """J1 for A1: what ``flows.match_flows`` finds, tallied per question, peer, port and action; rows of a question lie together."""
    n = parts(valid.count(), flows.sparkSession)
    return in_blocks(flows, valid, block_groups, GROUPS, ["srcaddr", "dstaddr", "bytes", "end"]).repartition(n, "request_id")


# ---------------------------------------------------------------- A6, why


CAUSES = "request_id long, accepts long, rejects long, port_wrong long, peer_wrong long, time_wrong long, split_second long, turn string"


def block_causes(q: pa.Table, f: pa.Table) -> pa.Table:
    """Per question with both actions: wrong records of its ports, its peers and its best split (``changepoint``)."""
    f = f.filter(pc.is_in(f.column("action"), pa.array(["ACCEPT", "REJECT"])))
    lo, hi, copies = (numbers(q.column(c)) for c in ("lo", "hi", "copies"))
    start, bad = numbers(f.column("start")), pc.equal(f.column("action"), "REJECT").to_numpy().astype(np.int64)
    peers, port = {"to": codes(f.column("srcaddr"))[0], "from": codes(f.column("dstaddr"))[0]}, codes(f.column("dstport"))[0]
    out = []
    for direction, asking, at in scopes(q, f):
        wrong = {}
        for by, value in (("port_wrong", port), ("peer_wrong", peers["to" if direction == "to" else "from"])):
            group, number = np.unique(value[at], return_inverse=True)
            order = np.lexsort((start[at], number))
            s, rej = start[at][order], running(bad[at][order])
            found = []
            for rows in steps(asking, len(group)):
                first, end = ranges(number[order], len(group), s, lo[rows], hi[rows])
                r = rej[end] - rej[first]
                found.append(np.minimum(r, end - first - r).sum(axis=1))
            wrong[by] = np.concatenate(found)
        second, place = np.unique(start[at], return_inverse=True)
        r = running(np.bincount(place, bad[at]).astype(np.int64))
        a = running(np.bincount(place)) - r
        first, end = np.searchsorted(second, lo[asking], "left"), np.searchsorted(second, hi[asking], "right")
        both = (a[end] > a[first]) & (r[end] > r[first])
        first, end, rows = first[both], end[both], asking[both]
        accepts, rejects = a[end] - a[first], r[end] - r[first]
        time_wrong, split, turn = np.minimum(accepts, rejects), np.full(len(rows), -1), np.full(len(rows), -1)
        some = np.flatnonzero(end - first > 1)  # a split lies before any second but the first
        i, j, n = first[some], end[some], len(second)
        rising = (r - a)[:n] * n + np.arange(n)  # records rejected less those accepted before a second, then the second
        falling = (a - r)[:n] * n + np.arange(n)
        blocked, opened = -range_max(-rising, i + 1, j), -range_max(-falling, i + 1, j)
        wrongs = np.stack([blocked // n - r[i] + a[j], opened // n - a[i] + r[j]])
        best = np.stack([wrongs[0], second[blocked % n], np.zeros(len(i), np.int64)]), np.stack([wrongs[1], second[opened % n], np.ones(len(i), np.int64)])
        less = (wrongs[1] < wrongs[0]) | (wrongs[1] == wrongs[0]) & (best[1][1] < best[0][1])
        time_wrong[some], split[some], turn[some] = np.where(less, best[1], best[0])
        k = copies[rows]
        out.append({"request_id": q.column("request_id").take(pa.array(rows)).combine_chunks(), "accepts": accepts * k, "rejects": rejects * k,
                    **{by: v[both] * k for by, v in wrong.items()}, "time_wrong": time_wrong * k, "split_second": pa.array(split, mask=turn < 0),
                    "turn": pa.array(["BLOCKED_FROM", "OPENED_FROM", None]).take(pa.array(np.where(turn < 0, 2, turn)))})
    return together(out, CAUSES)


def causes(flows: DataFrame, alone: DataFrame) -> DataFrame:
    """The evidence of ``changepoint.intermittent_cause`` for the questions of ``asked_once``: one row each."""
    return in_blocks(flows, alone, block_causes, CAUSES, ["srcaddr", "dstaddr"])


# ---------------------------------------------------------------- M7


ARRIVALS = "request_id long"


def block_arrivals(q: pa.Table, f: pa.Table) -> pa.Table:
    """Questions with a (srcaddr, dstaddr, dstport) whose flows of the window left and did not arrive."""
    f = f.filter(f.column("action").is_valid())
    lo, hi, start = numbers(q.column("lo")), numbers(q.column("hi")), numbers(f.column("start"))
    left, arrived = (pc.fill_null(pc.equal(f.column("flow_direction"), d), False).to_numpy() for d in ("egress", "ingress"))
    (src, _), (dst, dsts), (port, ports) = (codes(f.column(c)) for c in ("srcaddr", "dstaddr", "dstport"))
    out = []
    for _, asking, at in scopes(q, f):
        group, number = np.unique((src[at] * len(dsts) + dst[at]) * len(ports) + port[at], return_inverse=True)
        order = np.lexsort((start[at], number))
        at, number = at[order], number[order]
        sent, got = running(left[at].astype(np.int64)), running(arrived[at].astype(np.int64))
        for rows in steps(asking, len(group)):
            first, end = ranges(number, len(group), start[at], lo[rows], hi[rows])
            never = ((sent[end] > sent[first]) & (got[end] == got[first])).any(axis=1)
            out.append({"request_id": q.column("request_id").take(pa.array(rows[never])).combine_chunks()})
    return together(out, ARRIVALS)


def never_arrived(flows: DataFrame, alone: DataFrame) -> DataFrame:
    """Ids of the questions of ``asked_once`` that have such flows."""
    return in_blocks(flows, alone, block_arrivals, ARRIVALS, ["srcaddr", "dstaddr", "flow_direction"])


# ---------------------------------------------------------------- ids that come more than once


def asked_once(valid: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(questions whose id asks one thing, with the number of ``copies``; the other rows, or None).

    Rows with one id are one question; where they differ in scope or window their flows are counted together, and only pairs do that.
    """
    scope = ["request_id", "ip", "direction", "port", "protocol", "action", "lo", "hi"]
    q = materialise(valid.select(*scope).groupBy(*scope).agg(F.count(F.lit(1)).alias("copies")), "distinct-questions")
    many = q.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or request_id is null").select(F.col("request_id").alias("id"))
    many = materialise(many, "ids-of-many")
    if many.isEmpty():
        return q, None
    same = F.col("request_id").eqNullSafe(F.col("id"))
    others = q.join(many, same, "left_semi").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*scope)
    return q.join(many, same, "left_anti"), others
