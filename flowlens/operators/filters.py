"""Flow predicates and the peer projection.

Two forms of each predicate: with literal values (one question; the filter
reaches the Parquet scan as PushedFilters / PartitionFilters) and with request
columns (a table of questions; used as join conditions in J1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions import columns as C


def day_in(days) -> Column:
    """Day-partition prune."""
    return F.col("day").isin(list(days))


def in_window(lo, hi, start: Column | None = None) -> Column:
    """Both ends inclusive, on ``start`` only."""
    s = F.col("start") if start is None else start
    return s.between(lo, hi)


def peer_column(direction) -> Column:
    """The other endpoint (to -> srcaddr, from -> dstaddr)."""
    d = direction if isinstance(direction, Column) else F.lit(direction)
    return F.when(d == "to", F.col("srcaddr")).otherwise(F.col("dstaddr"))


def focus(ip: str, direction: str) -> Column:
    """P3 with literals: picks the column statically so it pushes down."""
    return F.col("dstaddr" if direction == "to" else "srcaddr") == F.lit(ip)


def port_eq(port: int) -> Column:
    """Always the destination port, whatever the direction."""
    return F.col("dstport") == F.lit(port)


def protocol_eq(name: str) -> Column:
    """P5: protocol name -> IANA number, then equality."""
    return F.col("protocol") == C.protocol_number(F.lit(name))


def action_eq(action: str) -> Column:
    """ALL means no filter."""
    return F.lit(True) if action == "ALL" else (F.col("action") == F.lit(action))


def scope_predicate(*, days=None, lo=None, hi=None, ip=None, direction="to", port=None,
                    protocol=None, action="ALL") -> Column:
    """Conjunction of the predicates that are present; absent ones drop out.

    ``protocol`` here is the IANA number (already normalised).
    """
    parts = []
    if days is not None:
        parts.append(day_in(days))
    if lo is not None and hi is not None:
        parts.append(in_window(lo, hi))
    if ip is not None:
        parts.append(focus(ip, direction))
    if port is not None:
        parts.append(port_eq(port))
    if protocol is not None:
        parts.append(F.col("protocol") == F.lit(int(protocol)))
    if action in ("ACCEPT", "REJECT"):
        parts.append(F.col("action") == F.lit(action))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def optional_eq(flow_col: Column, req_col: Column) -> Column:
    """Batch form of an optional predicate: NULL request value means no filter."""
    return req_col.isNull() | (flow_col == req_col)
