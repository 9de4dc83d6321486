"""V1-V9: validate and normalise a whole table of questions in one pass.

The reference checks one question per call; here each check is a column and the
first failing one (fixed order: ip, port, protocol, focus guard, start_time,
end_time, start > end) becomes ``detail``. Invalid rows are kept with
``status = 'TOOL_ERROR'`` so a batch never fails on one bad question; times are bounded
(1970 to 9999) before any window arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import columns as C


def normalise_direction(c: Column) -> Column:
    """V5: anything but to/from becomes to."""
    return F.when(c.isin(*K.DIRECTIONS), c).otherwise(F.lit("to"))


def normalise_action(c: Column) -> Column:
    """V5: case-sensitive; anything but ACCEPT/REJECT/ALL becomes ALL."""
    return F.when(c.isin(*K.ACTIONS), c).otherwise(F.lit("ALL"))


def normalise_window(c: Column, max_minutes: int = K.MAX_WINDOW_MIN) -> Column:
    """V7 look-back minutes: NULL or under 1 -> 60, capped at ``max_minutes``."""
    w = F.when(c.isNull() | (c < 1), F.lit(K.DEFAULT_WINDOW_MIN)).otherwise(c)
    return F.least(w, F.lit(max_minutes))


def normalise_max_hops(c: Column) -> Column:
    """V9: max_hops outside 1..30 (or NULL) -> 8."""
    lo, hi = K.MAX_HOPS_RANGE
    return F.when(c.between(lo, hi), c).otherwise(F.lit(K.DEFAULT_MAX_HOPS))


def validate_requests(requests: DataFrame, canonical: bool = False,
                      max_minutes: int = K.MAX_WINDOW_MIN) -> DataFrame:
    """V1: status, detail, normalised fields and the resolved window [lo, hi].

    Output columns: request_id, status, detail, ip, direction, port, protocol
    (IANA number), action, as_of_epoch, start_epoch, end_epoch, explicit, lo, hi,
    was_clipped, window_minutes (echo, half-to-even of (hi-lo)/60).

    Built as staged projections so each parsed value is computed once (Catalyst
    does not inline a non-trivial expression that is referenced twice).

    ``max_minutes`` is the longest window; a longer one, explicit or look-back, keeps its
    end, is cut at its start and sets ``was_clipped``. An ``as_of_epoch`` outside 1970 to
    9999 counts as missing. An optional ``port_text`` column holds the port as it was
    written: text that did not become a port is refused, never read as "any port".

    ``canonical=True`` rewrites a valid ip to its canonical text (D11), to match
    flows written with canonical addresses.
    """
    col = F.col
    port_text = col("port_text") if "port_text" in requests.columns else col("port").cast("string")
    s0 = requests.select("*", port_text.alias("_port_text"),
                         C.unbounded_epoch(col("start_time")).alias("_start"),
                         C.unbounded_epoch(col("end_time")).alias("_end"))
    s1 = s0.select(
        "request_id",
        F.when(col("ip") != "", col("ip")).alias("ip"),
        col("direction").alias("direction_raw"), "port", col("_port_text").alias("port_text"),
        col("protocol").alias("protocol_raw"),
        C.protocol_number(col("protocol")).alias("protocol"),
        col("action").alias("action_raw"), "window_minutes", "start_time", "end_time",
        C.bounded_epoch(col("as_of_epoch")).alias("as_of_epoch"),
        C.bounded_epoch(col("_start")).alias("start_epoch"),
        C.bounded_epoch(col("_end")).alias("end_epoch"))
    s2 = s1.select(
        "*",
        (col("start_epoch").isNotNull() | col("end_epoch").isNotNull()).alias("explicit"),
        F.coalesce(col("end_epoch"), col("as_of_epoch")).alias("hi0"),
        F.coalesce(col("start_epoch"), F.coalesce(col("end_epoch"), col("as_of_epoch"))
                   - K.DEFAULT_EXPLICIT_SPAN_S).alias("lo0"),
        normalise_window(col("window_minutes"), max_minutes).alias("w"),
        F.coalesce(col("window_minutes") > max_minutes, F.lit(False)).alias("w_cut"),
        (col("ip").isNotNull() & ~C.is_ip(col("ip"))).alias("ip_bad"))
    clipped = ((col("hi0") + K.PAD_S) - (col("lo0") - K.PAD_S)) > max_minutes * 60
    detail = F.coalesce(
        F.when(col("ip_bad"), C.fault("ip NOT_LITERAL", col("ip"))),
        F.when(col("port_text").isNotNull() & ~C.is_port(col("port")),
               C.fault("port OUT_OF_RANGE", col("port_text"))),
        F.when(col("protocol_raw").isNotNull() & col("protocol").isNull(),
               C.fault("protocol UNKNOWN", col("protocol_raw"))),
        F.when(col("ip").isNull() & col("port_text").isNull() & col("protocol_raw").isNull(),
               F.lit("scope EMPTY")),
        F.when(col("start_time").isNotNull() & col("start_epoch").isNull(),
               C.fault("start_time UNREADABLE", col("start_time"))),
        F.when(col("end_time").isNotNull() & col("end_epoch").isNull(),
               C.fault("end_time UNREADABLE", col("end_time"))),
        F.when(col("explicit") & (col("lo0") > col("hi0")), F.lit("start_time AFTER_END")),
        F.when(col("as_of_epoch").isNull() & (~col("explicit") | col("end_epoch").isNull()),
               F.lit("as_of_epoch MISSING")),
    )
    s3 = s2.select("*", detail.alias("detail"), clipped.alias("clipped"))
    x_hi = col("hi0") + K.PAD_S
    x_lo = F.when(col("clipped"), x_hi - max_minutes * 60).otherwise(col("lo0") - K.PAD_S)
    s4 = s3.select(
        "request_id",
        F.when(col("detail").isNull(), F.lit("OK")).otherwise(F.lit("TOOL_ERROR")).alias("status"),
        "detail", "ip",
        normalise_direction(col("direction_raw")).alias("direction"),
        "port", "protocol",
        normalise_action(col("action_raw")).alias("action"),
        "as_of_epoch", "start_epoch", "end_epoch", "explicit",
        F.when(col("explicit"), x_lo).otherwise(col("as_of_epoch") - col("w") * 60).alias("lo"),
        F.when(col("explicit"), x_hi).otherwise(col("as_of_epoch")).alias("hi"),
        F.when(col("explicit"), col("clipped")).otherwise(col("w_cut")).alias("was_clipped"))
    out = s4.withColumn(
        "window_minutes", F.bround((col("hi") - col("lo")).cast("double") / 60, 0).cast("int"))
    if canonical:
        out = out.withColumn("ip", F.when(col("status") == "OK", C.canonical_ip(col("ip"))).otherwise(col("ip")))
    return out


def valid_requests(requests: DataFrame) -> DataFrame:
    """Only the questions that passed V1."""
    return validate_requests(requests).filter(F.col("status") == "OK")


def window_days(v: DataFrame) -> DataFrame:
    """V8 flattened: one row per (request_id, day) covering [lo, hi]."""
    return v.select("request_id", F.explode(C.days_between(F.col("lo"), F.col("hi"))).alias("day"))
