"""Common failing segment of many paths (F10-F11): which links explain the traces that did not arrive.

A link joins two hops that answered one after the other (hops that time out in between are passed over); the last one leads to
the hop that answered last when the target was reached. The known paths to a host are those of its complete traces, at any time. A
trace that did not arrive is suspected of every link that comes after its last answering hop on a known path to its host (or of the first
link when nothing answered), except links that some trace of the same window proved by answering beyond them.

The suspects are reduced to few links by greedy set cover, window by window: the link that explains most unexplained traces, then the
next. A round takes all links at once that are the best choice of every trace they explain; taking them one after
another would choose the same, so the rounds are few although the links may be many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import probes as PB
from flowlens.session import materialise

WINDOW_S = 3600


def traces(probes: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(probe_id, host, window, arrived, ips): the answering hops of each trace in order; ``ips`` begins with the prober itself (``start``)."""
    t = PB.parse_trace(probes.filter(F.col("tool") == "traceroute_host"))
    ips = F.concat(F.array(F.lit("start")), F.transform(F.filter("hops", lambda h: ~h["timed_out"]), lambda h: h["ip"]))
    return t.select("probe_id", "host", (F.floor(F.col("probed_at") / window_s) * window_s).alias("window"),
                    (F.col("verdict") == "REACHED").alias("arrived"), ips.alias("ips"))


def _links(rows: DataFrame) -> DataFrame:
    """Every link of ``ips``, with ``from`` and ``to``."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ips") - 1), lambda k: F.struct(F.get("ips", k - 1).alias("from"), F.get("ips", k).alias("to")))
    return rows.filter(F.size("ips") > 1).select("*", F.explode(pairs).alias("l")).select(*rows.columns, "l.from", "l.to")


def suspects(probes: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(window, probe_id, from, to): the links that each failed trace may have failed on, written."""
    t = materialise(traces(probes, window_s), "traces")
    proven = _links(t.select("window", "ips")).select("window", "from", "to").distinct()
    known = t.filter("arrived").select("host", F.col("ips").alias("known")).distinct()
    failed = t.filter(~F.col("arrived")).select("window", "probe_id", "host", F.element_at("ips", -1).alias("last"))
    # the rest of the known path behind the last answer; a path that does not hold that hop says nothing
    rest = failed.join(known, "host").select(
        "window", "probe_id", F.slice("known", F.array_position("known", F.col("last")).cast("int"), F.size("known")).alias("ips"),
        F.array_contains("known", F.col("last")).alias("holds")).filter("holds").drop("holds")
    return materialise(_links(rest).select("window", "probe_id", "from", "to").distinct().join(proven, ["window", "from", "to"], "left_anti"), "suspects")


def greedy_cover(suspected: DataFrame) -> DataFrame:
    """(window, from, to, explains, round): the links chosen, with the traces that each newly explains.

    Of links that explain equally many, the first in order of (from, to) is taken.
    """
    left, chosen, n = suspected, None, 0
    link = ["window", "from", "to"]
    while not left.isEmpty():
        n += 1
        counts = left.groupBy(*link).agg(F.count(F.lit(1)).alias("explains"))
        rated = left.join(counts, link)
        # least by (fewer is worse, name): the best choice of each trace
        rank = F.struct(F.negative("explains").alias("c"), "from", "to")
        best = rated.groupBy("window", "probe_id").agg(F.min(rank).alias("b")).select("window", "probe_id", F.col("b.from").alias("from"), F.col("b.to").alias("to"))
        agreed = best.groupBy(*link).agg(F.count(F.lit(1)).alias("votes")).join(counts, link).filter("votes = explains")
        picked = materialise(agreed.select(*link, "explains", F.lit(n).alias("round")), "cover-links")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        done = left.join(picked.select(*link), link, "left_semi").select("window", "probe_id")
        left = materialise(left.join(done, ["window", "probe_id"], "left_anti"), "cover-left")
    return suspected.select(*link, F.lit(0).cast("bigint").alias("explains"), F.lit(0).alias("round")).limit(0) if chosen is None else chosen


def failing_segment(probes: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(window, from, to, explains, round) of the links that explain the failed traces of each window."""
    return greedy_cover(suspects(probes, window_s))
