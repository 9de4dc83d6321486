"""Incidents: reject episodes (M8) that overlap in time and share an address or a port, joined to connected groups.

Two episodes of one address (or one port) are linked when their times touch. The links are never made pair by pair: the episodes of an
address are joined to runs without a gap (``intervals.islands``), likewise those of a port, and an episode ties its address's run to its
port's run. Groups are the connected components of the runs, so a run of n episodes costs n links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.intervals import components, islands
from flowlens.session import materialise


def _run_of(episodes: DataFrame, by: str, chunk_s: int) -> DataFrame:
    """Each episode's run among those of the same ``by``: the name ``by|value|begin of the run``."""
    runs = islands(episodes.withColumn("n", F.lit(1)), [by], "started", "stopped", 0, ("n",), chunk_s).select(
        by, F.col("started").alias("begin"))
    # the run that holds an episode is the latest one to begin at or before it: carried forward in time order
    rows = episodes.select(by, F.col("started").alias("t"), F.lit(1).alias("kind"), "id", F.lit(None).cast("bigint").alias("begin")).unionByName(
        runs.select(by, F.col("begin").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "begin"))
    w = Window.partitionBy(by, "chunk").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = materialise(rows.withColumn("chunk", F.floor(F.col("t") / chunk_s)), "run-rows")
    last = rows.filter("kind = 0").groupBy(by, "chunk").agg(F.max("begin").alias("last"))
    chunks = rows.select(by, "chunk").distinct().join(last, [by, "chunk"], "left")
    carried = chunks.withColumn("carry", F.max("last").over(Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    inside = rows.withColumn("own", F.max("begin").over(w)).filter("kind = 1").join(carried, [by, "chunk"])
    return inside.select("id", F.concat_ws("|", F.lit(by), F.col(by).cast("string"), F.coalesce("own", "carry").cast("string")).alias(by + "_run"))


def incidents(episodes: DataFrame, standing_s: int, chunk_s: int = 3600) -> DataFrame:
    """(first_episode, started, stopped, episodes, addresses, ports, rejects, standing) of reject ``episodes``
    (dstaddr, dstport, episode, started, stopped, n_flows).

    An episode longer than ``standing_s`` is a standing rule: it would tie everything it outlasts together, so it is an incident of its own.
    """
    name = F.concat_ws("|", F.col("dstaddr"), F.col("dstport").cast("string"), F.col("episode").cast("string"))
    e = materialise(episodes.withColumn("id", name).withColumn("standing", F.col("stopped") - F.col("started") > standing_s), "episodes")
    brief = e.filter("not standing")
    tied = materialise(_run_of(brief, "dstaddr", chunk_s).join(_run_of(brief, "dstport", chunk_s), "id"), "episode-runs")
    roots = components(tied.select(F.col("dstaddr_run").alias("a"), F.col("dstport_run").alias("b")).distinct())
    named = tied.join(roots, tied["dstaddr_run"] == roots["node"]).select("id", "root")
    return e.join(named, "id", "left").groupBy(F.coalesce("root", "id").alias("root"), "standing").agg(
        F.min("id").alias("first_episode"), F.min("started").alias("started"), F.max("stopped").alias("stopped"),
        F.count(F.lit(1)).alias("episodes"), F.count_distinct("dstaddr").alias("addresses"), F.count_distinct("dstport").alias("ports"),
        F.sum("n_flows").cast("bigint").alias("rejects")).drop("root")
