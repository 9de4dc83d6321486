"""Unions of intervals per key (sessions, incidents' islands) that stay parallel when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialise


def islands(df: DataFrame, key: list[str], lo: str, hi: str, gap: int = 0, sums: tuple[str, ...] = (), chunk_s: int = 3600) -> DataFrame:
    """Maximal runs of intervals of one key in which each begins at most ``gap`` after the latest end before it.

    Output: key..., ``lo`` and ``hi`` of the run, and the sums of ``sums`` (counts per interval). Intervals are first reduced to one row per
    (key, begin), then joined inside chunks of begin time; the runs of the chunks, at most chunk_s / (gap + 1) a chunk, are joined
    over the chunks' borders. So no window sees more rows than there are seconds in a chunk, or runs of a key.
    """
    adds = [F.sum(c).alias(c) for c in sums]
    rows = df.groupBy(*key, lo).agg(F.max(hi).alias(hi), *adds).withColumn("_chunk", F.floor(F.col(lo) / chunk_s))
    for level, extra in (("chunk", ["_chunk"]), ("all", [])):
        w = Window.partitionBy(*key, *extra).orderBy(lo)
        before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(F.col(lo) <= before + gap, 0).otherwise(1))
        rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        rows = rows.groupBy(*key, *extra, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), *adds).drop("_run")
        if level == "chunk":
            rows = materialise(rows, "chunk-runs")
    return rows


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b: strings) is connected with.

    Each round joins every node with the least root among its neighbours and itself, then shortens: roots of roots. Rounds are written
    tables; nothing is collected. The rounds grow with the logarithm of a chain's length.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = (both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        low = roots.join(near, "node").select("node", F.least("root", "near").alias("low"), "root")
        # a root hears of the least root seen by any of its nodes, so whole trees join at once
        told = low.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        step = low.join(told, "node", "left").select("node", F.least("low", F.coalesce("told", "low")).alias("root"), F.col("root").alias("old"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = materialise(step.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), "old"), "roots")
        if step.filter("root <> old").isEmpty():
            return step.select("node", "root")
        roots = step.select("node", "root")
