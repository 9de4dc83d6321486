"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import stage


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, least node) of the links a-b among nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); nodes have one root if and only if they are connected.

    Each round every node joins the neighbour (or itself) that comes first in an order: by value in the first
    round, which folds stars at once, by a hash that changes with the round after that, so that a chain loses
    about a third of its nodes in each round whatever its numbering. Rounds are written tables; nothing is collected.
    """
    left = stage(links.where(F.col("a") != F.col("b")).select("a", "b"), "links")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        r = len(maps)

        def order(c, r=r):
            return F.col(c) if r == 0 else F.xxhash64(F.col(c), F.lit(r))

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("m"))
        step = stage(first.select(F.col("a").alias("node"),
                                  F.least("m", F.struct(order("a").alias("o"), F.col("a").alias("v")))["v"].alias("root")), "roots")
        maps.append(step)
        ends = left
        for c in ("a", "b"):
            ends = ends.join(step.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c)
        left = stage(ends.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop()
    while maps:
        up = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = maps.pop().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
