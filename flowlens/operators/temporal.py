"""Time-ordered building blocks that stay parallel when one key is hot.

* ``asof_latest``: for each left row, the latest right row with the same keys
  at or before the left time (an as-of join without all-pairs expansion).
* ``episodes``: runs of equal values per key in time order (gaps and islands)
  computed per time chunk and stitched across chunk borders.

Both split every key by a time bucket, so a key that holds a third of all rows
is still spread over many tasks; the only per-key window runs over one small
summary row per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialise


def asof_latest(left: DataFrame, right: DataFrame, by: list[str], left_id: str, left_time: str,
                right_time: str, tie: str, payload: list[str], name: str = "match",
                bucket_s: int = 3600) -> DataFrame:
    """Left rows plus struct ``name`` = latest right row (by ``right_time``, then ``tie``)
    whose keys equal the left row's keys and whose time is <= the left time.

    ``left_id`` must be a unique key of ``left`` (row ids are never generated,
    so a recomputed partition cannot change them). ``right`` rows with NULL
    keys never match. Plan: (1) latest right row per
    (keys, bucket) by partial aggregation; (2) a running max over the small
    per-key bucket summary carries it into later buckets; (3) inside the left
    row's own bucket, a window over left+right rows of that bucket finds the
    latest right row at or before the left time; (4) the later of (2) and (3).
    """
    rfields = [right_time, tie] + [p for p in payload if p not in (right_time, tie)]
    rstruct = F.struct(*[F.col(c) for c in rfields])
    not_null = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    R = (right.filter(not_null)
              .select(*by, F.floor(F.col(right_time) / bucket_s).alias("_b"),
                      F.col(right_time).alias("_t"), rstruct.alias("_r")))
    # left rows without a key match nothing; they stay out of the windows, where they would be one hot key
    L = left.select("*", F.floor(F.col(left_time) / bucket_s).alias("_b"), F.col(left_id).alias("_lid"))
    rtype = R.schema["_r"].dataType

    # (1) + (2): carry-in from earlier buckets.
    last_in_bucket = R.groupBy(*by, "_b").agg(F.max("_r").alias("_r"))
    wanted = L.filter(not_null).select(*by, "_b").distinct().select(*by, "_b", F.lit(None).cast(rtype).alias("_r"))
    summary = last_in_bucket.unionByName(wanted).groupBy(*by, "_b").agg(F.max("_r").alias("_r"))
    wk = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*by, "_b", F.max("_r").over(wk).alias("_carry"))

    # (3): inside the bucket; right rows sort before left rows at equal time.
    lkeys = L.filter(not_null).select(*by, "_b", F.col(left_time).alias("_t"), F.lit(1).alias("_kind"), "_lid",
                     F.lit(None).cast(rtype).alias("_r"))
    rkeys = R.select(*by, "_b", "_t", F.lit(0).alias("_kind"), F.lit(None).cast(L.schema["_lid"].dataType).alias("_lid"), "_r")
    wb = (Window.partitionBy(*by, "_b").orderBy("_t", "_kind")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (lkeys.unionByName(rkeys).withColumn("_in", F.max("_r").over(wb))
                .filter(F.col("_kind") == 1).select("_lid", "_in"))

    out = (L.join(inb, "_lid", "left")
            .join(carry, [L[k] == carry[k] for k in by] + [L["_b"] == carry["_b"]], "left"))
    best = F.when(F.col("_in").isNotNull(), F.col("_in")).otherwise(F.col("_carry"))
    keep = [L[c] for c in left.columns]
    return out.select(*keep, best.alias(name))


def episodes(df: DataFrame, key: list[str], order: list[str], value: str, time: str,
             chunk_s: int = 3600) -> DataFrame:
    """Runs of equal ``value`` per ``key`` ordered by ``order`` (first item: ``time``).

    Output: key..., episode (1-based), value, started (min time), stopped (max
    time), n. A fixed-width ``value`` (boolean, number) keeps every aggregate
    hash-based. Chunking by ``time`` keeps each window partition small; a run that
    crosses a chunk border is merged back by the chunk summary.
    """
    cols = list(dict.fromkeys([*key, *order, value]))
    f = df.select(*cols, F.floor(F.col(time) / chunk_s).alias("_c"))
    w = Window.partitionBy(*key, "_c").orderBy(*order)
    prev = F.lag(value).over(w)
    f = f.withColumn("_new", F.when(prev.isNull() | (prev != F.col(value)), 1).otherwise(0))
    f = f.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Every row of a run has the same value, so max() picks it. The runs feed
    # both the chunk summary and the final join: write them once.
    runs = materialise(f.groupBy(*key, "_c", "_run").agg(
        F.max(value).alias(value), F.min(time).alias("started"), F.max(time).alias("stopped"),
        F.count(F.lit(1)).alias("n")), "episode-runs")
    cs = runs.groupBy(*key, "_c").agg(
        F.max("_run").alias("_runs"),
        F.min_by(value, "_run").alias("_first"),
        F.max_by(value, "_run").alias("_last"))
    wc = Window.partitionBy(*key).orderBy("_c")
    cs = cs.withColumn("_merge", F.coalesce((F.lag("_last").over(wc) == F.col("_first")).cast("int"), F.lit(0)))
    cs = cs.withColumn("_offset", F.coalesce(
        F.sum(F.col("_runs") - F.col("_merge")).over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = runs.join(cs.select(*key, "_c", "_merge", "_offset"), [*key, "_c"])
    j = j.withColumn("episode", (F.col("_offset") + F.col("_run") - F.col("_merge")).cast("bigint"))
    return j.groupBy(*key, "episode").agg(
        F.max(value).alias(value), F.min("started").alias("started"), F.max("stopped").alias("stopped"),
        F.sum("n").cast("bigint").alias("n"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when a bounded count proves it has at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df

