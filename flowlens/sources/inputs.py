"""Load the driver's tables and derive the network inputs as Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.session import prepare
from flowlens.sources import fixtures

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PART_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a DataFrame over the cluster's cores when it has fewer partitions.

    A small table stored as one file (one Parquet row group) reads as one
    partition, so every row-wise step after it (regex parsing, validation,
    the probe side of a broadcast join) would run in a single task. The same
    holds for a few large row groups: a task gets ``PART_ROWS`` rows at most
    (the count reads file footers only), so its time and memory do not grow with the table.
    Inputs that already have enough splits are returned unchanged.
    """
    try:
        want = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Connect session): leave as is
        return df
    return df.repartition(want) if have < want else df


def _derive(spark: SparkSession, name: str, events: DataFrame) -> DataFrame:
    return spark.sql(fixtures.render(name, "spark"), events=spread(events))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 flow-log records (one per event) with the ``day`` key."""
    prepare(spark)
    return _derive(spark, "flows", table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 forensic questions."""
    prepare(spark)
    return _derive(spark, "requests", table(spark, sf_dir, "events"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 probe captures (stdout and stderr already joined)."""
    prepare(spark)
    return _derive(spark, "probes", table(spark, sf_dir, "events"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traceroute captures over several routers."""
    prepare(spark)
    return _derive(spark, "traces", table(spark, sf_dir, "events"))


def probe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe runs with separate streams, run status and traceroute max_hops."""
    return spark.sql(fixtures.render_probe_runs("spark", "{probes}"), probes=probes(spark, sf_dir))


def two_way_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records with the replies to them (stitching)."""
    return spark.sql(fixtures.render_two_way("spark", "{flows}"), flows=flows(spark, sf_dir))


def busy_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows folded into three hours."""
    return spark.sql(fixtures.render_busy_flows("spark", "{flows}"), flows=flows(spark, sf_dir))


def busy_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on ``busy_flows``."""
    prepare(spark)
    return spark.sql(fixtures.render_busy_requests("spark"), events=table(spark, sf_dir, "events"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4, IPv6 and other text in address columns (prefix matching)."""
    return spark.sql(fixtures.render_addresses("{flows}", "{requests}"), flows=flows(spark, sf_dir), requests=requests(spark, sf_dir))


def bench_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger flow set for benchmarks: one record per ``lineitem`` row.

    Ship dates are folded onto the same 30 days as ``events`` (flow logs are
    dense in time and kept for a retention window), 64 destinations, sources
    from the supplier key, REJECT for returned items.
    """
    prepare(spark)
    li = spread(table(spark, sf_dir, "lineitem"))
    return spark.sql("""
      SELECT 2 AS version, '123456789012' AS account_id,
        concat('eni-', lpad(cast(l_linenumber % 8 as string), 17, '0')) AS interface_id,
        concat('10.20.', cast(l_suppkey DIV 250 % 250 as string), '.', cast(l_suppkey % 250 as string)) AS srcaddr,
        concat('10.20.1.', cast(l_partkey % 64 + 1 as string)) AS dstaddr,
        cast(32768 + (l_orderkey * 7 + l_linenumber) % 28000 as int) AS srcport,
        CASE l_linenumber WHEN 1 THEN 5432 WHEN 2 THEN 80 WHEN 3 THEN 443 ELSE 8000 + l_linenumber END AS dstport,
        cast(CASE WHEN l_linenumber = 7 THEN 17 ELSE 6 END AS bigint) AS protocol,
        cast(l_quantity AS bigint) AS packets, cast(l_quantity AS bigint) * 60 AS bytes,
        t AS start, t + 60 AS `end`,
        CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS action,
        'OK' AS log_status, 'vpc-0a' AS vpc_id, concat('subnet-', cast(l_orderkey % 2 as string)) AS subnet_id,
        CASE WHEN l_orderkey % 16 < 8 THEN 'ingress' ELSE 'egress' END AS flow_direction,
        date_format(timestamp_seconds(t), 'yyyy/MM/dd') AS day
      FROM (SELECT *, 1704067200 + (datediff(l_shipdate, DATE'1992-01-01') % 30) * 86400
                      + (l_orderkey * 7 + l_linenumber * 13) % 86400 AS t FROM {li})""", li=li)


def bench_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over ``bench_flows``: one per order, look-back windows over the 30 days."""
    prepare(spark)
    o = spread(table(spark, sf_dir, "orders"))
    return spark.sql("""
      SELECT o_orderkey AS request_id,
        CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE concat('10.20.1.', cast(o_orderkey % 64 + 1 as string)) END AS ip,
        CASE o_orderkey % 7 WHEN 2 THEN 'from' ELSE 'to' END AS direction,
        CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 5432 END AS port,
        CASE o_orderkey % 4 WHEN 1 THEN 'TCP' END AS protocol,
        CASE o_orderkey % 6 WHEN 1 THEN 'REJECT' ELSE 'ALL' END AS action,
        cast(180 AS int) AS window_minutes,
        cast(NULL AS string) AS start_time, cast(NULL AS string) AS end_time,
        1704067200 + (datediff(o_orderdate, DATE'1992-01-01') % 30) * 86400 + (o_orderkey * 37) % 86400
          AS as_of_epoch
      FROM {o}""", o=o)
