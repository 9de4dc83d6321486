"""Flow-log text in, day-partitioned tables and findings out.

Flow logs arrive as space-delimited text objects under ``.../YYYY/MM/DD/``
(gzip is read transparently). The day key comes from the object path, so
passing only the needed day folders prunes the scan before any file is opened.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import columns as C
from flowlens.operators.requests import window_days
from flowlens.schemas import FLOW_COLUMNS, FLOW_SCHEMA

# Plain ``/2024/01/15/file`` and Hive-style ``/y=2024/m=01/d=15/file`` layouts.
DAY_PATH_RE = r"/(?:[^/=]+=)?([0-9]{4})/(?:[^/=]+=)?([0-9]{2})/(?:[^/=]+=)?([0-9]{2})/[^/]+$"
WRITE_TASK_BYTES = 256 << 20
TEXT_OPTIONS = {"sep": " ", "header": "true", "nullValue": "-"}


def read_flow_text_raw(spark: SparkSession, paths) -> DataFrame:
    """Positional DDL schema, one header line per object, ``-`` as NULL."""
    return spark.read.schema(FLOW_SCHEMA).options(**TEXT_OPTIONS).csv(paths)


def _path_day(p):
    return F.concat_ws("/", *[F.regexp_extract(p, DAY_PATH_RE, i) for i in (1, 2, 3)])


def with_day(df: DataFrame) -> DataFrame:
    """The ``yyyy/MM/dd`` day key taken from the object path."""
    p = F.col("_metadata.file_path")
    return df.select(*FLOW_COLUMNS, F.when(p.rlike(DAY_PATH_RE), _path_day(p)).alias("day"))


def read_flow_text(spark: SparkSession, paths) -> DataFrame:
    return with_day(read_flow_text_raw(spark, paths))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def day_dirs(root: str, day: str) -> list[str]:
    y, m, d = day.split("/")
    root = root.rstrip("/")
    return [f"{root}/{y}/{m}/{d}", f"{root}/yyyy={y}/mm={m}/dd={d}"]


def day_paths(spark: SparkSession, root: str, days) -> list[str]:
    """The existing day folders under ``root`` for ``days`` (missing days skipped)."""
    out = []
    for day in days:
        for d in day_dirs(root, day):
            p, fs = _fs(spark, d)
            if fs.exists(p):
                out.append(d)
    return out


def write_flow_text(df: DataFrame, root: str, compression: str = "gzip") -> None:
    """Write flow records the way they are delivered: text, one folder per day.

    Day folders are written Hive-style (``yyyy=/mm=/dd=``); the reader accepts
    both layouts. Header names use the delivery format's dashed field names.
    """
    y, m, d = (F.split(F.col("day"), "/").getItem(i) for i in range(3))
    cols = [F.col(c).alias(c.replace("_", "-")) for c in FLOW_COLUMNS]
    (df.select(*cols, y.alias("yyyy"), m.alias("mm"), d.alias("dd"))
       .write.mode("overwrite").partitionBy("yyyy", "mm", "dd")
       .options(**TEXT_OPTIONS).option("compression", compression).csv(root))


def register_flows(df: DataFrame, name: str = "vpc_flow_logs") -> DataFrame:
    """S3: address the flow table by name in SQL."""
    df.createOrReplaceTempView(name)
    return df


def _write_tasks(df: DataFrame) -> int:
    """Tasks so that one writes about ``WRITE_TASK_BYTES`` of input, at least the session's shuffle partitions."""
    n = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // WRITE_TASK_BYTES)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, 200_000))


def write_flows_table(df: DataFrame, path: str, partitions: int | None = None, canonical_addresses: bool = False,
                      cells: tuple[str, ...] = ("day",), replace_cells_only: bool = False) -> None:
    """S3 at scale: Parquet partitioned by ``cells``, rows range-partitioned and sorted by
    (day, dstaddr, start) so row-group statistics skip most of a day for one
    address and one window. Range partitioning splits a hot address across
    tasks by time instead of sending it to one writer.

    ``replace_cells_only=True`` overwrites just the cells present in ``df``
    (dynamic partition overwrite). ``canonical_addresses`` stores one text form
    per address (D11), computed once at write time."""
    if canonical_addresses:
        from flowlens.functions.columns import canonical_ip
        df = df.withColumn("srcaddr", canonical_ip(F.col("srcaddr"))) \
               .withColumn("dstaddr", canonical_ip(F.col("dstaddr")))
    order = list(dict.fromkeys([*cells, "day", "dstaddr", "start"]))
    w = (df.repartitionByRange(partitions or _write_tasks(df), *order)
           .sortWithinPartitions(*order)
           .write.mode("overwrite").partitionBy(*cells))
    if replace_cells_only:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def ingest_flow_text(spark: SparkSession, paths, table: str, partitions: int | None = None,
                     canonical_addresses: bool = False) -> None:
    """Load whole delivery folders (one per day) into a table that many loads share.

    A record's ``day`` is that of its ``start`` (D16), so day pruning never misses a
    record that was delivered under the next day's folder near midnight. The
    table is partitioned by (day, src_day), with ``src_day`` the folder's day: a
    load replaces what the same folders brought before, so a late record
    joins its day beside the others, and a repeated load changes nothing. Each
    folder must be given whole. A path without a day stops the load.

    A corrected delivery may have no record of a day that the folder had before: once the write has succeeded, the cells
    of the loaded folders that still hold their old files are removed. A load that is lost between the two is
    put right by loading the folder again.
    """
    from flowlens.functions.columns import day_of
    df = read_flow_text_raw(spark, paths)
    loaded = {"/".join(m.groups()) for f in df.inputFiles() if (m := re.search(DAY_PATH_RE, f))}
    before = {day: _cell_files(spark, table, day) for day in sorted(loaded)}
    p = F.col("_metadata.file_path")
    src = F.when(p.rlike(DAY_PATH_RE), _path_day(p)).otherwise(
        F.raise_error(F.concat(F.lit("no day in the object path "), p)))
    df = df.select(*FLOW_COLUMNS, day_of(F.col("start")).alias("day"), src.alias("src_day"))
    write_flows_table(df, table, partitions=partitions, canonical_addresses=canonical_addresses,
                      cells=("day", "src_day"), replace_cells_only=True)
    for day, cells in before.items():
        now = _cell_files(spark, table, day)
        for cell, files in cells.items():
            if now.get(cell) == files:
                p, fs = _fs(spark, cell)
                fs.delete(p, True)


def _cell_files(spark: SparkSession, table: str, src_day: str) -> dict[str, frozenset[str]]:
    """The cells of a delivery folder in a table, each with the names of its data files (metadata only)."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(src_day)
    p, fs = _fs(spark, f"{table.rstrip('/')}/day=*/src_day={name}")
    found = {}
    for cell in fs.globStatus(p) or []:
        where = cell.getPath()
        found[where.toString()] = frozenset(f.getPath().getName() for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", ".")))
    return found


def read_flows_table(spark: SparkSession, path: str) -> DataFrame:
    """Flow records with their day from a table of ``write_flows_table`` or ``ingest_flow_text``."""
    return spark.read.parquet(path).select(*FLOW_COLUMNS, F.col("day").cast("string").alias("day"))


def write_findings(df: DataFrame, path: str) -> None:
    """Keep query output in a results location."""
    df.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- S6, S7

ARGUMENTS = ("ip", "direction", "port", "protocol", "action", "window_minutes", "start_time", "end_time")


def requests_from_json(df: DataFrame, json_col: str = "arguments", id_col: str = "request_id",
                       as_of_col: str = "as_of_epoch") -> DataFrame:
    """Question arguments as JSON text; a missing key becomes NULL.

    Only a JSON integer is a port. ``port_text`` holds whatever was written, so that V3
    refuses text, fractions and numbers out of range instead of asking about any port. A
    time given as a JSON number is cut to whole seconds.
    """
    text = F.from_json(F.col(json_col), ", ".join(f"{c} string" for c in ARGUMENTS))
    # a second reading by type: NULL where the JSON value is text or does not fit
    typed = F.from_json(F.col(json_col), "port bigint, window_minutes int, start_time double, end_time double")
    s = df.select(F.col(id_col).alias("request_id"), text.alias("a"), typed.alias("n"), F.col(as_of_col).alias("as_of_epoch"))

    def time(name: str):
        return F.coalesce(F.col(f"n.{name}").try_cast("bigint").cast("string"), F.col(f"a.{name}")).alias(name)

    return s.select("request_id", "a.ip", "a.direction", F.col("n.port").try_cast("int").alias("port"),
                    F.col("a.port").alias("port_text"), "a.protocol", "a.action", "n.window_minutes",
                    time("start_time"), time("end_time"), "as_of_epoch")


def arguments_json(requests: DataFrame) -> DataFrame:
    """The inverse: one JSON argument object per question, NULL fields omitted."""
    return requests.select("request_id", F.to_json(F.struct(*ARGUMENTS)).alias("arguments"),
                           "as_of_epoch")


def finding_json(df: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Each finding as JSON text; NULL fields are written (as the reference does)."""
    fields = [c for c in df.columns if c != id_col]
    return df.select(id_col, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


# ---------------------------------------------------------------- S8

def record_bytes() -> Column:
    """Bytes of a record as a text line (``-`` for NULL, single spaces, line end)."""
    return F.octet_length(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-"))
                                             for c in FLOW_COLUMNS])) + 1


def seen_sources(flows: DataFrame) -> DataFrame:
    """(srcaddr, day, flows): which addresses sent anything on which day. Kept beside the table (``write_seen_sources``), it proves that an
    address was never seen without a scan of the flows."""
    return flows.filter(F.col("srcaddr").isNotNull()).groupBy("srcaddr", "day").agg(F.count(F.lit(1)).alias("flows"))


def write_seen_sources(flows: DataFrame, path: str) -> None:
    """Store ``seen_sources`` sorted by address, so a look-up reads the row groups of its addresses."""
    seen_sources(flows).repartitionByRange("srcaddr").sortWithinPartitions("srcaddr", "day").write.mode("overwrite").parquet(path)


def day_bytes(flows: DataFrame) -> DataFrame:
    """(day, records, day_bytes): text size of each day's records. The one pass over the flows that budgets need; keep it beside
    the table (``write_day_bytes``) and budgets read a row per day."""
    return flows.filter(F.col("day").isNotNull()).groupBy("day").agg(
        F.count(F.lit(1)).alias("records"), F.sum(record_bytes()).alias("day_bytes"))


def write_day_bytes(flows: DataFrame, path: str) -> None:
    """Store ``day_bytes``, at ingest."""
    day_bytes(flows).write.mode("overwrite").parquet(path)


def question_budget(per_day: DataFrame, validated: DataFrame, cap: int = K.SCAN_CAP_BYTES) -> DataFrame:
    """S8 per question: text bytes of the days its window touches, against the cap of one query.

    ``per_day`` is ``day_bytes``, stored: no flow is read. Invalid questions scan nothing and have no row; days
    without records count zero bytes.
    """
    ok = validated.filter(F.col("status") == "OK")
    days = window_days(ok)
    return (days.join(per_day.select("day", "day_bytes"), "day", "left").groupBy("request_id")
                .agg(F.count(F.lit(1)).alias("days"),
                     F.coalesce(F.sum("day_bytes"), F.lit(0)).cast("bigint").alias("bytes_scanned"))
                .withColumn("over_budget", F.col("bytes_scanned") > cap))


def within_budget(per_day: DataFrame, validated: DataFrame, cap: int = K.SCAN_CAP_BYTES) -> DataFrame:
    """Validated questions with those over the cap turned into error rows, before any flow is matched."""
    b = question_budget(per_day, validated, cap).select("request_id", "bytes_scanned", "over_budget")
    over = F.coalesce(F.col("over_budget"), F.lit(False))
    j = validated.join(b, "request_id", "left")
    return j.select(*[F.when(over, "TOOL_ERROR").otherwise(F.col("status")).alias("status") if c == "status"
                      else F.when(over, C.fault("scan OVER_BUDGET", F.col("bytes_scanned"))).otherwise(F.col("detail")).alias("detail")
                      if c == "detail" else c for c in validated.columns])


def scan_budget(spark: SparkSession, root: str, days, cap: int = K.SCAN_CAP_BYTES) -> DataFrame:
    """Bytes behind a query over ``days``, from file-system metadata only.

    One summary call per existing day folder (no data is read); the result is
    compared with the cap before any job runs.
    """
    rows = []
    for d in sorted(set(days)):
        size = files = 0
        for path in day_paths(spark, root, [d]):
            p, fs = _fs(spark, path)
            s = fs.getContentSummary(p)
            size += int(s.getLength())
            files += int(s.getFileCount())
        rows.append((d, files, size))
    per_day = spark.createDataFrame(rows, "day string, files bigint, bytes bigint")
    return per_day.agg(F.count(F.when(F.col("files") > 0, 1)).alias("days"),
                       F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"),
                       F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")) \
                  .withColumn("cap_bytes", F.lit(cap).cast("bigint")) \
                  .withColumn("over_budget", F.col("bytes") > F.col("cap_bytes"))

