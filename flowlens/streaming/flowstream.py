"""Flow records that arrive late, as Structured Streaming jobs.

Records are aggregated per minute by the delivery process and land 10-20
minutes after the fact, so both jobs use a 20-minute watermark on the record
start time and append finished windows to Parquet. ``availableNow`` processes
what has arrived and stops, which suits scheduled runs; the checkpoint in the
shared folder makes a restarted run continue where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.columns import day_of
from flowlens.schemas import FLOW_COLUMNS, FLOW_SCHEMA
from flowlens.sources import fixtures
from flowlens.sources import flowlogs as FLG

LATENESS = "20 minutes"


def flows_stream(spark: SparkSession, events_path: str) -> DataFrame:
    """A stream of flow records derived from an arriving ``events`` file set."""
    schema = spark.read.parquet(events_path).schema  # glob or folder of events files
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(events_path)
    f = spark.sql(fixtures.render("flows", "spark"), events=ev)
    return f.withColumn("start_ts", F.timestamp_seconds(F.col("start")))


def minute_counts(flows: DataFrame) -> DataFrame:
    """Accept / reject / all counts per minute of record start."""
    g = (flows.withWatermark("start_ts", LATENESS)
              .groupBy(F.window("start_ts", "1 minute").alias("w"))
              .agg(F.count(F.lit(1)).alias("flows"),
                   F.count(F.when(F.col("action") == "ACCEPT", 1)).alias("accepts"),
                   F.count(F.when(F.col("action") == "REJECT", 1)).alias("rejects")))
    return g.select(F.unix_timestamp(F.col("w.start")).alias("minute_start"),
                    F.unix_timestamp(F.col("w.end")).alias("minute_end"), "flows", "accepts", "rejects")


def reject_sessions(flows: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Reject sessions per (dstaddr, dstport): consecutive rejects at most ``gap`` apart
    (a session window [t, t + gap) that touches the next one merges with it)."""
    # All records drive event time, so the session of a block that has stopped is closed by whatever flows next. The condition
    # reads the event-time column and cannot be split, else Catalyst would filter before the watermark.
    reject = F.when(F.col("start_ts").isNotNull(),
                    (F.col("action") == "REJECT") & F.col("dstaddr").isNotNull() & F.col("dstport").isNotNull()).otherwise(False)
    r = flows.withWatermark("start_ts", LATENESS).filter(reject)
    g = (r.groupBy(F.session_window("start_ts", gap).alias("s"), "dstaddr", "dstport")
          .agg(F.count(F.lit(1)).alias("rejects"), F.min("start").alias("first_start"),
               F.max("start").alias("last_start")))
    return g.select("dstaddr", "dstport", F.unix_timestamp(F.col("s.start")).alias("session_start"),
                    F.unix_timestamp(F.col("s.end")).alias("session_end"), "rejects", "first_start", "last_start")


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Append finished windows to Parquet, processing everything that has arrived."""
    q = (df.writeStream.outputMode("append").format("parquet")
           .option("path", sink).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    q.awaitTermination()


def start_continuous(df: DataFrame, sink: str, checkpoint: str, every: str = "1 minute"):
    """Keep the job running, appending finished windows every ``every``.

    Returns the ``StreamingQuery``; restarting with the same checkpoint resumes
    from the last committed batch (files and state), so a lost driver or
    executor does not lose or repeat output.
    """
    return (df.writeStream.outputMode("append").format("parquet")
              .option("path", sink).option("checkpointLocation", checkpoint)
              .trigger(processingTime=every).start())


def load_batch(df: DataFrame, batch: int, table: str, sizes: str) -> None:
    """Write one batch of delivered records to its own cells (day, batch) of ``table`` and its day sizes beside it.

    A batch that comes again (a restart between the write and the stream's commit) replaces exactly what it wrote before.
    """
    rows = df.select(*FLOW_COLUMNS, day_of(F.col("start")).alias("day"), F.lit(batch).cast("bigint").alias("batch"))
    FLG.write_flows_table(rows, table, cells=("day", "batch"), replace_cells_only=True)
    # the sizes are taken from the cells just written, not from the text once more
    written = df.sparkSession.read.parquet(table).filter(F.col("batch") == batch).withColumn("day", F.col("day").cast("string"))
    (FLG.day_bytes(written).withColumn("batch", F.lit(batch).cast("bigint")).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sizes))


def ingest_stream(spark: SparkSession, root: str, table: str, sizes: str, checkpoint: str, files: int = 64) -> None:
    """S1-S3 as a stream: load every delivered text object under ``root`` that has not been loaded yet, then stop.

    ``files`` objects make a batch; the checkpoint remembers which were loaded. Read the table with ``read_flows_table`` and the sizes
    with ``stored_day_bytes``.
    """
    raw = (spark.readStream.schema(FLOW_SCHEMA).options(**FLG.TEXT_OPTIONS).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", files).csv(root))
    q = (raw.writeStream.foreachBatch(lambda df, batch: load_batch(df, batch, table, sizes))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stored_day_bytes(spark: SparkSession, sizes: str) -> DataFrame:
    """(day, records, day_bytes) over all batches."""
    return spark.read.parquet(sizes).groupBy("day").agg(F.sum("records").alias("records"), F.sum("day_bytes").alias("day_bytes"))
