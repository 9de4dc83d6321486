"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(df: DataFrame, size_col: str, bytes_each: int) -> int:
    """Number of hash buckets so that one holds about ``bytes_each`` bytes of the column.

    One aggregate over the whole table; never fewer than the session's shuffle partitions.
    """
    total = df.agg(F.sum(F.octet_length(F.col(size_col))).alias("b")).first()["b"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def crc_mod(doc_id, m: int):
    """crc32 of the decimal text of an id, modulo m (Column)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(m))


def text_list(col: pa.ChunkedArray | pa.Array) -> list[str]:
    """Values of a string column, null as empty."""
    return ["" if x is None else x for x in col.to_pylist()]


def slices(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` characters (one text at least)."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > limit:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def text_slices(col: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, int, list[str]]]:
    """(lo, hi, texts) over a string column: at most ``limit`` bytes at a time (one text at least), null as empty."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    lo, n = 0, 0
    for i, size in enumerate(sizes + [limit + 1]):
        if i > lo and n + size > limit:
            yield lo, i, text_list(col.slice(lo, i - lo))
            lo, n = i, 0
        n += size


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


def crc_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
