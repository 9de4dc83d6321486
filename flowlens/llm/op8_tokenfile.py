"""Token-id files: one zstandard dictionary for all documents, one frame per document.

A file set has two parts under one path:

``dictionary``  one row: the dictionary bytes and their sha256.
``shards``      rows in ascending doc_id order; a shard holds up to ``SHARD_DOCS`` documents or about
                ``SHARD_BYTES`` of frames: ``shard`` (ascending), ``first_doc``, ``last_doc``, ``n_tokens``,
                ``dict_sha256``, the index ``doc_ids``, ``offsets`` (n + 1 byte offsets) and ``counts``
                (ids per document), and ``data``: the frames one after another.

A frame holds the ids as little-endian unsigned integers of ``id_bytes`` bytes (2 if the vocabulary
allows, else 4). ``read_document`` finds the shard by its pushed-down doc_id range and opens one frame.

Cases: a null text is an empty document (end id only); a null doc_id comes first; repeated doc_ids
stay separate entries; an empty table gives no shard and no row. Extra columns are not read.
The dictionary is trained on a bounded sample (``SAMPLE_DOCS`` texts of at most ``SAMPLE_BYTES``
bytes, chosen by hash); with too few samples the samples themselves are the dictionary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import crc_ids, map_arrow, text_slices
from flowlens.llm.encode import encoder
from flowlens.session import scratch_path

SAMPLE_DOCS = 512
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 65_536
LEVEL = 3
SHARD_DOCS = 4_096
SHARD_BYTES = 8_000_000
SHARDS = ("shard long, first_doc long, last_doc long, n_tokens long, id_bytes int, dict_sha256 string, "
          "doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, data binary")
ROWS = "shard long, doc_id long, local long, n_tokens long, ids_crc32 long"


def _encode(path: str, column: pa.Array, end_id: int, dtype: str):
    """Serialized ids of each text with its end id."""
    for _, _, texts in text_slices(column):
        ids, counts = encoder(path).encode(texts)
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            yield np.append(ids[a:b], np.uint32(end_id)).astype(dtype).tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int, dtype: str) -> bytes:
    """Dictionary from the sampled documents' serialized ids."""
    size = F.octet_length("text")
    docs = docs.where((size > 0) & (size <= SAMPLE_BYTES)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    # thinned by the hash first, so that the tasks together send about twice the sample, however many they are
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("h", "text").limit(SAMPLE_DOCS)
    raw = list(_encode(path, pa.array([r["text"] for r in sample.collect()], pa.string()), end_id, dtype))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(raw)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the file set to ``out``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_bytes = 2 if encoder(tokenizer_path).tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536 else 4
    dtype = f"<u{id_bytes}"
    words = train_dictionary(docs, tokenizer_path, end_id, dtype)
    digest = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(digest, bytearray(words))], "dict_sha256 string, dictionary binary").write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(words)

    def pack(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, counts, frames, size = [], [], [], 0

        def shard():
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            values = [base + seq, known[0] if known else None, known[-1] if known else None, sum(counts), id_bytes,
                      digest, ids, offsets, counts, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        i64 = pa.int64()
        names = [x.split()[0] for x in SHARDS.split(", ")]
        kinds = [i64, i64, i64, i64, pa.int32(), pa.string(), pa.list_(i64), pa.list_(i64), pa.list_(i64), pa.binary()]
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), _encode(tokenizer_path, b.column("text"), end_id, dtype)):
                frame = compressor.compress(raw)
                ids.append(doc)
                counts.append(len(raw) // id_bytes)
                frames.append(frame)
                size += len(frame)
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield shard()
                    seq, size, ids, counts, frames = seq + 1, 0, [], [], []
        if ids:
            yield shard()

    (docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(pack, SHARDS).write.parquet(f"{out}/shards"))


def _shards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{out}/shards")


def _load_dictionary(spark: SparkSession, out: str) -> tuple[str, bytes]:
    r = spark.read.parquet(f"{out}/dictionary").first()
    words = bytes(r["dictionary"])
    if hashlib.sha256(words).hexdigest() != r["dict_sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return r["dict_sha256"], words


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, dict_sha256) of every document, decoded from the files."""
    digest, words = _load_dictionary(spark, out)
    shared = spark.sparkContext.broadcast(words)

    def unpack(b):
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for r in range(b.num_rows):
            row = {c: b.column(c)[r].as_py() for c in ("shard", "id_bytes", "dict_sha256", "doc_ids", "offsets", "counts")}
            if row["dict_sha256"] != digest:
                raise ValueError("a shard was written with another dictionary")
            data = memoryview(b.column("data")[r].as_buffer())
            crcs, sizes = [], []
            for lo, hi in zip(row["offsets"], row["offsets"][1:]):
                ids = np.frombuffer(opener.decompress(data[lo:hi]), f"<u{row['id_bytes']}")
                sizes.append(len(ids))
                crcs.append(crc_ids(ids))
            if sizes != row["counts"]:
                raise ValueError("a frame does not hold the ids that the index states")
            local = (np.cumsum(sizes) - sizes).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(sizes), pa.int64())] + [pa.array(x, pa.int64()) for x in (row["doc_ids"], local, sizes, crcs)],
                names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    shards = _shards(spark, out)
    rows = map_arrow(shards, unpack, ROWS)
    # one short row per shard: the ids before it
    before = shards.select("shard", F.col("n_tokens").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("shard", "base"), "shard").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.lit(digest).alias("dict_sha256"))


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[list[int]]:
    """Ids of the entries of one document, opening only its frames."""
    digest, words = _load_dictionary(spark, out)
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(words))
    found = (_shards(spark, out).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
             .select("id_bytes", "data", F.posexplode(F.arrays_zip("doc_ids", F.slice("offsets", 1, F.size("counts")).alias("lo"),
                                                                   F.slice("offsets", 2, F.size("counts")).alias("hi"))).alias("k", "d"))
             .where(F.col("d.doc_ids") == doc_id)
             .select("id_bytes", F.expr("substring(data, int(d.lo) + 1, int(d.hi - d.lo))").alias("frame")))
    return [np.frombuffer(opener.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}").tolist() for r in found.collect()]


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the file set to the shared folder and read it back."""
    out = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, out, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, out)
