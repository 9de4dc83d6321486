"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is 64 bits; two that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` of ``blocks`` blocks. Every distinct fingerprint is therefore put under one key for
each choice of that many blocks, keys are joined by sorting, and the pairs under a key are compared. Of the
links under one key only a spanning forest is written, so the output stays below the number of rows read.
A key with more than ``HOT`` fingerprints is not compared pairwise: its fingerprints are linked through all
values at most ``max_bits / 2`` bits away, which two of them share exactly if they differ in at most
``max_bits`` bits (a ball has 2,081 values for 4 bits), and which any number of tasks can group.

At larger corpora raise ``blocks``: a key has about 64 * (blocks - max_bits) / blocks bits.

Cases: a null or blank text has fingerprint 0 and links like any other; fewer words than the shingle
length: the whole sequence is the one shingle; repeated rows and copies share a fingerprint and are compared
once; a null doc_id keeps its row and never names a component unless it stands alone; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, stage, text_slices
from flowlens.llm.graph import components, forest

HOT = 2_048
SEED = 42


def fingerprints(texts: list[str], words: int) -> np.ndarray:
    """SimHash of each text (uint64)."""
    out = np.zeros(len(texts), np.uint64)
    hashes, owners, counts = [], [], []
    digest = xxhash.xxh64_intdigest
    for k, t in enumerate(texts):
        w = t.encode().lower().split()  # bytes: lower-cases A-Z, splits at the six ASCII spaces
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= words:
            found = [digest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            starts = (ends[:-words + 1] if words > 1 else ends) - np.fromiter(map(len, w[:len(w) - words + 1]), np.int64) - 1
            found = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1:] - 1).tolist())]
        hashes += found
        owners.append(k)
        counts.append(len(found))
    if not owners:
        return out
    h = np.array(hashes, np.uint64)
    n = np.array(counts, np.int64)
    ones = np.zeros((len(owners), 64), np.int64)
    begin = np.cumsum(n) - n
    as_bytes = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):  # one byte of the hash at a time keeps the unpacked bits small
        bits = np.unpackbits(as_bytes[:, byte:byte + 1], axis=1, bitorder="little")
        ones[:, byte * 8:byte * 8 + 8] = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    out[owners] = ((2 * ones > n[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, version, fp) of every row of ``docs`` (doc_id, text); version tells texts of one doc_id apart."""
    def run(b):
        fp = np.concatenate([fingerprints(texts, words) for _, _, texts in text_slices(b.column("text"))])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(fp.view(np.int64))], names=["doc_id", "version", "fp"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    return map_arrow(docs, run, "doc_id long, version long, fp long")


def block_masks(blocks: int, keep: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, keep)]


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the close pairs inside each run of equal keys (sorted)."""
    n = len(key)
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    last = np.repeat(np.concatenate([change, [n]]), np.diff(np.concatenate([[0], change, [n]]))) - 1
    at, d, left, right = np.flatnonzero(last > np.arange(n)), 1, [], []
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits]
        left.append(near)
        right.append(near + d)
        d += 1
        at = at[at + d <= last[at]]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = forest(np.concatenate(left), np.concatenate(right), n)
    return fp[x].view(np.int64), fp[y].view(np.int64)


def key_links(fps: DataFrame, max_bits: int, blocks: int, hot: int) -> DataFrame:
    """(a, b) links found under the keys; b is null for a fingerprint under a hot key."""
    masks = np.array(block_masks(blocks, blocks - max_bits), np.uint64)

    def keys(batch):
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fp), 4096):
            part = fp[lo:lo + 4096]
            # a key is the masked bits, mixed with the number of the mask
            key = (part[None, :] & masks[:, None]) * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(len(masks), dtype=np.uint64) << np.uint64(57))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.tile(part, len(masks)).view(np.int64))], names=["key", "fp"])

    def scan(batches):
        held_k, held_f, hot_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def rows(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            open_at = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [len(k)]]))
            big = np.repeat(size > hot, size) | ((k == hot_key) if hot_key is not None else False)
            hot_key = k[-1] if big[-1] else None
            if big.any():
                yield rows(f[big].view(np.int64), [None] * int(big.sum()))
            done = ~big[:open_at]
            a, b = _links(k[:open_at][done], f[:open_at][done], max_bits)
            if len(a):
                yield rows(a, b)
            held_k, held_f = (k[open_at:], f[open_at:]) if hot_key is None else (k[:0], f[:0])
        a, b = _links(held_k, held_f, max_bits)
        if len(a):
            yield rows(a, b)

    keyed = map_arrow(fps.select("fp"), keys, "key long, fp long")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(scan, "a long, b long")


def ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links of the fingerprints ``a`` that share a value at most max_bits / 2 bits away from both."""
    masks = np.array([sum(1 << x for x in c) for r in range(max_bits // 2 + 1) for c in combinations(range(64), r)], np.uint64)

    def ball(batch):
        for v in batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64):
            yield pa.RecordBatch.from_arrays([pa.array((masks ^ v).view(np.int64)), pa.array(np.full(len(masks), v).view(np.int64))], names=["m", "a"])

    near = map_arrow(fps, ball, "m long, a long")
    least = near.groupBy("m").agg(F.min("a").alias("b"))
    return near.join(least, "m").where("a != b").select("a", "b").distinct()


def groups(docs: DataFrame, words: int, max_bits: int, blocks: int, hot: int = HOT) -> DataFrame:
    """(doc_id, version, fp, root, component_id) of every row of ``docs`` (doc_id, text); a root is one component."""
    if max_bits % 2 or blocks <= max_bits:
        raise ValueError("max_bits must be even and below blocks")
    prints = stage(fingerprint_table(docs, words), "simhash")
    fps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = stage(key_links(fps, max_bits, blocks, hot), "simhash-links")
    links = found.where("b is not null")
    crowded = found.where("b is null").select("a").distinct()
    if not crowded.isEmpty():
        links = links.unionByName(ball_links(crowded, max_bits))
    roots = components(links.distinct()).select(F.col("node").alias("fp"), "root")
    named = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, blocks: int = 7, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    return groups(docs, words, max_bits, blocks, hot).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """One row of each group of ``docs``: the least doc_id (a null one last) and, where rows share it, the least text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    first = groups(docs, words, max_bits, blocks).groupBy("root").agg(F.min(order).alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.version").alias("version"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version"))
    kept = rows.alias("a").join(first.alias("b"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", "version"]).select("row.*")
