"""Best-fit packing of token documents into sequences by bin completion.

Only the lengths decide a packing, and there are at most ``capacity`` distinct lengths, so the search
runs on the histogram of lengths (bounded by ``capacity`` rows whatever the corpus): it returns fillings
with the number of times each is used. Documents then find their place by their rank among the pieces
of equal length, which is a count per (length, chunk) and a rank inside the chunk; no length, however
frequent, meets in one task.

Search: around the largest length left, fillings of the rest are enumerated largest first; a filling
to which a length that is left could still be added is dominated and never made, and one length that
fills the rest exactly dominates all others. Branches whose waste exceeds what an improvement on the
incumbent allows are pruned. The incumbent starts as the best-fit decreasing solution, and a search that
reaches the lower bound ceil(total / capacity) ends. ``NODES`` bounds the search; the best incumbent is kept.

Cases: a null or empty text is a document of the end id alone; repeated rows are packed like others;
a null doc_id is kept; an empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import crc_ids, map_arrow, stage, text_slices
from flowlens.llm.encode import encoder

NODES = 20_000
FILLINGS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of every document's ids (with the end id)."""
    def cut(batch):
        ids_of = batch.column("doc_id")
        for lo, _, texts in text_slices(batch.column("text")):
            flat, counts = encoder(tokenizer_path).encode(texts)
            ends = np.cumsum(counts)
            doc, piece, start, length, crc = [], [], [], [], []
            for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                ids = np.append(flat[a:b], np.uint32(end_id))
                for j, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s:s + capacity]
                    doc.append(lo + k)
                    piece.append(j)
                    start.append(s)
                    length.append(len(part))
                    crc.append(crc_ids(part))
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


class _Lengths:
    """Counts of the lengths that are left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sorted = sorted(self.n)

    def largest(self, bound: int, taken: dict[int, int]) -> int:
        """Largest length <= bound with a copy left beside ``taken``; 0 if none."""
        i = bisect_right(self.sorted, bound) - 1
        while i >= 0:
            s = self.sorted[i]
            if self.n[s] > taken.get(s, 0):
                return s
            i -= 1
        return 0

    def times(self, used: dict[int, int]) -> int:
        return min(self.n[s] // c for s, c in used.items())

    def add(self, used: dict[int, int], times: int) -> None:
        for s, c in used.items():
            n = self.n.get(s, 0) + c * times
            if s not in self.n:
                insort(self.sorted, s)
            self.n[s] = n
            if not n:
                del self.n[s]
                del self.sorted[bisect_right(self.sorted, s) - 1]


def fillings(left: _Lengths, capacity: int, keep: int = FILLINGS, nodes: int = 300) -> list[tuple[int, dict[int, int]]]:
    """(waste, lengths used) of undominated fillings around the largest length left, least waste first."""
    first = left.largest(capacity, {})
    found: list[tuple[int, dict[int, int]]] = []
    budget = [nodes]

    def fill(rest: int, bound: int, taken: dict[int, int]) -> bool:
        """True when a filling without waste was found."""
        s = left.largest(min(rest, bound), taken)
        if s == 0:
            if left.largest(rest, taken) == 0:  # else dominated: a length passed over still fits
                found.append((rest, dict(taken)))
            return rest == 0
        while s and budget[0] > 0:
            budget[0] -= 1
            taken[s] = taken.get(s, 0) + 1
            done = fill(rest - s, s, taken)
            taken[s] -= 1
            if not taken[s]:
                del taken[s]
            if done:
                return True
            s = left.largest(s - 1, taken)
        return False

    fill(capacity - first, capacity - first, {first: 1})
    found.sort(key=lambda f: f[0])
    return found[:keep]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on the histogram: (times, lengths used)."""
    left, out = _Lengths(counts), []
    while (s := left.largest(capacity, {})):
        used, rest = {s: 1}, capacity - s
        while rest and (t := left.largest(rest, used)):
            used[t] = used.get(t, 0) + 1
            rest -= t
        times = left.times(used)
        left.add(used, -times)
        out.append((times, used))
    return out


def pack_lengths(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, dict[int, int]]]:
    """Fillings (times used, lengths) that hold all the lengths in as few sequences as the search finds."""
    total = sum(s * c for s, c in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    best_n, waste = sum(t for t, _ in best), 0
    left = _Lengths(counts)
    path: list[tuple[int, dict[int, int], int]] = []
    choices = [fillings(left, capacity)]
    while choices and nodes > 0 and best_n > bound:
        if not choices[-1]:
            choices.pop()
            if path:
                times, used, w = path.pop()
                left.add(used, times)
                waste -= w * times
            continue
        nodes -= 1
        w, used = choices[-1].pop(0)
        times = left.times(used)
        if w:  # the waste that a better solution than the incumbent may still have
            times = min(times, ((best_n - 1) * capacity - total - waste) // w)
        if times <= 0:
            continue
        left.add(used, -times)
        waste += w * times
        path.append((times, used, w))
        if not left.n:
            best, best_n = [(t, u) for t, u, _ in path], sum(t for t, _, _ in path)
        choices.append(fillings(left, capacity) if left.n else [])
    return best


def segments(solution: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies per sequence, offset in it) by length and rank."""
    rows, used, sequence = [], {}, 0
    for times, lengths in solution:
        offset = 0
        for s in sorted(lengths, reverse=True):
            c = lengths[s]
            rows.append((s, used.get(s, 0), sequence, c, offset))
            used[s] = used.get(s, 0) + c * times
            offset += s * c
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a written table with ``length``)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(segments(pack_lengths(counts, capacity)))
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    sizes = keyed.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")
    ranked = (keyed.withColumn("r", F.row_number().over(inside) - 1).join(sizes, ["length", "chunk"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).alias("rank")))

    def put(b):
        seg = table.value
        length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        wide = int(max(seg[:, 1].max(), rank.max())) + 1
        at = np.searchsorted(seg[:, 0] * wide + seg[:, 1], length * wide + rank, side="right") - 1
        _, first, sequence, copies, offset = seg[at].T
        k = rank - first
        cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(sequence + k // copies), pa.array(offset + k % copies * length)],
                                         names=[x.split()[0] for x in PLACED.split(", ")])
    return map_arrow(ranked, put, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text)."""
    return place(stage(cut_pieces(docs, tokenizer_path, capacity, end_id), "pack-pieces"), capacity)
