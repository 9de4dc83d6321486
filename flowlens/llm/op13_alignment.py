"""Alignment of two tokenizers: groups of tokens between shared ends, and corpus-wide counts of linked id pairs.

A and B cut the bytes of blank + text into tokens. Divide and conquer at shared cuts: in an interval of A and B tokens
the A end nearest the middle that is also a B end is looked for (middle first, then alternately beside it, each
by a bisect in B's ends); the interval is cut there and both halves are treated alike; an interval without a shared end
inside is a leaf, one group. All intervals of a block take a step at once, so the recursion is a short loop.

An A and a B token are linked when their byte ranges end together, which is at the end of each group. Distinct pairs of a
block of documents are numbered and counted in the block; block counts are summed by pair; a pair's count and whether
it is the highest of its B id come back to each block through a join on the pair, and blocks of bounded size add them up for
their documents. So a frequent pair costs one row per block, and no pair, document or group meets whole in a task.

A long text is cut before blanks that follow no white space, where both tokenizers always end a token, into units of
about ``UNIT`` characters, so memory is bounded unless one word is longer than that. A block closes at ``BLOCK_LINKS`` links.

Cases: a null or empty text, and one whose joined token bytes differ from blank + text (U+2581, which B reads as a
blank), has no tokens: zeros and an empty string. Special-token strings are ordinary text. Equal counts of one B id are all its
highest. Repeated rows and null doc_ids are rows like others. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, ragged, slices, stage, text_slices
from flowlens.llm.encode import encoder

UNIT = 500_000
BLOCK_LINKS = 3_000_000
CHUNK = 400_000
PAIR = np.int64(1 << 32)
ROWS = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "links binary, pairs binary, counts binary")
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (in A, in B) of the tokens that end together.

    ``a_ends`` and ``b_ends`` grow strictly; ``a_upto`` and ``b_upto`` count the tokens up to the end of each text, where both end.
    """
    cuts_a, cuts_b = [a_upto - 1], [b_upto - 1]
    # ends strictly inside an interval: A's lo..hi-1 and B's blo..bhi-1; ``step`` counts the probes around the middle
    lo, hi = np.concatenate([[0], a_upto[:-1]]), a_upto - 1
    blo, bhi = np.concatenate([[0], b_upto[:-1]]), b_upto - 1
    step = np.zeros(len(lo), np.int64)
    while True:
        some = (lo < hi) & (blo < bhi) & (step < 2 * (hi - lo))
        if not some.any():
            break
        lo, hi, blo, bhi, step = (x[some] for x in (lo, hi, blo, bhi, step))
        probe = (lo + hi) // 2 + np.where(step & 1, -((step + 1) >> 1), step >> 1)
        inside = (probe >= lo) & (probe < hi)
        end = a_ends[np.where(inside, probe, lo)]
        at = np.searchsorted(b_ends, end)
        hit = inside & (at >= blo) & (at < bhi)
        hit[hit] = b_ends[at[hit]] == end[hit]
        cut, j = probe[hit], at[hit]
        cuts_a.append(cut)
        cuts_b.append(j)
        miss = ~hit
        zero = np.zeros(len(cut), np.int64)
        lo, hi, blo, bhi, step = (np.concatenate(x) for x in (
            (lo[miss], lo[hit], cut + 1), (hi[miss], cut, hi[hit]), (blo[miss], blo[hit], j + 1), (bhi[miss], j, bhi[hit]),
            (step[miss] + 1, zero, zero)))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all entries, start and length of each."""
    lengths = np.fromiter(map(len, entries), np.int64, len(entries))
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes behind each id of a byte-level (.json) or byte-fallback (.model) vocabulary."""
    coder = encoder(path, False)
    if path.endswith(".model"):
        m = coder.model
        return _flat([bytes([int(m.id_to_piece(k)[3:-1], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace("▁", " ").encode()
                      for k in range(m.get_piece_size())])
    # the byte-level alphabet: printable characters stand for themselves, the other bytes for U+0100 on, in order
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    value = {b: b for b in plain} | {0x100 + k: b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    entries = {v: k for k, v in coder.tokenizer.get_vocab(with_added_tokens=True).items()}
    return _flat([bytes(value[ord(c)] for c in entries[k]) if k in entries else b"" for k in range(max(entries) + 1)])


@cache
def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """'k,' for k = 0..n-1."""
    return _flat([b"%d," % k for k in range(n)])


def units(text: str) -> list[str]:
    """Blank + text, cut before blanks that follow no white space into parts of about ``UNIT`` characters."""
    whole, out, lo = " " + text, [], 0
    while len(whole) - lo > UNIT:
        place = re.compile(r"(?<!\s) ").search(whole, lo + UNIT)
        if place is None:
            break
        out.append(whole[lo:place.start()])
        lo = place.start()
    return [*out, whole[lo:]]


class Aligned:
    """Tokens, groups and links of a list of units."""

    def __init__(self, parts: list[str], a_path: str, b_path: str):
        raw = [p.encode() for p in parts]
        data, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        self.good = np.ones(len(parts), bool)
        sides = []
        for path in (a_path, b_path):
            ids, counts = encoder(path, False).encode(parts)
            flat, start, length = token_bytes(path)
            width = length[ids]
            upto = np.cumsum(counts)
            total = np.concatenate([[0], np.cumsum(width)])
            got = total[upto] - total[upto - counts]
            same = got == size
            if same.all():
                differ = flat[ragged(start[ids], width)] != data
                if differ.any():
                    same[np.unique(np.searchsorted(np.cumsum(size), np.flatnonzero(differ), side="right"))] = False
            else:
                for k in np.flatnonzero(same):
                    own = ids[upto[k] - counts[k]:upto[k]]
                    same[k] = flat[ragged(start[own], length[own])].tobytes() == raw[k]
            self.good &= same
            sides.append((ids, counts, width))
        if not self.good.all():  # units with other bytes leave with their tokens
            sides = [(ids[keep], counts[self.good], width[keep]) for ids, counts, width in sides
                     for keep in [np.repeat(self.good, counts)]]
        (self.a, self.n_a, wide_a), (self.b, self.n_b, wide_b) = sides
        if len(self.n_a):
            self.cut_a, self.cut_b = shared_ends(np.cumsum(wide_a), np.cumsum(wide_b), np.cumsum(self.n_a), np.cumsum(self.n_b))
        else:
            self.cut_a = self.cut_b = np.zeros(0, np.int64)
        self.groups_upto = np.searchsorted(self.cut_a, np.cumsum(self.n_a) - 1, side="right")

    def pairs(self) -> np.ndarray:
        """The linked ids of each group, as a * 2^32 + b."""
        return self.a[self.cut_a].astype(np.int64) * PAIR + self.b[self.cut_b]

    def spelled(self):
        """Bytes of ``a1,a2|b1;...`` unit by unit (each ends with ';'): (unit, bytes) in order, a unit in one or more chunks."""
        n_a, n_b = len(self.a), len(self.b)
        value, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        size_a, size_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        place_a = np.arange(n_a) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        place_b = np.arange(n_b) + np.repeat(np.cumsum(size_a), size_b)
        value[place_a], value[place_b] = self.a, self.b
        mark[place_a[self.cut_a]], mark[place_b[self.cut_b]] = ord("|"), ord(";")
        flat, start, length = decimals(1 << 16)
        upto = np.cumsum(self.n_a + self.n_b)
        unit = 0
        for lo in range(0, n_a + n_b, CHUNK):
            own = value[lo:lo + CHUNK]
            width = length[own]
            out, ends = flat[ragged(start[own], width)], np.cumsum(width)
            out[ends - 1] = mark[lo:lo + CHUNK]
            view, done = out.tobytes(), 0
            while unit < len(upto) and upto[unit] <= lo + len(own):
                stop = int(ends[upto[unit] - lo - 1]) if upto[unit] > lo else 0
                yield unit, view[done:stop]
                done, unit = stop, unit + 1
            if done < len(view):
                yield unit, view[done:]


def align_texts(texts: list[str], a_path: str, b_path: str, with_groups: bool):
    """Per text: (n_a, n_b, n_groups, sha256, groups text or None, pairs of its links)."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        if t:
            some = units(t)
            parts += some
            owner += [k] * len(some)
    out = [[0, 0, 0, "", "" if with_groups else None, []] for _ in texts]
    sums = [hashlib.sha256() for _ in texts]
    spelled: list[list[bytes]] = [[] for _ in texts]
    held: dict[int, bytes] = {}  # the last byte of what came so far: the final ';' of a text is not part of it
    bad = set()
    for lo, hi in slices(parts, 2 * UNIT):
        found, own = Aligned(parts[lo:hi], a_path, b_path), np.array(owner[lo:hi])
        bad.update(own[~found.good].tolist())
        own = own[found.good].tolist()
        for unit, chunk in found.spelled():
            k = own[unit]
            if chunk:
                chunk = held.pop(k, b"") + chunk
                sums[k].update(chunk[:-1])
                held[k] = chunk[-1:]
                if with_groups:
                    spelled[k].append(chunk[:-1])
        pairs, before = found.pairs(), 0
        for unit, k in enumerate(own):
            upto = int(found.groups_upto[unit])
            out[k][0] += int(found.n_a[unit])
            out[k][1] += int(found.n_b[unit])
            out[k][2] += upto - before
            out[k][5].append(pairs[before:upto])
            before = upto
    none = np.zeros(0, np.int64)
    for k in bad:
        out[k] = [0, 0, 0, "", "" if with_groups else None, []]
    for row in out:
        row[5] = np.concatenate([none, *row[5]])
    for row, h, text in zip(out, sums, spelled):
        if row[0]:
            row[3] = h.hexdigest()
            if with_groups:
                row[4] = b"".join(text).decode()
    return out


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """The alignment of every row of ``docs`` (doc_id, text), written: rows of documents, and one row per block with its pairs."""
    def run(batches):
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        ids, rows, links = [], [], 0

        def close():
            lengths = [len(r[5]) for r in rows]
            pairs, local, counts = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
            local = local.astype(np.uint32)
            ends = np.cumsum(lengths)
            own = [local[e - n:e].tobytes() for e, n in zip(ends.tolist(), lengths)]
            cols = [list(c) for c in zip(*[r[:5] for r in rows])]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (n + 1), pa.int64()), pa.array(ids + [None], pa.int64()), *(pa.array(c + [None], pa.int64()) for c in cols[:3]),
                 pa.array(lengths + [None], pa.int64()), pa.array(cols[3] + [None], pa.string()), pa.array(cols[4] + [None], pa.string()),
                 pa.array(own + [None], pa.binary()), pa.array([None] * n + [pairs.tobytes()], pa.binary()),
                 pa.array([None] * n + [counts.astype(np.int64).tobytes()], pa.binary())], names=[c.split()[0] for c in ROWS.split(", ")])

        for b in batches:
            for lo, hi, texts in text_slices(b.column("text")):
                found = align_texts(texts, a_path, b_path, with_groups)
                ids += b.column("doc_id").slice(lo, hi - lo).to_pylist()
                rows += found
                links += sum(len(r[5]) for r in found)
                if links > BLOCK_LINKS or len(rows) > 20_000:
                    yield from close()
                    ids, rows, links, block = [], [], 0, block + 1
        if rows:
            yield from close()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(read.mapInArrow(run, ROWS), "aligned")


def block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, at, pair, n): the distinct pairs of each block and how many links hold them there."""
    def run(b):
        for block, pairs, counts in zip(*(b.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
            pairs, counts = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(np.arange(len(pairs))), pa.array(pairs), pa.array(counts)],
                                             names=["block", "at", "pair", "n"])
    return map_arrow(aligned.where("pairs is not null").select("block", "pairs", "counts"), run, "block long, at long, pair long, n long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair (a * 2^32 + b) in the corpus, and whether no pair of the B id has more; written."""
    counts = stage(block_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))
    return stage(counts.withColumn("b", b_id).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pair-best")


def linked_ids(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best) of every id pair linked anywhere."""
    return pair_counts(aligned).select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"),
                                       F.col("count").alias("links"), "best")


def score_links(aligned: DataFrame) -> DataFrame:
    """Every document of ``aligned`` with n_best and count_sum over its links."""
    asked = block_pairs(aligned).drop("n").join(pair_counts(aligned), "pair").select("block", "at", "count", "best")
    docs = aligned.where("pairs is null").drop("pairs", "counts")

    def add(key, left, right):
        n = right.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = right.column("at").to_numpy()
        count[at] = right.column("count").to_numpy()
        best[at] = right.column("best").to_numpy()
        own = [np.frombuffer(x, np.uint32) for x in left.column("links").to_pylist()]
        sums = [pa.array([int(v[x].sum()) for x in own], pa.int64()) for v in (best, count)]
        return pa.table([left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + sums
                        + [left.column(c) for c in ("groups_sha256", "groups")], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(add, OUT)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text)."""
    return score_links(align(docs, a_path, b_path)).drop("groups")
