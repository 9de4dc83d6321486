"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to lower-case letters and digits. An item is cut into windows of
at most ``WINDOW`` characters (one every ``STRIDE``); a window of m characters tolerates m / 16 edits. So any
contiguous quote of ``WINDOW + STRIDE - 1`` letters and digits (61) of an item holds a whole window and is found,
wherever it begins; of an item of up to ``WINDOW`` the whole item counts. Text with words replaced is found by what stands between them.
By the lemma a region within e edits of it shares at least m - q + 1 - q * e of its q-grams, and they lie on
diagonals at most e apart. Shared q-grams are counted in overlapping diagonal bands 2 (e + 1) wide, one every
e + 1, so that one band holds all of them; bands that reach the bound are aligned (banded edit distance).

The items are a query set: their distinct windows go to every task in blocks of about ``BLOCK_GRAMS`` characters, one pass over
the documents per block; each pass is written and its broadcast destroyed before the next. A window that many items share (an
opening phrase) is one window; its items are joined to what it matched afterwards. Shared q-grams of windows and text are counted in
slices of windows of at most ``SLICE`` rows, and candidates are aligned side by side.

Cases: null and empty texts match nothing; an item with fewer than q letters and digits is no evidence and matches
nothing; repeated items are separate; repeated documents and null doc_ids are matched like others; an empty table on
either side gives no row. ``matches`` reads no extra columns, ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, ragged, stage, text_slices
from flowlens.llm.letters import lowered, rolling

Q = 10
WINDOW = 50
STRIDE = 12
EDITS_PER = 16
BLOCK_GRAMS = 2_000_000
FILTER_BITS = 22
SLICE = 4_000_000
ALIGNED = 16_384
FOUND = "doc_id long, window string, edits long, start long, end long"


def windows(cp: np.ndarray) -> list[np.ndarray]:
    """Windows of an item's letters and digits."""
    if len(cp) < Q:
        return []
    if len(cp) <= WINDOW:
        return [cp]
    starts = [*range(0, len(cp) - WINDOW, STRIDE), len(cp) - WINDOW]
    return [cp[s:s + WINDOW] for s in starts]


def budget(m: int) -> int:
    """Edits allowed for a window of m characters; the count bound of the lemma stays positive."""
    return max(0, min(m // EDITS_PER, (m - Q) // Q))


class Index:
    """q-grams of a block of distinct windows."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.windows = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        grams = [rolling(w, Q) for w in self.windows]
        h = np.concatenate(grams)
        win = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.keys, which = np.unique(h[order], return_inverse=True)
        self.pos = pos[order]
        self.entry = which * len(grams) + win[order]  # grows: by gram, then by window
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.length = np.array([len(w) for w in self.windows])
        self.edits = np.array([budget(len(w)) for w in self.windows])
        self.need = self.length - Q + 1 - Q * self.edits


_INDEX: dict[str, Index] = {}


def _index(name: str, texts: list[str]) -> Index:
    """The worker's index of a block; the last one is kept."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(texts)
    return _INDEX[name]


def align(patterns: np.ndarray, text: np.ndarray, doc_lo: np.ndarray, doc_hi: np.ndarray, shift: np.ndarray, width: int, most: int):
    """(edits, end) of the best match of each pattern (rows of one length) in its document ``text[doc_lo:doc_hi]`` on the diagonals
    shift..shift + width; edits are most + 1 if above.

    Banded dynamic programme over all pairs at once: row i holds the columns i + shift - most .. i + shift + width + most of the text.
    """
    lo = (shift - most)[:, None]
    cols = np.arange(width + 2 * most + 1)
    big = np.int16(most + 1)
    doc_lo, doc_hi = doc_lo[:, None], doc_hi[:, None]
    at = lo + cols  # column of row 0: a match may begin anywhere in the band
    row = np.where((at >= doc_lo) & (at <= doc_hi), 0, big).astype(np.int16)
    step = cols.astype(np.int16)
    for i in range(patterns.shape[1]):
        at = at + 1
        within = (at >= doc_lo) & (at <= doc_hi)
        same = text[np.clip(at - 1, 0, len(text) - 1)] == patterns[:, i, None]
        best = np.where(within & (at > doc_lo), row + ~same, big)  # a diagonal step keeps its place in the band
        up = np.full_like(row, big + 1)
        up[:, :-1] = row[:, 1:] + 1
        best = np.where(within, np.minimum(best, up), big).astype(np.int16)
        best = np.minimum.accumulate(best - step, axis=1) + step  # steps along the text
        row = np.where(within, np.minimum(best, big), big)
    k = row.argmin(axis=1)
    return row[np.arange(len(row)), k].astype(np.int64), shift - most + k + patterns.shape[1]


def _candidates(index: Index, doc: np.ndarray, hit: np.ndarray, gram: np.ndarray, lo: int, hi: int):
    """(document, window, band) of the bands that reach their window's bound, for windows lo..hi - 1, in slices."""
    n = len(index.windows)
    first, last = (np.searchsorted(index.entry, gram * n + w) for w in (lo, hi))
    count = last - first
    if count.sum() > SLICE and hi - lo > 1:
        yield from _candidates(index, doc, hit, gram, lo, (lo + hi) // 2)
        yield from _candidates(index, doc, hit, gram, (lo + hi) // 2, hi)
        return
    if not count.any():
        return
    entry, where = ragged(first, count), np.repeat(hit, count)
    win, pos = index.entry[entry] % n, index.pos[entry]
    band = (where - pos) // (index.edits[win] + 1)
    # each q-gram of the window counts once in a band, whatever its places there
    key = _packed([np.concatenate([doc[where]] * 2), np.concatenate([win, win]) - lo, np.concatenate([band, band - 1]) + WINDOW + 1,
                   np.concatenate([pos, pos])])
    begin = np.flatnonzero(np.concatenate([[True], np.any(key[:3, 1:] != key[:3, :-1], axis=0)]))
    enough = np.diff(np.concatenate([begin, [key.shape[1]]]))
    d, w, b = key[:3, begin]
    w += lo
    good = enough >= index.need[w]
    yield d[good], w[good], b[good] - WINDOW - 1


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """The distinct rows of the columns (not negative), sorted."""
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    if sum(bits) > 63:
        key = np.stack(columns)
        key = key[:, np.lexsort(key[::-1])]
        return key[:, np.concatenate([[True], np.any(key[:, 1:] != key[:, :-1], axis=0)])]
    one = np.zeros(len(columns[0]), np.int64)
    for c, b in zip(columns, bits):
        one = (one << b) | c
    one = np.unique(one)
    out = []
    for b in reversed(bits):
        out.append(one & ((1 << b) - 1))
        one = one >> b
    return np.stack(out[::-1])


def _find(index: Index, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text number, window, edits, start, end) of the best match of each window in each text; start and end count characters of the text."""
    none = (np.zeros(0, np.int64),) * 5
    cp, lengths = lowered(texts, digits=True)
    kept = np.flatnonzero(cp)
    letters = cp[kept]
    doc = np.repeat(np.arange(len(texts)), lengths)[kept]
    h = rolling(letters, Q)
    if not len(h):
        return none
    hit = np.flatnonzero(index.bits[h >> np.uint64(64 - FILTER_BITS)])
    hit = hit[doc[hit] == doc[hit + Q - 1]]
    gram = np.searchsorted(index.keys, h[hit])
    gram[gram == len(index.keys)] = 0
    real = index.keys[gram] == h[hit]
    hit, gram = hit[real], gram[real]
    if not len(hit):
        return none
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for d, w, band in _candidates(index, doc, hit, gram, 0, len(index.windows)):
        for m in np.unique(index.length[w]):
            some = np.flatnonzero(index.length[w] == m)
            e = budget(int(m))
            for lo in range(0, len(some), ALIGNED):
                k = some[lo:lo + ALIGNED]
                patterns = np.stack([index.windows[x] for x in w[k].tolist()])
                edits, end = align(patterns, letters, first[d[k]], first[d[k] + 1], band[k] * (e + 1), 2 * e + 1, e)
                ok = edits <= e
                for x, y, n, stop in zip(d[k][ok].tolist(), w[k][ok].tolist(), edits[ok].tolist(), end[ok].tolist()):
                    best[x, y] = min(best.get((x, y), (n, stop)), (n, stop))
    if not best:
        return none
    d, w = np.array(list(best)).T
    edits, end = np.array(list(best.values())).T
    base = np.concatenate([[0], np.cumsum(lengths)])
    begin = np.maximum(first[d], end - index.length[w])
    return d, w, edits, kept[begin] - base[d], kept[end - 1] + 1 - base[d]


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window) of every item with evidence, written."""
    def run(b):
        cols = ([], [])
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            cp = lowered([text], digits=True)[0]
            for w in windows(cp[cp != 0]):
                cols[0].append(item)
                cols[1].append(w.tobytes().decode("utf-32-le"))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["item_id", "window"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    return stage(map_arrow(rows, run, "item_id long, window string").distinct(), "windows")


def blocks(shown: DataFrame):
    """(name, broadcast distinct windows) block by block; each broadcast is destroyed when the next is asked for."""
    distinct = shown.select("window").distinct()
    total = distinct.agg(F.sum(F.length("window")).alias("n")).first()["n"] or 0
    n = -(-total // BLOCK_GRAMS)
    for k in range(n):
        part = distinct.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        texts = [r["window"] for r in part.collect()]  # about BLOCK_GRAMS characters
        if texts:
            shared = distinct.sparkSession.sparkContext.broadcast(texts)
            yield uuid.uuid4().hex, shared
            shared.destroy()


def found(docs: DataFrame, shown: DataFrame) -> list[DataFrame]:
    """(doc_id, window, edits, start, end) of the windows' best matches in each document: a written table per block."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = []
    for name, shared in blocks(shown):
        def run(b, name=name, shared=shared):
            index = _index(name, shared.value)
            for lo, _, texts in text_slices(b.column("text")):
                d, w, edits, start, end = _find(index, texts)
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(d + lo)), pa.array([index.texts[k] for k in w.tolist()], pa.string()),
                         pa.array(edits), pa.array(start), pa.array(end)], names=[x.split()[0] for x in FOUND.split(", ")])

        out.append(stage(map_arrow(docs, run, FOUND), "window-matches"))
    return out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, window_chars, start, end): the best matching window of each item in each document."""
    shown = item_windows(items)
    rows = docs.sparkSession.createDataFrame([], FOUND)
    for part in found(docs, shown):
        rows = rows.unionByName(part)
    best = F.min(F.struct("edits", F.negative(F.length("window")).alias("n"), "start", "end")).alias("m")
    return rows.join(shown, "window").groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("m.edits").alias("edits"), F.negative("m.n").cast("long").alias("window_chars"),
        F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; written after each block of windows."""
    for name, shared in blocks(item_windows(items)):
        def run(b, name=name, shared=shared):
            index = _index(name, shared.value)
            for lo, hi, texts in text_slices(b.column("text")):
                bad = set(_find(index, texts)[0].tolist())
                yield b.slice(lo, hi - lo).filter(pa.array([i not in bad for i in range(hi - lo)]))

        docs = stage(map_arrow(docs, run, docs.schema), "clean-documents")
    return docs
