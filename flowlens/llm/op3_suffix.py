"""Exact removal of repeated 50-byte strings by sorting suffixes, deep-shallow.

Every suffix counts up to ``LENGTH`` bytes. To sort only what can repeat, suffixes are gathered by an anchor: the
least hash among the ``GRAM``-byte strings inside their first ``LENGTH`` bytes (equal strings have equal anchors).
Consecutive suffixes with the same anchor are one run; a run of w suffixes is a fragment of w + LENGTH - 1 bytes.

1. Each part (documents by hash of doc_id, about ``PART_BYTES``) sends its distinct anchors to anchor buckets, which
   answer whether an anchor occurs in other parts and whether it is frequent (more than ``HOT`` runs).
2. For anchors that do, the part sends its distinct fragments with the least doc_id that holds each; for a frequent
   anchor it sends the suffixes themselves, by their own hash, so that no anchor meets in one task.
3. A bucket sorts the fragments, then the suffixes of fragments that share an anchor and differ, and answers for each
   fragment which of its suffixes start in an earlier document.
4. The part marks the bytes of those suffixes and hashes what is left.

The sort (``deep_shallow``) takes 8 bytes as one character: multikey partitioning, one character at a time, to depth
``SHALLOW``; groups that still agree go to blind tries, which look only at the character where a group branches and skip
what all its members share. Steps 1 to 4 are one plan; the documents are shuffled once and the exchange is reused.

A task holds its text, its runs (about one for 14 bytes of text) and what it sends; all else is made a slice at a time: hashes of
``CHUNK`` suffixes, ``ROWS`` fragments (whole anchors together), ``SUFFIXES`` suffixes of fragments, packets of ``PACKET`` bytes.

Cases: a null text is empty (nothing to remove, hash of no bytes); texts shorter than ``LENGTH`` lose nothing; a null
doc_id comes after all others; rows with the same doc_id are the same age and do not remove each other; an empty table
gives no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import buckets, ragged
from flowlens.llm.letters import rolling

LENGTH = 50
GRAM = 24
PART_BYTES = 16_000_000
HOT = 4_096
SHALLOW = 2
RUN = 32  # suffixes of a run at most (longer ones, in periodic texts, are cut)
WIDTH = 88  # bytes of the longest fragment, filled to whole characters
LAST = (1 << 63) - 1
FULL = np.uint32(0xFFFFFFFF)
CHUNK = 500_000  # suffixes hashed at a time
ROWS = 16_000  # fragments laid out at a time
SUFFIXES = 50_000  # suffixes laid out at a time
PACKET = 16_000_000  # bytes of fragments in one batch


def deep_shallow(words: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows of ``words`` sorted inside their groups; new[i] is true where row order[i] differs from the one before."""
    n, depth = words.shape
    order = np.lexsort((words[:, 0], group))
    g, w = group[order], words[order, 0]
    new = np.ones(n, bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])

    def tied(open_rows):
        segment = np.cumsum(new) - 1
        return np.flatnonzero((np.bincount(segment)[segment] > 1) & open_rows), segment

    def split(at, segment, w):
        o = np.lexsort((w, segment))
        order[at] = order[at][o]
        w = w[o]
        new[at[1:]] |= (segment[1:] == segment[:-1]) & (w[1:] != w[:-1])

    open_rows = np.ones(n, bool)
    for level in range(1, min(shallow, depth)):
        at, segment = tied(open_rows)
        if not len(at):
            return order, new
        split(at, segment[at], words[order[at], level])
    while True:  # blind tries, one branching per round
        at, segment = tied(open_rows)
        if not len(at):
            return order, new
        s = segment[at]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.concatenate([head, [len(at)]]))
        rows = words[order[at]]
        differs = np.logical_or.reduceat(rows != np.repeat(rows[head], size, axis=0), head, axis=0)
        branches = differs.any(axis=1)
        open_rows[at[np.repeat(~branches, size)]] = False  # all members are equal
        keep = np.repeat(branches, size)
        place = np.repeat(differs.argmax(axis=1), size)
        split(at[keep], s[keep], rows[keep, place[keep]])


def runs(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first suffix, number of suffixes) of the runs of documents that lie one after another in ``buf``, ``CHUNK`` suffixes at a time."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for lo in range(0, len(buf) - LENGTH + 1, CHUNK):
        top = min(lo + CHUNK + LENGTH - 1, len(buf))
        inner = edges[np.searchsorted(edges, lo, side="right") - 1:np.searchsorted(edges, top) + 1]
        anchor, first, count = runs_of(buf[lo:top], np.diff(np.clip(inner, lo, top)))
        found.append((anchor, first + lo, count))
    anchor, first, count = map(np.concatenate, zip(*found))
    return anchor, first, count


def runs_of(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of one chunk of at least ``LENGTH`` bytes."""
    low, have, want = rolling(buf, GRAM), 1, LENGTH - GRAM + 1
    while have * 2 <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < want:
        low = np.minimum(low[:have - want], low[want - have:])
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    valid = doc[:len(low)] == doc[LENGTH - 1:]
    change = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    count = np.diff(np.concatenate([first, [len(low)]]))
    real = valid[first]
    first, count = first[real], count[real]
    pieces = -(-count // RUN)
    k = ragged(np.zeros(len(first), np.int64), pieces)
    first, count = np.repeat(first, pieces) + k * RUN, np.repeat(count, pieces) - k * RUN
    return low[first], first, np.minimum(count, RUN).astype(np.uint8)


def fragments(buf: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes: the bytes of each run, zeros after them."""
    out = np.zeros((len(first), WIDTH), np.uint8)
    size = count + LENGTH - 1
    out[np.arange(WIDTH)[None, :] < size[:, None]] = buf[ragged(first, size)]
    return out


def characters(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte characters in byte order."""
    return rows.view(">u8").astype(np.uint64)


def classes(rows: np.ndarray, anchor: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each fragment, a member of each class); equal anchor, length and bytes."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.concatenate([characters(rows), count.astype(np.uint64)[:, None]], axis=1)
    order, new = deep_shallow(words, anchor)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def resolve(rows: np.ndarray, anchor: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each fragment with its doc_id: bits of the suffixes that also start in a document with a smaller doc_id."""
    if not len(rows):
        return np.zeros(0, np.uint32)
    number, member = classes(rows, anchor, count)
    least = least_of(number, doc, len(member))
    mask = np.zeros(len(member), np.uint32)
    # fragments that share an anchor with a different one: compare their suffixes
    a = anchor[member]  # classes come in the order of anchors
    shared = np.zeros(len(a), bool)
    same = a[1:] == a[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    todo = np.flatnonzero(shared)
    size = count[member[todo]]

    def compare(owner, place, group):
        order, new = deep_shallow(strings(rows.ravel(), member[owner] * WIDTH + place), group)
        first = np.minimum.reduceat(least[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        earlier = order[first < least[owner[order]]]
        np.bitwise_or.at(mask, owner[earlier], np.uint32(1) << place[earlier].astype(np.uint32))

    ends, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < len(todo):
        hi = lo + max(1, int(np.searchsorted(ends[lo:], SUFFIXES + (ends[lo - 1] if lo else 0))))
        hi = int(np.searchsorted(a[todo], a[todo[hi - 1]], side="right"))
        owner, place = np.repeat(todo[lo:hi], size[lo:hi]), ragged(np.zeros(hi - lo, np.int64), size[lo:hi])
        if len(owner) <= 2 * SUFFIXES:
            compare(owner, place, a[owner])
        else:  # a frequent anchor: its suffixes in slices by their own hash
            own = rolling_at(rows.ravel(), member[owner] * WIDTH + place)
            for at in by_anchor(own, SUFFIXES):
                compare(owner[at], place[at], own[at])
        lo = hi
    return np.where(doc > least[number], FULL, mask[number])


def by_anchor(anchor: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Places of about ``limit`` fragments at a time; those with one anchor come together."""
    order = np.argsort(anchor, kind="stable")
    a, lo = anchor[order], 0
    while lo < len(a):
        hi = int(np.searchsorted(a, a[min(lo + limit, len(a)) - 1], side="right"))
        yield np.sort(order[lo:hi])
        lo = hi


def all_classes(buf: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``classes`` of fragments that lie in ``buf``, laid out a slice of anchors at a time."""
    number, members, n = np.empty(len(first), np.int64), [np.zeros(0, np.int64)], 0
    for at in by_anchor(anchor, ROWS):
        own, member = classes(fragments(buf, first[at], count[at]), anchor[at], count[at])
        number[at] = own + n
        members.append(at[member])
        n += len(member)
    return number, np.concatenate(members)


def resolve_all(buf: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``resolve`` of fragments that lie in ``buf``, laid out a slice of anchors at a time."""
    mask = np.zeros(len(first), np.uint32)
    for at in by_anchor(anchor, ROWS):
        mask[at] = resolve(fragments(buf, first[at], count[at]), anchor[at], count[at], doc[at])
    return mask


class Part:
    """Runs of the documents of one part and their distinct anchors by bucket."""

    def __init__(self, table: pa.Table, n_buckets: int):
        text = table.column("text").cast(pa.large_binary())
        order = pc.sort_indices(pa.table({"doc_id": table.column("doc_id"), "text": text}), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.n_buckets = table.column("doc_id").take(order), n_buckets
        self.buf, self.lengths = joined(text.take(order))
        self.ends = np.cumsum(self.lengths)
        self.anchor, self.first, self.count = runs(self.buf, self.lengths)
        self.doc = pc.fill_null(self.ids, LAST).to_numpy()[np.searchsorted(self.ends, self.first, side="right")]
        keys, self.key, self.uses = np.unique(self.anchor, return_inverse=True, return_counts=True)
        bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.keys, self.cuts = keys, np.searchsorted(bucket[self.order], np.arange(n_buckets + 1))

    def anchors(self):
        """(bucket, 40 bits of each distinct anchor, its uses up to 255)."""
        short = (self.keys // np.uint64(self.n_buckets))[self.order]
        uses = np.minimum(self.uses[self.order], 255).astype(np.uint8)
        for b, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
            if hi > lo:
                yield b, np.ascontiguousarray(short[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), uses[lo:hi].tobytes()

    def mark(self, flags: dict[int, bytes]) -> None:
        """Take the buckets' answers and make the distinct fragments to send."""
        flat = np.frombuffer(b"".join(flags[b] for b in sorted(flags)), np.uint8)
        answer = np.zeros(len(self.keys), np.uint8)
        answer[self.order] = flat
        answer = answer[self.key]
        inside = np.flatnonzero((answer == 0) & (self.uses[self.key] > 1))
        self.inside = tuple(x[inside] for x in (self.first, self.count, self.anchor, self.doc))
        del self.keys, self.key, self.uses, self.order
        # runs whose anchor is elsewhere too, distinct ones: whole fragments, or single suffixes of frequent anchors
        sent = np.flatnonzero(answer & 1)
        self.runs = self.first[sent], self.count[sent]
        doc, anchor, frequent = self.doc[sent], self.anchor[sent], answer[sent] == 3
        del self.anchor, self.first, self.count, self.doc, answer
        first, count = self.runs
        self.number, member = all_classes(self.buf, first, count, anchor)
        self.least = least_of(self.number, doc, len(member))
        self.late = doc > self.least[self.number]
        self.whole, self.split = np.flatnonzero(~frequent[member]), np.flatnonzero(frequent[member])
        whole, self.splits = member[self.whole], count[member[self.split]]
        suffix = ragged(first[member[self.split]], self.splits)
        own = rolling_at(self.buf, suffix)
        self.same, one = all_classes(self.buf, suffix, np.ones(len(suffix), np.uint8), own)
        self.first_sent = np.concatenate([first[whole], suffix[one]])
        self.count_sent = np.concatenate([count[whole], np.ones(len(one), np.uint8)])
        self.anchor_sent = np.concatenate([anchor[whole], own[one]])
        self.least_sent = np.concatenate([self.least[self.whole], least_of(self.same, np.repeat(self.least[self.split], self.splits), len(one))])
        bucket = (self.anchor_sent % np.uint64(self.n_buckets)).astype(np.int64)
        self.sent = np.argsort(bucket, kind="stable")
        self.sent_cuts = np.searchsorted(bucket[self.sent], np.arange(self.n_buckets + 1))

    def packets(self, part: int) -> Iterator[pa.Table]:
        """Rows of PACKETS of the distinct fragments, about ``PACKET`` bytes at a time and a bucket at least."""
        m = self.sent
        size = self.count_sent[m] + np.uint8(LENGTH - 1)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        filled = np.flatnonzero(np.diff(self.sent_cuts))
        before = ends[self.sent_cuts[filled]]  # bytes before each bucket
        lo = 0
        while lo < len(filled):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PACKET)))
            cuts = np.append(self.sent_cuts[filled[lo:hi]], self.sent_cuts[filled[hi - 1] + 1])
            c = slice(cuts[0], cuts[-1])
            data = np.empty(ends[cuts[-1]] - ends[cuts[0]], np.uint8)
            for i in range(c.start, c.stop, ROWS):
                j = min(i + ROWS, c.stop)
                data[ends[i] - ends[c.start]:ends[j] - ends[c.start]] = self.buf[ragged(self.first_sent[m[i:j]], size[i:j])]
            yield pa.table({"bucket": filled[lo:hi], "part": np.full(hi - lo, part), "anchors": cut(self.anchor_sent[m[c]].astype("<u8"), cuts - cuts[0]),
                            "counts": cut(self.count_sent[m[c]], cuts - cuts[0]), "docs": cut(self.least_sent[m[c]].astype("<i8"), cuts - cuts[0]),
                            "bytes": cut(data, ends[cuts] - ends[cuts[0]])})
            lo = hi

    def removed(self, masks: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the part go."""
        answer = np.zeros(len(self.sent), np.uint32)
        answer[self.sent] = np.frombuffer(b"".join(masks[b] for b in sorted(masks)), "<u4")
        mask = np.zeros(len(self.least), np.uint32)
        mask[self.whole] = answer[:len(self.whole)]
        # frequent anchors: a fragment's suffix goes if it is known from an earlier document here or elsewhere
        owner = np.repeat(self.split, self.splits)
        single = len(self.whole) + self.same
        place = ragged(np.zeros(len(self.split), np.int64), self.splits).astype(np.uint32)
        gone = (answer[single] != 0) | (self.least[owner] > self.least_sent[single])
        np.bitwise_or.at(mask, owner[gone], np.uint32(1) << place[gone])
        sent = np.where(self.late, FULL, mask[self.number])
        local = resolve_all(self.buf, *self.inside)
        step = np.zeros(len(self.buf) + 1, np.int8)  # a byte lies in LENGTH suffixes at most
        for first, count, bits in ((*self.runs, sent), (*self.inside[:2], local)):
            all_of = bits == FULL
            np.add.at(step, first[all_of], 1)
            np.add.at(step, first[all_of] + count[all_of] - 1 + LENGTH, -1)
            partly = np.flatnonzero(~all_of & (bits != 0))
            for some in np.split(partly, range(ROWS, len(partly), ROWS)):
                place = ragged(np.zeros(len(some), np.int64), count[some])
                at = np.repeat(first[some], count[some]) + place
                at = at[(np.repeat(bits[some], count[some]) >> place.astype(np.uint32)) & np.uint32(1) == 1]
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
        return np.cumsum(step[:-1], dtype=np.int8) > 0


def least_of(number: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Least doc_id of each of n classes."""
    least = np.full(n, LAST)
    np.minimum.at(least, number, doc)
    return least


def strings(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of the LENGTH bytes from each place, as characters."""
    out = np.empty((len(first), -(-LENGTH // 8)), np.uint64)
    for lo in range(0, len(first), SUFFIXES):
        rows = np.zeros((len(first[lo:lo + SUFFIXES]), out.shape[1] * 8), np.uint8)
        rows[:, :LENGTH] = buf[first[lo:lo + SUFFIXES][:, None] + np.arange(LENGTH)]
        out[lo:lo + SUFFIXES] = characters(rows)
    return out


def rolling_at(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each place."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(first), SUFFIXES):
        h = np.zeros(len(first[lo:lo + SUFFIXES]), np.uint64)
        for w in strings(buf, first[lo:lo + SUFFIXES]).T:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out.append(h)
    return np.concatenate(out)


def joined(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a binary column one after another, length of each value); null is empty."""
    col = pc.fill_null(pa.chunked_array(col).cast(pa.large_binary()).combine_chunks(), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, cuts, data = col.buffers()
    cuts = np.frombuffer(cuts, "<i8")[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(data or b"", np.uint8)[cuts[0]:cuts[-1]], np.diff(cuts)


def cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` between each two neighbours of ``cuts``; nothing is copied."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype("<i4")), pa.py_buffer(values)])


def _by_bucket(t: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(t.column("bucket").to_pylist(), t.column(column).to_pylist()))


def _table(rows, names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.table({f: pa.array(c, kinds[k]) for (f, k), c in zip(fields, cols)})


ANCHORS = "bucket long, part long, anchors binary, uses binary"
FLAGS = "part long, bucket long, flags binary"
PACKETS = "bucket long, part long, anchors binary, counts binary, docs binary, bytes binary"
MASKS = "part long, bucket long, masks binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def answer_anchors(t: pa.Table, hot: int) -> pa.Table:
    """Flags of every distinct anchor of a bucket: 1 if other parts have it too, 3 if it is frequent as well."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in t.column("anchors").to_pylist()]
    keys = np.zeros((sum(map(len, raw)), 8), np.uint8)
    keys[:, :5] = np.concatenate(raw)
    uses = np.frombuffer(b"".join(t.column("uses").to_pylist()), np.uint8)
    _, number, parts = np.unique(keys.view("<u8").ravel(), return_inverse=True, return_counts=True)
    total = np.bincount(number, uses)
    flags = ((parts > 1).astype(np.uint8) * np.where(total > hot, 3, 1).astype(np.uint8))[number]
    cuts = np.cumsum([len(r) for r in raw])
    return _table([(p, b, f.tobytes()) for p, b, f in zip(t.column("part").to_pylist(), t.column("bucket").to_pylist(), np.split(flags, cuts[:-1]))], FLAGS)


def answer_fragments(t: pa.Table) -> pa.Table:
    """Masks of the fragments of a bucket."""
    anchor, docs = (joined(t.column(c))[0].view(kind) for c, kind in (("anchors", "<u8"), ("docs", "<i8")))
    count, own = joined(t.column("counts"))
    buf, _ = joined(t.column("bytes"))
    size = count.astype(np.int64) + LENGTH - 1
    mask = resolve_all(buf, np.cumsum(size) - size, count, anchor, docs)
    cuts = np.cumsum(own)
    return _table([(p, b, m.astype("<u4").tobytes())
                   for p, b, m in zip(t.column("part").to_pylist(), t.column("bucket").to_pylist(), np.split(mask, cuts[:-1]))], MASKS)


def remove_repeats(docs: DataFrame, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = buckets(docs, "text", part_bytes)
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "part")

    def send_anchors(t: pa.Table) -> pa.Table:
        p = t.column("part")[0].as_py()
        return _table([(b, p, k, u) for b, k, u in Part(t, n).anchors()], ANCHORS)

    def send_fragments(t: pa.Table, flags: pa.Table) -> pa.Table:
        p, part = t.column("part")[0].as_py(), Part(t, n)
        part.mark(_by_bucket(flags, "flags"))
        return pa.concat_tables([_table([], PACKETS), *part.packets(p)])

    def finish(t: pa.Table, flags: pa.Table, masks: pa.Table) -> pa.Table:
        part = Part(t, n)
        part.mark(_by_bucket(flags, "flags"))
        gone = part.removed(_by_bucket(masks, "masks"))
        rows = []
        for doc, size, hi in zip(part.ids.to_pylist(), part.lengths.tolist(), part.ends.tolist()):
            g = gone[hi - size:hi]
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if size else 0
            rows.append((doc, size, int(g.sum()), spans, hashlib.sha256(part.buf[hi - size:hi][~g].tobytes()).hexdigest()))
        return _table(rows, RESULT)

    flags = (dealt.groupBy("part").applyInArrow(send_anchors, ANCHORS)
             .repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: answer_anchors(t, hot), FLAGS)).repartition(n, "part")
    masks = (dealt.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(send_fragments, PACKETS)
             .repartition(n, "bucket").groupBy("bucket").applyInArrow(answer_fragments, MASKS))
    # both answers in one table, so that the last step is one cogroup
    both = flags.select("part", "bucket", "flags", F.lit(None).cast("binary").alias("masks")).unionByName(
        masks.select("part", "bucket", F.lit(None).cast("binary").alias("flags"), "masks"))

    def finish_both(t: pa.Table, answers: pa.Table) -> pa.Table:
        is_mask = answers.column("masks").is_valid()
        return finish(t, answers.filter(answers.column("flags").is_valid()), answers.filter(is_mask))

    return dealt.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(finish_both, RESULT)
