"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A text is read once as UTF-8 bytes by a table-driven transducer. ``CLASS`` maps a byte to one of five classes, ``NEXT`` a
(state, class) to the next state and ``EMIT`` a (state, class) to output bits: a word starts here, a capital, a code
point (any byte but a continuation), a symbol. Every column of ``NEXT`` is constant, so the state before a byte is a lookup
of the class before it and the pass runs over a whole block of texts at once. The word spans it puts out go into
an open-addressing hash table; a span counts as seen only when length and bytes equal those of the span in the slot.

Filters and their letters: A fewer than ``min_words`` words; B distinct words under ``min_distinct_pct`` per cent of the
words; C capitals over ``max_capital_pct`` per cent of the code points; D any symbol of ``#$%&*|``; E the text equals that of
a smaller doc_id. ``profiles`` gives the figures of each document, ``failures`` the letters that a document fails, and ``audit`` one
row for each part, order and step. A part's documents are reduced to counts per set of failed filters (32 at most)
before orders are laid out beside them, so the orders cost nothing per document.

Memory: a block holds ``BLOCK`` bytes of text; a longer text is read in blocks cut between words, its distinct words kept as
a set. Texts are compared by SHA-256. Copies never meet in one task: the least doc_id of a text is a partial
aggregate, joined back.

Cases: a null or empty text has no words (it fails A, not B, C or D); null and empty texts are equal. A null source is the part ''.
A null doc_id is never smaller nor greater than another, so it neither removes nor is removed by E. Rows with equal doc_id and
text do not remove each other. A label counts once per document whatever the number of its label rows (the greatest
value holds); no label row, or a null one: neither good nor toxic. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, ragged, stage

BLOCK = 1 << 20
LETTERS = "ABCDE"
SPACE, CAPITAL, SYMBOL, CONTINUATION, OTHER = range(5)
START, CAP, POINT, SYM = 1, 2, 4, 8
BETWEEN, WORD = 0, 1
PROFILE = ("doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, "
           "digest binary")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CLASS[byte], NEXT[class] (the same from either state), EMIT[state, class]."""
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = CONTINUATION
    kind[ord("A"):ord("Z") + 1] = CAPITAL
    kind[[ord(c) for c in "#$%&*|"]] = SYMBOL
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    after = np.full(5, WORD, np.uint8)
    after[SPACE] = BETWEEN
    emit = np.zeros((2, 5), np.uint8)
    emit[:, [SPACE, CAPITAL, SYMBOL, OTHER]] |= POINT
    emit[:, CAPITAL] |= CAP
    emit[:, SYMBOL] |= SYM
    emit[BETWEEN, [CAPITAL, SYMBOL, CONTINUATION, OTHER]] |= START
    return kind, after, emit


CLASS, NEXT, EMIT = _tables()
BASE = 0x9E3779B97F4A7C15
_POWER = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """BASE^0..n and its inverses modulo 2^64."""
    if n >= len(_POWER[0]):
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWER[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * BLOCK), b, np.uint64))])
    return _POWER


def utf8_block(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null as empty) and the n + 1 offsets of its texts in them."""
    col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def first_spans(data: np.ndarray, first: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each span is the one that holds its slot: exactly one of all equal (owner, bytes)."""
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(0x632BE59B)) * up[:len(data)])])
    h = (total[end] - total[first]) * down[first] + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bits = max(4, int(2 * len(first)).bit_length())
    slots = np.full(1 << bits, -1, np.int64)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    length = end - first
    holds = np.zeros(len(first), bool)
    at = np.arange(len(first))
    while len(at):
        free = slots[slot] < 0
        slots[slot[free]] = at[free]
        held = slots[slot]
        own = held == at
        holds[at[own]] = True
        like = ~own & (h[held] == h[at]) & (owner[held] == owner[at]) & (length[held] == length[at])
        a, b = at[like], held[like]
        differ = data[ragged(first[a], length[a])] != data[ragged(first[b], length[b])]
        if differ.any():  # equal hashes of different words: those go on to the next slot
            like[np.flatnonzero(like)[np.unique(np.repeat(np.arange(len(a)), length[a])[differ])]] = False
        go = ~own & ~like
        at, slot = at[go], (slot[go] + 1) & ((1 << bits) - 1)
    return holds


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text (words, distinct words, capitals, code points, symbols), and the spans of the distinct words."""
    n = len(offsets) - 1
    kind = CLASS[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = NEXT[kind[:-1]]
    state[offsets[:-1][np.diff(offsets) > 0]] = BETWEEN
    out = EMIT[state, kind]
    first = np.flatnonzero(out & START)
    inside = np.concatenate([kind != SPACE, [False]])
    stops = inside[:-1] & ~inside[1:]
    stops[offsets[1:][np.diff(offsets) > 0] - 1] = inside[:-1][offsets[1:][np.diff(offsets) > 0] - 1]
    end = np.flatnonzero(stops) + 1
    owner = np.searchsorted(offsets, first, side="right") - 1
    holds = first_spans(data, first, end, owner)

    def per_text(places):
        return np.diff(np.searchsorted(places, offsets))

    counts = np.stack([np.bincount(owner, minlength=n), np.bincount(owner[holds], minlength=n), per_text(np.flatnonzero(out & CAP)),
                       np.diff(offsets) - per_text(np.flatnonzero((out & POINT) == 0)), per_text(np.flatnonzero(out & SYM))])
    return counts, first[holds], end[holds]


def scan_long(data: np.ndarray) -> np.ndarray:
    """Counts of one long text, block by block; blocks end at white space (a longer word is taken whole)."""
    total, words, lo = np.zeros(5, np.int64), set(), 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data):
            blanks = np.flatnonzero(CLASS[data[hi:hi + BLOCK]] == SPACE)
            hi = hi + int(blanks[0]) if len(blanks) else min(len(data), hi + BLOCK)
            if len(blanks):
                break
        counts, first, end = scan(data[lo:hi], np.array([0, hi - lo]))
        total += counts[:, 0]
        raw = data[lo:hi].tobytes()
        words.update(raw[a:b] for a, b in zip(first.tolist(), end.tolist()))
        lo = hi
    total[1] = len(words)
    return total


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (5 x texts) of all texts of a batch, in blocks of about ``BLOCK`` bytes."""
    out = np.zeros((5, len(offsets) - 1), np.int64)
    size = np.diff(offsets)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, side="right")) - 1)
        if size[lo] > BLOCK:
            hi = lo + 1
            out[:, lo] = scan_long(data[offsets[lo]:offsets[hi]])
        else:
            out[:, lo:hi] = scan(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])[0]
        lo = hi
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """Figures of every row of ``docs`` (doc_id, text, source): words, distinct words, capitals, code points, symbols, SHA-256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))

    def run(b):
        data, offsets = utf8_block(b.column("text"))
        counts = text_counts(data, offsets)
        view = memoryview(data)
        digest = [hashlib.sha256(view[lo:hi]).digest() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), *map(pa.array, counts), pa.array(digest, pa.binary())],
                                         names=[c.split()[0] for c in PROFILE.split(", ")])

    return map_arrow(rows, run, PROFILE)


def failures(docs: DataFrame, min_words: int = 200, min_distinct_pct: int = 50, max_capital_pct: int = 2) -> DataFrame:
    """(doc_id, part, fails): the filters that each row of ``docs`` fails, bit k for letter k of ABCDE."""
    found = profiles(docs)
    fails = (F.when(F.col("n_words") < min_words, 1).otherwise(0)
             + F.when(100 * F.col("n_distinct") < min_distinct_pct * F.col("n_words"), 2).otherwise(0)
             + F.when(100 * F.col("n_capitals") > max_capital_pct * F.col("n_points"), 4).otherwise(0)
             + F.when(F.col("n_symbols") > 0, 8).otherwise(0))
    rows = stage(found.select("doc_id", "part", fails.cast("int").alias("alone"), "digest"), "audit-rows")
    copies = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("digest", "least"), "audit-copies")
    return rows.join(copies, "digest", "left").select(
        "doc_id", "part", (F.col("alone") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("fails"))


def fail_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents of ``failed`` per part and set of failed filters."""
    flags = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic")))
    some = flags.where("is_good + is_toxic > 0")
    return (failed.join(some, "doc_id", "left").groupBy("part", "fails")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("is_good"), F.lit(0)).alias("good"),
                 F.coalesce(F.sum("is_toxic"), F.lit(0)).alias("toxic")))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from ``fail_counts``.

    A document that fails k filters is removed by each of them in 120 / k of the orders.
    """
    orders = " ".join("".join(p) for p in permutations(LETTERS))
    laid = counts.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    laid = laid.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def letter_bit(k):
        return F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", k, F.lit(1))) - ord(LETTERS[0]))

    earlier = F.lit(0)
    for k in range(1, len(LETTERS)):
        earlier = earlier + F.when(F.col("step") > k, letter_bit(F.lit(k))).otherwise(0)
    laid = laid.select("*", letter_bit(F.col("step")).alias("bit"), earlier.alias("earlier"))

    own, before = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("earlier")) != 0

    def total(value, keep, name):
        return F.sum(F.when(keep, F.col(value)).otherwise(0)).cast("long").alias(name)

    share = F.col("n") * (F.lit(120) / F.bit_count("fails")).cast("long")
    return laid.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total("n", ~own & ~before, "kept"), total("n", own & ~before, "removed"), total("n", own & before, "redundant"),
        total("n", F.col("fails") == F.col("bit"), "unique_fails"), total("good", own & ~before, "good_lost"),
        total("toxic", own & ~before, "toxic_lost"), F.sum(F.when(own, share).otherwise(0)).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, min_words: int = 200, min_distinct_pct: int = 50, max_capital_pct: int = 2) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``docs``."""
    return interactions(stage(fail_counts(failures(docs, min_words, min_distinct_pct, max_capital_pct), labels), "audit-counts"))


SQL = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') words from d),
f as (select doc_id, part,
        (case when len(words) < 200 then 1 else 0 end)
      + (case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end)
      + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
      + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
      + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) fails
      from w),
g as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
c as (select part, fails, count(*) n, coalesce(sum(good), 0) good, coalesce(sum(toxic), 0) toxic from f left join g using (doc_id) group by part, fails),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits
      from x a join x b on b.bit <> a.bit join x c on c.bit not in (a.bit, b.bit) join x d on d.bit not in (a.bit, b.bit, c.bit)
      join x e on e.bit not in (a.bit, b.bit, c.bit, d.bit)),
s as (select filter_order, k step, bits[k] bit, coalesce(list_sum(bits[1:k - 1]), 0)::int earlier from o, (values (1), (2), (3), (4), (5)) v(k)),
l as (select part, filter_order, step, n, good, toxic, (fails & bit) <> 0 own, (fails & earlier) <> 0 before, fails = bit single, bit_count(fails::int) k from c, s)
select part, filter_order, step::int step, sum(case when not own and not before then n else 0 end)::bigint kept,
  sum(case when own and not before then n else 0 end)::bigint removed, sum(case when own and before then n else 0 end)::bigint redundant,
  sum(case when single then n else 0 end)::bigint unique_fails, sum(case when own and not before then good else 0 end)::bigint good_lost,
  sum(case when own and not before then toxic else 0 end)::bigint toxic_lost, sum(case when own then n * (120 // k) else 0 end)::bigint shapley
from l group by part, filter_order, step
"""
