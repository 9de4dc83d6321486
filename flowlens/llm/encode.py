"""Token ids of whole texts by the tokenizers library, with the ids of pieces remembered.

Both vocabularies used here split a text before they merge anything: always between a word of
letters and the punctuation after it, and always before a blank or line break that follows another
character. A text is therefore cut into pieces at such places (numpy over code points), each distinct
piece is encoded once by the library, and the ids of the text are those of its pieces in order. Pieces
are known by two independent 64-bit hashes. A text with white space other than blanks and line breaks, or with
the string of a special token that the library is to find, is encoded whole. The memory is emptied when it is
full (``MAX_PIECES``), which costs time and changes no id.

``encoder(path)`` gives the ids of the library as it loads the file; ``encoder(path, specials=False)`` takes special-token
strings as ordinary text; ``encoder(path)`` of a ``.model`` file is the sentencepiece library.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

from flowlens.llm.common import ragged

MAX_PIECES = 1_200_000
SLOTS = 1 << 22
SEPARATOR = "\U0010ffff"
ODD = rf"[^\S \n]|{SEPARATOR}"
MARKS = ".,;:!?|%&*$#"
SPACE, LETTER, MARK, OTHER, CUT = range(5)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


@cache
def kinds() -> np.ndarray:
    """Kind of each code point; letters are those up to U+024F, of which all are in the Unicode class L."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x250):
        if chr(cp).isalpha():
            out[cp] = LETTER
    out[[ord(c) for c in MARKS]] = MARK
    out[[ord(" "), ord("\n")]] = SPACE
    out[ord(SEPARATOR)] = CUT
    return out


class _Powers:
    """Powers of the hash bases and of their inverses modulo 2^64."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 19)
            one = np.ones(1, np.uint64)
            self.tables = [tuple(np.concatenate([one, np.cumprod(np.full(self.n, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
                           for base in BASES]
        return self.tables


POWERS = _Powers()


class PieceEncoder:
    def __init__(self, path: str, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        if not specials:
            self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        found = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.odd = re.compile("|".join([ODD, *map(re.escape, found)]))
        bare, led = self.library(["a", " a"])
        self.keep_space = bare != led  # whether a blank belongs to the word after it
        self.reset()

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def reset(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        self.n, self.used = 0, 0
        self.hash = np.zeros((2, 1 << 16), np.uint64)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece (two hashes), -1 if it is not known."""
        out = np.full(h.shape[1], -1, np.int64)
        at = np.arange(h.shape[1])
        slot = (h[0] >> np.uint64(42)).astype(np.int64)
        while len(at):
            i = self.slots[slot]
            hit = (i >= 0) & (self.hash[0][i] == h[0][at]) & (self.hash[1][i] == h[1][at])
            out[at[hit]] = i[hit]
            go = (i >= 0) & ~hit
            at, slot = at[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        ids = self.library(pieces)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(ids), int(lengths.sum())
        while self.n + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)], axis=1)
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        new = np.arange(self.n, self.n + n)
        self.starts[new], self.lengths[new], self.hash[:, new] = self.used + np.cumsum(lengths) - lengths, lengths, h
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.n, self.used = self.n + n, self.used + total
        slot = (h[0] >> np.uint64(42)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several, the last stays
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & (SLOTS - 1)

    def _cut(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end) of the pieces in order, and the places of the separators."""
        kind = kinds()[cp]
        cuts = np.flatnonzero(kind == CUT)
        word = (kind != SPACE) & (kind != CUT)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        if word[-1]:
            edge = np.concatenate([edge, [len(cp)]])
        first, end = edge[::2], edge[1::2]

        def within(mask):
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            return total[end] - total[first]

        letters = within(kind == LETTER)
        turned = np.zeros(len(cp), bool)
        turned[1:] = (kind[:-1] == MARK) & (kind[1:] == LETTER)
        simple = (letters > 0) & (within(kind == OTHER) == 0) & (within(turned) == 0)
        middle = first + letters
        lead = first
        if self.keep_space:
            before = np.concatenate([[0], end[:-1]])
            k = np.searchsorted(cuts, first)
            lead = np.maximum(before, np.where(k > 0, cuts[k - 1] + 1 if len(cuts) else 0, 0))
            simple &= (lead == first) | ((lead == first - 1) & (cp[lead] == 32))
        two = simple & (middle < end)
        size = 1 + two
        at = np.cumsum(size) - size
        begin, stop = np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()), np.int64)
        begin[at], stop[at] = lead, np.where(two, middle, end)
        begin[at[two] + 1], stop[at[two] + 1] = middle[two], end[two]
        if self.keep_space:  # blanks after the last word of a text
            limit = np.concatenate([cuts, [len(cp)]])
            k = np.searchsorted(end, limit, side="right") - 1
            tail = np.maximum(np.where(k >= 0, end[k] if len(end) else 0, 0), np.concatenate([[0], cuts + 1]))
            some = tail < limit
            if some.any():
                put = np.searchsorted(begin, tail[some])
                begin, stop = np.insert(begin, put, tail[some]), np.insert(stop, put, limit[some])
        return begin, stop, cuts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        odd = [k for k, t in enumerate(texts) if self.odd.search(t)]
        left = set(odd)
        plain = texts if not odd else ["" if k in left else t for k, t in enumerate(texts)]
        ids, counts = self._encode(plain)
        if odd:  # these go to the library whole
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, found in zip(odd, self.library([texts[k] for k in odd])):
                parts[k] = np.array(found, np.uint32)
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, counts

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = SEPARATOR.join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, stop, cuts = self._cut(cp)
        value = (cp.astype(np.uint64) + np.uint64(0x632BE59B)) * np.uint64(0x2545F4914F6CDD1D)
        value ^= value >> np.uint64(29)
        h = np.empty((2, len(begin)), np.uint64)
        for row, (up, down) in zip(h, POWERS.upto(len(cp) + 1)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:len(cp)])])
            row[:] = (total[stop] - total[begin]) * down[begin]
            row ^= row >> np.uint64(31)
            row *= np.uint64(0xBF58476D1CE4E5B9)
        if self.n > MAX_PIECES:
            self.reset()
        at = self._find(h)
        while len(lost := np.flatnonzero(at < 0)):
            _, one = np.unique(h[0][lost], return_index=True)
            one = lost[one]
            self._learn(h[:, one], [joined[a:b] for a, b in zip(begin[one].tolist(), stop[one].tolist())])
            at[lost] = self._find(h[:, lost])
        lengths = self.lengths[at].astype(np.int64)
        ids = self.flat[ragged(self.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        upto = ends[np.searchsorted(begin, np.concatenate([cuts, [len(cp)]]))]
        return ids, np.diff(np.concatenate([[0], upto]))


class SentenceEncoder(PieceEncoder):
    """Ids of texts that begin with a blank, by the sentencepiece library, whose own leading blank is that blank.

    No entry of the vocabulary holds a line break, or a blank after another character; so nothing is merged over the
    place before such a blank or on either side of a line break, and pieces are cut there.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("\n" in e or re.search("[^\u2581]\u2581", e) for e in entries):
            raise ValueError("an entry crosses a cut")
        self.odd = re.compile(f"[{SEPARATOR}\u2581]")
        self.blank = self.model.piece_to_id("\u2581")
        self.reset()

    def library(self, texts: list[str]) -> list[list[int]]:
        led = [t.startswith(" ") for t in texts]
        # a text without a leading blank is encoded behind a line break; the two entries before it are dropped
        ids = self.model.encode([t[1:] if s else "\n" + t for t, s in zip(texts, led)], num_threads=1)
        return [[self.blank] if t == " " else x if s else x[2:] for t, s, x in zip(texts, led, ids)]

    def _cut(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = cp == ord(SEPARATOR)
        border = cut | (cp == 10)
        border[0] = True
        border[1:] |= (cp[:-1] == 10) | cut[:-1] | ((cp[1:] == 32) & (cp[:-1] != 32))
        at = np.flatnonzero(border)
        stop = np.append(at[1:], len(cp))
        some = ~cut[at]
        return at[some], stop[some], np.flatnonzero(cut)


def encoder(path: str, specials: bool = True) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    key = path, specials
    if key not in _ENCODERS:
        _ENCODERS[key] = SentenceEncoder(path) if path.endswith(".model") else PieceEncoder(path, specials)
    return _ENCODERS[key]
