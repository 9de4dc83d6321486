"""Licence scan: matching statistics of whole texts against a generalised suffix automaton of licence tokens, chained into spans.

All templates (the base phrases and the notices) are token sequences in one suffix automaton. The words of a text stream through it:
after each word, the state and the length of the longest run of words ending there that occurs in some template. From these
come (a) the base places: a phrase ends at a word when its state is the reached one, long enough, or lies above it on the suffix
links; (b) the long matches: lengths of ``MIN_MATCH`` words or more that the next word does not extend, with all their
occurrences in notices. Matches of one notice that lie in order in text and notice, at most ``GAP`` words apart in either, are chained;
a chain is a span when it covers ``MIN_SHARE`` of the notice's words and at least ``MIN_COVER`` of them (all of a shorter notice).

The score of a document is the largest share of a notice that one of its spans covers, and at least 0.5 when a base phrase occurs.

Words outside the templates end every match, so only runs of template words are streamed: the first ``STEPS`` words of all runs of a
block side by side, the rest of a longer run word by word. The automaton is built in each task from the templates and is linear in
their words. Word numbers of a long text are found block by block; only those (four bytes a word) are held whole.

Cases: a null or empty text has no words, places or labels, and score 0. Overlapping places all count; of equally good chains the one
ending first holds its words, and two spans of a notice share no match. Repeated rows and null doc_ids are rows like others. An empty table
gives no row. Extra columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, ragged
from flowlens.llm.op12_filters import utf8_block

BLOCK = 1 << 20
MIN_MATCH, GAP, MIN_SHARE, MIN_COVER = 4, 6, 0.5, 8
STEPS = 64
PHRASE_SCORE = 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# The usual notices of public licences (label, text).
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
SPAN = "struct<label:string,notice:int,first_word:long,last_word:long,covered:int,share:double>"
ROWS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        f"spans array<{SPAN}>")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Automaton:
    """Generalised suffix automaton of word-number sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[int]] = []  # the states of each sequence's prefixes
        for words in sequences:
            state, path = 0, []
            for w in words:
                state = self._extend(state, w)
                path.append(state)
            self.ends.append(path)

    def _new(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, w: int) -> int:
        """The target of ``w`` from ``state``, as a state whose longest string is just one word longer than that of ``state``."""
        old, size = self.next[state][w], self.length[state] + 1
        if self.length[old] == size:
            return old
        twin = self._new(size, self.link[old], dict(self.next[old]))
        self.link[old] = twin
        while state >= 0 and self.next[state].get(w) == old:
            self.next[state][w] = twin
            state = self.link[state]
        return twin

    def _extend(self, state: int, w: int) -> int:
        if w in self.next[state]:
            return self._split(state, w)
        new = self._new(self.length[state] + 1, 0, {})
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, w)
        return new

    def walk(self, state: int, length: int, words: list[int]) -> tuple[list[int], list[int]]:
        """State and matched length after each word."""
        states, lengths = [], []
        step, link, longest = self.next, self.link, self.length
        for w in words:
            while w not in step[state] and state:
                state = link[state]
                length = longest[state]
            if w in step[state]:
                state, length = step[state][w], length + 1
            states.append(state)
            lengths.append(length)
        return states, lengths


class Scanner:
    """The automaton of phrases and notices, and what follows from its states."""

    def __init__(self, phrases, notices):
        self.phrases, self.notices = phrases, notices
        texts = [re.findall(WORD, lower(t)) for t, _ in phrases] + [re.findall(WORD, lower(t)) for _, t in notices]
        if not all(texts):
            raise ValueError("a template without words")
        self.vocabulary = sorted({w for t in texts for w in t})
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        auto = self.auto = Automaton([[number[w] for w in t] for t in texts])
        self._index_words()
        n, wide = len(auto.length), len(number) + 1
        self.wide = wide
        steps = sorted((s * wide + w, t) for s in range(n) for w, t in auto.next[s].items())
        self.keys, self.targets = np.array([k for k, _ in steps], np.int64), np.array([t for _, t in steps], np.int64)
        self.link, self.longest = np.array(auto.link, np.int64), np.array(auto.length, np.int64)
        by_length = sorted(range(n), key=auto.length.__getitem__)
        # phrases: above[p] marks the states strictly below the phrase's own state on the suffix links
        self.phrase_size = [len(t) for t in texts[:len(phrases)]]
        self.phrase_state = [path[-1] for path in auto.ends[:len(phrases)]]
        self.below = np.zeros((len(phrases), n), bool)
        for s in by_length[1:]:
            up = auto.link[s]
            self.below[:, s] = self.below[:, up] | (np.array(self.phrase_state) == up)
        # notices: occurrences (notice, end) of each state long enough
        self.notice_size = [len(t) for t in texts[len(phrases):]]
        self.occurs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, path in enumerate(auto.ends[len(phrases):]):
            for end, s in enumerate(path):
                while auto.length[s] >= MIN_MATCH:
                    self.occurs[s].append((k, end))
                    s = auto.link[s]

    def _index_words(self) -> None:
        raw = [w.encode() for w in self.vocabulary]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.word_end = np.cumsum(size)
        self.word_data, self.word_size = data, size
        head, tail = ends_of(data, self.word_end - size, self.word_end)
        key = word_key(head, tail, size)
        order = np.argsort(key)
        self.key, self.order = key[order], order
        self.head, self.tail = head, tail
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two template words share a key")

    def word_numbers(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word (span of lower-cased bytes) in the vocabulary, 0 if it is not there."""
        head, tail = ends_of(data, first, end)
        key = word_key(head, tail, end - first)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        some = np.flatnonzero(self.key[at] == key)
        word = self.order[at[some]]
        same = (self.head[word] == head[some]) & (self.tail[word] == tail[some]) & (self.word_size[word] == (end - first)[some])
        some, word = some[same], word[same]
        big = np.flatnonzero(self.word_size[word] > 16)  # up to 16 bytes the first and last eight are the word
        if len(big):
            size = self.word_size[word[big]]
            differ = data[ragged(first[some[big]], size)] != self.word_data[ragged(self.word_end[word[big]] - size, size)]
            wrong = big[np.unique(np.repeat(np.arange(len(big)), size)[differ])]
            some, word = np.delete(some, wrong), np.delete(word, wrong)
        out = np.zeros(len(first), np.int32)
        out[some] = word + 1
        return out

    def statistics(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and matched length after each word; ``starts``: the first word of each text."""
        state, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = words > 0
        fresh = np.zeros(len(words) + 1, bool)
        fresh[starts] = True
        fresh = fresh[:-1]
        begin = known & (fresh | ~np.concatenate([[False], known[:-1]])) if len(words) else known
        first = np.flatnonzero(begin)
        stop = known & np.concatenate([begin[1:] | ~known[1:], [True]]) if len(words) else known
        size = np.flatnonzero(stop) + 1 - first
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        now, have = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for j in range(min(STEPS, int(size[0]) if len(size) else 0)):
            n = int(np.searchsorted(-size, -j, side="left"))  # runs longer than j
            s, m, w = now[:n], have[:n], words[first[:n] + j].astype(np.int64)
            at = np.arange(n)
            new_s, new_m = np.zeros(n, np.int64), np.zeros(n, np.int64)
            while len(at):
                key = s * self.wide + w
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                new_s[at[hit]], new_m[at[hit]] = self.targets[k[hit]], m[hit] + 1
                go = ~hit & (s > 0)
                at, s, w = at[go], self.link[s[go]], w[go]
                m = self.longest[s]
            now[:n], have[:n] = new_s, new_m
            state[first[:n] + j], length[first[:n] + j] = new_s, new_m
        for k in range(int(np.searchsorted(-size, -STEPS, side="left"))):
            a, b = int(first[k]) + STEPS, int(first[k] + size[k])
            state[a:b], length[a:b] = self.auto.walk(int(now[k]), int(have[k]), words[a:b].tolist())
        return state, length

    def places(self, state: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every base place."""
        some = np.flatnonzero(length > 1) if min(self.phrase_size, default=2) > 1 else np.flatnonzero(length > 0)
        s, m = state[some], length[some]
        first, which = [], []
        for p, size in enumerate(self.phrase_size):
            hit = some[self.below[p][s] | ((s == self.phrase_state[p]) & (m >= size))]
            first.append(hit - size + 1)
            which.append(np.full(len(hit), p))
        return (np.concatenate(first), np.concatenate(which)) if first else (np.zeros(0, np.int64),) * 2

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int, float]]:
        """Spans (label, notice, first word, last word, covered, share) from the long matches (last word, length, state) of one text, in order."""
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for last, size, state in matches:
            for notice, end in self.occurs[state]:
                seeds.setdefault(notice, []).append((last, end, size))
        out = []
        for notice, own in sorted(seeds.items()):
            whole = self.notice_size[notice]
            own.sort()
            best: list[tuple[int, int]] = []  # (words covered, previous seed) of the best chain that ends in each seed
            for i, (last, end, size) in enumerate(own):
                top = (size, -1)
                j = i - 1
                while j >= 0 and last - own[j][0] <= size + GAP:
                    gain = min(size, last - own[j][0], end - own[j][1])
                    if gain > 0 and end - own[j][1] <= size + GAP and best[j][0] + gain > top[0]:
                        top = (best[j][0] + gain, j)
                    j -= 1
                best.append(top)
            used = set()
            for i in sorted(range(len(own)), key=lambda i: (-best[i][0], own[i])):
                covered, chain, j = best[i][0], [], i
                while j >= 0 and j not in used:
                    chain.append(j)
                    j = best[j][1]
                if j >= 0:  # the chain runs into one that is taken: only what lies behind counts
                    covered -= best[j][0]
                if covered >= max(MIN_SHARE * whole, min(whole, MIN_COVER)):
                    used.update(chain)
                    head = own[chain[-1]]
                    out.append((self.notices[notice][0], notice, head[0] - head[2] + 1, own[i][0], covered, min(1.0, covered / whole)))
        return sorted(out, key=lambda x: (x[2], x[1]))


def ends_of(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each span as numbers (the last: 0 for spans under eight bytes)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    size = np.minimum(end - first, 8)
    head = eight[first] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - size).astype(np.uint64)))
    long = end - first >= 8
    return head, np.where(long, eight[np.where(long, end - 8, 0)], np.uint64(0))


def word_key(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    key = head * np.uint64(0x9E3779B97F4A7C15) ^ (tail + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


@cache
def lower_word_bytes() -> np.ndarray:
    """Byte -> its lower case if it is part of a word, else 0."""
    out = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


@cache
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(phrases, notices)


def words_of(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a block of texts, and how many words each text has."""
    low = lower_word_bytes()[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    first = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    end = np.flatnonzero(inside & ~after) + 1
    return scan.word_numbers(low, first, end), np.diff(np.searchsorted(first, offsets))


def long_words(scan: Scanner, data: np.ndarray) -> np.ndarray:
    """Word numbers of one long text, block by block; blocks end outside words (a longer word is taken whole)."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data):
            gaps = np.flatnonzero(lower_word_bytes()[data[hi:hi + BLOCK]] == 0)
            hi = hi + int(gaps[0]) if len(gaps) else min(len(data), hi + BLOCK)
            if len(gaps):
                break
        out.append(words_of(scan, data[lo:hi], np.array([0, hi - lo]))[0])
        lo = hi
    return np.concatenate(out)


def scan_texts(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(n_words, n_base, first, last, base labels, labels, score, spans) of each text."""
    size, found, counts, lo = np.diff(offsets), [], [], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, side="right")) - 1)
        if size[lo] > BLOCK:
            hi = lo + 1
            found.append(long_words(scan, data[offsets[lo]:offsets[hi]]))
            counts.append([len(found[-1])])
        else:
            words, n = words_of(scan, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            found.append(words)
            counts.append(n)
        lo = hi
    words, counts = np.concatenate(found), np.concatenate(counts)
    base = np.cumsum(counts) - counts
    state, length = scan.statistics(words, base)
    place, which = scan.places(state, length)
    owner = np.searchsorted(base + counts, place, side="right")
    places: dict[int, list[tuple[int, int]]] = {}
    for k, p, w in zip(owner.tolist(), place.tolist(), which.tolist()):
        places.setdefault(k, []).append((p - int(base[k]), w))
    last = np.append(length[1:], 0)
    ends = np.zeros(len(length) + 1, bool)
    ends[base + counts] = True
    peak = np.flatnonzero((length >= MIN_MATCH) & ((last <= length) | ends[1:]))
    owner = np.searchsorted(base + counts, peak, side="right")
    matches: dict[int, list[tuple[int, int, int]]] = {}
    for k, p, m, s in zip(owner.tolist(), peak.tolist(), length[peak].tolist(), state[peak].tolist()):
        matches.setdefault(k, []).append((p - int(base[k]), m, s))
    out = []
    for k, n in enumerate(counts.tolist()):
        own = places.get(k, [])
        spans = scan.spans(matches[k]) if k in matches else []
        base_labels = {scan.phrases[w][1] for _, w in own}
        score = max([x[5] for x in spans] + [PHRASE_SCORE if own else 0.0])
        out.append((n, len(own), min(own)[0] if own else None, max(own)[0] if own else None, ",".join(sorted(base_labels)),
                    ",".join(sorted(base_labels | {x[0] for x in spans})), score, spans))
    return out


def scan_documents(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of ``docs`` (doc_id, text)."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    fields = [f.split(":")[0] for f in SPAN[7:-1].split(",")]
    span_type = pa.list_(pa.struct(list(zip(fields, [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]))))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]

    def run(b):
        data, offsets = utf8_block(b.column("text"))
        found = scan_texts(scanner(phrases, notices), data, offsets)
        cols = [[r[k] for r in found] for k in range(7)] + [[[dict(zip(fields, x)) for x in r[7]] for r in found]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, ROWS)
