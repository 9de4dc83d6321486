"""Suffix dedup (op 3) against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import op3_suffix, registry
from tests.llm.cases import SF, edge_docs, edge_rows, empty_docs, sf_rows

LAST = 1 << 62


def brute(rows, length=50):
    """Sorted result rows; a null id is younger than all others."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            age = LAST if doc is None else doc
            first[w] = min(age, first.get(w, LAST))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (LAST if doc is None else doc):
                gone[s:s + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(doc), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_table_against_brute_force(spark):
    got = result(registry.QUERIES["op3_suffix_dedup"](spark, SF))
    assert got == brute([(d["doc_id"], d["text"]) for d in sf_rows("documents")]) and sum(r[2] for r in got) > 0


def test_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert result(op3_suffix.remove_repeats(edge_docs(spark))) == brute(rows)
    assert op3_suffix.remove_repeats(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("hot", [4_096, 8])
def test_shared_passages_periodic_texts_and_frequent_anchors(spark, hot):
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))

    line, passage = words(12), words(40)
    rows = [(i, words(rng.randint(0, 60)) + (line if rng.random() < 0.7 else "") + words(8) + (passage[rng.randint(0, 40):] if i % 5 == 0 else ""))
            for i in range(120)]
    rows += [(200, "ab" * 300), (201, "x" + "ab" * 200), (202, "a" * 500), (203, "b" + "a" * 120 + "c"), (204, "\x00" * 130), (205, "z" + "\x00" * 70),
             (206, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (3, rows[3][1]), (-7, rows[9][1] + "tail")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op3_suffix.remove_repeats(df, hot=hot, part_bytes=2_000)) == brute(rows)


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, size=(800, 24), dtype=np.uint8)
    rows[:, :14] = rows[rng.integers(0, 6, 800), :14]  # long common prefixes
    rows[700:] = rows[:100]
    group = rng.integers(0, 3, 800)
    for shallow in (1, 2, 3):
        order, new = op3_suffix.deep_shallow(op3_suffix.characters(rows), group, shallow)
        keys = [(int(group[i]), rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(800)]


def test_runs_cover_every_suffix_once():
    text = np.frombuffer(b"the cat sat on the mat and the cat sat on the mat again, and again, and again." * 4, np.uint8)
    lengths = np.array([30, 0, 100, len(text) - 130])
    anchor, first, count = op3_suffix.runs(text, lengths)
    starts = sorted(s + j for s, n in zip(first.tolist(), count.tolist()) for j in range(n))
    assert starts == [*range(30, 81), *range(130, len(text) - 49)]


def test_fragments_are_laid_out_a_slice_at_a_time(monkeypatch):
    """Classes and masks do not depend on the slices, and no slice holds more than its rows and one anchor."""
    rng, sizes, lay = np.random.default_rng(3), [], op3_suffix.fragments
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    first, count = rng.integers(0, 300, 900), rng.integers(1, op3_suffix.RUN + 1, 900)
    anchor, doc = rng.integers(0, 60, 900).astype(np.uint64), rng.integers(0, 9, 900)
    rows = lay(buf, first, count)
    number, member = op3_suffix.classes(rows, anchor, count)
    mask = op3_suffix.resolve(rows, anchor, count, doc)
    monkeypatch.setattr(op3_suffix, "ROWS", 40)
    monkeypatch.setattr(op3_suffix, "fragments", lambda b, f, c: sizes.append(len(f)) or lay(b, f, c))
    got, members = op3_suffix.all_classes(buf, first, count, anchor)
    assert len(members) == len(member) and len(set(zip(number.tolist(), got.tolist()))) == len(member)
    assert (got[members] == np.arange(len(members))).all()
    assert (op3_suffix.resolve_all(buf, first, count, anchor, doc) == mask).all() and mask.any()
    assert max(sizes) < 40 + np.bincount(anchor.astype(int)).max()


def passages(rng, n_bytes, n_lines=400):
    """Documents of (doc_id, text) that share lines, about ``n_bytes`` in all."""
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 120))) for _ in range(n_lines)]
    rows, size = [], 0
    while size < n_bytes:
        text = " ".join(rng.choice(lines) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh ", k=80)) for _ in range(30))
        rows.append((len(rows), text))
        size += len(text)
    return rows


def test_memory_of_a_part_is_its_text_its_runs_and_one_slice():
    """4 MB of text, of which every anchor is in other parts too: under 100 MB at any time (208 MB when hashes and suffixes were laid out whole)."""
    rows = passages(random.Random(5), 4_000_000)
    t = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    tracemalloc.start()
    try:
        for flag in (1, 0):
            part = op3_suffix.Part(t, 1)
            part.mark({0: bytes([flag]) * len(part.keys)})
            gone = part.removed({0: bytes(4 * len(part.sent))})
            assert gone.sum() > 500_000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6, peak


def test_frequent_anchor_is_compared_in_slices(monkeypatch):
    """One anchor with more suffixes than a slice: the same masks, and no more suffixes laid out at a time than a slice and one string's copies."""
    rng, sizes, sort = np.random.default_rng(4), [], op3_suffix.deep_shallow
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    first, count = rng.integers(0, 2900, 400), rng.integers(1, op3_suffix.RUN + 1, 400)
    anchor, doc = np.zeros(400, np.uint64), rng.integers(0, 9, 400)
    rows = op3_suffix.fragments(buf, first, count)
    mask = op3_suffix.resolve(rows, anchor, count, doc)
    monkeypatch.setattr(op3_suffix, "SUFFIXES", 300)
    monkeypatch.setattr(op3_suffix, "deep_shallow", lambda w, g, *x: sizes.append(len(w)) or sort(w, g, *x))
    assert (op3_suffix.resolve(rows, anchor, count, doc) == mask).all() and mask.any()
    assert max(sizes[1:]) < 400 < count.sum()


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_runs_of_chunks_are_the_runs_of_the_whole(monkeypatch, chunk):
    rng = np.random.default_rng(6)
    text = rng.integers(97, 100, 700).astype(np.uint8)
    lengths = np.array([0, 120, 49, 0, 51, 300, 0, 180, 0])

    def each():
        return sorted((s + j, a) for a, s, n in zip(*(x.tolist() for x in op3_suffix.runs(text, lengths))) for j in range(n))

    whole = each()
    monkeypatch.setattr(op3_suffix, "CHUNK", chunk)
    assert each() == whole and len(whole) == sum(max(0, n - 49) for n in lengths.tolist())


def test_packets_hold_the_fragments_whatever_their_batches(monkeypatch):
    rows = passages(random.Random(7), 30_000, 20)
    t = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})

    def packets():
        part = op3_suffix.Part(t, 5)
        part.mark({b: bytes([1 + 2 * (b % 2)]) * int(part.cuts[b + 1] - part.cuts[b]) for b in range(5)})
        got = list(part.packets(3))
        return len(got), pa.concat_tables(got).to_pylist()

    n, whole = packets()
    monkeypatch.setattr(op3_suffix, "PACKET", 1)
    many, single = packets()
    assert (n, many) == (1, 5) and single == whole and {r["bucket"] for r in whole} == set(range(5))
    assert all(len(r["bytes"]) == sum(c + op3_suffix.LENGTH - 1 for c in r["counts"]) and len(r["docs"]) == 8 * len(r["counts"]) for r in whole)
