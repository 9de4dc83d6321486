"""Cross-tokenizer alignment (op 13) against the two libraries and plain Python."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from flowlens.llm import op13_alignment, registry
from flowlens.llm.encode import SentenceEncoder
from tests.llm.cases import SF, edge_docs, edge_rows, empty_docs, sf_rows

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
CODER, MODEL = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
CODER.encode_special_tokens = True
VALUES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in VALUES}
BYTE.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in VALUES)})


def a_bytes(k):
    return bytes(BYTE[c] for c in CODER.id_to_token(k))


def b_bytes(k):
    piece = MODEL.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if MODEL.is_byte(k) else piece.replace("▁", " ").encode()


def groups(text):
    """[(A ids, B ids)] between shared ends."""
    if not text:
        return []
    a, b = CODER.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text)
    if b"".join(map(a_bytes, a)) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
        return []
    ends = [np.cumsum([len(f(k)) for k in ids]).tolist() for ids, f in ((a, a_bytes), (b, b_bytes))]
    shared, out, i, j = set(ends[0]) & set(ends[1]), [], 0, 0
    for e in sorted(shared):
        x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def spelled(gs):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)


def brute(rows):
    found = [(d, groups(t)) for d, t in rows]
    counts = Counter((x[-1], y[-1]) for _, gs in found for x, y in gs)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for d, gs in found:
        links = [(x[-1], y[-1]) for x, y in gs]
        out.append((d, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(spelled(gs).encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_alignment_of_the_table(spark):
    assert got(registry.QUERIES["op13_tokenizer_alignment"](spark, SF)) == brute([(r["doc_id"], r["text"]) for r in sf_rows("documents")])


def test_alignment_cases(spark, monkeypatch):
    rows = [r[:2] for r in edge_rows()] + [(30, "a ▁ b"), (31, "<|endoftext|><s></s> <unk>"), (32, "\U0001f600 \U0010ffff x"), (33, " lead  two   three "), (34, "﷽ﬁ\r\n\x85")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(op13_alignment.align_documents(docs, A, B)) == brute(rows)
    assert got(op13_alignment.align_documents(edge_docs(spark), A, B)) == brute([r[:2] for r in edge_rows()])
    assert op13_alignment.align_documents(empty_docs(spark), A, B).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(op13_alignment.align_documents(none, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_and_pairs_come_out_whole(spark):
    rows = [(1, "hello world, hello"), (2, "日本語 text"), (3, None)]
    aligned = op13_alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B, with_groups=True)
    assert {r["doc_id"]: r["groups"] for r in aligned.where("pairs is null").collect()} == {d: spelled(groups(t)) for d, t in rows}
    counts = Counter((x[-1], y[-1]) for _, t in rows for x, y in groups(t))
    assert {(r["a_id"], r["b_id"]): r["links"] for r in op13_alignment.linked_ids(aligned).collect()} == dict(counts)


def test_long_texts_in_units_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op13_alignment, "UNIT", 40)
    monkeypatch.setattr(op13_alignment, "CHUNK", 7)
    texts = ["Some words, \n  and  more\t of them: 12345 <|endoftext|> ééé " * 20, "x" * 200 + " y " * 50, "tail ▁ bad " * 30, "", "q"]
    for text, row in zip(texts, op13_alignment.align_texts(texts, A, B, True)):
        gs = groups(text)
        assert row[:5] == [sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs),
                           hashlib.sha256(spelled(gs).encode()).hexdigest() if gs else "", spelled(gs)]
        assert row[5].tolist() == [x[-1] * (1 << 32) + y[-1] for x, y in gs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30)), min_size=1, max_size=4))
def test_divide_and_conquer_finds_every_shared_end(docs):
    a_ends, b_ends, a_upto, b_upto, base = [], [], [], [], 0
    for a, b in docs:
        size = max(sum(a), sum(b))
        for widths, ends, upto in ((a, a_ends, a_upto), (b, b_ends, b_upto)):
            e = np.cumsum(widths).tolist()
            e = e if e[-1] == size else [*e, size]
            ends.extend(base + x for x in e)
            upto.append(len(ends))
        base += size
    i, j = op13_alignment.shared_ends(*map(np.array, (a_ends, b_ends, a_upto, b_upto)))
    assert [a_ends[k] for k in i] == [b_ends[k] for k in j] == sorted(set(a_ends) & set(b_ends))


PARTS = st.lists(st.sampled_from(["the", " ", "  ", "\n", "\t", "it's", "Ab.", "é", "▁", "\x00", ",", "12", "日本", "<s>", "<unk>", "ß", "\r\n", "\U0010ffff", "ing"]),
                 min_size=1, max_size=12)


@pytest.fixture(scope="module")
def pieces():
    return SentenceEncoder(B)


@settings(max_examples=300, deadline=None)
@given(parts=PARTS)
def test_pieces_give_the_ids_of_sentencepiece(pieces, parts):
    text = "".join(parts)
    want = MODEL.encode(text)
    ids, counts = pieces.encode([" " + text, " a"])
    assert ids[:counts[0]].tolist() == want and counts.tolist() == [len(want), 1]
