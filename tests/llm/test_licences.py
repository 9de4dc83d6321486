"""Licence scan (op 11) against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import op11_licences as op
from flowlens.llm import registry
from flowlens.llm.op12_filters import utf8_block
from tests.llm.cases import SF, edge_docs, edge_rows, empty_docs, sf_rows


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    words, found = words_of(text), []
    for phrase, label in op.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def scanned(texts, phrases=op.PHRASES, notices=op.NOTICES):
    return op.scan_texts(op.Scanner(phrases, notices), *utf8_block(pa.array(texts, pa.string())))


def columns(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_columns_of_the_table(spark):
    df = registry.QUERIES["op11_licence_scan"](spark, SF)
    rows, docs = columns(df), sf_rows("documents")
    assert len(rows) == len(docs) == df.count()
    for d in docs:
        r, (n, k, first, last, labels) = rows[d["doc_id"]], base(d["text"])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, k, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
        if not re.search("licen", d["text"], re.I):
            assert r["labels"] == labels
    found = {x for r in rows.values() for x in r["labels"].split(",")}
    assert {"mit", "apache-2.0"} & found


def test_cases(spark):
    for r, (_, text, *_) in zip(op.scan_documents(edge_docs(spark).coalesce(1)).collect(), edge_rows()):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert (r["labels"], r["score"], r["spans"]) == ("", 0.0, [])
    assert op.scan_documents(empty_docs(spark)).collect() == []
    rows = [(1, "MIT License mit-license"), (1, "MIT License mit-license"), (None, "the Apache LICENSE"), (2, "É" * 20 + " CC BY")]
    got = op.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_base"], r["base_labels"], r["score"]) for r in got) == [
        (0, 1, "apache", 0.5), (1, 2, "mit", 0.5), (1, 2, "mit", 0.5), (2, 1, "cc-by", 0.5)]


def test_every_notice_is_a_span_of_its_own():
    for k, (label, text) in enumerate(op.NOTICES):
        whole = len(words_of(text))
        row = scanned(["Some words before it. " + text + "; others after"])[0]
        assert label in row[5].split(",") and row[6] == 1.0
        assert (label, k, 4, 3 + whole, whole, 1.0) in row[7]


def test_quotes_with_changed_words_are_chained():
    label, text = op.NOTICES[1]
    words = words_of(text)
    words[10:11] = ["xyzzy", "plugh"]
    words[20] = "of"
    del words[30]
    row = scanned(["lead in " + " ".join(words) + " end", " ".join(words[:20]), "the software and the license of the copies"])
    assert row[0][5] == label and len(row[0][7]) == 1
    (_, _, first, last, covered, share), = row[0][7]
    assert (first, last) == (2, 1 + len(words)) and covered >= len(words) - 8 and share == covered / len(words_of(text))
    assert row[1][5] == "" and row[2][5] == "" and row[1][6] == 0


def test_a_notice_twice_gives_two_spans():
    text = op.NOTICES[9][1]
    row = scanned([text + " filler word here now and then again " + text])[0]
    assert [x[4] for x in row[7]] == [len(words_of(text))] * 2


TOKENS = st.lists(st.sampled_from(["a", "b", "c", "z"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TOKENS, min_size=1, max_size=4), templates=st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4),
       steps=st.integers(1, 5))
def test_matching_statistics(texts, templates, steps):
    notices = tuple(("x", " ".join(t)) for t in templates)
    scan = op.Scanner((("a b", "p"), ("b a b", "q"), ("c", "r")), notices)
    known = [" ".join(["", *t, ""]) for t in templates + [["a", "b"], ["b", "a", "b"], ["c"]]]
    op.STEPS, kept = steps, op.STEPS
    try:
        data, offsets = utf8_block(pa.array([" ".join(t) for t in texts]))
        words, counts = op.words_of(scan, data, offsets)
        starts = np.cumsum(counts) - counts
        state, length = scan.statistics(words, starts)
        place, which = scan.places(state, length)
    finally:
        op.STEPS = kept
    want, found = [], []
    for t, start in zip(texts, starts.tolist()):
        for i in range(len(t)):
            want.append(max([m for m in range(1, i + 2) if any(" ".join(["", *t[i + 1 - m:i + 1], ""]) in k for k in known)], default=0))
            found += [(start + i, p) for p, (phrase, _) in enumerate(scan.phrases) if t[i:i + len(phrase.split())] == phrase.split()]
    assert length.tolist() == want
    assert sorted(zip(place.tolist(), which.tolist())) == sorted(found)


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(3)
    notice = op.NOTICES[5][1]
    texts = [" ".join(rng.choice(["the", "license", "of", notice, "q" * 70, "é", "mit license"]) for _ in range(60)) for _ in range(5)] + ["", "the " * 400]
    want = scanned(texts)
    monkeypatch.setattr(op, "BLOCK", 50)
    assert scanned(texts) == want
    assert [r[:5] for r in want] == [base(t) for t in texts]


def test_words_that_share_both_ends_differ():
    notices = (("x", "abcdefghXXabcdefgh one two three four"),)
    assert scanned(["abcdefghYYabcdefgh one two three four", "abcdefghXXabcdefgh one two three four"], (), notices)[0][7] == []
