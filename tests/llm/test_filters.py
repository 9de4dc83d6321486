"""Filter interaction audit (op 12) against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import op12_filters, registry
from tests.llm.cases import SF, edge_docs, edge_rows, empty_docs, sf_rows

LABELS = "doc_id long, quality int, toxic int"


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text)))


def fails(rows):
    """Set of failed letters of each (doc_id, text)."""
    least = {}
    for d, t in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    out = []
    for d, t in rows:
        w, u, c, n, s = figures(t)
        out.append("".join(x for x, bad in (("A", w < 200), ("B", 100 * u < 50 * w), ("C", 100 * c > 2 * n), ("D", s > 0),
                                            ("E", d is not None and d > least[t or ""])) if bad))
    return out


def brute(rows, labels):
    """rows: (doc_id, text, source)."""
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for (d, _, source), f in zip(rows, fails([r[:2] for r in rows])):
        parts[source or ""].append((d, f))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for p in permutations("ABCDE"):
            left = docs
            for k, letter in enumerate(p):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                out[part, "".join(p), k + 1] = [len(left), len(gone), sum(letter in f for _, f in docs) - len(gone), sum(f == letter for _, f in docs),
                                                sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (part_, p, k), v in out.items():
            if part_ == part:
                v.append(shapley[p[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_of_the_table(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in sf_rows("documents")]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in sf_rows("labels")]
    assert found(registry.QUERIES["op12_filter_audit"](spark, SF)) == brute(rows, labels)


def test_audit_cases(spark):
    rows = [(r[0], r[1], r[3] if r[0] != 5 else None) for r in edge_rows()]
    rows += [(20, "A" * 300, None), (None, "", "s"), (21, "word " * 300, "s"), (22, "word " * 300, "t"), (22, "word " * 300, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (7, 1, None), (22, 1, 1)], LABELS)
    want = brute(rows, [(5, 1, 1), (6, None, 1), (7, 1, None), (22, 1, 1)])
    assert found(op12_filters.audit(docs, labels)) == want
    clash = edge_docs(spark).drop("piece").withColumnRenamed("fp", "fails").withColumnRenamed("key", "part").withColumnRenamed("rank", "n")
    assert found(op12_filters.audit(clash, labels.where("doc_id < 0"))) == brute([(r[0], r[1], r[3]) for r in edge_rows()], [])
    assert op12_filters.audit(empty_docs(spark), labels).collect() == []


TEXTS = st.lists(st.text(alphabet=st.sampled_from("aAbZ# \n\t\x0b\x1c\x85é日|$"), max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts=TEXTS)
def test_one_pass_counts(texts):
    data, offsets = op12_filters.utf8_block(pa.array(texts + [None], pa.string()))
    got = op12_filters.text_counts(data, offsets).T.tolist()
    assert [tuple(x) for x in got] == [figures(t) for t in texts + [None]]


def test_long_texts_are_read_in_blocks(monkeypatch):
    monkeypatch.setattr(op12_filters, "BLOCK", 64)
    texts = ["ab cd " * 50 + "é" * 200 + " Ab#", "x" * 500, " " * 300, "one two", "", "q w e r t y " * 9]
    data, offsets = op12_filters.utf8_block(pa.array(texts).slice(0))
    assert [tuple(x) for x in op12_filters.text_counts(data, offsets).T.tolist()] == [figures(t) for t in texts]


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(op12_filters, "BASE", 1)
    op12_filters._POWER[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    monkeypatch.setattr(op12_filters, "_powers", lambda n: [np.ones(n + 1, np.uint64)] * 2)  # the hash is now blind to order
    texts = ["abc acb bac cab abc cab", "listen silent enlist"]
    data, offsets = op12_filters.utf8_block(pa.array(texts))
    assert op12_filters.text_counts(data, offsets)[1].tolist() == [4, 3]


def test_profiles_keep_the_digest(spark):
    row = op12_filters.profiles(spark.createDataFrame([(1, "ä b", None)], "doc_id long, text string, source string")).first()
    assert bytes(row["digest"]) == hashlib.sha256("ä b".encode()).digest() and row["n_points"] == 3
