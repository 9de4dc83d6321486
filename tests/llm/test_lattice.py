"""Lattice language model (op 7) against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from flowlens.llm import op7_lattice, registry
from tests.llm.cases import SF, edge_docs, edge_rows, empty_docs, sf_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def base_scores(rows):
    counts = Counter()
    for doc, text in rows:
        if not held(doc):
            counts.update(words(text) + [None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        tokens = words(text) + [None]
        out.append((str(doc), held(doc), len(tokens), sum(counts[t] > 0 for t in tokens), n,
                    sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return sorted(out)


def check(got, rows):
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    want = base_scores(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def pieces():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table, spelled = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            spelled[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            table[sp.id_to_piece(i)] = i
    return table, spelled


def all_ways(word, table, spelled):
    """Every way to cut a word, as lists of piece numbers."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        head = word[:n]
        first = [table[head]] if head in table else [spelled[b] for b in head.encode()] if n == 1 else None
        if first:
            out += [first + rest for rest in all_ways(word[n:], table, spelled)]
    return out


def test_marginal_and_expected_counts_over_all_ways():
    v = op7_lattice.vocabulary(PATH)
    table, spelled = pieces()
    found = ["the", "cat", "x日y", "\U0001f600", "éa", "a", "", "thing"]
    logp = np.log(np.maximum(v.prior, 1e-300))
    lat = op7_lattice.Lattices(v, found)
    got = lat.forward(logp)[0]
    counts = np.array([3.0, 1, 2, 1, 1, 5, 1, 2])
    expected = np.zeros(v.size)
    for w, lp, c in zip(found, got, counts):
        ways = all_ways("▁" + w, table, spelled)
        scores = [math.fsum(logp[i] for i in way) for way in ways]
        total = math.log(math.fsum(math.exp(s) for s in scores))
        assert lp == pytest.approx(total, rel=1e-9)
        for way, s in zip(ways, scores):
            for i in way:
                expected[i] += c * math.exp(s - total)
    assert np.allclose(lat.expected(logp, counts, v.size), expected)


def test_table_against_plain_python(spark):
    got = registry.QUERIES["op7_lattice_lm"](spark, SF).collect()
    check(got, [(d["doc_id"], d["text"]) for d in sf_rows("documents")])
    assert all(r["score"] < 0 for r in got)
    # a text of words that were seen is likelier, per character, than one of strange characters
    size = {d["doc_id"]: len(d["text"] or "") for d in sf_rows("documents")}
    known = [r["score"] / max(1, size[r["doc_id"]]) for r in got if r["n_tokens"] > 30]
    assert np.median(known) > -1.2


def test_training_raises_the_likelihood(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = {}
    for rounds in (0, 1, 2):
        monkeypatch.setattr(op7_lattice, "ROUNDS", rounds)
        logp_total = op7_lattice.score(docs, PATH).where("held_out").agg({"score": "sum"}).first()[0]
        total[rounds] = logp_total
    assert total[1] > total[0] or total[0] == pytest.approx(total[1])
    assert total[2] > total[1]


def test_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = op7_lattice.score(edge_docs(spark), PATH).collect()
    check(got, rows)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1 and all(math.isfinite(r["score"]) for r in got)
    assert op7_lattice.score(empty_docs(spark), PATH).count() == 0
    alone = spark.createDataFrame([(d, "only held out") for d in range(200) if held(d)], "doc_id long, text string")
    check(op7_lattice.score(alone, PATH).collect(), [(r["doc_id"], r["text"]) for r in alone.collect()])
