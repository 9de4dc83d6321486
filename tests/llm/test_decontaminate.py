"""Benchmark decontamination (op 4) against brute force and planted passages."""

import random

import numpy as np

from flowlens.llm import op4_decontaminate as D
from flowlens.llm import registry
from flowlens.llm.letters import lowered
from tests.llm.cases import LONG, SF, edge_docs, empty_docs, sf_rows


def plain(text):
    cp = lowered([text or ""], digits=True)[0]
    return cp[cp != 0]


def least_edits(pattern, text):
    """Edits of the best match of the pattern anywhere in the text (full dynamic programme)."""
    row = np.zeros(len(text) + 1, int)
    cols = np.arange(len(text) + 1)
    for i, c in enumerate(pattern, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != c))
        row = np.concatenate([[i], best])
        row = np.minimum.accumulate(row - cols) + cols
    return int(row.min())


def brute(docs, items):
    """(doc, item): fewest edits over the item's windows that are within their budget."""
    out = {}
    for doc, text in docs:
        t = plain(text)
        for item, other in items:
            for w in D.windows(plain(other)):
                if len(t) >= len(w) - D.budget(len(w)):
                    e = least_edits(w, t)
                    if e <= D.budget(len(w)):
                        out[doc, item] = min(e, out.get((doc, item), e))
    return out


def test_table_against_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in registry.QUERIES["op4_benchmark_decontamination"](spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in sf_rows("documents") if len(r["text"] or "") < 4000]
    items = [(r["item_id"], r["text"]) for r in sf_rows("benchmark")]
    want = brute(docs, items)
    short = {d for d, _ in docs}
    assert {k: v for k, v in got.items() if k[0] in short} == want and want


def test_edited_passages(spark):
    rng = random.Random(4)
    letters = "abcdefghij"

    def words(n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))

    items = [(i, words(rng.randint(3, 60))) for i in range(12)] + [(90, "short"), (91, None), (92, "")]
    docs = []
    for k in range(60):
        passage = list(items[k % 12][1])
        for _ in range(rng.randint(0, max(1, len(passage) // 10))):
            at = rng.randrange(len(passage))
            what = rng.randrange(3)
            passage[at:at + 1] = [] if what == 0 else [rng.choice(letters)] if what == 1 else [passage[at], rng.choice(letters)]
        styled = "".join(passage)
        docs.append((k, words(20) + " " + (styled.upper().replace(" ", "!! ") if k % 3 else styled) + " " + words(15)))
    docs += [(k, words(60)) for k in range(100, 120)]
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == brute(docs, items)
    text = dict(docs)
    for r in got:
        if not r["edits"]:
            w = plain(text[r["doc_id"]][r["start"]:r["end"]])
            assert len(w) == r["window_chars"]


def test_partial_and_word_edited_quotes(spark):
    rng = random.Random(7)
    # an item of 186 letters in 31 words of six
    item = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(31)]
    whole = "".join(item)
    noise = lambda: " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(20))
    docs = [(i, f"{noise()} {whole[i:i + 61]} {noise()}") for i in range(len(whole) - 60)]
    for k, changed in enumerate([(10, 20), (7, 15, 24), (0, 30), (12,), (9, 21), (5, 14, 23)]):
        docs.append((1000 + k, noise() + " " + " ".join("zzzzzz" if w in changed else x for w, x in enumerate(item)) + " " + noise()))
    clean = [(2000 + k, f"{noise()} {whole[k:k + 25]} {noise()}") for k in range(0, 150, 10)]  # too short to be evidence
    got = D.matches(spark.createDataFrame(docs + clean, "doc_id long, text string"),
                    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    # independent of the operator's windows: every 50 letters of the item in a row that stand in the text but for 3 edits
    pieces = [plain(whole[i:i + 50]) for i in range(len(whole) - 49)]
    near = {d for d, text in docs[::5] + docs[-6:] + clean if min(least_edits(x, plain(text)) for x in pieces) <= 3}
    found = {r["doc_id"] for r in got}
    assert found == {d for d, _ in docs} and near == {d for d, _ in docs[::5] + docs[-6:]}


def test_blocks_of_the_query_set(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, D.matches(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_GRAMS", 500)
    assert len(list(D.blocks(D.item_windows(items)))) > 2
    assert sorted(map(tuple, D.matches(docs, items).collect())) == want
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted([r["doc_id"] for r in D.drop_contaminated(docs, items).collect()] + list({r[0] for r in want}))


def test_batched_alignment_against_the_full_programme():
    rng = np.random.default_rng(5)
    for m in (12, 33, 50):
        e = D.budget(m)
        text = rng.integers(97, 100, 400).astype(np.uint32)
        patterns, shifts = [], []
        for _ in range(120):
            at = int(rng.integers(0, len(text) - m))
            p = list(text[at:at + m])
            for _ in range(int(rng.integers(0, e + 2))):
                k = int(rng.integers(0, len(p)))
                p[k:k + 1] = [[], [100], [p[k], 101]][int(rng.integers(0, 3))]
            patterns.append((p + [102] * m)[:m])
            shifts.append(at - int(rng.integers(0, e + 1)))
        patterns, shifts = np.array(patterns, np.uint32), np.array(shifts)
        edits, end = D.align(patterns, text, np.zeros(len(shifts), int), np.full(len(shifts), len(text)), shifts, 2 * e + 1, e)
        for p, s, n, stop in zip(patterns, shifts, edits, end):
            # a match on these diagonals lies in this part of the text
            part = text[max(0, s - e):s + 2 * e + 1 + e + m]
            want = least_edits(p, part)
            assert n == min(want, e + 1) if want > e else n <= e and want <= n
            if n <= e:
                assert least_edits(p, text[:stop]) <= n


def test_shared_openings_of_items(spark):
    """Items with one opening against a text that repeats it: one window, its places counted once."""
    opening = "Which of the following statements is correct about subject"
    items = [(k, f"{opening} {k}") for k in range(60)]
    shown = D.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    assert shown.groupBy("window").count().agg({"count": "max"}).first()[0] == 60 and shown.select("window").distinct().count() <= 62
    texts = [(1, " ".join(f"{opening[:44]} word{k}" for k in range(60))), (2, f"so {opening} 17 then"), (3, "nothing of the kind at all")]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.matches(spark.createDataFrame(texts, "doc_id long, text string"),
                                                                       spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(texts, items) and {d for d, _ in got} == {2}


def test_windows_are_counted_in_slices(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [r["text"] or "" for r in docs.collect()]
    index = D.Index([r["window"] for r in D.item_windows(items).select("window").distinct().orderBy("window").collect()])

    def found():
        return sorted(zip(*(x.tolist() for x in D._find(index, texts))))

    want = found()
    monkeypatch.setattr(D, "SLICE", 50)
    monkeypatch.setattr(D, "ALIGNED", 3)
    assert found() == want and want


def test_cases(spark):
    items = spark.createDataFrame([(1, LONG[:400], "x"), (2, None, "x"), (3, "one two three four five six seven eight nine ten", "x"), (None, LONG[500:700], "x")],
                                  "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(edge_docs(spark), items).collect()}
    assert got == {(8, 1), (9, 1), (8, None), (9, None), (5, 3), (6, 3), (7, 3)}
    assert D.matches(empty_docs(spark), items).count() == 0
    assert D.matches(edge_docs(spark), items.where("false")).count() == 0
    kept = D.drop_contaminated(edge_docs(spark), items)
    assert kept.columns == edge_docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "10", "11", "12", "None"])
