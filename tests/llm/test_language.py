"""Language identification (op 2): held-out accuracy and cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import op2_langid, registry
from tests.llm.cases import edge_docs, empty_docs, sf_rows

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op2_language_id"](spark, MID).collect()}
    docs = sf_rows("documents", MID)
    assert len(rows) == len(docs)
    right = [rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if rows[d["doc_id"]]["held_out"]]
    assert len(right) > 200 and np.mean(right) > 0.98
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_held_out_labels_and_sources_do_not_matter(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").limit(300)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in op2_langid.detect(x).collect()} for x in (docs, other))
    assert a == b


def test_cases(spark):
    rows = op2_langid.detect(edge_docs(spark)).collect()
    assert len(rows) == 14
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert by[5]["lang_pred"] in ("en", "de") and by[5]["lang_pred"] == by[6]["lang_pred"] == by[7]["lang_pred"]
    assert op2_langid.detect(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).where("doc_id is null").withColumn("lang", F.lit(None).cast("string"))
    assert [(r["lang_pred"], r["score"], r["held_out"]) for r in op2_langid.detect(unlabelled).collect()] == [("und", 0.0, False)]


def test_rejection_keeps_whole_rows(spark):
    docs = edge_docs(spark)
    kept = op2_langid.keep_languages(docs, min_score=0)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["5", "6", "7", "7", "8", "9", "10", "11", "12", "None"])
    answers = {r["doc_id"]: r for r in op2_langid.detect(docs).collect()}
    sure = [str(d) for d in (5, 6, 7, 7, 8, 9, 10, 11, 12, None) if answers[d]["score"] >= 0.5]
    assert sorted(str(r["doc_id"]) for r in op2_langid.keep_languages(docs).collect()) == sorted(sure)


def test_the_predicted_language_is_used(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").limit(300)
    pred = {r["doc_id"]: r["lang_pred"] for r in op2_langid.detect(docs).collect()}
    gap = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    filled = {r["doc_id"]: r["lang"] for r in op2_langid.keep_languages(gap).collect() if r["doc_id"] % 3 == 0}
    assert filled and np.mean([pred[d] == v for d, v in filled.items()]) > 0.97 and None not in filled.values()
    some = op2_langid.keep_languages(docs, languages={"fr", "es"})
    assert {r["doc_id"] for r in some.collect()} == {d for d, v in pred.items() if v in ("fr", "es")}


def test_driver_memory_stays_flat(spark):
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    docs = spark.read.parquet(f"{MID}/documents.parquet")
    sizes = []
    for _ in range(10):
        op2_langid.keep_languages(docs).write.format("noop").mode("overwrite").save()
        sizes.append(resident())
    assert sizes[-1] - sizes[1] < 8_000_000


def plain_svm(x, y, rounds=200, penalty=1e-4):
    """The same classifier row by row in Python floats."""
    n = [sum(v > 0 for v in y), sum(v < 0 for v in y)]
    w = v = [0.0] * (len(x[0]) + 1)
    for t in range(rounds):
        grad = [penalty * c for c in v]
        for row, sign in zip(x, y):
            row = [*row, 1.0]
            slack = 1 - sign * sum(a * b for a, b in zip(row, v))
            if slack > 0:
                for k, a in enumerate(row):
                    grad[k] -= 2 * sign * slack * a * 0.5 / n[0 if sign > 0 else 1]
        new = [c - g / (4 + penalty) for c, g in zip(v, grad)]
        v = [c + t / (t + 3) * (c - o) for c, o in zip(new, w)]
        w = new
    return w


def test_linear_svm_against_plain_python():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(40, 6)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0)
    got = op2_langid.linear_svm(np.hstack([x, np.ones((40, 1))]).astype(np.float32), y.astype(np.float32))
    assert np.abs(got - plain_svm(x.tolist(), y.tolist())).max() < 1e-3


def test_one_versus_one_inside_a_family():
    rng = np.random.default_rng(0)
    centres = np.abs(rng.normal(size=(5, op2_langid.DIM))).astype(np.float32)
    centres[1] = centres[0] + 0.35 * np.abs(rng.normal(size=op2_langid.DIM))  # two close languages
    x, labels = [], []
    for i in range(5):
        for _ in range(40):
            v = centres[i] + 0.2 * np.abs(rng.normal(size=op2_langid.DIM))
            x.append(v / np.linalg.norm(v))
            labels.append(f"l{i}")
    x = np.array(x, np.float32)
    model = op2_langid.train(np.hstack([x, np.ones((len(x), 1), np.float32)]), labels)
    assert any({0, 1} <= set(g) for g in model.groups) and len(model.groups) == 3
    found, score = op2_langid.predict(model, x)
    assert np.mean([model.langs[k] == v for k, v in zip(found, labels)]) > 0.97 and (score >= 0).all() and (score <= 1).all()
