"""The pipeline on a small fixture against a brute-force version of each stage."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from flowlens.llm.common import stage
from tests.llm.cases import LONG, SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import classes, close, fingerprint
from tests.llm.test_tokens import WORD, check_packing, ids_of


def fixture(spark, tmp_path):
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))

    items = [(i, words(30)) for i in range(4)]
    rows = [(i, words(rng.randint(5, 120)), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)]  # copies
    rows += [(200, None, "en", "s", None), (201, "123 !!", None, "s", 6), (202, "", "fr", "s", 0)]
    rows += [(210 + i, words(10) + " " + items[i][1] + " " + words(9), "en", "s", 1) for i in range(4)]
    rows += [(220, words(20) + " mail me.you@mail.example.com " + words(4), "en", "s", 1), (221, LONG, "fr", "s", len(LONG)), (39, rows[39][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    sizes = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert set(got) == kept and len(got) == len(rows) - 3
        if name == "simhash_near_dedup":
            root = dict(classes([(d, fingerprint(t)) for d, t in sorted(kept)], close))
            kept = {(d, t) for d, t in kept if root[d] == d}
            assert sorted(got) == sorted(kept)
        if name == "benchmark_decontamination":
            bad = {d for d, _ in leaks([(d, t) for d, t in kept if len(t) < 5000], items)}
            assert bad == {210, 211, 212, 213}
            kept = {(d, t) for d, t in kept if d not in bad}
            assert sorted(got) == sorted(kept)
        if name == "pii_surrogates":
            new = dict(got)
            assert set(new) == {d for d, _ in kept} and "me.you@mail.example.com" not in new[220] and "@" in new[220]
            assert all(new[d] == t for d, t in kept if d != 220)
            kept = set(got)
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True)
    packed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()]
    check_packing(packed, sorted(kept), 2048)
    whole = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    assert sum(r["length"] for r in whole) == sum(len(ids_of(WORD, t)) + 1 for _, t in kept)


def test_stages_take_the_hard_cases(spark):
    from tests.llm.cases import edge_docs, empty_docs
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns
            docs = stage(out, "case")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.count("*")).first()[0] >= 0
