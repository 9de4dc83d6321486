"""Corpus pipeline: five of the training-data operators, one after another, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of
``documents``. Between stages the rows are written as Parquet to the shared checkpoint folder and read again, so a lost
executor never sends the job back beyond one stage.

A stage keeps every row that gives it no reason to go: texts without a language go first (a missing ``lang`` is filled with
the predicted one, and one whose deciding classifiers contradict each other goes), then all but one document of
each group of near duplicates, then documents with a benchmark passage; personal data is replaced and the rest is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import op1_packing, op2_langid, op4_decontaminate, op5_simhash, op6_pii
from flowlens.llm.common import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_langid.keep_languages(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_simhash.keep_one(docs, words=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_pii.surrogate_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]
#: Trained models, hashes and components have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
