"""Queries of the training-data operators, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import (op1_packing, op2_langid, op3_suffix, op4_decontaminate, op5_simhash, op6_pii, op7_lattice, op8_tokenfile, op9_vectors,
                          op10_html, op11_licences, op12_filters, op13_alignment)
from flowlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_tokenfile.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_langid.detect(table(spark, sf_dir, "documents"))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html.extract(table(spark, sf_dir, "pages"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op6_pii.replace_pii(docs)


@query
def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_licences.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = op12_filters.SQL


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                          public_tokenizers.path("piece_bpe_32k.model"))
