"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_trie, conversation_repair, conversation_trie, html_extract, language_id, near_dedup, ngram_join, oracles, packing, pii_bootstrap, secret_scan, toxicity, transport_stream, va_search
from quire.llm.tables import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.findings(read(spark, sf_dir, "documents"), model)


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.describe(transport_stream.store(read(spark, sf_dir, "documents")))


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digests(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), model).drop("text")


def op6_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.predictions(docs, language_id.train(docs))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(read(spark, sf_dir, "conversations"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_secret_scan, op3_transport_stream, op4_pii_bootstrap, op5_toxicity, op6_va_search, op7_near_dedup, op8_bpe_trie, op9_language_id, op10_html_extract, op11_conversation_repair, op12_conversation_trie, op13_ngram_join)}


def oracle_sql() -> dict[str, str]:
    """Trained models, tokenizers, media and indexes have no equivalent in SQL; the tests hold them against brute force."""
    return {"op11_conversation_repair": oracles.REPAIR, "op12_conversation_trie": oracles.TRIE, "op13_ngram_join": oracles.JOIN}
