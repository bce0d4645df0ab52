"""The queries of this subpackage: op1 to op13."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.llm import bpe, decontaminate, divergence, exponion, langid, minhash, pii, pq, secrets, substrings, tokencount, toxicity, urlfilter
from cutroom.llm.oracle import ORACLE_SQL  # noqa: F401
from cutroom.session import table


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(rank file, pattern) of the public tokenizers installed on every machine."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer_file(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), n=20)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its personal data is redacted, edit by edit."""
    return tokencount.count_edited(table(spark, sf_dir, "documents"), pii.edits_of, *tokenizer_file())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "toxic")
    characters = toxicity.fit_characters(docs)
    learned = docs.where(~langid.held_out()).join(labels, F.col("doc_id") == F.col("labelled"))
    rates = toxicity.fit(learned, characters)
    scored = toxicity.score_documents(docs, characters, rates, threshold=0.7)
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


#: The rules that op11 judges by: (verdict, host/path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster_vectors(table(spark, sf_dir, "embeddings"), dim=64, k=16, rounds=3, seed=1)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least_docs=10, top=10)


_ALL = (
    op1_embedding_near_dedup, op2_byte_bpe, op3_language_id, op4_decontaminate, op5_pii, op6_substring_dedup, op7_secret_scan, op8_token_counts, op9_toxicity,
    op10_minhash_near_dedup, op11_url_filters, op12_centroid_clusters, op13_source_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}
