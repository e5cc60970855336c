"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm import (
    bitplane, chat_snapshots, digest_index, hard_negatives, heap_bpe, license_compression, masked_lm, mixing, multi_order_join,
    phrase_index, pii, spelling, string_kernel,
)
from kerbflow.llm.common import table
from kerbflow.session import work_path


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.rendered(table(spark, sf_dir, "conversations"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the corpus has, at 95 % of the largest entropy, no source more than four times."""
    docs = table(spark, sf_dir, "documents")
    budget = docs.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    return mixing.mixture(docs, entropy=0.95, repetitions=4.0, budget=budget).select(
        "doc_id", "source", "tokens", "epoch", "block", "start", F.round("weight", 9).alias("weight"), F.round("place", 9).alias("place"))


def op3_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = bitplane.write_planes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return bitplane.read_documents(chunks)


def op4_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, work_path(spark, "digest-index"))
    return digest_index.deduplicate(table(spark, sf_dir, "documents"), index)


def op6_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return string_kernel.identify(docs, string_kernel.train(docs))


def op8_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_compression.scan(table(spark, sf_dir, "documents"))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = masked_lm.word_counts(docs)
    return masked_lm.score(docs, *masked_lm.train(docs, counts=counts), counts)


def op10_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_order_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six code points and five occurrences; one letter is taken out of one occurrence in 199."""
    return spelling.of_corpus(table(spark, sf_dir, "documents"), damage=199)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five positives and five negatives each of every hundredth vector, against all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mine(rows, rows.where(F.col("id") % 100 == 0))


QUERIES = {f.__name__: f for f in (
    op1_chat_snapshots, op2_temperature_mixing, op3_bitplane_ids, op4_heap_bpe_counts, op5_digest_index, op6_phrase_index,
    op7_string_kernel, op8_license_compression, op9_masked_lm, op10_multi_order_join,
    op11_pii_spans, op12_spelling_variants, op13_hard_negatives)}
