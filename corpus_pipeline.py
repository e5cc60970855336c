"""A corpus pipeline of five operators: (name, function) stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the last one
returns what its files hold per document. Between stages the rows are written as Parquet and read again; a stage begins with
emptying the folders that earlier ones left (:func:`release`), except what its input reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm import bitplane, mixing, multi_order_join, phrase_index, string_kernel
from kerbflow.llm.common import bounded_batches, keyed, picked, release, stored, table


#: A text whose best decision value is below this has next to nothing in common with any language that was learned.
LEAST_SCORE = 0.1


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the next one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no text or no letter, and those that resemble no learned language (``LEAST_SCORE``).

    Any learned language stays. Without a labelled row there is no model, and every document with a letter stays.
    """
    release(docs)
    bounded_batches(spark)
    model = string_kernel.train(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    told = free_name(docs, "told")
    rows = docs.withColumn(told, string_kernel.predict(F.col("text"), model))
    known = (F.col(f"{told}.lang_pred") != string_kernel.UNKNOWN) & (F.col(f"{told}.score") >= LEAST_SCORE)
    return rows.where(known).select(*columns(docs))


def as_documents(rows: DataFrame, key: str) -> DataFrame:
    """Each row as a document of its own, named by its key."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id, rows without an id last; of equal ids one.

    Rows are compared one by one, so that rows that share an id, or have none, may be in different groups.
    """
    release(docs)
    key, block = free_name(docs, "row"), free_name(docs, "row_block")
    rows = keyed(docs, key, block, "keyed-rows")
    groups = multi_order_join.near_duplicates(as_documents(rows, key)).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    # combined before the shuffle, so that a group may be any size
    stays = groups.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order)["key"].alias(key))
    kept = picked(rows, key, block, stored(stays.select(key), "survivors")).select(*columns(docs))
    release(kept)  # the sets and groups have done their work
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go, whatever other rows have the same id or none."""
    release(docs)
    key, block = free_name(docs, "row"), free_name(docs, "row_block")
    rows = keyed(docs, key, block, "keyed-rows")
    found = phrase_index.decontaminate(as_documents(rows, key), table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias(key)), "contaminated-rows")
    return picked(rows, key, block, gone, there=False).select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice, towards 95 % of the largest entropy; no document is left out."""
    release(docs)
    return mixing.apply(docs, entropy=0.95, repetitions=2.0)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte planes of token ids; per document its place in the stream, as read back from the files."""
    release(docs)
    return bitplane.read_documents(bitplane.write_planes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_ids),
]

#: The language model and the token ids are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower() + "-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
