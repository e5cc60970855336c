"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table in shared storage, bucketed and sorted by the digest of the normalised text, one row
per distinct text. A batch is reduced to one row per digest (combined before the shuffle, so a text with very many
copies is no hot key), anti-joined with the index by a sort-merge join that leaves the index where it lies, and the
texts not seen before are appended. Appending a batch again adds nothing, so a batch can be repeated after a failure.

Defined results: NULL text counts as empty text; a NULL ``doc_id`` is kept only where no row of the text has an id;
rows that repeat a ``doc_id`` and its text are one document and share their answer; an empty table adds nothing.
Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm.common import stored

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, SPACES, " ")).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the 32-byte digest of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


class DigestIndex:
    """An index at ``path`` (shared storage). Opening a path that holds one goes on with it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (doc_id, digest) that the index lacks, each with its smallest doc_id."""
        new = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        fresh = new.hint("merge").join(self.table(), "digest", "left_anti").select("digest", "keep_id")
        fresh.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def resolve(self, batch: DataFrame) -> DataFrame:
        """``batch`` with ``keep_id`` from the index and ``group_size``, the number of its rows of the same text.

        What is looked up has one row per digest and is written first, so the join with the rows is a plain
        sort-merge join whose hot digests adaptive execution can split.
        """
        sizes = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        found = stored(sizes.join(self.table(), "digest").select("digest", "keep_id", "group_size"), "digest-lookup")
        return batch.join(found, "digest")

    def drop(self) -> None:
        """Forget the table's name in this session; the files at ``path`` stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Add ``docs`` to ``index`` and tell for every row which document stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    batch = stored(digests(docs), "digests")
    index.add(batch)
    return index.resolve(batch).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
