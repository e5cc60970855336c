"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.session import work_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders, and tables or None, that steps have written and :func:`release` has not emptied yet.
WRITTEN: list[tuple[str, str | None]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared storage and read it back.

    Later steps then start from files, whatever executor is lost, and Spark plans with their real size.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    WRITTEN.append((path, None))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``stored``, bucketed by ``key``: grouping or joining by it later leaves the rows where they lie."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    WRITTEN.append((path, table))
    return spark.table(table)


def keyed(rows: DataFrame, key: str, block: str, name: str) -> DataFrame:
    """The rows with a key of their own and its block, written once so that both are the same in every later task."""
    numbered = rows.withColumn(key, F.monotonically_increasing_id())
    return stored_by(numbered.withColumn(block, F.shiftright(key, 15)), block, name)


def picked(rows: DataFrame, key: str, block: str, keys: DataFrame, there: bool = True) -> DataFrame:
    """The rows of :func:`keyed` whose key is, or is not, in ``keys``; ``key`` and ``block`` are dropped.

    A block's keys become a bitmap of 4 KB, and only bitmaps are shuffled: the rows lie bucketed by block, whatever their size.
    """
    bits, place = f"{block}_bits", F.col(key).bitwiseAND(F.lit(32767))
    maps = keys.select(F.shiftright(key, 15).alias(block), place.alias(bits)).groupBy(block).agg(F.bitmap_construct_agg(bits).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, place % 8), F.lit(0)) == 1
    return rows.join(maps.hint("shuffle_hash"), block, "left").where(bit if there else ~bit).drop(key, block, bits)


def release(inputs: DataFrame) -> None:
    """Empty the folders of all earlier steps but those that ``inputs`` reads.

    For a caller whose inputs have been written for good, such as a stage of the pipeline. A DataFrame of an earlier step that was
    not written anywhere can't be read afterwards.
    """
    if WRITTEN:
        empty_folders(inputs, read=False)


def discard(rows: DataFrame) -> None:
    """Empty the folders that ``rows`` reads, once the steps that needed them have written what they return."""
    empty_folders(rows, read=True)


def empty_folders(rows: DataFrame, read: bool) -> None:
    """Empty the written folders that ``rows`` reads, or all others."""
    spark, used = rows.sparkSession, rows.inputFiles()
    for path, name in list(WRITTEN):
        tail = path.rsplit("/", 1)[1]
        if any(tail in file for file in used) == read:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            # overwriting with no rows removes the files on whatever storage Spark writes to
            spark.createDataFrame([], "x int").coalesce(1).write.mode("overwrite").parquet(path)
            WRITTEN.remove((path, name))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 2 ** 26) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, so that a batch of long texts stays small in a worker.

    Set for the session, as Spark reads these settings when a job starts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. ``lower`` is used where it does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space, the number in that array of every word, and where each text's words begin.

    Arrow compares the words, so that Python meets a word of many places once. The last text's end is the last beginning.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, cuts, data = texts.buffers()
    cuts = np.frombuffer(cuts, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[cuts[0]:cuts[-1]]
    cuts = cuts - cuts[0]
    white = ((data - np.uint8(0x09)) < 5) | (data == 0x20)
    # a word begins after white space
    first = ~white
    first[1:] &= white[:-1]
    heads = cuts[cuts < len(data)]  # and where a text does
    first[heads] = ~white[heads]
    places = np.flatnonzero(first)
    # a word with the white space after it, which is taken off the distinct ones only
    spans = pa.py_buffer(np.append(places, len(data)))
    words = pa.Array.from_buffers(pa.large_string(), len(places), [None, spans, pa.py_buffer(data)]).dictionary_encode()
    distinct = pc.ascii_trim_whitespace(words.dictionary).dictionary_encode()
    return distinct.dictionary.cast(pa.large_binary()), distinct.indices.to_numpy()[words.indices.to_numpy()], np.searchsorted(places, cuts)


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What :func:`numbered_words` returns, with the distinct words as a list."""
    distinct, numbers, begins = numbered_words(texts)
    return as_list(distinct), numbers, begins


def as_list(words: pa.Array) -> list:
    """What ``to_pylist`` returns for strings or binaries, several times as fast."""
    return words.to_numpy(zero_copy_only=False).tolist()


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in this Python worker and kept for the tasks that it runs later.

    One thing is kept at a time: workers outlive a step, and what an earlier step remembered would stay in memory beside the next.
    """
    kept = sys.modules.setdefault("_kerbflow_worker", types.ModuleType("_kerbflow_worker"))
    if getattr(kept, "key", None) != key:
        kept.key = kept.made = None
        kept.made, kept.key = make(), key
    return kept.made
