"""Benchmark decontamination with a distributed positional inverted index.

Every benchmark text is cut into windows of consecutive words. The corpus is counted once for how often each window
word occurs; a window with a word that never occurs can't be found and is dropped. Then the position lists that the
search opens are stored: those of the two rarest words of each window, plus an end mark per document that tells its
length. The list of a window's rarest word is intersected with that of its second word after shifting both to the
same place (an equi-join on document and shifted position, so no list is gathered in one task), and what is left is
compared word by word with the context stored beside the posting.

The words to look for are held as 64-bit hashes and sent to the tasks in blocks of at most ``BLOCK`` hashes, one scan
per block, so what is broadcast has a fixed bound (a few MB) however large the benchmark is. Hashes only select;
the words themselves decide.

Defined results: NULL texts have no words. ``doc_id`` names a document: rows with the same id (or all rows with NULL) give
one result row that joins their hits and has the largest word count. Repeated benchmark rows count once; a NULL
``item_id`` is shown as an empty string. Empty tables give no hits or no rows. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import ascii_lower, stored

#: Between words: every ASCII character but digits and letters (upper-case letters are lowered first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 100_000
WINDOW = 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id (as a string) and ``terms``: every run of ``size`` words, or all words of an item with fewer."""
    tokens = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                              words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return (tokens.select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.slice("w", F.col("s") + 1, F.lit(size)).alias("terms")).distinct())


def in_blocks(hashes: DataFrame) -> list[DataFrame]:
    """The rows of ``hashes`` (stored, keyed by ``h``) in parts small enough to be sent to every task."""
    parts = -(-hashes.count() // BLOCK) or 1
    return [F.broadcast(hashes.where(F.pmod("h", F.lit(parts)) == i)) for i in range(parts)]


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word hash of ``vocabulary`` occurs in ``docs``: h, n."""
    seen = docs.select(F.explode(words(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("h"))
    parts = [seen.join(block, "h", "left_semi") for block in in_blocks(vocabulary)]
    return reduce(DataFrame.unionAll, parts).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def plan_search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows whose words all occur, with their two rarest words: hashes h1, h2, offset o1 and distance ``delta``."""
    wins = stored(windows(benchmark, size), "windows")
    spread = wins.select("item_id", "terms", F.posexplode("terms").alias("o", "w")).select(
        "item_id", "terms", "o", F.xxhash64("w").alias("h"))
    counts = stored(term_counts(docs, stored(spread.select("h").distinct(), "window-words")), "word-counts")
    ranked = (spread.join(counts, "h").groupBy("item_id", "terms")
              .agg(F.sort_array(F.collect_list(F.struct("n", "o", "h"))).alias("r"))
              .where(F.size("r") == F.size("terms")))
    first, second = F.col("r")[0], F.element_at("r", F.least(F.lit(2), F.size("r")))
    return ranked.select("item_id", "terms", first["h"].alias("h1"), first["o"].alias("o1"), second["h"].alias("h2"),
                         (second["o"] - first["o"]).alias("delta"))


def postings(docs: DataFrame, opened: DataFrame, size: int = WINDOW) -> DataFrame:
    """Position lists of the words in ``opened`` (h, lead) and the end mark of every document.

    Columns: h, doc_id, pos; for words that lead a search ``around``, up to size - 1 words on both sides, and
    ``at``, the word's own place in it. The end mark has h NULL and the number of words as pos.
    """
    flat = docs.select("doc_id", F.array_append(words(F.col("text")), "").alias("w")).select(
        "doc_id", "w", F.posexplode("w").alias("pos", "term"))
    flat = flat.withColumn("h", F.when(F.col("term") != "", F.xxhash64("term")).otherwise(F.lit(0).cast("bigint")))
    before = F.least("pos", F.lit(size - 1))
    parts = []
    for k, block in enumerate(in_blocks(opened)):
        mark = F.col("term") == "" if k == 0 else F.lit(False)
        # the end marks come along in the first block
        found = flat.join(block, "h", "left").where(F.col("lead").isNotNull() & (F.col("term") != "") | mark)
        parts.append(found.select(
            F.when(F.col("term") != "", F.col("h")).alias("h"), "doc_id", "pos",
            F.when(F.col("lead") & (F.col("term") != ""),
                   F.slice("w", F.col("pos") - before + 1, before + size)).alias("around"),
            before.alias("at")))
    return stored(reduce(DataFrame.unionAll, parts).sortWithinPartitions("h"), "postings")


def build_index(docs: DataFrame, search: DataFrame, size: int = WINDOW) -> DataFrame:
    """Stored postings for the words that ``search`` opens."""
    opened = search.select(F.col("h1").alias("h"), F.lit(True).alias("lead")).unionAll(
        search.select(F.col("h2").alias("h"), F.lit(False).alias("lead"))).groupBy("h").agg(F.max("lead").alias("lead"))
    return postings(docs, stored(opened, "opened-words"), size)


def _lists(index: DataFrame, search: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of the rarest and the second words, shifted to the rarest word's place."""
    pairs = search.select("h1", "h2", "delta").distinct()
    lead = index.withColumnRenamed("h", "h1").join(pairs, "h1")
    second = index.withColumnRenamed("h", "h2").join(pairs, "h2").select(
        "h1", "h2", "delta", "doc_id", (F.col("pos") - F.col("delta")).alias("pos"))
    return lead, second


def phrase_matches(index: DataFrame, search: DataFrame) -> DataFrame:
    """Exact occurrences of windows: doc_id, item_id, start, length (in words)."""
    lead, second = _lists(index, search)
    both = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.delta") == F.col("b.delta")) & (
        F.col("a.pos") == F.col("b.pos")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    kept = lead.alias("a").join(second.alias("b"), both, "left_semi")
    same = F.slice("around", F.col("at") - F.col("o1") + 1, F.size("terms")) == F.col("terms")
    return (kept.join(search, ["h1", "h2", "delta"]).where((F.col("at") >= F.col("o1")) & same)
            .select("doc_id", "item_id", (F.col("pos") - F.col("o1")).alias("start"), F.size("terms").alias("length"))
            .distinct())


def proximity_matches(index: DataFrame, search: DataFrame, slop: int = 3) -> DataFrame:
    """Places where a window's two rarest words stand within ``slop`` words of where the window has them.

    doc_id, item_id, pos (of the rarest word), off (how far the second word is from its place; 0 in a phrase).
    """
    lead, second = _lists(index, search)
    width = slop + 1
    lead = lead.withColumn("cell", F.floor(F.col("pos") / width)).alias("a")
    second = second.withColumn("cell", F.explode(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("pos") / width) + d))).alias("b")
    near = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("h1", "h2", "delta", "cell")])
    near = near & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    off = F.col("b.pos") - F.col("a.pos")
    hits = lead.join(second, near).where(F.abs(off) <= slop).select(
        F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), F.col("a.delta").alias("delta"),
        F.col("a.doc_id").alias("doc_id"), F.col("a.pos").alias("pos"), off.alias("off"))
    return hits.join(search.select("h1", "h2", "delta", "item_id"), ["h1", "h2", "delta"]).select(
        "doc_id", "item_id", "pos", "off").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated."""
    search = stored(plan_search(docs, benchmark, size), "search")
    index = build_index(docs, search, size)
    spans = stored(phrase_matches(index, search), "spans")
    hit = spans.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p")).distinct()
    rows = index.where(F.col("h").isNull()).select("doc_id", F.col("pos").cast("bigint").alias("n_words"),
                                                   F.lit(0).cast("bigint").alias("hit"), F.lit(None).cast("string").alias("item"))
    none = F.lit(0).cast("bigint")
    rows = rows.unionAll(hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hit")).select("doc_id", none, "hit", F.lit(None)))
    rows = rows.unionAll(spans.select("doc_id", none, none, "item_id").distinct())
    out = rows.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max("hit").alias("n_hit"),
                                     F.sort_array(F.collect_set("item")).alias("item_ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), "item_ids",
                      (F.col("n_hit") > 0).alias("contaminated"))
