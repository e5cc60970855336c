"""Groups of spelling variants: words within one edit of each other, found in a sorted word list.

1. *Words.* Runs of Latin letters of all texts, counted over the whole corpus; ``min_count`` occurrences make a word.
2. *Ranges.* Let m be the length of the shorter of two words that are one edit apart, and p the length of their shared
   prefix. If p lies in [a, b), both begin with the same a code points and end with the same m - b. So every word takes its
   place in the ranges (m, a, b, head, tail) for [a, b) = [0, m/2) and [m/2, m), once as the shorter and once as the longer
   word, and every pair meets in exactly one of them. A range with more than ``most`` words is cut in two again, at the middle
   of [a, b), and so on. A range whose [a, b) is one place long holds words that differ in that place alone, so it is bounded
   by the alphabet (64 + 64 * 64 words), whatever the vocabulary. Ranges are dealt to tasks by key, and no word is left out.
3. *Sorted-list dynamic programming.* In a range the parts between head and tail are sorted. Each of them is compared with those
   behind it by the edit-distance matrix, of which only the band of three diagonals is kept. The rows of the prefix that a
   part shares with the one before it (their LCP) are used again; where a row has nothing below two, all parts with that prefix
   are skipped by a binary search.
4. *Forms.* A word's form is its near word of largest count, if that count is ``ratio`` times its own or more. Counts
   grow along the links, so they have no cycles, and pointer doubling finds the last form in log(links) rounds.

Defined results: NULL and empty texts have no words, a NULL id counts as an empty one. Rows are counted as they stand, repeated rows
too. Equal counts go by code-point order. A table without words gives no rows. Texts and words may have any length. Only doc_id
and text are read.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import LOWER, UPPER, stored

RUN = r"[A-Za-zÀ-ÿ]"
RANGE = ["m", "a", "b", "head", "tail"]
LAST = "\U0010ffff"
FAR = 2  # any distance of two or more
#: Rows of a task; a row is a word in one of its ranges.
TASK_ROWS = 50_000


def occurrences(docs: DataFrame, shortest: int, damage: int | None) -> DataFrame:
    """One row per run of letters of at least ``shortest``: ``word``, in lower case as to A-Z.

    With ``damage``, a word whose crc32 together with its document's id is a multiple of it lacks one letter.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    run = F.col("run")
    low = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", low.alias("word"))
    if damage is None:
        return words.select("word")
    word, lost = F.col("word"), F.col("h") % F.char_length("word")
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word), "UTF-8"))
    cut = F.concat(F.substring(word, F.lit(1), lost.cast("int")), F.substring(word, (lost + 2).cast("int"), F.char_length(word)))
    return words.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(word).alias("word")).where(
        F.char_length("word") >= shortest)


def vocabulary(docs: DataFrame, shortest: int = 6, min_count: int = 5, damage: int | None = None) -> DataFrame:
    """Stored table of the words: word, n."""
    counts = occurrences(docs, shortest, damage).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.where(F.col("n") >= min_count), "vocabulary")


def placed(words: DataFrame, shortest: int) -> DataFrame:
    """Every word in its ranges, once as the shorter and once as the longer word of a pair."""
    size, m = F.char_length("word"), F.col("m")
    half = (m / 2).cast("int")
    as_long = F.when(size > shortest, size - 1)
    rows = words.withColumn("m", F.explode(F.array_compact(F.array(size, as_long)))).withColumn(
        "cut", F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), m.alias("b")))))
    return between(rows.select("m", "cut.a", "cut.b", F.lit("").alias("head"), F.lit("").alias("tail"),
                               F.col("word").alias("mid"), "n", F.lit(0).alias("from"), m.alias("to")))


def between(rows: DataFrame) -> DataFrame:
    """Move what [a, b) leaves of the part between ``from`` and ``to`` to the head and the tail."""
    mid, size = F.col("mid"), F.char_length("mid")
    front, back = F.col("a") - F.col("from"), F.col("to") - F.col("b")
    return rows.select(
        "m", "a", "b", F.concat("head", F.substring(mid, F.lit(1), front)).alias("head"),
        F.concat(F.substring(mid, size - back + 1, back), "tail").alias("tail"),
        F.substring(mid, front + 1, size - front - back).alias("mid"), "n")


def halved(rows: DataFrame) -> DataFrame:
    a, b = F.col("from"), F.col("to")
    middle = ((a + b) / 2).cast("int")
    cuts = F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))
    return between(rows.withColumnsRenamed({"a": "from", "b": "to"}).withColumn("cut", F.explode(cuts)).withColumns(
        {"a": F.col("cut.a"), "b": F.col("cut.b")}))


def ranges(words: DataFrame, shortest: int = 6, most: int = 2000) -> DataFrame:
    """The ranges of all words, none with more than ``most`` words unless its [a, b) is one place."""
    rows, done = stored(placed(words, shortest), "ranges"), []
    while True:
        hot = stored(rows.where(F.col("b") - F.col("a") > 1).groupBy(*RANGE).agg(F.count(F.lit(1)).alias("size")).where(
            F.col("size") > most).drop("size"), "hot-ranges")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, RANGE, "left_anti"))
        rows = stored(halved(rows.join(hot, RANGE, "left_semi")), "ranges")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def shared(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = 0
    for p, q in zip(x, y):
        if p != q:
            break
        n += 1
    return n


def sorted_list_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """All (i, j), i < j, of words one edit apart; ``words`` are sorted and differ from each other.

    A row of the matrix for a prefix of d code points holds the distances to the query's prefixes of d - 1, d and d + 1.
    """
    lcp = [0, *[shared(x, y) for x, y in itertools.pairwise(words)]]
    end = len(words)
    for i, query in enumerate(words[:-1]):
        size = len(query)
        # the query's own rows; outside the matrix there is nothing near
        rows = [(FAR, 0, 1 if size else FAR)] + [(1, 0, 1)] * (size - 1) + ([(1, 0, FAR)] if size else [])
        j = i + 1
        while j < end:
            word = words[j]
            depth = lcp[j]
            del rows[depth + 1:]
            left, here, right = rows[depth]
            skip = False
            for letter in word[depth:]:
                # of the query: the letters before, at and behind the diagonal
                x = left + (query[depth - 1] != letter) if 0 < depth <= size else FAR
                x = min(x, here + 1) if depth <= size else FAR
                y = min(here + (query[depth] != letter), right + 1, x + 1) if depth < size else FAR
                z = min(right + (query[depth + 1] != letter), y + 1) if depth + 1 < size else FAR
                left, here, right = x, y, z
                depth += 1
                if x > 1 and y > 1 and z > 1:
                    skip = True
                    break
                rows.append((x, y, z))
            if skip:
                j = bisect_left(words, word[:depth] + LAST, j + 1)
                continue
            gap = size - len(word)
            if -1 <= gap <= 1 and (left, here, right)[gap + 1] == 1:
                yield i, j
            j += 1


def near(rows: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of every pair of words one edit apart."""
    schema = "word string, near string, near_n bigint"
    made = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out: list[tuple[str, str, int]] = []
        for (m, a, b, head, tail), group in itertools.groupby(held, key=lambda row: row[:5]):
            group = [(row[5], row[6]) for row in group]
            mids = [mid for mid, _ in group]
            for i, j in sorted_list_pairs(mids):
                (x, n), (y, k) = group[i], group[j]
                # the shorter has the length of the range; of two ranges, that of the first difference has the pair
                if min(len(x), len(y)) != b - a or shared(x, y) + a >= b and b < m:
                    continue
                x, y = head + x + tail, head + y + tail
                out += (x, y, k), (y, x, n)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    spark = rows.sparkSession
    # the work of a row is far more than its bytes tell, so the number of tasks follows the rows
    tasks = max(-(-rows.count() // TASK_ROWS), spark.sparkContext.defaultParallelism)
    dealt = rows.select(*RANGE, "mid", "n").repartition(tasks, *RANGE).sortWithinPartitions(*RANGE, "mid")
    return dealt.mapInArrow(scan, schema)


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain of ``links`` (word, form), by doubling the steps."""
    links = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps = stored(links.join(onward, "root", "left"), "forms")
        if steps.where(F.col("onward").isNotNull()).isEmpty():
            return links
        links = steps.select("word", F.coalesce("onward", "root").alias("root"))


def variants(words: DataFrame, shortest: int = 6, ratio: int = 5, most: int = 2000) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``words`` (word, n)."""
    words = stored(words.select("word", "n"), "words")
    met = near(ranges(words, shortest, most))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(F.negative("near_n").alias("k"), F.col("near").alias("w"))))
    own = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    pairs = met.select("word", F.lit(None).cast("bigint").alias("n"), "near", "near_n")
    found = own.unionByName(pairs).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    leads = -F.col("best.k") >= ratio * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(leads, F.col("best.w")).alias("form"),
                                F.when(leads, -F.col("best.k")).alias("form_n")), "near-words")
    roots = last_forms(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def of_corpus(docs: DataFrame, shortest: int = 6, min_count: int = 5, ratio: int = 5, damage: int | None = None) -> DataFrame:
    """:func:`variants` of the words of ``docs`` (doc_id, text)."""
    return variants(vocabulary(docs, shortest, min_count, damage), shortest, ratio)


def grouped(found: DataFrame) -> DataFrame:
    """root, variants (words with their counts), n: the words that share a last form, where there is more than one."""
    member: Column = F.struct("word", "n")
    # a group is a tree of words one edit apart whose counts fall by ``ratio`` at each step, so the alphabet bounds it
    return found.groupBy("root").agg(F.sort_array(F.collect_list(member)).alias("variants"), F.sum("n").alias("n")).where(
        F.size("variants") > 1)
