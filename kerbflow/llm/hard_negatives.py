"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Scores are integer inner products. An anchor's positives are its best rows of the same label; a negative of a positive is a
row of another label whose score lies between ``low`` and ``high`` percent of the positive's. Both are top-k searches:

1. *Blocks.* All rows are dealt by a hash of their key to blocks whose number grows with the square root of the table, so that a
   block fits a task (``BLOCK_VALUES``) and the anchors, a stated query set, go to every block once. Blocks do not follow
   labels or values, so a label or a vector that a third of all rows have is spread over all of them.
2. *Sorted lists.* A task holds one block: its integer matrix and, per dimension, the order of the rows by that component. The
   search for positives has lists per label, so that it reads rows of the anchor's label only.
3. *Threshold algorithm.* An anchor reads every list from the end that its own sign there makes best, some entries at a time.
   Every row met for the first time is looked up and scored whole. What is not met yet scores at most the sum over the dimensions of
   anchor component times last read component; the search stops once that is strictly below each window's k-th score, or
   below the window itself, so that ties are decided by id over all rows.
4. *Merge.* Blocks give at most k rows per window; a ranked window over these keeps the best k.

Defined results: rows with a NULL id, label or vector, a NULL or non-finite component, or one of ``LIMIT`` and more take no part;
so integers stay exact. Vectors of unlike lengths are compared as if the shorter ended in zeros. Rows are told apart by a key of
their own: rows that repeat an id are rows of their own and also each other's positives, and as anchors they are listed each.
Equal scores go by id, then by the rows' labels and vectors. An anchor without positives, and a positive without negatives, gives no row. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm.common import stored

#: Components beyond this take no part: with integers up to 2^20, a hundred times a score is exact over 2^15 dimensions.
LIMIT = 4096.0
#: Components of a block at most, which bounds the memory of a task (about 30 bytes each).
BLOCK_VALUES = 2 ** 23
FIRST_READ = 16  # entries of each list that are read at first; each further read is twice as long


def prepared(vectors: DataFrame, vector: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """Stored table of the rows that take part: key, id, label, v (integers)."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LIMIT))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good)
    v = F.transform(x, lambda e: F.floor(e * scale).cast("int"))
    rows = usable.select(F.col("vec_id").alias("id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), v.alias("v"))
    # equal ids in an order of their own, the same in every later task
    return stored(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")


def blocks_of(rows: DataFrame) -> int:
    """The anchors are repeated per block and the rows of a block per task, so both grow with the root of the table."""
    n, values = rows.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    return max(math.ceil(math.sqrt(n) / 16), math.ceil((values or 0) / BLOCK_VALUES), 1)


class Windows:
    """The best k scores of some ranges of scores; equal scores go by id, then by key."""

    def __init__(self, bounds: list[tuple[float, float]], k: int):
        self.bounds, self.k = bounds, k
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in bounds]

    def offer(self, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """``rows`` are numbered by (id, key)."""
        for w, (low, high) in enumerate(self.bounds):
            inside = np.flatnonzero((100 * scores >= low) & (100 * scores <= high))
            if len(inside):
                s = np.concatenate([self.kept[w][0], scores[inside]])
                r = np.concatenate([self.kept[w][1], rows[inside]])
                best = np.lexsort((r, -s))[:self.k]
                self.kept[w] = s[best], r[best]

    def settled(self, threshold: int) -> bool:
        """Whether a row of at most this score can change nothing."""
        return all(100 * threshold < low or len(s) == self.k and threshold < s[-1]
                   for (low, _), (s, _) in zip(self.bounds, self.kept))


class SortedLists:
    """One list of rows per dimension, in rising order of that component."""

    def __init__(self, matrix: np.ndarray, rows: np.ndarray):
        self.rows, self.part = rows, np.ascontiguousarray(matrix[rows])
        self.order = np.argsort(self.part, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.part, self.order, axis=0)

    def search(self, anchor: np.ndarray, windows: Windows, skip: np.ndarray | None = None) -> None:
        """Threshold algorithm: offer rows to ``windows`` until those not met cannot matter. ``skip``: rows that don't count."""
        n = len(self.rows)
        dims = np.flatnonzero(anchor)
        met = np.zeros(n, bool)
        if skip is not None:
            met |= skip[self.rows]
        weights, down = anchor[dims], anchor[dims] > 0
        read, step = 0, FIRST_READ
        while read < n:
            upto = min(read + step, n) if len(dims) else n
            if upto == n:
                new = np.flatnonzero(~met)
            else:
                seen = np.zeros(n, bool)
                seen[self.order[n - upto:n - read, dims[down]]] = True
                seen[self.order[read:upto, dims[~down]]] = True
                new = np.flatnonzero(seen & ~met)
            if len(new):
                met[new] = True
                windows.offer(self.part[new] @ anchor, self.rows[new], self.rows)
            if upto == n:
                return
            last = np.where(down, self.values[n - upto, dims], self.values[upto - 1, dims])
            if windows.settled(int(weights @ last)):
                return
            read, step = upto, 2 * step


class Block:
    """The rows of one block, numbered by (id, key)."""

    def __init__(self, keys: list[np.ndarray], ids: list[np.ndarray], labels: list[np.ndarray], vectors: list):
        key, ident, label = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, ids, labels))
        order = np.lexsort((key, ident))
        self.keys, self.ids, self.labels = key[order], ident[order], label[order]
        self.width = max((len(v) for v in vectors), default=0)
        self.matrix = np.zeros((len(order), self.width), np.int64)
        for at, k in enumerate(order):
            self.matrix[at, :len(vectors[k])] = vectors[k]
        self.lists: dict[int | None, SortedLists] = {}

    def of(self, label: int | None) -> SortedLists:
        """The lists of the rows of a label, or of all."""
        if label not in self.lists:
            rows = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            self.lists[label] = SortedLists(self.matrix, rows)
        return self.lists[label]

    def anchor(self, v) -> np.ndarray:
        """Beyond the common dimensions a product is zero."""
        out = np.zeros(self.width, np.int64)
        n = min(len(v), self.width)
        out[:n] = v[:n]
        return out

    def positives(self, key: int, label: int, v, k: int) -> Windows:
        found = Windows([(-math.inf, math.inf)], k)
        own = np.zeros(len(self.ids), bool)
        own[self.keys == key] = True
        self.of(label).search(self.anchor(v), found, own)
        return found

    def negatives(self, label: int, v, scores: list[int], k: int, low: int, high: int) -> Windows:
        found = Windows([(low * s, high * s) for s in scores], k)
        self.of(None).search(self.anchor(v), found, self.labels == label)
        return found


FOUND = "anchor bigint, anchor_id bigint, place int, key bigint, id bigint, score bigint"


def searched(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """The best k rows per block and window, merged: ``FOUND`` and their rank.

    ``anchors``: key, id, label, v and ``scores``, the scores of the positives; without ``low`` positives are searched.
    """
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("key", pa.int64()),
                        ("id", pa.int64()), ("score", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = None, None, ([], [], [], [])
        for batch in batches:
            out = []
            which, kinds, keys, ids, labels = (batch.column(c).to_numpy() for c in range(5))
            flat, cuts = batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy() - batch.column(5).offsets[0].as_py()
            scores = batch.column(6)
            for at in range(batch.num_rows):
                if which[at] != now:  # the rows of a block come before its anchors
                    now, block, held = which[at], None, ([], [], [], [])
                v = flat[cuts[at]:cuts[at + 1]]
                if kinds[at] == 0:
                    for part, value in zip(held, (keys[at:at + 1].copy(), ids[at:at + 1].copy(), labels[at:at + 1].copy(), v.copy())):
                        part.append(value)
                    continue
                if block is None:
                    block, held = Block(*held), ([], [], [], [])
                if low is None:
                    found = block.positives(keys[at], labels[at], v, k)
                else:
                    found = block.negatives(labels[at], v, scores[at].as_py(), k, low, high)
                for place, (s, r) in enumerate(found.kept):
                    out.append((np.full(len(s), keys[at]), np.full(len(s), ids[at]), np.full(len(s), place, np.int32),
                                block.keys[r], block.ids[r], s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    none = F.lit(None).cast("array<bigint>")
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                        "key", "id", "label", "v", none.alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                           "key", "id", "label", "v", "scores")
    # a task with several blocks goes through them one after the other
    both = dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "key")
    found = stored(both.mapInArrow(scan, FOUND), "best-of-blocks")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` come from :func:`prepared`; ``anchors`` are some of them.
    """
    blocks = blocks_of(rows)
    first = searched(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks, positives)
    pairs = stored(first.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` entries per anchor
    windows = pairs.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))),
                                                      lambda p: p["positive_score"]).alias("scores"))
    asked = anchors.join(windows.withColumnRenamed("anchor", "key"), "key")
    found = searched(rows, asked, blocks, negatives, low, high)
    place = pairs.withColumn("place", F.col("rank") - 1).drop("rank")
    return found.join(place, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
