"""Masked pseudo-likelihood of documents under a small bidirectional network trained in numpy.

Words are counted over the whole corpus; the most frequent ones are the vocabulary of the network, all others share some
buckets by hash. The full counts stay a stored table: a word of a bucket has the bucket's probability times its own share of
the bucket, (count + 1) / (count of the bucket + distinct words + 1), where the last 1 is for all words never counted. The network predicts the word at a masked place from the ``SIDE`` words before and after it: one embedding per
word and place is summed, squashed, and a two-level softmax (group of words, word in the group) gives the probability.
A document's score is the sum of the log-probabilities of all its words, each predicted from both sides.

Training covers all words of all documents: each document belongs to one round, in which its words are dealt into masks by
a hash of text, place and round, so that every word is masked once. Every task takes gradient steps over the masks of its
documents from the shared weights, and the tasks' weights are averaged by a grouped shuffle, weighted by their number of
masked words. What is gathered grows with the corpus; what comes to the driver is one set of weights, and the
vocabulary, both of fixed size.

Defined results: NULL, empty and white-space texts have 0 words, log-probability 0 and a NULL mean. Rows are scored one
by one, so repeated rows agree and ids may be NULL or repeated. An empty corpus leaves the network at its start, and an
empty table gives no rows. Texts of any length are handled in stretches of ``STRETCH`` words. Only doc_id and text
are read. Floating-point sums make the last digits depend on how the corpus is partitioned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kerbflow.llm.common import as_list, bounded_batches, distinct_words, numbered_words, stored

WORDS, BUCKETS, GROUP, WIDTH, SIDE = 960, 63, 32, 24, 2
EDGE = WORDS + BUCKETS  # stands before the first and after the last word
SIZE = 1024
AROUND = (*range(-SIDE, 0), *range(1, SIDE + 1))
STRETCH, BLOCK, CHUNK = 16_384, 4096, 4096
HELD = 500_000  # distinct words that a task counts before it sends them
HEADS = 1 << 19  # words of at least this part of the words outside the vocabulary, so no more than this many, are sent with their counts


def word_counts(docs: DataFrame) -> DataFrame:
    """Stored table of all words of the corpus and how often they stand there: w, n.

    A task sends a word once for every ``HELD`` distinct ones, so that it holds few.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> pa.Table:
            total = pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"w": total["w"], "n": total["n_sum"]})

        def sent(total: pa.Table) -> list[pa.RecordBatch]:
            return pa.table({"w": total["w"].cast(pa.large_string()).cast(pa.string()), "n": total["n"]}).to_batches(HELD)

        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            words, numbers, _ = numbered_words(pc.ascii_lower(batch.column(0)))
            held.append(pa.table({"w": words, "n": np.bincount(numbers, minlength=len(words))}))
            size += len(words)
            if size > HELD:
                held, size = [sums()], 0
                if len(held[0]) > HELD:
                    yield from sent(held.pop())
        if held:
            yield from sent(sums())

    words = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "w string, n bigint")
    return stored(words.groupBy("w").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame) -> dict[str, int]:
    """The ``WORDS`` most frequent words of the corpus, numbered; equal counts go by the word."""
    return {r["w"]: i for i, r in enumerate(counts.orderBy(F.desc("n"), "w").limit(WORDS).collect())}


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def encode(text: str | list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a text, or of a list of words: its own in the vocabulary, else that of its bucket."""
    words = split(text) if isinstance(text, str) else text
    return np.array([i if (i := known.get(w)) is not None else WORDS + zlib.crc32(w) % BUCKETS for w in words], dtype=np.int64)


def encode_all(texts: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, list[tuple[int, int]], list[bytes], np.ndarray]:
    """Numbers of the words of all texts and where each text's begin and end; then the distinct words and which of them each word is."""
    distinct, which, begins = distinct_words(pc.ascii_lower(texts))
    return encode(distinct, known).astype(np.int16)[which], list(zip(begins[:-1].tolist(), begins[1:].tolist())), distinct, which


def edged(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts of these sizes with edges between the texts, and where each word stands there."""
    at = np.arange(len(ids)) + np.repeat(np.arange(SIDE, SIDE * (len(sizes) + 1), SIDE), sizes)
    out = np.full(len(ids) + SIDE * (len(sizes) + 1), EDGE, np.int16)
    out[at] = ids
    return out, at


def around(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words around each place, one row for each of ``AROUND``."""
    return np.stack([padded.take(at + d) for d in AROUND])


def masks(text: str, places: np.ndarray, turn: int, mask: int) -> np.ndarray:
    """Which of the ``mask`` masks of a round hides the word at each place."""
    return dealt(places, seed_of(text.encode("utf-8", "replace"), turn), mask)


def seed_of(text: bytes, turn: int) -> int:
    return (zlib.crc32(text) << 32) + (turn << 24)


def dealt(places: np.ndarray, seeds: int | np.ndarray, mask: int) -> np.ndarray:
    """The masks of :func:`masks` for places of texts with these seeds."""
    x = places.astype(np.uint64) + np.asarray(seeds, np.uint64)
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return (x >> np.uint64(33)) % np.uint64(mask)


@dataclass
class Network:
    """``place[k][w]``: embedding of word w at context place k; then weights and biases of the two softmax levels.

    What a step computes lies in ``rooms`` that the next one uses again: fresh arrays of this size come from the
    system page by page, which takes longer than what is computed in them.
    """

    place: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray
    rooms: dict[str, np.ndarray] = field(default_factory=dict, repr=False, compare=False)

    def room(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        """An array for any values, valid until it is asked for again."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, kind)
        return self.rooms[name][:size].reshape(shape)

    @staticmethod
    def start(seed: int = 7) -> Network:
        r, groups = np.random.default_rng(seed), SIZE // GROUP
        shapes = (2 * SIDE, SIZE, WIDTH), (WIDTH,), (WIDTH, groups), (groups,), (groups, WIDTH, GROUP), (groups, GROUP)
        return Network(*[(r.normal(0, 0.1, x) * (k in (0, 2, 4))).astype(np.float32) for k, x in enumerate(shapes)])

    def parts(self) -> list[np.ndarray]:
        return [self.place, self.bias, self.group, self.group_bias, self.word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32)

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size
        return self

    def contexts(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words around places of one text."""
        padded, place = edged(ids, np.array([len(ids)]))
        return around(padded, place[at])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """One column per row of the batch."""
        n = context.shape[1]
        total, some, h = self.room("total", n, WIDTH), self.room("some", n, WIDTH), self.room("hidden", WIDTH, n)
        self.place[0].take(context[0], axis=0, out=total, mode="clip")
        for k, c in enumerate(context[1:], 1):
            total += self.place[k].take(c, axis=0, out=some, mode="clip")
        total += self.bias
        np.copyto(h, total.T)
        return np.tanh(h, out=h)

    def outer(self, h: np.ndarray) -> np.ndarray:
        """First level: one column of logits per column of ``h``."""
        out = np.matmul(self.group.T, h, out=self.room("outer", SIZE // GROUP, h.shape[1]))
        out += self.group_bias[:, None]
        return out

    def inner(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Second level for columns sorted by their group ``g``: one column of logits per column, and (group, from, to)."""
        cuts = np.searchsorted(g, np.arange(SIZE // GROUP + 1))
        runs = [(k, *cuts[k:k + 2].tolist()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        out, bias = self.room("inner", GROUP, len(g)), self.room("bias", GROUP, len(g))
        for k, lo, hi in runs:
            np.matmul(self.word[k].T, h[:, lo:hi], out=out[:, lo:hi])
        out += self.word_bias.T.take(g, axis=1, out=bias, mode="clip")
        return out, runs

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target in its context."""
        out = np.empty(len(target), np.float32)
        for lo in range(0, len(target), BLOCK):
            some = target[lo:lo + BLOCK]
            order, g = _by_group(some)
            h, row = self.hidden(context[:, lo:lo + BLOCK].take(order, axis=1)), np.arange(len(some))
            level, (inner, _) = self.outer(h), self.inner(h, g)
            own = level[g, row] + inner[some[order] % GROUP, row]
            out[lo + order] = own - _log_sum(level) - _log_sum(inner)
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on a batch of masked words."""
        order, g = _by_group(target)
        context, target, n, row = context.take(order, axis=1), target[order], len(order), np.arange(len(order))
        h = self.hidden(context)
        level, (inner, runs) = self.outer(h), self.inner(h, g)
        _softmax(level)
        level[g, row] -= 1
        _softmax(inner)
        inner[target % GROUP, row] -= 1
        back = np.matmul(self.group, level, out=self.room("back", WIDTH, n))
        more, change = self.room("more", WIDTH, n), self.room("change", *self.word.shape)
        change[...] = 0
        for k, lo, hi in runs:
            np.matmul(self.word[k], inner[:, lo:hi], out=more[:, lo:hi])
            np.matmul(h[:, lo:hi], inner[:, lo:hi].T, out=change[k])
        back += more
        change *= rate / n
        self.word -= change
        self.word_bias[[k for k, _, _ in runs]] -= rate / n * np.add.reduceat(inner, [lo for _, lo, _ in runs], axis=1).T
        self.group -= rate / n * (h @ level.T)
        self.group_bias -= rate / n * level.sum(1)
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        h *= rate / n
        back *= h
        self.bias -= back.sum(1)
        # every embedding is moved by the sum over the rows that it stands in, one width after the other
        at = (context + SIZE * np.arange(2 * SIDE)[:, None]).ravel()
        moved, weights = self.room("moved", WIDTH, 2 * SIDE * SIZE), self.room("weights", 2 * SIDE, n, kind=float)
        for k in range(WIDTH):
            weights[...] = back[k]
            moved[k] = np.bincount(at, weights.ravel(), 2 * SIDE * SIZE)
        self.place -= moved.T.reshape(self.place.shape)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the targets by group, and the sorted groups. Small integers are sorted in linear time."""
    g = (target // GROUP).astype(np.int16)
    order = np.argsort(g, kind="stable")
    return order, g[order]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of every column; ``x`` is used up."""
    top = x.max(axis=0)
    x -= top
    np.exp(x, out=x)
    return top + np.log(x.sum(axis=0))


def _softmax(x: np.ndarray) -> None:
    """Logits become shares of the classes (rows) in every column."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)


def train(docs: DataFrame, rounds: int = 2, mask: int = 8, batch: int = 2048, rate: float = 1.0,
          counts: DataFrame | None = None) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary and averaged weights after ``rounds`` rounds, each over its share of all documents."""
    bounded_batches(docs.sparkSession)
    known = vocabulary(word_counts(docs) if counts is None else counts)
    numbers = {w.encode("utf-8", "replace"): i for w, i in known.items()}
    weights = Network.start().flat()
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "share", F.pmod(F.xxhash64("text"), F.lit(rounds)).cast("int"))
    for turn in range(rounds):
        begin = weights

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, seen, held, size = Network.start().load(begin), 0, [], 0

            def take() -> None:
                context, target, hidden = (np.concatenate(x, axis=-1) for x in zip(*held))
                order = np.argsort(hidden.astype(np.int16), kind="stable")
                for some in np.array_split(order, -(-len(order) // batch)):
                    net.step(context[:, some], target[some], rate)

            for part in batches:
                every, ends, _, _ = encode_all(part.column(0), numbers)
                sizes = np.array([hi - lo for lo, hi in ends], np.int64)
                seeds = np.array([seed_of(t, turn) for t in as_list(part.column(0).cast(pa.binary()))], np.uint64)
                first = 0
                for k, (_, end) in enumerate(ends):
                    size += int(sizes[k])
                    if size < mask * batch and k + 1 < len(ends):
                        continue
                    some, lo = sizes[first:k + 1], ends[first][0]
                    if end > lo:
                        padded, at = edged(every[lo:end], some)
                        places = np.arange(end - lo) - np.repeat(np.cumsum(some) - some, some)
                        held.append((around(padded, at), every[lo:end], dealt(places, np.repeat(seeds[first:k + 1], some), mask)))
                        seen += end - lo
                    first = k + 1
                    if size >= mask * batch:
                        take()
                        held, size = [], 0
            if held:
                take()
            if seen:
                flat, task = net.flat(), TaskContext.get().partitionId()
                cut = [flat[k:k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(len(cut)), pa.int32()), pa.array([task // 32] * len(cut), pa.int32()),
                    pa.array([float(seen)] * len(cut)), pa.array(cut, pa.binary())], names=["chunk", "team", "n", "part"])

        def average(some: pd.DataFrame) -> pd.DataFrame:
            n = some["n"].sum()
            total = sum(k / n * np.frombuffer(p, np.float32).astype(float) for k, p in zip(some["n"], some["part"]))
            return pd.DataFrame({"chunk": [some["chunk"].iloc[0]], "team": [0], "n": [n], "part": [total.astype(np.float32).tobytes()]})

        shape = "chunk int, team int, n double, part binary"
        made = rows.where(F.col("share") == turn).select("text").mapInArrow(learn, shape)
        # first within teams of 32 tasks, then over the teams
        teams = stored(made.groupBy("chunk", "team").applyInPandas(average, shape), "team-weights")
        parts = teams.groupBy("chunk").applyInPandas(average, shape).orderBy("chunk").collect()
        if parts:
            weights = np.concatenate([np.frombuffer(p["part"], np.float32) for p in parts])
    return known, weights


def score(docs: DataFrame, known: dict[str, int], weights: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all words) and mean_log_prob of every row.

    ``counts`` are the words of the training corpus; by default ``docs`` is taken for that corpus.
    """
    bounded_batches(docs.sparkSession)
    own = (word_counts(docs) if counts is None else counts).where(~F.col("w").isin(list(known)))
    sums = own.groupBy((F.crc32(F.col("w").cast("binary")) % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    # what a word of a bucket has before its own count is known, to which log(count + 1) is added
    base, every_n = np.zeros(SIZE), 0
    for r in sums.collect():
        base[WORDS + r["b"]] = -np.log(r["n"] + r["words"] + 1)
        every_n += r["n"]
    # frequent words bring their counts along, the many others get them by a join
    often = F.col("n") >= -(-every_n // HEADS)
    sent = own.where(often).select(F.col("w").cast("binary").alias("w"), "n").toArrow()
    head_words, head_gains = sent["w"].combine_chunks(), np.log(sent["n"].to_numpy() + 1.0)
    numbers = {w.encode("utf-8", "replace"): i for w, i in known.items()}

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, heads = Network.start().load(weights), dict(zip(as_list(head_words), head_gains.tolist()))
        for batch in batches:
            words, which, begins = distinct_words(pc.ascii_lower(batch.column(1)))
            ids, sizes = encode(words, numbers), np.diff(begins)
            gains = np.array([heads.get(w, -1.0) for w in words])
            rare = (gains < 0) & (ids >= WORDS)
            own_share = base[ids] + np.maximum(gains, 0)
            hashes = np.zeros(len(words), np.uint64)
            hashes[rare] = [xxhash.xxh64_intdigest(words[k], 42) for k in np.flatnonzero(rare).tolist()]
            every, row = ids.astype(np.int16)[which], np.repeat(np.arange(len(sizes)), sizes)
            padded, at = edged(every, sizes)
            values = own_share[which]
            for lo in range(0, len(every), STRETCH):
                values[lo:lo + STRETCH] += net.log_probs(around(padded, at[lo:lo + STRETCH]), every[lo:lo + STRETCH])
            tail = rare[which]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row[tail], minlength=len(sizes)))])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)[which[tail]]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.bincount(row, values, len(sizes))), lists],
                names=["doc_id", "n_tokens", "log_prob", "rare"])

    shape = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("n_tokens", LongType()), ("log_prob", DoubleType()), ("rare", ArrayType(LongType()))):
        shape = shape.add(name, kind)
    # the row key is written once, so that it is the same in every later task
    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(total, shape)
    rows = stored(scored.select(F.monotonically_increasing_id().alias("key"), "*"), "scored")
    gains = own.where(~often).groupBy(F.xxhash64("w").alias("h")).agg(F.log(F.sum("n") + F.lit(1.0)).alias("gain"))
    met = rows.select("key", F.explode("rare").alias("h")).join(gains, "h")
    found = stored(met.groupBy("key").agg(F.sum("gain").alias("gain")), "gains")
    whole = F.col("log_prob") + F.coalesce("gain", F.lit(0.0))
    return rows.drop("rare").join(found, "key", "left").select(
        "doc_id", "n_tokens", whole.alias("log_prob"), F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).alias("mean_log_prob"))
