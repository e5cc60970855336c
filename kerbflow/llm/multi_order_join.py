"""Word-shingle Jaccard join: groups of documents linked at 0.75 or more, found by several global token orders.

1. *Sets.* Every text becomes the sorted set of 56-bit hashes of its five-word shingles (two shingles of one pair of
   documents with n shingles each share a hash with probability about n^2 / 7e16). Rows are written in blocks of a
   few million shingles.
2. *Counts.* For every shingle it must be known whether other documents have it, and roughly how many. Blocks send
   their distinct shingles (a prefix of the hash, one entry per block, so a shingle that a third of all documents share
   is an entry per block, not per document) to the part of the hash range they belong to, and get back those with
   two or more documents. A prefix may be shared by chance; that costs candidates, never links.
3. *Prefixes under several orders.* In each order a document's unshared shingles come first, then the shared ones: by
   document count in the first order, by two independent hashes in the others. Two sets with Jaccard 0.75 share a
   shingle among the first n - ceil(0.75 n) + 1 of each order. Unshared shingles match nothing, so only the shared
   ones that still fit in are kept; a document with less than 75 % shared shingles has none and is linked with nothing.
4. *Candidates and verification.* Candidates share a prefix shingle in the first order, at places that leave enough
   shingles for a link, and must also share one in every other order before their whole sets are compared. Pairs are not listed within a shingle's group. In a first step each
   document meets one pivot, the most central document of its groups; then pairs are listed only between documents of
   one group that are not yet known to be connected. Rounds of new pivots go on while those are many and a round makes them fewer; in the end every
   pair that shares a prefix shingle is connected, or was compared, or fails a filter. No cap, nothing is dropped.

Equal sets are one document in steps 4, under their smallest id; so a group of exact copies costs one row each.

Defined results: NULL or empty texts, or texts of white space, have no shingles and are linked with nothing. One to
four words are one shingle. A NULL ``doc_id`` can't be named in a group: such rows are returned alone, with component_id
NULL. Rows that repeat a ``doc_id`` with the same text are one document and are returned as often as they stand; with
different texts the id joins what either text links. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import LOWER, UPPER, bounded_batches, discard, keyed, picked, stored, stored_by, worker_state
from kerbflow.operators.graph import linked_components

PERCENT = 75
WORDS = 5
WIDTH = 7  # bytes of a shingle hash
BLOCK = 2_000_000  # shingles in a block of rows
PER_RANGE = 500_000  # shingles that one range of the hash space should get
RANGE_BITS = 8  # at least so many bits of ranges
ORDERS = 3
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of 64-bit values."""
    x = (x ^ FACTORS[salt]) * FACTORS[0]
    x ^= x >> np.uint64(32)
    x *= FACTORS[1]
    return x ^ (x >> np.uint64(29))


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit values."""
    return np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


class Shingler:
    """Sorted distinct shingle hashes of a text. Hashes of words are remembered, at most ``remember`` of them."""

    def __init__(self, remember: int = 300_000):
        self.known, self.remember = {}, remember

    def __call__(self, text: str) -> np.ndarray:
        words, known = text.encode("utf-8", "replace").lower().split(), self.known  # ASCII letters and white space only
        try:
            codes = [known[w] for w in words]
        except KeyError:
            if len(known) > self.remember:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            codes = [known[w] for w in words]
        h = np.array(codes, dtype=np.uint64)
        if not len(h):
            return h
        size = min(WORDS, len(h))
        value = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            value += h[k:len(h) - size + 1 + k] * FACTORS[k]
        return np.unique(mixed(value, 5) >> np.uint64(8))


SETS = "src bigint, doc_id bigint, n bigint, sig binary, tokens binary"


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Stored rows (src, doc_id, n, sig, tokens), one per row of ``docs`` with an id; ``src`` numbers blocks of rows."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in SETS.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, src, held = worker_state("shingles", Shingler), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = shingles(text)
                rows.append((src, doc_id, len(t), xxhash.xxh3_128_digest(t.tobytes()), pack(t, WIDTH)))
                held += len(t)
                if held > BLOCK:
                    src, held = src + 1, 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text).mapInArrow(make, SETS)
    return stored_by(rows, "src", "shingle-sets")


def shared_shingles(sets: DataFrame, bits: int) -> DataFrame:
    """Per block, which of its shingle prefixes (``bits`` + 24 bits) two or more documents have.

    Rows (src, part, tail, df): ``part`` is the range, ``tail`` packs the last 24 bits of the prefixes in order, ``df``
    the number of documents, 255 at most.
    """
    drop = np.uint64(8 * WIDTH - bits - 24)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def requests(src: int, held: list[np.ndarray]) -> pa.RecordBatch:
            prefix, count = np.unique(np.concatenate(held) >> drop, return_counts=True)
            part = (prefix >> np.uint64(24)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            tails, counts = np.split(prefix, cuts), np.split(np.minimum(count, 255).astype(np.uint8), cuts)
            return pa.RecordBatch.from_arrays([
                pa.array(part[np.concatenate([[0], cuts])], pa.int64()), pa.array([src] * len(tails), pa.int64()),
                pa.array([pack(t, 3) for t in tails], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())],
                names=["part", "src", "tail", "df"])

        block, held = None, []
        for batch in batches:
            for src, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if src != block and held:
                    yield requests(block, held)
                    held = []
                block = src
                if tokens:
                    # a long text may repeat a prefix; it counts once per document
                    held.append(np.unique(unpack(tokens, WIDTH) >> drop) << drop)
        if held:
            yield requests(block, held)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        tails = [unpack(t, 3) for t in rows["tail"]]
        values, back = np.unique(np.concatenate(tails), return_inverse=True)
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in rows["df"]])
        total = np.minimum(np.bincount(back, weights=counts), 255).astype(np.uint8)
        out, at = [], 0
        for src, tail in zip(rows["src"], tails):
            df = total[back[at:at + len(tail)]]
            at += len(tail)
            if (df > 1).any():
                out.append((src, rows["part"].iloc[0], pack(tail[df > 1], 3), df[df > 1].tobytes()))
        return pd.DataFrame(out, columns=["src", "part", "tail", "df"])

    asked = sets.select("src", "tokens").mapInArrow(ask, "part bigint, src bigint, tail binary, df binary")
    return asked.groupBy("part").applyInPandas(answer, "src bigint, part bigint, tail binary, df binary")


LINKABLE = "doc_id bigint, n bigint, shared bigint, sig binary, central double, tokens binary, p1 array<bigint>, p2 array<int>, p3 array<int>"


def linkable(sets: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Documents with enough shared shingles, their sets, and their prefix shingles under each order; ``row`` and ``block`` name the row.

    Of the last two orders only 32 bits of a shingle are kept: a chance match there costs a comparison.
    """
    drop = np.uint64(8 * WIDTH - bits - 24)
    names = [c.split()[0] for c in LINKABLE.split(", ")]

    def choose(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(answers):
            known = np.concatenate([unpack(t, 3) | np.uint64(int(p) << 24) for t, p in zip(answers["tail"], answers["part"])])
            count = np.concatenate([np.frombuffer(c, np.uint8) for c in answers["df"]])
            order = np.argsort(known)
            known, count = known[order], count[order]
            for doc_id, n, sig, data in zip(docs["doc_id"], docs["n"], docs["sig"], docs["tokens"]):
                tokens = unpack(data, WIDTH)
                prefix = tokens >> drop
                at = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
                hit = known[at] == prefix
                held = int(hit.sum())
                keep = held - -(-PERCENT * n // 100) + 1
                if n and keep > 0:
                    df, own = count[at[hit]], tokens[hit]
                    first = own[np.lexsort((own, df))[:keep]]
                    rest = [own[np.argsort(mixed(own, k), kind="stable")[:keep]] for k in (2, 3)]
                    out.append((doc_id, n, held, sig, float(df.sum()) / n, data, first.astype(np.int64), *[p.astype(np.uint32).view(np.int32) for p in rest]))
        return pd.DataFrame(out, columns=names)

    rows = sets.groupBy("src").cogroup(shared.groupBy("src")).applyInPandas(choose, LINKABLE)
    return keyed(rows, "row", "block", "linkable")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of ids in ``rows``, those that pass every order's prefix filter and have Jaccard 0.75 or more."""
    def jaccard(sizes: Iterator[tuple]) -> Iterator[pd.Series]:
        for left, right in sizes:
            out = []
            for x, y in zip(left, right):
                x, y = unpack(x, WIDTH), unpack(y, WIDTH)
                both = len(x) + len(y) - len(np.union1d(x, y))
                out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    jaccard.__annotations__ = {"sizes": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    similar = F.pandas_udf(jaccard, "boolean")
    side = lambda s: rows.select(*[F.col(c).alias(f"{s}{c}") for c in ("doc_id", "n", "p2", "p3")])
    sets = lambda s: rows.select(F.col("doc_id").alias(f"{s}doc_id"), F.col("tokens").alias(f"{s}tokens"))
    close = 100 * F.least("xn", "yn") >= PERCENT * F.greatest("xn", "yn")
    passed = (pairs.join(side("x"), F.col("a") == F.col("xdoc_id")).join(side("y"), F.col("b") == F.col("ydoc_id"))
              .where(close & F.arrays_overlap("xp2", "yp2") & F.arrays_overlap("xp3", "yp3")).select("a", "b"))
    passed = stored(passed, "filtered-pairs")
    return (passed.join(sets("x"), F.col("a") == F.col("xdoc_id")).join(sets("y"), F.col("b") == F.col("ydoc_id"))
            .where(similar("xtokens", "ytokens")).select("a", "b"))


def relabelled(label: DataFrame, links: DataFrame, own_names: bool = False) -> DataFrame:
    """``label`` (doc_id, component) after ``links`` (a, b) have connected its components.

    With ``own_names`` every document still is a component of its own, so the links need no look-up.
    """
    own = label.select("doc_id", "component")
    if own_names:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        ends = links.join(own.toDF("a", "u"), "a").join(own.toDF("b", "v"), "b").where("u <> v").select("u", "v")
    roots = linked_components(ends)
    if roots is None:
        return label
    roots = roots.toDF("component", "root")
    return stored(own.join(roots, "component", "left").select("doc_id", F.coalesce("root", "component").alias("component")), "labels")


def may_link(n: str, at: str, m: str, to: str) -> Column:
    """Whether sets of n and m shingles may link whose first common shingle stands at places ``at`` and ``to``.

    They have at most what is left from there on in common, and need 75/175 of their added sizes. Every linked pair
    passes at its first common shingle, which is in both prefixes.
    """
    left = F.least(F.col(n) - F.col(at), F.col(m) - F.col(to))
    return (100 + PERCENT) * left >= PERCENT * (F.col(n) + F.col(m))


def connected(rows: DataFrame, max_rounds: int = 6) -> DataFrame:
    """doc_id and component of the documents of ``rows`` that share a prefix shingle with another one."""
    # a shingle's place counts the unshared ones before it
    places = stored(rows.select("doc_id", "central", "n", "shared", F.posexplode("p1").alias("at", "t")).withColumn(
        "at", F.col("n") - F.col("shared") + F.col("at")).drop("shared"), "prefixes")
    shared = stored(places.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"), "shared-prefixes")
    groups = stored(places.join(shared, "t", "left_semi"), "prefix-groups")
    discard(places)
    compared = None
    label = stored(groups.select("doc_id").distinct().withColumn("component", F.col("doc_id")), "labels")
    before = math.inf
    for turn in itertools.count():
        if turn:
            members = stored(groups.join(label, "doc_id"), "members")
        else:
            members = groups.withColumn("component", F.col("doc_id"))
        # groups whose members are not all connected yet; tables are written before they meet many rows of a group, so
        # that the join is a plain one whose hot keys adaptive execution can split
        unsettled = stored(members.groupBy("t", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("t").agg(
            F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "component"))["component"].alias("largest"),
            F.sum("k").alias("size")).where("parts > 1"), "unsettled")
        everyone, members = members, stored(members.join(unsettled, "t"), "open-groups")
        if turn:
            discard(everyone)
        outside = F.col("component") != F.col("largest")
        size, cost = members.agg(F.count(F.lit(1)), F.sum(F.when(outside, F.col("size")))).first()
        if not size:
            break
        # unlike documents with a common shingle stay apart whatever pivot they meet: no further round helps then
        last = turn > 0 and (cost <= 20 * size or turn >= max_rounds or cost > 0.9 * before)
        before = cost
        if last:
            # all pairs between parts of a group: members outside its largest part meet the whole group
            side = lambda rows, s: rows.select("t", *[F.col(c).alias(s + c) for c in ("doc_id", "component", "n", "at")])
            pairs = side(members.where(outside), "x_").join(side(members, "y_"), "t").where(
                (F.col("x_component") != F.col("y_component")) & may_link("x_n", "x_at", "y_n", "y_at")).select(
                F.col("x_doc_id").alias("x"), F.col("y_doc_id").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            rank = F.struct(-F.col("central"), "doc_id") if turn == 0 else F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id")
            pivot = stored(members.groupBy("t").agg(F.min_by(F.struct("doc_id", "component", "n", "at"), rank).alias("p")), "pivots")
            meets = members.join(pivot, "t").where(
                (F.col("component") != F.col("p.component")) & may_link("n", "at", "p.n", "p.at")).groupBy(
                "doc_id", F.col("p.doc_id").alias("pivot")).agg(F.count(F.lit(1)).alias("k"))
            pairs = meets.groupBy("doc_id").agg(F.max_by("pivot", F.struct("k", -F.col("pivot"))).alias("pivot")).select(
                F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b"))
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        compared = pairs if compared is None else compared.unionAll(pairs)
        discard(members)
        label = relabelled(label, stored(verified(pairs, rows), "links"), own_names=turn == 0)
        if last:
            break
    return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    sets = shingle_sets(docs)
    sizes = stored(sets.select("doc_id", "n"), "set-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = min(max(RANGE_BITS, math.ceil(math.log2(max(total / PER_RANGE, 1)))), 8 * WIDTH - 24)
    rows = linkable(sets, shared_shingles(sets, bits), bits)
    discard(sets)  # the sets that may link are among the rows; of the others only the size is asked for
    # equal sets under their smallest id
    first = stored(rows.groupBy("sig", "n").agg(F.min(F.struct("doc_id", "row")).alias("m")).select(
        "sig", "n", F.col("m.doc_id").alias("first"), F.col("m.row").alias("row")), "distinct-sets")
    chosen = stored(picked(rows, "row", "block", first), "set-rows")
    named = stored(rows.select("doc_id", "sig", "n").join(first.drop("row"), ["sig", "n"]).groupBy("doc_id").agg(
        F.min("first").alias("first"), F.collect_set("first").alias("firsts")), "named")
    discard(rows)
    # an id with several texts connects their sets
    several = named.where(F.size("firsts") > 1).select(F.col("first").alias("a"), F.explode("firsts").alias("b")).where("a <> b")
    label = connected(chosen)
    if not several.isEmpty():
        lone = first.select(F.col("first").alias("doc_id")).join(label, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component"))
        label = relabelled(label.unionAll(lone.distinct()), several)
    label = label.withColumnRenamed("doc_id", "first")
    label = stored(named.select("doc_id", "first").join(label, "first", "left").select(
        "doc_id", F.coalesce("component", "first").alias("component_id")), "document-components")
    counted = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return counted.unionAll(unnamed(docs))


def unnamed(docs: DataFrame) -> DataFrame:
    """The rows without an id, alone; their shingles are counted with built-in functions."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WORDS - 1), F.lit(1)))
    count = F.when(F.size("w") == 0, 0).otherwise(F.size(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, WORDS)))))
    return docs.where(F.col("doc_id").isNull()).select("doc_id", words.alias("w")).select(
        "doc_id", count.cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
