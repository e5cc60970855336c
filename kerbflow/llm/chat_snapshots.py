"""Chat formatting with collapse of cumulative snapshots.

A conversation is often logged again after every turn, so a log is full of conversations that are the beginning of a
longer one. Each turn gets the hash of everything up to it (the sums, over the turns so far, of four 32-bit parts of an
MD5 of position, role and text). A conversation whose last such hash is one of another conversation's earlier turns is a
snapshot and is removed by an anti-join; of conversations that are equal in full the smallest id stays. What is left is
rendered.

Positions and sums are made per bucket of turns and linked by one row per bucket, hashes are made distinct before they
are joined, and text is rendered in segments of ``SEGMENT`` turns, so neither a conversation with a third of all rows nor
a first turn that a third of all conversations share ends up in one task. Only built-in functions are used.

Defined results: rows that repeat conversation, turn, role and text are one turn. Turns that share a number are ordered
by the hash of role and text; a NULL number comes first. NULL is a conversation id of its own; a NULL role or text differs
from an empty one but renders as nothing. An empty table renders nothing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbflow.functions.skew import bucketed_row_number
from kerbflow.llm.common import stored

SEGMENT = 64
KEY = ["pos", "s0", "s1", "s2", "s3"]


def _marked(value: Column) -> Column:
    """A text that tells NULL from any value."""
    return F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit("="), value), F.lit("-"))


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns: c (the conversation, never NULL), t (turn number, never NULL), digest, conv_id, role, text."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("c"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 62))).alias("t"),
        F.md5(F.concat(_marked(F.col("role")), F.lit("|"), _marked(F.col("text")))).alias("digest"), "conv_id", "role", "text")
    return rows.groupBy("c", "t", "digest").agg(*[F.first(x).alias(x) for x in ("conv_id", "role", "text")])


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """Adds pos (from 1) and the four sums of the turns up to it to ``rows`` (c, t, digest)."""
    placed = bucketed_row_number(rows, ["c"], F.shiftright("t", 6), ["t", "digest"], "pos")
    mixed = F.md5(F.concat_ws("|", F.col("pos"), F.col("digest")))
    parts = [F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"v{k}") for k in range(4)]
    placed = stored(placed.select("c", "t", "digest", "pos", F.floor((F.col("pos") - 1) / SEGMENT).alias("segment"), *parts), "turn-hashes")
    chain = Window.partitionBy("c").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("c", "segment").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(4)])
    before = totals.select("c", "segment", *[F.coalesce(F.sum(f"v{k}").over(chain), F.lit(0)).alias(f"b{k}") for k in range(4)])
    local = Window.partitionBy("c", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(before, ["c", "segment"]).select(
        "c", "t", "digest", "pos", "segment", *[(F.sum(f"v{k}").over(local) + F.col(f"b{k}")).alias(f"s{k}") for k in range(4)])


def maximal(hashed: DataFrame) -> DataFrame:
    """Conversations that are no beginning of a longer one and the first of their equals: c, n (number of turns)."""
    ends = hashed.groupBy("c").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = stored(ends.select("c", *[F.col(f"end.{k}").alias(k) for k in KEY]), "conversation-ends")
    lasts = ends.groupBy(*KEY).agg(F.min(F.struct(F.char_length("c").alias("k"), "c")).alias("m"), F.count(F.lit(1)).alias("equal"))
    # a hash of an inner turn: more conversations have it than end there
    inner = hashed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("seen"))
    snapshots = inner.join(lasts.select(*KEY, "equal"), KEY).where(F.col("seen") > F.col("equal")).select(*KEY)
    return lasts.join(snapshots, KEY, "left_anti").select(F.col("m.c").alias("c"), F.col("pos").alias("n"))


def rendered(conversations: DataFrame, before_role: str = "<|im_start|>", after_role: str = "\n", end: str = "<|im_end|>\n") -> DataFrame:
    """conv_id, n_turns, segment, rendered: every conversation that stays, in segments of at most ``SEGMENT`` turns."""
    rows = stored(turns(conversations), "turns")
    hashed = stored(prefix_hashes(rows.select("c", "t", "digest")), "prefix-hashes")
    kept = stored(maximal(hashed), "maximal")
    places = hashed.select("c", "t", "digest", "pos", "segment").join(kept, "c")
    piece = F.concat(F.lit(before_role), F.coalesce("role", F.lit("")), F.lit(after_role), F.coalesce("text", F.lit("")), F.lit(end))
    shown = rows.join(stored(places, "places"), ["c", "t", "digest"]).select("c", "conv_id", "n", "segment", "pos", piece.alias("piece"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return shown.groupBy("c", "segment").agg(
        F.first("conv_id").alias("conv_id"), F.first("n").cast("bigint").alias("n_turns"),
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("rendered")).select(
        "conv_id", "n_turns", "segment", "rendered")
