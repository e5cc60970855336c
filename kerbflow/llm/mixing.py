"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are) and normalised. The
exponent is bisected on the sums over all sources: the largest one whose entropy reaches the target, unless a source
would then be repeated more often than allowed; the limit on repetition comes first. The weights are realised as
permutations: the documents of a source are dealt into blocks by hash, every pass over the source takes its blocks in
another order and the documents of a block in another order, and the last pass ends where the source's budget is
spent. ``place`` (0 to 1 within every source) merges the sources so that each stretch of the mixture has the weights.

Only built-in functions are used. A source with a third of all rows is many blocks; running totals go over blocks (in
two levels) and within a block, never over a source.

Defined results: a document's tokens are its words between ASCII white space, one at least, so empty and NULL texts stay
in. NULL is a source of its own. Rows that repeat doc_id, source and text are one unit, taken together; rows that share
a doc_id only are told apart by their text. Documents are dealt into blocks by a hash of doc_id; rows without an id, and
those of an id that has several texts with more tokens than a block, by a hash of the row. Ties of the permutation go by doc_id. An empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbflow.functions.skew import bucketed_running
from kerbflow.llm.common import stored

BLOCK_TOKENS = 100_000
STEP_BITS, STEPS = 4, 6
SEED = "mix"


def n_tokens(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("bigint")


def order_key(*parts: Column) -> Column:
    """60 bits that depend on ``parts`` and look random."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 15), 16, 10).cast("bigint")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["source"], docs["text"])


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def units(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, text): s (the source, never NULL), key, doc_id, source, copies, tokens."""
    rows = docs.select("doc_id", "source", _source(docs["source"]).alias("s"), row_key(docs).alias("key"), n_tokens(docs["text"]).alias("t"))
    return rows.groupBy("s", "key", "doc_id").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("copies"), F.sum("t").alias("tokens"))


def exponent(sources: DataFrame, entropy: float, repetitions: float, budget: int | None) -> float:
    """The exponent for ``sources`` (s, tokens): a multiple of 2^-24 between 0 and 1.

    Each step tries 15 values at once on the sums over all sources and keeps a sixteenth of the interval.
    """
    total, top, count = sources.agg(F.sum("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not count:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def sums(values: list[float]) -> list:
        tried = sources.select(share.alias("p"), F.explode(F.array(*[F.lit(v) for v in values])).alias("e"))
        return tried.groupBy("e").agg(
            F.sum(F.pow("p", "e")).alias("z"), F.sum(F.pow("p", "e") * F.log("p")).alias("l"),
            F.max(F.pow("p", F.col("e") - 1)).alias("r")).orderBy("e").collect()

    def too_even(row) -> bool:
        """Whether the entropy at this exponent reaches the target, so that a larger exponent may do too."""
        return math.log(row["z"]) - row["e"] * row["l"] / row["z"] >= entropy * math.log(count) - 1e-12

    def too_often(row) -> bool:
        most = row["r"] / (top / total) ** (row["e"] - 1) if budget is None else budget / total * row["r"] / row["z"]
        return most > repetitions * (1 + 1e-12)

    def bisect(small_enough) -> float:
        """The largest exponent that ``small_enough`` holds for; it holds up to some point."""
        if small_enough(sums([1.0])[0]):
            return 1.0
        low, width = 0.0, 1.0
        for _ in range(STEPS):
            width /= 1 << STEP_BITS
            low = max([low, *[r["e"] for r in sums([low + k * width for k in range(1, 1 << STEP_BITS)]) if small_enough(r)]])
        return low

    by_entropy, by_limit = bisect(too_even), bisect(too_often)
    # by_limit still repeats too often, one step more does not
    step = 2.0 ** -(STEP_BITS * STEPS)
    return max(by_entropy, min(by_limit + step, 1.0) if by_limit > 0 or too_often(sums([0.0])[0]) else 0.0)


def quotas(sources: DataFrame, tau: float, budget: int | None) -> DataFrame:
    """Adds weight, and quota in tokens. Without a budget the largest source is taken once and no source less."""
    total, top = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    total, top = float(total or 1), float(top or 1)
    share = F.col("tokens") / total
    z = sources.agg(F.sum(F.pow(share, F.lit(tau)))).first()[0] or 1.0
    times = F.pow(F.col("tokens") / top, F.lit(tau - 1)) if budget is None else F.pow(share, F.lit(tau - 1)) * (budget / total / z)
    return sources.withColumn("weight", F.pow(share, F.lit(tau)) / z).withColumn("quota", F.round(F.col("tokens") * times).cast("bigint"))


def mixture(docs: DataFrame, entropy: float = 0.95, repetitions: float = 4.0, budget: int | None = None,
            block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per unit and pass: doc_id, source, key, copies, tokens, epoch, block, start, weight, place."""
    rows = stored(units(docs), "units")
    sources = stored(rows.groupBy("s").agg(F.sum("tokens").alias("tokens")), "sources")
    tau = exponent(sources, entropy, repetitions, budget)
    plan = quotas(sources, tau, budget).select(
        "s", F.col("tokens").alias("all"), "weight", "quota", F.ceil(F.col("tokens") / block_tokens).alias("blocks"))
    plan = stored(plan, "source-plan")
    # the plan's few columns reach the rows by a join that adaptive execution can split where a source is large
    many = rows.where("doc_id IS NOT NULL").groupBy("s", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).where(
        (F.col("n") > 1) & (F.col("t") > block_tokens)).select("s", "doc_id", F.lit(True).alias("_by_row"))
    by_row = F.col("doc_id").isNull() | F.coalesce("_by_row", F.lit(False))
    name = F.when(by_row, F.col("key").cast("string")).otherwise(F.col("doc_id").cast("string"))
    dealt = rows.join(plan.select("s", "blocks"), "s").join(many, ["s", "doc_id"], "left").withColumn(
        "block", F.pmod(order_key(name), F.col("blocks"))).drop("blocks", "_by_row")
    dealt = stored(dealt, "dealt")
    passes = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("quota") / F.col("all")) - 1, F.lit(0).cast("bigint")))
    blocks = (dealt.groupBy("s", "block").agg(F.sum("tokens").alias("size")).join(plan, "s")
              .where("quota > 0").withColumn("epoch", F.explode(passes))
              .withColumn("turn", order_key(F.col("s"), F.col("epoch"), F.col("block"))))
    ran = bucketed_running(blocks, ["s", "epoch"], F.shiftright("turn", 48), ["turn", "block"], "size", "upto", "sum")
    before = ran.withColumn("upto", F.col("upto").cast("bigint")).select("s", "block", "epoch", "weight", "quota",
                           (F.col("epoch") * F.col("all") + F.col("upto") - F.col("size")).alias("from")).where("from < quota")
    before = stored(before, "block-starts")
    within = Window.partitionBy("s", "block", "epoch").orderBy("order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(before, ["s", "block"]).withColumn("order", order_key(F.col("epoch"), F.col("doc_id"))).withColumn(
        "start", F.col("from") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return placed.where("start < quota").select(
        "doc_id", "source", "key", "copies", "tokens", "epoch", "block", "start", "weight",
        (F.col("start") / F.col("quota")).alias("place"))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it; same columns, no order."""
    times = mixture(docs, **how).groupBy("key").agg(F.count(F.lit(1)).alias("_times"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select("*", row_key(docs).alias("_mix_key")).join(
        times.withColumnRenamed("key", "_mix_key"), "_mix_key")
    repeat = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))
    return joined.select(*columns, repeat.alias("_mix_turn")).drop("_mix_turn")
