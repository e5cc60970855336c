"""Order-dependent operators that do not gather a whole group in one task.

A window over ``keys`` sorts each group in a single task. When one group can hold a large share of the
rows, the group is first cut into buckets that follow the order column; the window runs per bucket, one
summary row per bucket links the buckets, and a join on (keys, bucket) brings the link back. The result
equals the plain window's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, str]
) -> DataFrame:
    """``lag`` of ``values`` (output name → source column) over ``keys`` ordered by ``order``.

    ``bucket`` must never decrease along ``order``. Adds ``_has_prev`` telling a missing previous row from a
    previous row whose value is NULL. Rows with a missing key belong to no group and have no previous row.

    The input is read and shuffled once. Rows inside a bucket find their previous row there; only the first and the last
    row of every bucket go on to a window over the whole group, in which the row before a first row is the last row of
    the bucket before. Rows alike in ``order`` go by a hash of all columns, so that both passes agree on them.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    tagged = df.withColumn("_bucket", bucket).withColumn("_tie", F.xxhash64(*names))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order, "_tie")
    packed = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    tagged = tagged.withColumns({"_prev": F.lag(packed).over(local), "_more": F.lead(F.lit(True)).over(local)})
    edge = F.col("_prev").isNull() | F.col("_more").isNull()
    chain = Window.partitionBy(*keys).orderBy("_bucket", *order, "_tie")
    edges = tagged.where(edge).withColumn("_prev", F.coalesce("_prev", F.lag(packed).over(chain)))
    joined = tagged.where(~edge).unionByName(edges)
    grouped = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    joined = joined.withColumn("_p", F.when(grouped, F.col("_prev")))
    return joined.select(
        *names,
        *[F.col(f"_p.{out}").alias(out) for out in values],
        F.col("_p").isNotNull().alias("_has_prev"),
    )


def bucketed_running(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str, how: str
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` from the start of the group to the current row."""
    fold = {"sum": F.sum, "max": F.max}[how]
    tagged = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("_local", fold(value).over(local))
    chain = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tagged.groupBy(*keys, "_bucket").agg(fold(value).alias("_total"))
        .withColumn("_carry", fold("_total").over(chain)).drop("_total")
    )
    joined = tagged.join(carry, keys + ["_bucket"], "left")
    if how == "sum":
        combined = F.coalesce("_local", F.lit(0.0)) + F.coalesce("_carry", F.lit(0.0))
    else:
        combined = F.greatest("_local", "_carry")
    return joined.select(*df.columns, combined.alias(out))


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``order`` (``bucket`` must follow ``order``).

    Without keys all rows are numbered in one sequence. ``bucket`` is then a number, and the buckets are summed up in
    blocks of 1024, so that one task sees a row per block only.
    """
    if not keys:
        return _numbered(df, bucket, order, out)
    tagged = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    tagged = tagged.withColumn("_local", F.row_number().over(local))
    chain = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(chain), F.lit(0))).drop("_n")
    )
    joined = tagged.join(offset, keys + ["_bucket"], "left")
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).cast("int").alias(out))


def _numbered(df: DataFrame, bucket: Column, order: list[str], out: str) -> DataFrame:
    tagged = df.withColumns({"_bucket": bucket, "_block": F.floor(bucket / 1024)})
    tagged = tagged.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    counts = tagged.groupBy("_block", "_bucket").agg(F.count(F.lit(1)).alias("_n"))

    def earlier(window: Window, name: str) -> Column:
        rows_before = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(rows_before), F.lit(0)).alias(name)

    in_block = counts.select("_block", "_bucket", earlier(Window.partitionBy("_block").orderBy("_bucket"), "_inside"))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).select(
        "_block", earlier(Window.orderBy("_block"), "_before"))
    joined = tagged.join(in_block.join(blocks, "_block").drop("_block"), "_bucket")
    return joined.select(*df.columns, (F.col("_local") + F.col("_inside") + F.col("_before")).cast("bigint").alias(out))


def frequency_cube(rows: DataFrame, keys: list[str], values: dict[str, Column], base: dict[str, Column]) -> DataFrame:
    """How often each value stands in each group: ``keys``, kind, value, n.

    ``values`` names the kinds. A kind of its own, NULL, has the aggregates ``base`` of the group's rows. A hot group is
    combined before the shuffle and costs its distinct values, whatever its number of rows.
    """
    kinds = [F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value")) for kind, value in values.items()]
    own = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("value"))
    cells = F.filter(F.array(own, *kinds), lambda c: c["kind"].isNull() | c["value"].isNotNull())
    long = rows.withColumn("_cell", F.explode(cells)).withColumns({"kind": F.col("_cell.kind"), "value": F.col("_cell.value")})
    return long.groupBy(*keys, "kind", "value").agg(F.count(F.lit(1)).alias("n"), *[
        column.alias(name) for name, column in base.items()])


def cube_median(kind: str) -> Column:
    """Exact median of a kind of a cube."""
    return F.percentile(F.when(F.col("kind") == kind, F.col("value")), F.lit(0.5), F.col("n"))


def cube_values(kind: str, ceiling: float | None = None) -> Column:
    """Distinct values of a kind with their counts; with ``ceiling`` only those between 0 and it."""
    kept = F.col("kind") == kind
    if ceiling is not None:
        kept = kept & (F.col("value") > 0) & (F.col("value") < ceiling)
    return F.collect_list(F.when(kept, F.struct(F.col("value").alias("v"), F.col("n").alias("n"))))


def counted_below(values: Column, limit: Column) -> Column:
    """Number of rows of :func:`cube_values` below ``limit``."""
    return F.aggregate(F.filter(values, lambda h: h["v"] < limit), F.lit(0).cast("bigint"), lambda acc, h: acc + h["n"])


def value_at(values: Column, place: Column) -> Column:
    """The value at a place (from 0) of the rows of :func:`cube_values` in rising order."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(F.array_sort(values), start, lambda acc, h: F.struct(
        (acc["seen"] + h["n"]).alias("seen"),
        F.when(acc["v"].isNull() & (acc["seen"] + h["n"] > place), h["v"]).otherwise(acc["v"]).alias("v")))["v"]


def salted_lookup(big: DataFrame, small: DataFrame, big_key: str, small_key: str, spread: list[str],
                  heavy_rows: int = 1_000_000) -> DataFrame:
    """Left join of ``big`` to ``small`` (one row per key) that splits keys with very many rows.

    Keys holding more than ``heavy_rows`` rows are listed; there are at most rows / ``heavy_rows`` of them. Whether the
    list is sent to every task or shuffled is left to Spark's check of its size. Their rows are spread over several salts by a hash of ``spread`` and
    their ``small`` row is repeated once per salt.
    """
    heavy = (
        big.groupBy(F.col(big_key).alias("_hk")).agg(F.count(F.lit(1)).alias("_hn"))
        .where(F.col("_hn") > heavy_rows)
        .select("_hk", F.ceil(F.col("_hn") / heavy_rows).alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(heavy, F.col(big_key) == F.col("_hk"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), parts)).drop("_hk", "_parts")
    right = small.join(heavy, F.col(small_key) == F.col("_hk"), "left").withColumn(
        "_rsalt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_hk", "_parts")
    same = (F.col(big_key) == F.col(small_key)) & (F.col("_salt") == F.col("_rsalt"))
    return left.join(right, same, "left").drop("_salt", "_rsalt")
