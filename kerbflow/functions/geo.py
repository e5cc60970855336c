"""Great-circle distance and two exact nearest-neighbour joins: within groups by grids, over everything by blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbflow.functions import boxes
from kerbflow.session import cut_lineage

# The two earth radii in use (stop search / shape distances).
RADIUS_STOP_SEARCH = 6371000.0
RADIUS_SHAPE = 6371008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_STOP_SEARCH) -> Column:
    """Metres between two points. The search radius uses the atan2 form, the shape radius the asin form."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    if radius == RADIUS_STOP_SEARCH:
        return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    return 2 * radius * F.asin(F.sqrt(h))


def cell(coordinate: Column, size: float) -> Column:
    return F.floor(coordinate / F.lit(size)).cast("bigint")


def around(c: Column) -> Column:
    return F.array(c - 1, c, c + 1)


def within_radius(points: DataFrame, targets: DataFrame, cell_size: float = 0.01) -> DataFrame:
    """Targets within ``radius_m`` of each point, as an equi-join on grid cells.

    ``points`` has ``lat, lon, radius_m``; ``targets`` has ``t_lat, t_lon``. Each point is expanded to the
    cells its bounding box touches, so the number of candidate rows follows the area searched and no side
    has to be broadcast.
    """
    d_lat = F.degrees(F.col("radius_m") / RADIUS_STOP_SEARCH)
    d_lon = d_lat / F.cos(F.radians(F.abs("lat") + d_lat))

    def span(name: str, delta: Column) -> Column:
        return F.sequence(cell(F.col(name) - delta, cell_size), cell(F.col(name) + delta, cell_size))

    probes = (
        points.withColumn("_cy", F.explode(span("lat", d_lat)))
        .withColumn("_cx", F.explode(span("lon", d_lon)))
    )
    placed = (
        targets.where(F.col("t_lat").isNotNull() & F.col("t_lon").isNotNull())
        .withColumn("_cy", cell(F.col("t_lat"), cell_size))
        .withColumn("_cx", cell(F.col("t_lon"), cell_size))
    )
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    return (
        placed.join(probes, ["_cy", "_cx"])
        .withColumn("distance_exact", distance)
        .where(F.col("distance_exact") <= F.col("radius_m"))
        .drop("_cy", "_cx")
    )


def nearest(
    points: DataFrame,
    targets: DataFrame,
    point_key: list[str],
    target_order: list[str],
    keep: list[str],
    by: list[str] | None = None,
    metric: str = "haversine",
    first_cell: float = 0.001,
) -> DataFrame:
    """Exact nearest target of every point, without comparing every pair.

    ``points`` carries ``lat, lon`` and ``point_key``; ``targets`` carries ``t_lat, t_lon``,
    ``target_order`` (tie order) and ``keep``; ``by`` lists columns both sides must share. A grid of cells
    is searched in the 3 x 3 block around each point: a hit closer than anything outside the block can be
    is final, the other points go on to a grid four times as coarse. Cells start small so that dense areas
    are settled while a cell still holds few targets. Cells do not wrap: points and targets on the two sides of
    longitude 180 do not see each other until the coarsest grid.
    """
    by = by or []
    lat, lon = F.col("lat"), F.col("lon")
    if metric == "haversine":
        dist = haversine_m(lat, lon, F.col("t_lat"), F.col("t_lon"))
    else:
        dist = (F.col("t_lon") - lon) * (F.col("t_lon") - lon) + (F.col("t_lat") - lat) * (F.col("t_lat") - lat)
    best = F.min(F.struct(dist.alias("d"), *[F.col(c) for c in dict.fromkeys(target_order + keep)])).alias("_hit")
    columns = list(dict.fromkeys(by + point_key))
    # both are read again on every grid
    pending = cut_lineage(points.where(lat.isNotNull() & lon.isNotNull()).select(*columns, "lat", "lon"))
    needed = list(dict.fromkeys([*by, *target_order, *keep, "t_lat", "t_lon"]))
    usable = cut_lineage(targets.where(F.col("t_lat").isNotNull() & F.col("t_lon").isNotNull()).select(*needed))
    settled: DataFrame | None = None
    size = first_cell
    while True:
        last = size >= 360  # the block then covers every coordinate
        probes = (
            pending.withColumn("_cy", F.explode(around(cell(lat, size))))
            .withColumn("_cx", F.explode(around(cell(lon, size))))
        )
        placed = usable.withColumn("_cy", cell(F.col("t_lat"), size)).withColumn("_cx", cell(F.col("t_lon"), size))
        hits = placed.join(probes, by + ["_cy", "_cx"]).groupBy(*columns, "lat", "lon").agg(best)
        if metric == "haversine":
            limit = RADIUS_STOP_SEARCH * F.asin(F.cos(F.radians(lat)) * math.sin(math.radians(min(size, 90.0))))
        else:
            limit = F.lit(size * size)
        final = cut_lineage(hits if last else hits.where(F.col("_hit.d") <= limit))
        settled = final if settled is None else settled.unionByName(final)
        if last:
            break
        pending = cut_lineage(pending.join(final.select(*columns), columns, "left_anti"))
        if pending.isEmpty():
            break
        size *= 4
    return settled.select(
        *columns, "lat", "lon", F.col("_hit.d").alias("distance"), *[F.col(f"_hit.{c}").alias(c) for c in keep]
    )


def nearest_of_all(
    points: DataFrame,
    targets: DataFrame,
    point_key: list[str],
    target_order: list[str],
    keep: list[str],
    block_bits: int = 15,
) -> DataFrame:
    """Exact nearest target of every point by great-circle distance, however many there are and wherever they lie.

    Columns as in :func:`nearest`; distances that are the same to a micrometre are a tie. Targets of one position are one
    place. Places are cut into blocks of at most ``2 ** block_bits`` by their order, first in latitude, then in longitude, and
    each block is outlined by a few boxes. A point is sent to the blocks that may hold its nearest place, mostly one, and
    many points of a block are dealt to several tasks. A task searches its block by a tree of boxes, so a dense area costs
    a point little more than an empty one, and no task holds more than its block and its share of points.
    """
    columns = list(dict.fromkeys(point_key))
    value = F.struct(*[F.col(c) for c in dict.fromkeys(target_order + keep)])
    places = cut_lineage(targets.where(_placed("t_lat") & _placed("t_lon")).groupBy("t_lat", "t_lon").agg(F.min(value).alias("_hit")))
    asked = points.where(_placed("lat") & _placed("lon")).select(*columns, "lat", "lon")
    block_rows, total = 1 << block_bits, places.count()
    if total <= block_rows:
        places = places.withColumn("_block", F.lit(0).cast("bigint"))
        asked = asked.withColumn("_block", F.lit(0).cast("bigint"))
    else:
        strips = places.repartitionByRange(math.ceil(math.sqrt(total / block_rows)), "t_lat").sortWithinPartitions("t_lon")
        # the id counts the rows of a strip
        places = cut_lineage(strips.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), block_bits)))
        sides = ", ".join(f"{c} double" for c in boxes.BOX)
        outlines = places.select("_block", "t_lat", "t_lon").groupBy("_block").applyInArrow(boxes.outline, f"_block bigint, {sides}")
        # at most 64 rows a block
        kinds = T.StructType([*asked.schema, T.StructField("_block", T.LongType())])
        asked = asked.mapInArrow(boxes.router(outlines.toArrow()), kinds)
    asked = cut_lineage(asked.withColumn("_turn", F.monotonically_increasing_id()))
    # one row a block
    parts = F.broadcast(asked.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_parts")))
    dealt = asked.join(parts, "_block").withColumn("_part", F.pmod("_turn", "_parts"))
    copies = places.join(parts, "_block").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    left, right = dealt.select("_block", "_part", *columns, "lat", "lon"), copies.select("_block", "_part", "t_lat", "t_lon", "_hit")
    kinds = T.StructType([*left.schema[2:], *right.schema[2:]])
    pairs = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInArrow(boxes.match, kinds)
    dist = haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    tie = F.struct(F.round(dist, 6).alias("near"), F.col("_hit").alias("hit"), dist.alias("d"))
    return pairs.groupBy(*columns, "lat", "lon").agg(F.min(tie).alias("_best")).select(
        *columns, "lat", "lon", F.col("_best.d").alias("distance"), *[F.col(f"_best.hit.{c}").alias(c) for c in keep])


def _placed(name: str) -> Column:
    """Whether a coordinate is a number: neither missing nor NaN nor infinite."""
    return F.abs(name) < float("inf")
