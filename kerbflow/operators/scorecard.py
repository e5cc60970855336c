"""Observed headways, school scorecard and route overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import metrics as m
from kerbflow.functions.clock import window_hour
from kerbflow.functions.skew import counted_below, cube_median, cube_values, frequency_cube, value_at
from kerbflow.operators import gtfs as g
from kerbflow.operators.ridership import pick_load

Windows = dict[str, tuple[str, str]]


def windowed_records(records: DataFrame, windows: Windows) -> DataFrame:
    """Records of every named window: current and previous trip inside ``[start, end)``."""
    names = []
    for name, (start, end) in windows.items():
        lo, hi = window_hour(start), window_hour(end)
        prev = F.col("prev_scheduled_sec") / 3600
        inside = (F.col("local_hour") >= lo) & (F.col("local_hour") < hi) & (F.col("prev_scheduled_sec") > 0)
        names.append(F.when(inside & (prev >= lo) & (prev < hi), F.lit(name)))
    return records.withColumn("time_window", F.explode(F.array_compact(F.array(*names))))


def observed_headways(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Headway medians, floor-index quartiles and bunching per ``keys``; the rate divides by kept rows."""
    planned = F.when(F.col("scheduled_headway_sec") > 0, F.col("scheduled_headway_sec"))
    cube = frequency_cube(rows, keys, {"planned": planned, "actual": F.col("actual_headway_sec")}, {})
    groups = cube.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind").isNull(), F.col("n"))).alias("n"),
        F.coalesce(cube_median("planned"), F.lit(0.0)).alias("_sched"),
        cube_median("actual").alias("_act"),
        cube_values("actual").alias("_values"),
    )
    limit = m.bunching_threshold(F.col("_sched"))
    total = F.aggregate("_values", F.lit(0).cast("bigint"), lambda acc, h: acc + h["n"])
    groups = groups.withColumns({f"_p{share}": value_at(F.col("_values"), F.floor(total * share / 100)) for share in (25, 75)})
    groups = groups.withColumn("bunched", counted_below(F.filter("_values", lambda h: h["v"] > 0), limit))
    return groups.select(
        *keys, "n",
        (F.col("_act") / 60).alias("observed_median_min"),
        (F.col("_p25") / 60).alias("p25_min"),
        (F.col("_p75") / 60).alias("p75_min"),
        (F.col("bunched") / F.col("n")).alias("bunching_rate"),
        F.when(F.col("_sched") > 0, F.col("_sched") / 60).alias("csv_scheduled_min"),
    )


def observed_with_fallback(rows: DataFrame, pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stop-level metrics of each (route, stop) in ``pairs``, the route level where a stop has none."""
    by = by or []
    stop = observed_headways(rows, [*by, "route_id", "stop_id"]).withColumn("_stop", F.lit(True))
    values = ["n", "observed_median_min", "p25_min", "p75_min", "bunching_rate", "csv_scheduled_min"]
    route = observed_headways(rows, [*by, "route_id"]).select(
        *by, "route_id", *[F.col(v).alias(f"r_{v}") for v in values])
    joined = pairs.join(stop, [*by, "route_id", "stop_id"], "left").join(route, [*by, "route_id"], "left")
    own = F.col("_stop").isNotNull()
    return joined.where(own | F.col("r_n").isNotNull()).select(
        *by, "route_id", "stop_id",
        *[F.when(own, F.col(v)).otherwise(F.col(f"r_{v}")).alias(v) for v in values],
        (~own).alias("is_route_level"),
    )


def headway_grains(rows: DataFrame) -> DataFrame:
    """Every record counted for its (route, stop) and for its route (stop NULL) in one pass."""
    return rows.groupingSets(
        [["route_id", "stop_id"], ["route_id"]], "route_id", "stop_id"
    ).agg(F.count(F.lit(1)).alias("n"), F.median("actual_headway_sec").alias("median_actual_sec"))


def route_stop_headways(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per (route, stop): primary direction by count, lowest order in it, medians, ratio, sample count."""
    keys = [*(by or []), "route_id", "stop_id"]
    directions = rows.groupBy(*keys, "direction_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_point_order").alias("o"))
    primary = directions.groupBy(*keys).agg(
        F.min(F.struct(F.negative("n").alias("k"), F.col("direction_id"), F.col("o"))).alias("p"))
    planned = F.when(F.col("scheduled_headway_sec") > 0, F.col("scheduled_headway_sec"))
    values = rows.groupBy(*keys).agg(
        F.coalesce(F.median(planned), F.lit(0.0)).alias("s"), F.median("actual_headway_sec").alias("a"),
        F.count(F.lit(1)).alias("sample_count"))
    return values.join(primary, keys).select(
        *keys, F.col("p.direction_id").alias("direction_id"),
        F.coalesce("p.o", F.lit(0)).alias("time_point_order"),
        (F.col("s") / 60).alias("scheduled_median_min"), (F.col("a") / 60).alias("actual_median_min"),
        F.when(F.col("s") > 0, F.col("a") / F.col("s")).otherwise(0.0).alias("ratio"), "sample_count",
    )


def overlay_order(overlay: DataFrame) -> DataFrame:
    first = F.when(F.col("direction_id") == "Inbound", 0).otherwise(1)
    return overlay.orderBy("route_id", first, "direction_id", "time_point_order", "stop_id")


def merge_headways(pairs: DataFrame, scheduled: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Scheduled and stop-level observed headways of each pair, with the effective schedule and flags.

    The feed's headway wins when positive, else the one seen in the arrivals.
    """
    joined = pairs.join(scheduled.select(*keys, "scheduled_median_min"), keys, "left").join(
        observed.select(*keys, "observed_median_min", "p25_min", "p75_min", "bunching_rate", "csv_scheduled_min"),
        keys, "left")
    feed = F.coalesce("scheduled_median_min", F.lit(0.0))
    csv = F.col("csv_scheduled_min")
    effective = F.when(feed > 0, feed).otherwise(F.coalesce(csv, F.lit(0.0)))
    flags = F.array_compact(F.array(
        F.when((feed <= 0) & (csv > 0), F.lit("csv-scheduled")),
        F.when(F.col("observed_median_min").isNull(), F.lit("no-archived"))))
    return joined.withColumn("effective_min", effective).withColumn(
        "ratio", F.when(effective > 0, F.col("observed_median_min") / effective)
    ).withColumn("flags", F.array_join(flags, ","))


def crowding_flags(annotations: DataFrame) -> DataFrame:
    kind = F.col("type")
    return annotations.groupBy("stop_id", "route_id").agg(
        F.bool_or(kind == "crowding").alias("has_crowding"),
        F.bool_or(kind == "denied_boardings").alias("has_denied_boardings"))


def with_crowding(df: DataFrame, annotations: DataFrame) -> DataFrame:
    joined = df.join(crowding_flags(annotations), ["stop_id", "route_id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ["has_crowding", "has_denied_boardings"]})


def school_stop_headways(
    schools: DataFrame, feed: g.Feed, records: DataFrame, windows: Windows, service_date: str
) -> DataFrame:
    """Headways of every (school, window, route, stop) with stop-level observations.

    One plan for all schools and windows: nearby stops, the routes serving any of them, then scheduled and
    observed headways per (window, route, stop), joined once.
    """
    near = g.stops_near(schools, feed["stops"])
    routes = g.routes_for_stops(near, feed, ["school_id"])
    dates = schools.sparkSession.createDataFrame([(service_date,)], "d string").select(
        F.col("d").cast("date").alias("service_date"))
    active = g.active_services(dates, feed["calendar"], feed["calendar_dates"])
    keys = ["time_window", "route_id", "stop_id"]
    scheduled = g.scheduled_headways(feed, active, windows).drop("service_date")
    observed = observed_headways(windowed_records(records, windows), keys)
    pairs = observed.select(*keys).join(near, "stop_id").join(routes, ["school_id", "route_id"])
    return merge_headways(pairs, scheduled, observed, keys).where(F.col("observed_median_min").isNotNull())


def stop_view(headways: DataFrame, annotations: DataFrame) -> DataFrame:
    delayed = F.coalesce(F.col("ratio") >= m.DELAY_RATIO, F.lit(False))
    return with_crowding(headways.withColumn("has_delay", delayed), annotations)


def scorecard_rows(headways: DataFrame) -> DataFrame:
    """The key stop of each (school, window, route): the nearest one with data, best ratio first."""
    fields = ["stop_id", "stop_name", "effective_min", "observed_median_min", "p25_min", "p75_min",
              "bunching_rate", "ratio", "flags"]
    rows = headways.groupBy("school_id", "time_window", "route_id", "route_short_name", "route_long_name").agg(
        F.min_by(F.struct(*fields), F.struct("distance_m", "stop_id")).alias("k"))
    return rows.select(
        "school_id", "time_window", "route_id",
        F.concat_ws(" - ", "route_short_name", "route_long_name").alias("route_name"),
        *[F.col(f"k.{c}").alias(c) for c in fields],
    ).orderBy("school_id", "time_window", F.asc_nulls_last("ratio"), "route_id")


def routes_with_delay(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ratio") >= m.DELAY_RATIO).select("school_id", "time_window", "route_id", "ratio")


def route_overlay(
    headways: DataFrame, stops: DataFrame, metrics: DataFrame, loads: DataFrame, day: DataFrame | None = None
) -> DataFrame:
    """Map overlay: headways with stop position, direction-aware stop metrics and load.

    With a ``day`` table the on-time rate comes from it alone. Stops without coordinates are dropped.
    """
    position = stops.select("stop_id", "stop_name", F.col("stop_lat").cast("double").alias("lat"),
                            F.col("stop_lon").cast("double").alias("lon")
                            ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    code = F.when(F.col("direction_id") == "1", "Inbound").when(F.col("direction_id") == "0", "Outbound")
    # a feed may label a direction either way; a label equal to ours wins over its code
    exact = metrics.select("route_id", "stop_id", F.coalesce(code, "direction_id").alias("direction_id"),
                           code.isNotNull().alias("_coded"), "on_time_rate", "bunching_rate")
    known = exact.groupBy("route_id", "stop_id", "direction_id").agg(
        F.min_by(F.struct("on_time_rate", "bunching_rate"), "_coded").alias("s"))
    known = known.select("route_id", "stop_id", "direction_id", "s.on_time_rate", "s.bunching_rate")
    out = headways.join(position, "stop_id").join(known, ["route_id", "stop_id", "direction_id"], "left")
    if day is not None:
        out = out.drop("on_time_rate").join(day.select("route_id", "stop_id", "on_time_rate"), ["route_id", "stop_id"], "left")
    return pick_load(out, loads)


def overlay_filter(overlay: DataFrame, inbound: bool, outbound: bool, stop: str | None = None) -> DataFrame:
    """One selected direction keeps that direction; both or none keeps all."""
    kept = overlay
    if inbound != outbound:
        kept = kept.where(F.col("direction_id") == ("Inbound" if inbound else "Outbound"))
    return kept.where(F.col("stop_id") == stop) if stop else kept


