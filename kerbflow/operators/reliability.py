"""On-time, bunching and trip-duration metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import metrics as m
from kerbflow.functions.skew import bucketed_row_number, counted_below, cube_median, cube_values, frequency_cube
from kerbflow.operators.arrivals import STOP_DAY, TRIP_KEY, TRIP_ORDER, positive, quarter_hour, scheduled_gap

SCHEDULED, GAP, ACTUAL = "scheduled", "gap", "actual"


def stop_day_metrics(filled: DataFrame, by_hour: bool = False) -> DataFrame:
    """Per (route, stop, direction, date), and per clock hour if asked, from rows with their headway filled.

    The bunching rate divides by **all** rows. Medians are exact. :func:`stop_day_summary` gives the same
    from cleaned rows, without computing the filled rows first.
    """
    keys = STOP_DAY + (["hour"] if by_hour else [])
    rows = filled.withColumn("hour", F.floor("local_hour").cast("int")) if by_hour else filled
    on_time = m.on_time(F.col("actual_sec"), F.col("scheduled_sec")).cast("int")
    cube = frequency_cube(
        rows.withColumn("_on_time", on_time), keys,
        {SCHEDULED: F.col("scheduled_headway_sec"), GAP: scheduled_gap(by_hour), ACTUAL: F.col("actual_headway_sec")},
        {"on_time": F.sum("_on_time"), "place": F.min("time_point_order")})
    own = F.col("kind").isNull()
    return _of_cells(cube.withColumns({c: F.when(own, F.col(v)) for c, v in {"n_obs": "n", "on_time": "on_time", "place": "place"}.items()}), keys)


def _of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of cells ``kind, value, n``; ``n_obs, on_time, place`` stand in one cell of each of their rows."""
    groups = cells.groupBy(*keys).agg(
        F.coalesce(F.min("place"), F.lit(0)).alias("time_point_order"),
        F.sum("n_obs").alias("n_obs"),
        F.sum("on_time").alias("on_time_count"),
        F.coalesce(cube_median(SCHEDULED), cube_median(GAP)).alias("median_scheduled_headway_sec"),
        cube_median(ACTUAL).alias("median_actual_headway_sec"),
        cube_values(ACTUAL, m.BUNCHING_MAX_SEC).alias("_short"),
    )
    limit = m.bunching_threshold(F.col("median_scheduled_headway_sec"))
    groups = groups.withColumn("bunched_count", counted_below(F.col("_short"), limit)).drop("_short")
    return groups.withColumn("on_time_rate", F.col("on_time_count") / F.col("n_obs")).withColumn(
        "bunching_rate", F.col("bunched_count") / F.col("n_obs"))


def stop_day_quarters(clean: DataFrame) -> DataFrame:
    """Summary of every quarter of an hour of a stop-day, with the headways that reach back to the quarter before.

    ``cells`` (kind, value, n) counts the scheduled headways, the gaps to the previous scheduled clock and the actual
    headways, filled as in :func:`fill_actual_headway`; ``n_obs, on_time, place`` summarise the rows. Rows are shuffled
    once, by stop-day and quarter, and reduced to value counts there; what meets per stop-day is one row a quarter.
    """
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in STOP_DAY])  # other rows have no previous row
    keys = [*STOP_DAY, "quarter"]
    names = [F.col(f"`{c}`") for c in clean.columns]
    local = Window.partitionBy(*keys).orderBy(*TRIP_ORDER, "_tie")
    rows = clean.withColumns({"quarter": quarter_hour(), "_tie": F.xxhash64(*names)}).withColumns({
        "_planned": F.lag("scheduled_sec").over(local), "_seen": F.lag("actual_sec").over(local),
        "_first": F.lag(F.lit(True)).over(local).isNull(), "_last": F.lead(F.lit(True)).over(local).isNull()})
    previous = F.when(known, F.col("_seen"))
    clocks = F.struct("scheduled_sec", "actual_sec", "actual_headway_sec")
    cube = frequency_cube(
        rows.withColumn("_on_time", m.on_time(F.col("actual_sec"), F.col("scheduled_sec")).cast("int")), keys,
        {SCHEDULED: F.col("scheduled_headway_sec"), GAP: F.when(known, F.col("scheduled_sec") - F.col("_planned")),
         ACTUAL: F.coalesce("actual_headway_sec", positive(F.col("actual_sec") - previous))},
        {"on_time": F.sum("_on_time"), "place": F.min("time_point_order"),
         "head": F.max(F.when(F.col("_first"), clocks)), "tail": F.max(F.when(F.col("_last"), clocks))})
    own = F.col("kind").isNull()
    quarters = cube.groupBy(*keys).agg(
        F.collect_list(F.when(~own, F.struct("kind", "value", "n"))).alias("cells"),
        *[F.max(F.when(own, F.col(c))).alias(out) for c, out in
          {"n": "n_obs", "on_time": "on_time", "place": "place", "head": "head", "tail": "tail"}.items()])
    chain = Window.partitionBy(*STOP_DAY).orderBy("quarter")
    before = quarters.withColumn("_before", F.when(known, F.lag(F.struct("quarter", "tail")).over(chain)))
    filled = F.when(F.col("head.actual_headway_sec").isNull(), positive(F.col("head.actual_sec") - F.col("_before.tail.actual_sec")))
    return before.select(
        *keys, "n_obs", "on_time", "place", "cells", filled.alias("filled"),
        (F.col("head.scheduled_sec") - F.col("_before.tail.scheduled_sec")).alias("gap"),
        # whether the gap stays in one clock hour
        (F.floor(F.col("_before.quarter") / 4) == F.floor(F.col("quarter") / 4)).alias("in_hour"))


def stop_day_summary(quarters: DataFrame, by_hour: bool = False) -> DataFrame:
    """:func:`stop_day_metrics` from :func:`stop_day_quarters`, without another shuffle."""
    def cell(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(1).cast("bigint").alias("n"))

    gap = F.when(F.col("in_hour"), F.col("gap")) if by_hour else F.col("gap")
    back = F.filter(F.array(cell(ACTUAL, F.col("filled")), cell(GAP, gap)), lambda c: c["value"].isNotNull())
    keys = STOP_DAY + (["hour"] if by_hour else [])
    rows = quarters.withColumn("hour", F.floor(F.col("quarter") / 4).cast("int"))
    cells = rows.select(*keys, "n_obs", "on_time", "place", F.posexplode_outer(F.concat("cells", back)).alias("_at", "_cell"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    return _of_cells(cells.select(*keys, "_cell.kind", "_cell.value", "_cell.n", *[
        F.when(first, F.col(c)).alias(c) for c in ("n_obs", "on_time", "place")]), keys)


def min_samples(df: DataFrame, n: int = m.MIN_STOP_SAMPLES, column: str = "n_obs") -> DataFrame:
    return df.where(F.col(column) >= n)


def stop_metrics(daily: DataFrame, by_hour: bool = False) -> DataFrame:
    """Over dates: medians of the daily rates, stops with too few observations dropped."""
    keys = ["route_id", "stop_id", "direction_id"] + (["hour"] if by_hour else [])
    agg = daily.groupBy(*keys).agg(
        F.min("time_point_order").alias("time_point_order"),
        F.median("on_time_rate").alias("on_time_rate"),
        F.median("bunching_rate").alias("bunching_rate"),
        F.sum("n_obs").alias("n_obs"),
    )
    return min_samples(agg)


def stop_metrics_by_hour(quarters: DataFrame) -> DataFrame:
    """All hours in one pass: the hour joins the grouping key instead of 24 filtered passes."""
    return stop_metrics(stop_day_summary(quarters, by_hour=True), by_hour=True)


def route_comparison(daily: DataFrame, min_stop_days: int = m.MIN_ROUTE_STOP_DAYS) -> DataFrame:
    agg = daily.groupBy("route_id").agg(
        F.median("on_time_rate").alias("on_time_rate"),
        F.median("bunching_rate").alias("bunching_rate"),
        F.count("on_time_rate").alias("n_stop_days"),
    )
    return min_samples(agg, min_stop_days, "n_stop_days")


def reliability_summary(daily: DataFrame, focus: str) -> DataFrame:
    """One row per route: row and date counts, stop-days, medians (focus route: valid stop-days only)."""
    counts = daily.groupBy("route_id").agg(
        F.sum("n_obs").alias("n_rows"), F.count_distinct("service_date").alias("n_dates"))
    used = daily.where((F.col("route_id") != focus) | (F.col("n_obs") >= m.MIN_STOP_SAMPLES))
    rates = used.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_stop_days"),
        F.median("on_time_rate").alias("on_time_rate"),
        F.median("bunching_rate").alias("bunching_rate"),
    )
    return counts.join(rates, "route_id", "left").withColumn("is_focus", F.col("route_id") == focus)


def worst_stops(daily: DataFrame, focus: str, k: int = 5) -> DataFrame:
    """The ``k`` worst stop-days by bunching, then one row per stop, so fewer than ``k`` may remain."""
    top = (
        daily.where((F.col("route_id") == focus) & (F.col("n_obs") >= m.MIN_STOP_SAMPLES))
        .orderBy(F.desc("bunching_rate"), "stop_id", "direction_id", "service_date")
        .limit(k)
    )
    return top.groupBy("stop_id").agg(
        F.max_by(F.struct("bunching_rate", "n_obs"),
                 F.struct("bunching_rate", F.negative("n_obs").alias("n"))).alias("_w")
    ).select("stop_id", "_w.bunching_rate", "_w.n_obs")


def trip_summaries(points: DataFrame) -> DataFrame:
    """First and last time point of every half-trip; only these two need an actual clock.

    Input is one row per time point.
    """
    ends = points.groupBy("route_id", *TRIP_KEY).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(F.struct("scheduled_sec", "actual_sec"), "time_point_order").alias("a"),
        F.max_by(F.struct("scheduled_sec", "actual_sec"), "time_point_order").alias("b"),
    ).where(F.col("n_points") >= 2)
    actual = F.col("b.actual_sec") - F.col("a.actual_sec")
    planned = F.col("b.scheduled_sec") - F.col("a.scheduled_sec")
    out = ends.where((actual >= 0) & (planned > 0)).select(
        "route_id", *TRIP_KEY,
        F.col("a.scheduled_sec").alias("first_sched_sec"),
        (actual / 60).alias("trip_min"),
        (planned / 60).alias("sched_trip_min"),
        (actual - planned > m.TRIP_DELAY_SEC).alias("delayed"),
    )
    return out


def trip_series_order(trips: DataFrame) -> DataFrame:
    """Position ``pos`` of each trip within its route by date and start; a route is numbered day by day."""
    day = F.unix_date("service_date")
    order = ["service_date", "first_sched_sec", "half_trip_id", "direction_id"]
    return bucketed_row_number(trips, ["route_id"], day, order, "pos")


def trips_per_day(trips: DataFrame) -> DataFrame:
    per_day = trips.groupBy("route_id", "service_date").count()
    return per_day.groupBy("route_id").agg(
        F.sum("count").alias("n_trips"),
        F.min("count").alias("min_per_day"),
        F.max("count").alias("max_per_day"),
        F.median("count").alias("median_per_day"),
        F.avg("count").alias("mean_per_day"),
    )


def trip_calendar(trips: DataFrame) -> DataFrame:
    """Chart data of a trip: fraction of the day, and its cell in a month grid (weeks start on Monday)."""
    day = F.col("service_date")
    first = F.trunc(day, "month")
    lead = F.pmod(F.dayofweek(first) + 5, F.lit(7))
    return trips.withColumn("day_fraction", F.least(F.greatest(F.col("first_sched_sec") / 86400, F.lit(0.0)),
                                                          F.lit(0.999))).withColumn(
        "weekday", F.pmod(F.dayofweek(day) + 5, F.lit(7)).cast("int")
    ).withColumn("week_row", F.floor((F.dayofmonth(day) - 1 + lead) / 7).cast("int"))


def heatmap_cells(clean: DataFrame) -> DataFrame:
    """On-time share per (route, stop, date), directions pooled."""
    cells = clean.groupBy("route_id", F.trim("stop_id").alias("stop_id"), "service_date").agg(
        F.sum(m.on_time(F.col("actual_sec"), F.col("scheduled_sec")).cast("int")).alias("on_time_count"),
        F.count(F.lit(1)).alias("total_trips"),
    )
    return min_samples(cells, column="total_trips").withColumn(
        "on_time_rate", F.col("on_time_count") / F.col("total_trips"))


def on_time_day(clean: DataFrame, route: str, date: str) -> DataFrame:
    day = clean.where((F.col("route_id") == route) & (F.col("service_date") == F.lit(date).cast("date")))
    return heatmap_cells(day).select("route_id", "stop_id", "on_time_rate", F.col("total_trips").alias("n_obs"))


def guarded_semi(cells: DataFrame, pattern: DataFrame, by: list[str]) -> DataFrame:
    """Keep cells whose stop is on the pattern, unless that would leave nothing in the ``by`` group.

    The guard is one flag per group from a partial aggregate, joined back, so no group is gathered.
    """
    keys = [*by, "stop_id"]
    marked = cells.join(pattern.select(*keys).distinct().withColumn("_on", F.lit(True)), keys, "left")
    marked = marked.withColumn("_on", F.coalesce("_on", F.lit(False)))
    guard = marked.groupBy(*by).agg(F.bool_or("_on").alias("_any"))
    return marked.join(guard, by).where(F.col("_on") | ~F.col("_any")).drop("_on", "_any")


def stop_pair_order(clean: DataFrame) -> DataFrame:
    """Lowest time-point order of every (route, stop, direction)."""
    return clean.groupBy("route_id", "stop_id", "direction_id").agg(
        F.min(F.coalesce("time_point_order", F.lit(0))).alias("min_order"))


def first_appearance(df: DataFrame, group: list[str], item: str, order: list[str]) -> DataFrame:
    """Ordered distinct: rank of each item by its first position (0-based)."""
    first = df.groupBy(*group, item).agg(F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*group).orderBy("_first", item)  # bounded by the distinct items of a group
    return first.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).drop("_first")


def heatmap_axis(cells: DataFrame, pairs: DataFrame, axis: DataFrame) -> DataFrame:
    """Rows of a heatmap: every axis stop in order, then stops with cells but no axis place.

    ``axis`` has ``route_id, stop_id, axis_rank``. Orphans follow by lowest time-point order, then id.
    """
    present = cells.select("route_id", "stop_id").distinct()
    best = pairs.groupBy("route_id", "stop_id").agg(
        F.min(F.struct("direction_id", "min_order")).alias("p"), F.min("min_order").alias("lowest"))
    placed = axis.select("route_id", "stop_id", F.lit(0).alias("block"), F.col("axis_rank").alias("pos"))
    orphans = present.join(axis.select("route_id", "stop_id"), ["route_id", "stop_id"], "left_anti").join(
        best.select("route_id", "stop_id", "lowest"), ["route_id", "stop_id"], "left"
    ).select("route_id", "stop_id", F.lit(1).alias("block"), F.coalesce("lowest", F.lit(999999)).alias("pos"))
    digits = F.regexp_extract("stop_id", r"(\d+)", 1).try_cast("bigint")
    # bounded by the stops of one route, not by observations
    w = Window.partitionBy("route_id").orderBy("block", "pos", F.coalesce(digits, F.lit(0)), "stop_id")
    return (
        placed.unionByName(orphans)
        .join(best, ["route_id", "stop_id"], "left")
        .withColumn("row_rank", (F.row_number().over(w) - 1).cast("int"))
        .select("route_id", "stop_id", "row_rank", F.coalesce("p.direction_id", F.lit("")).alias("direction_id"),
                F.coalesce("p.min_order", F.lit(0)).alias("time_point_order"))
    )


def heatmap_pivot(daily: DataFrame, value: str, keys: list[str], days: DataFrame | None = None) -> DataFrame:
    """(stop × date) matrix of mean rates; rows with no value on any date are dropped.

    Every date of ``daily`` is a column. They are read from ``days`` (``service_date``; bounded by the calendar) where
    that is cheaper to compute than ``daily`` and has at least its dates.
    """
    seen = (daily if days is None else days).select(F.date_format("service_date", "yyyy-MM-dd").alias("d"))
    dates = sorted(r["d"] for r in seen.where(F.col("d").isNotNull()).distinct().collect())
    if not dates:
        return daily.select(*keys).limit(0)
    grid = (
        min_samples(daily).withColumn("_d", F.date_format("service_date", "yyyy-MM-dd"))
        .groupBy(*keys).pivot("_d", dates).agg(F.avg(value))
    )
    return grid.where(F.coalesce(*[F.col(f"`{d}`") for d in dates]).isNotNull())


def heatmap_hour_pivot(hourly: DataFrame, value: str) -> DataFrame:
    hours = list(range(24))
    grid = hourly.groupBy("route_id", "direction_id", "stop_id").pivot("hour", hours).agg(F.avg(value))
    grid = grid.select("route_id", "direction_id", "stop_id", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in hours])
    return grid.where(F.coalesce(*[F.col(f"h{h:02d}") for h in hours]).isNotNull())


def drilldown(arrivals: DataFrame, route: str, stop: str, date: str) -> DataFrame:
    """Every trip of one (route, stop, date) with its delay; rows without an actual clock are kept."""
    from kerbflow.functions import clock

    both = F.col("scheduled_sec").isNotNull() & F.col("actual_sec").isNotNull()
    return (
        arrivals.where((F.col("route_id") == route) & (F.trim("stop_id") == stop)
                       & (F.col("service_date") == F.lit(date).cast("date"))
                       & F.col("standard_type").isin("Schedule", "Headway"))
        .withColumn("scheduled_sec", clock.clock_seconds(F.col("scheduled")))
        .withColumn("actual_sec", clock.clock_seconds(F.col("actual")))
        .select(
            "service_date", "route_id", "direction_id", "half_trip_id", "stop_id", "time_point_id",
            F.coalesce("time_point_order", F.lit(0)).alias("time_point_order"), "point_type", "standard_type",
            clock.hms_text(F.col("scheduled_sec")).alias("scheduled_time"),
            clock.hms_text(F.col("actual_sec")).alias("actual_time"),
            "scheduled_sec", "actual_sec",
            F.when(both, F.col("actual_sec") - F.col("scheduled_sec")).otherwise(0.0).alias("delay_sec"),
            F.when(both, m.on_time(F.col("actual_sec"), F.col("scheduled_sec"))).otherwise(False).alias("is_on_time"),
            F.col("scheduled_headway"), F.col("headway").alias("actual_headway"),
        )
        .orderBy("scheduled_sec", "half_trip_id", "time_point_order")
    )
