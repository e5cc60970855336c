"""Stop-arrival observations: cleaning, previous-trip headways, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import clock
from kerbflow.functions.skew import bucketed_lag

STANDARD_TYPES = ["Schedule", "Headway"]
STOP_DAY = ["route_id", "stop_id", "direction_id", "service_date"]
TRIP_KEY = ["service_date", "direction_id", "half_trip_id"]
# A total order of the rows of one stop-day: the scheduled clock first, then everything that can differ.
TRIP_ORDER = ["scheduled_sec", "actual_sec", "half_trip_id", "time_point_order", "standard_type",
              "headway", "scheduled_headway"]


def quarter_hour() -> Column:
    return F.floor(F.col("scheduled_sec") / 900)


def positive(gap: Column) -> Column:
    return F.when(gap > 0, gap)


def clean_arrivals(arrivals: DataFrame) -> DataFrame:
    """Rows with a usable type and both clocks; headways that are not positive become missing.

    A scheduled headway of 0 is kept (only negative ones mean "missing"), as it takes part in the median.
    """
    scheduled = F.col("scheduled_headway").cast("double")
    headway = F.col("headway").cast("double")
    return (
        arrivals.where(F.col("standard_type").isin(STANDARD_TYPES))
        .withColumn("scheduled_sec", clock.clock_seconds(F.col("scheduled")))
        .withColumn("actual_sec", clock.clock_seconds(F.col("actual")))
        .where(F.col("scheduled_sec").isNotNull() & F.col("actual_sec").isNotNull())
        .withColumn("local_hour", clock.fractional_hour(F.col("scheduled_sec")))
        .withColumn("scheduled_headway_sec", F.when(scheduled != -1, scheduled))
        .withColumn("actual_headway_sec", F.when(headway > 0, headway))
    )


def fill_actual_headway(clean: DataFrame) -> DataFrame:
    """Fill a missing actual headway with the gap to the previous trip of the stop-day, if positive.

    Also keeps the previous scheduled clock, which the scheduled-headway fallback needs.
    """
    lagged = bucketed_lag(
        clean, STOP_DAY, quarter_hour(), TRIP_ORDER,
        {"prev_scheduled_sec": "scheduled_sec", "prev_actual_sec": "actual_sec"},
    )
    gap = F.col("actual_sec") - F.col("prev_actual_sec")
    return lagged.withColumn(
        "actual_headway_sec", F.coalesce("actual_headway_sec", positive(gap))
    ).drop("_has_prev", "prev_actual_sec")


def scheduled_gap(within_hour: bool = False) -> Column:
    """Gap to the previous scheduled clock; with ``within_hour`` only inside the same clock hour."""
    gap = F.col("scheduled_sec") - F.col("prev_scheduled_sec")
    if within_hour:
        return F.when(F.floor(F.col("prev_scheduled_sec") / 3600) == F.floor("local_hour"), gap)
    return gap


def headway_records(arrivals: DataFrame) -> DataFrame:
    """Actual and scheduled headway of every trip at a stop, strict clocks only.

    Differs from :func:`fill_actual_headway` on purpose: only the ``T`` form with whole seconds is read, a
    row may lack an actual clock if it carries a headway, the previous trip may lack one too (then there is
    no gap), and a missing scheduled headway falls back to the scheduled gap, else 0.
    """
    scheduled = F.col("scheduled_headway").cast("double")
    headway = F.col("headway").cast("double")
    actual = F.col("actual_sec")
    rows = (
        arrivals.where(F.col("standard_type").isin(STANDARD_TYPES))
        .withColumn("scheduled_sec", clock.strict_clock_seconds(F.col("scheduled")))
        .withColumn("actual_sec", clock.strict_clock_seconds(F.col("actual")))
        .withColumn("local_hour", clock.strict_minute_hour(F.col("scheduled")))
        .where(F.col("scheduled_sec").isNotNull())
        .where((F.coalesce(headway, F.lit(-1)) > 0) | (F.coalesce(scheduled, F.lit(-1)) > 0)
               | (F.coalesce(actual, F.lit(-1)) > 0))
        .withColumn("time_point_order", F.coalesce("time_point_order", F.lit(0)))
    )
    lagged = bucketed_lag(
        rows, STOP_DAY, quarter_hour(), TRIP_ORDER,
        {"prev_scheduled_sec": "scheduled_sec", "prev_actual_sec": "actual_sec"},
    )
    gap = F.when((actual > 0) & (F.col("prev_actual_sec") > 0), actual - F.col("prev_actual_sec"))
    planned_gap = F.col("scheduled_sec") - F.col("prev_scheduled_sec")
    return (
        lagged.withColumn("actual_headway_sec", F.when(headway > 0, headway).otherwise(F.when(gap > 0, gap)))
        .where(F.col("actual_headway_sec").isNotNull())
        .withColumn(
            "scheduled_headway_sec",
            F.when(scheduled > 0, scheduled).when(planned_gap > 0, planned_gap).otherwise(F.lit(0.0)),
        )
        .select(*STOP_DAY, "half_trip_id", "time_point_order", "scheduled_sec", "local_hour",
                "prev_scheduled_sec", "scheduled_headway_sec", "actual_headway_sec")
    )


def headway_window(
    records: DataFrame, start: str, end: str, first_date: str | None = None, last_date: str | None = None,
    directions: list[str] | None = None,
) -> DataFrame:
    """Records whose current **and** previous trip lie in ``[start, end)``.

    A previous scheduled clock of exactly midnight counts as no previous trip.
    """
    lo, hi = clock.window_hour(start), clock.window_hour(end)
    previous = F.col("prev_scheduled_sec") / 3600
    keep = (F.col("local_hour") >= lo) & (F.col("local_hour") < hi) & (F.col("prev_scheduled_sec") > 0)
    keep = keep & (previous >= lo) & (previous < hi)
    if first_date:
        keep = keep & (F.col("service_date") >= F.lit(first_date).cast("date"))
    if last_date:
        keep = keep & (F.col("service_date") <= F.lit(last_date).cast("date"))
    if directions:
        keep = keep & F.col("direction_id").isin(directions)
    return records.where(keep)


def filter_routes(arrivals: DataFrame, focus: str, comparison: list[str]) -> DataFrame:
    return arrivals.where(F.col("route_id").isin([focus, *comparison]))


def hour_slice(clean: DataFrame, hour: int) -> DataFrame:
    return clean.where(F.floor("local_hour") == hour)


def dedupe_points(clean: DataFrame) -> DataFrame:
    """One row per time point of a half-trip, Schedule rows first.

    An aggregate rather than ``row_number``, so duplicates are dropped before the shuffle.
    """
    rank = F.when(F.col("standard_type") == "Schedule", 0).when(F.col("standard_type") == "Headway", 1).otherwise(2)
    keys = ["route_id", *TRIP_KEY, "time_point_order"]
    tie = F.struct(rank.alias("r"), F.col("scheduled_sec"), F.col("actual_sec"), F.col("stop_id"))
    kept = F.min(F.struct(tie.alias("tie"), F.col("standard_type"))).alias("_kept")
    return clean.groupBy(*keys).agg(kept).select(
        *keys,
        F.col("_kept.tie.stop_id").alias("stop_id"),
        F.col("_kept.standard_type").alias("standard_type"),
        F.col("_kept.tie.scheduled_sec").alias("scheduled_sec"),
        F.col("_kept.tie.actual_sec").alias("actual_sec"),
    )


def dedupe_fill(points: DataFrame) -> DataFrame:
    """One row per time point of a half-trip: the first row, its actual filled from a later duplicate."""
    keys = ["route_id", "service_date", "half_trip_id", "time_point_order"]
    tie = F.struct("scheduled_sec", "stop_id", "direction_id", "actual_sec")
    has_actual = F.when(F.col("actual_sec").isNotNull(), tie)
    return points.groupBy(*keys).agg(F.min(tie).alias("_first"), F.min(has_actual).alias("_actual")).select(
        *keys,
        F.col("_first.direction_id").alias("direction_id"),
        F.col("_first.stop_id").alias("stop_id"),
        F.col("_first.scheduled_sec").alias("scheduled_sec"),
        F.coalesce("_first.actual_sec", "_actual.actual_sec").alias("actual_sec"),
    )


def service_dates(records: DataFrame) -> DataFrame:
    return records.select("service_date").distinct()
