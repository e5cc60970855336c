"""Reliability thresholds, colour classes and exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# On-time band, bunching limits, sample minimums and delay limits.
ON_TIME_EARLY_SEC = 60
ON_TIME_LATE_SEC = 300
BUNCHING_SHARE = 0.5
BUNCHING_MAX_SEC = 240
MIN_STOP_SAMPLES = 5
MIN_ROUTE_STOP_DAYS = 10
TRIP_DELAY_SEC = 180
DELAY_RATIO = 1.2
LOAD_CAP = 30

# Stress level 0-4 to map colour.
STRESS_COLORS = ["grey", "green", "deepskyblue", "orange", "red"]
# Map class colours.
GOOD, FAIR, BAD, UNKNOWN, UNKNOWN_RATIO = "#16a34a", "#ca8a04", "#dc2626", "#9ca3af", "#6b7280"


def on_time(actual: Column, scheduled: Column) -> Column:
    return (actual - scheduled).between(-ON_TIME_EARLY_SEC, ON_TIME_LATE_SEC)


def bunching_threshold(scheduled_headway: Column) -> Column:
    known = F.when(scheduled_headway > 0, F.least(scheduled_headway * BUNCHING_SHARE, F.lit(float(BUNCHING_MAX_SEC))))
    return F.coalesce(known, F.lit(float(BUNCHING_MAX_SEC)))


def stress_color(lts: Column) -> Column:
    palette = F.array(*[F.lit(c) for c in STRESS_COLORS])
    # the guard keeps a negative index from counting from the end of the array
    return F.coalesce(F.when(lts >= 0, F.try_element_at(palette, lts.cast("int") + 1)), F.lit(STRESS_COLORS[0]))


def metric_class(metric: str, value: Column) -> Column:
    """Map colour of a ratio, on-time rate, bunching rate or load."""
    if metric == "ratio":
        return F.when(value.isNull(), UNKNOWN_RATIO).when(value <= 1.0, GOOD).when(value <= 1.2, FAIR).otherwise(BAD)
    if metric == "on_time":
        return F.when(value.isNull(), UNKNOWN).when(value >= 0.8, GOOD).when(value >= 0.6, FAIR).otherwise(BAD)
    if metric == "bunching":
        return F.when(value.isNull(), UNKNOWN).when(value <= 0.1, GOOD).when(value <= 0.25, FAIR).otherwise(BAD)
    if metric == "load":
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / LOAD_CAP))
        # Colour ramp ends, (22, 163, 74) to (220, 38, 38).
        r = F.floor(22 + (220 - 22) * share + 0.5).cast("int")
        g = F.floor(163 + (38 - 163) * share + 0.5).cast("int")
        b = F.floor(74 + (38 - 74) * share + 0.5).cast("int")
        return F.when(value.isNull(), UNKNOWN).otherwise(F.format_string("rgb(%d,%d,%d)", r, g, b))
    raise ValueError(f"unknown metric {metric!r}")


def floor_index(column: str, share: float) -> Column:
    """Aggregate: the element at 0-based position ``floor(n * share)`` of the sorted non-null values.

    ``percentile_disc`` returns position ``ceil(n * share)`` counted from 1; counted from the other end with the
    other share that is the position wanted, for groups of any size. The aggregate keeps a value to count map that is
    combined before the shuffle instead of the whole group.
    """
    return F.expr(f"percentile_disc({1 - share!r}) WITHIN GROUP (ORDER BY `{column}` DESC)")
