"""The reliability report: every section derived from one cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.operators import arrivals as a
from kerbflow.operators import reliability as r


def reliability_sections(arrivals: DataFrame, focus: str, comparison: list[str]) -> dict[str, DataFrame]:
    clean = a.clean_arrivals(a.filter_routes(arrivals, focus, comparison))
    quarters = r.stop_day_quarters(clean)
    daily = r.stop_day_summary(quarters)
    trips = r.trip_summaries(a.dedupe_points(clean))
    return {
        "filled": a.fill_actual_headway(clean),
        "daily": daily,
        "stop": r.stop_metrics(daily),
        "hour": r.stop_metrics_by_hour(quarters),
        "comparison": r.route_comparison(daily),
        "summary": r.reliability_summary(daily, focus),
        "worst": r.worst_stops(daily, focus),
        "trips": trips,
        "trips_per_day": r.trips_per_day(trips),
    }


def reliability_report(arrivals: DataFrame, focus: str, comparison: list[str]) -> DataFrame:
    """Summary, stop, hour and trip sections as one long table."""
    s = reliability_sections(arrivals, focus, comparison)
    none = F.lit("")

    def long(section: str, df: DataFrame, k2, k3, on_time: str, bunching: str, n: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col("route_id").alias("k1"), k2.alias("k2"), k3.alias("k3"),
                         F.col(on_time).cast("double").alias("on_time_rate"),
                         F.col(bunching).cast("double").alias("bunching_rate"), F.col(n).alias("n"))

    stop, direction = F.col("stop_id"), F.col("direction_id")
    return (
        long("summary", s["summary"], none, none, "on_time_rate", "bunching_rate", "n_rows")
        .unionByName(long("stop", s["stop"], stop, direction, "on_time_rate", "bunching_rate", "n_obs"))
        .unionByName(long("hour", s["hour"], stop, F.concat(direction, F.lit("@"), F.col("hour").cast("string")),
                          "on_time_rate", "bunching_rate", "n_obs"))
        .unionByName(long("trips", s["trips_per_day"], none, none, "mean_per_day", "median_per_day", "n_trips"))
    )
