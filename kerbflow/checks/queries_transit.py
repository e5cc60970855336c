"""Transit queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbflow.checks import adapters as ad
from kerbflow.functions import clock, text
from kerbflow.functions import metrics as m
from kerbflow.operators import arrivals as a
from kerbflow.operators import gtfs as g
from kerbflow.operators import reliability as r
from kerbflow.operators import ridership as rd
from kerbflow.operators import scorecard as sc
from kerbflow.plans.reliability_report import reliability_report
from kerbflow.session import work_path
from kerbflow.sources import transit as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BELLS = ad.BELLS
BY_BELL = ["time_window", "route_id", "stop_id"]
OTHERS = ["1", "39", "66"]


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def clean(s, d):
    return a.clean_arrivals(ad.arrivals(s, d))


def filled(s, d):
    return a.fill_actual_headway(clean(s, d))


def quarters(s, d):
    return r.stop_day_quarters(clean(s, d))


def daily(s, d):
    return r.stop_day_summary(quarters(s, d))


def records(s, d):
    return a.headway_records(ad.arrivals(s, d))


def windowed(s, d):
    return a.headway_window(records(s, d), *ad.WINDOW)


def by_bell(s, d):
    return sc.windowed_records(records(s, d), BELLS)


def bell_pairs(s, d):
    """Every (route, stop) of the feed in every bell window."""
    names = F.array(*[F.lit(name) for name in BELLS])
    return g.route_stop_pairs(ad.gtfs(s, d)).withColumn("time_window", F.explode(names))


def strict_points(s, d):
    """Time points with the strict clocks, one per order."""
    rows = (
        ad.arrivals(s, d).where(F.col("standard_type").isin(a.STANDARD_TYPES))
        .withColumn("scheduled_sec", clock.strict_clock_seconds(F.col("scheduled")))
        .withColumn("actual_sec", clock.strict_clock_seconds(F.col("actual")))
        .where(F.col("scheduled_sec").isNotNull() & F.col("time_point_order").isNotNull())
    )
    return a.dedupe_points(rows)


@query("p13_clean_arrivals")
def _(s, d):
    return clean(s, d).select(
        "service_date", "route_id", "direction_id", "half_trip_id", "stop_id", "standard_type", "time_point_order",
        "scheduled_sec", "actual_sec", "local_hour", "scheduled_headway_sec", "actual_headway_sec")


@query("p14_on_time")
def _(s, d):
    flag = m.on_time(F.col("actual_sec"), F.col("scheduled_sec")).alias("on_time")
    return clean(s, d).groupBy("route_id", flag).agg(F.count(F.lit(1)).alias("n"))


@query("p15_bunching_threshold")
def _(s, d):
    limit = m.bunching_threshold(F.col("scheduled_headway")).alias("threshold")
    return ad.arrivals(s, d).groupBy("scheduled_headway", limit).agg(F.count(F.lit(1)).alias("n"))


@query("p16_norm_direction")
def _(s, d):
    named = F.when(F.col("event_type").isin("click", "view"), "Inbound").otherwise("Outbound")
    k = F.col("user_id") % 5
    raw = F.when(k == 0, " INBOUND ").when(k == 1, "0.0").when(k == 2, "1").when(k == 3, named).otherwise(" Loop ")
    return ad.table(s, d, "events").select(raw.alias("raw")).groupBy(
        "raw", text.norm_direction(F.col("raw")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("p21_date_label")
def _(s, d):
    return ad.arrivals(s, d).groupBy(clock.date_label(F.col("service_date")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("w1_fill_actual_headway")
def _(s, d):
    return filled(s, d).select("route_id", "stop_id", "direction_id", "service_date", "half_trip_id", "standard_type",
                               "scheduled_sec", "actual_sec", "prev_scheduled_sec", "actual_headway_sec")


QUERIES["w2_headway_records"] = records


@query("w3_scheduled_diffs")
def _(s, d):
    return filled(s, d).groupBy(*a.STOP_DAY, a.scheduled_gap().alias("gap")).agg(F.count(F.lit(1)).alias("n"))


@query("w4_dedupe_points")
def _(s, d):
    return a.dedupe_points(clean(s, d))


@query("w9_worst_stops")
def _(s, d):
    return r.worst_stops(daily(s, d), "28")


QUERIES["g4_stop_day_metrics"] = daily
QUERIES["g5_stop_metrics"] = lambda s, d: r.stop_metrics(daily(s, d))
QUERIES["g6_stop_metrics_by_hour"] = lambda s, d: r.stop_metrics_by_hour(quarters(s, d))
QUERIES["g7_route_comparison"] = lambda s, d: r.route_comparison(daily(s, d))


QUERIES["g8_reliability_summary"] = lambda s, d: r.reliability_summary(daily(s, d), "28")


QUERIES["g9_trips_per_day"] = lambda s, d: r.trips_per_day(r.trip_summaries(a.dedupe_points(clean(s, d))))
QUERIES["g13_trip_summaries"] = lambda s, d: r.trip_summaries(a.dedupe_points(clean(s, d)))
QUERIES["g13_trip_series"] = lambda s, d: r.trip_summaries(strict_points(s, d))
QUERIES["g16_observed_headways"] = lambda s, d: sc.observed_headways(by_bell(s, d), BY_BELL)


@query("g16_observed_fallback")
def _(s, d):
    return sc.observed_with_fallback(by_bell(s, d), bell_pairs(s, d), ["time_window"])


QUERIES["g17_headway_grains"] = lambda s, d: sc.headway_grains(records(s, d))
QUERIES["g18_route_stop_headways"] = lambda s, d: sc.overlay_order(sc.route_stop_headways(windowed(s, d)))
QUERIES["g19_heatmap_cells"] = lambda s, d: r.heatmap_cells(clean(s, d))
QUERIES["g20_on_time_day"] = lambda s, d: r.on_time_day(clean(s, d), "28", ad.SERVICE_DAY)
QUERIES["g21_heatmap_pivot"] = lambda s, d: r.heatmap_pivot(
    daily(s, d), "on_time_rate", ["route_id", "direction_id", "stop_id"], clean(s, d))
QUERIES["g22_heatmap_hour_pivot"] = lambda s, d: r.heatmap_hour_pivot(
    r.stop_metrics_by_hour(quarters(s, d)), "on_time_rate")
QUERIES["r6_filter_routes"] = lambda s, d: a.filter_routes(ad.arrivals(s, d), "28", ["1", "39"]).groupBy(
    "route_id").agg(F.count(F.lit(1)).alias("n"))
QUERIES["r7_hour_slice"] = lambda s, d: a.hour_slice(clean(s, d), 8).select(
    "route_id", "stop_id", "service_date", "scheduled_sec", "actual_sec")
QUERIES["r8_headway_window"] = lambda s, d: a.headway_window(
    records(s, d), *ad.WINDOW, first_date="2024-01-05", last_date="2024-01-20", directions=["Inbound"])
QUERIES["r9_min_samples"] = lambda s, d: r.min_samples(daily(s, d))


@query("r10_guarded_semi")
def _(s, d):
    # a pattern that covers some stops of most routes and none of route 66
    digits = F.substring("stop_id", 2, 9).cast("int") % 3
    pattern = g.route_stop_pairs(ad.gtfs(s, d)).where(F.col("route_id") != "66").select(
        "route_id", F.concat(F.lit("S"), digits.cast("string")).alias("stop_id"))
    return r.guarded_semi(r.heatmap_cells(clean(s, d)), pattern, ["route_id"])


QUERIES["r11_overlay_filter"] = lambda s, d: sc.overlay_filter(sc.route_stop_headways(windowed(s, d)), False, True)
QUERIES["c3_drilldown"] = lambda s, d: r.drilldown(ad.arrivals(s, d), "28", "S1", ad.SERVICE_DAY)
QUERIES["c8_trip_calendar"] = lambda s, d: r.trip_calendar(r.trip_summaries(a.dedupe_points(clean(s, d))))
QUERIES["t1_arrivals_sorted"] = lambda s, d: clean(s, d).select(
    *a.STOP_DAY, "scheduled_sec", "actual_sec").orderBy(*a.STOP_DAY, "scheduled_sec", "actual_sec")


@query("t4_trip_series_order")
def _(s, d):
    return r.trip_series_order(r.trip_summaries(strict_points(s, d)))


@query("t5_drilldown_order")
def _(s, d):
    rows = r.drilldown(ad.arrivals(s, d), "28", "S1", ad.SERVICE_DAY).where(F.col("actual_sec").isNotNull())
    w = Window.orderBy(F.desc("delay_sec"), "scheduled_sec", "half_trip_id", "time_point_order")  # one stop-day
    return rows.select("half_trip_id", "delay_sec", F.row_number().over(w).alias("pos"))


QUERIES["u2_service_dates"] = lambda s, d: a.service_dates(records(s, d))
QUERIES["j11_with_stop_names"] = lambda s, d: g.with_stop_names(r.heatmap_cells(clean(s, d)), ad.gtfs(s, d)["stops"])
QUERIES["x6_reliability_report"] = lambda s, d: reliability_report(ad.arrivals(s, d), "28", OTHERS)

# --- schedule feed ---------------------------------------------------------------------------------------


def active(s, d, dates: DataFrame | None = None):
    feed = ad.gtfs(s, d)
    if dates is None:
        dates = ad.arrivals(s, d).select("service_date")
    return g.active_services(dates, feed["calendar"], feed["calendar_dates"])


def one_day(s, day: str) -> DataFrame:
    return s.createDataFrame([(day,)], "d string").select(F.col("d").cast("date").alias("service_date"))


@query("s7_gtfs_feed")
def _(s, d):
    folder = work_path(s, "feed")
    for name, rows in ad.gtfs(s, d).items():
        if name != "calendar_dates":  # a feed may lack a file
            rows.write.csv(f"{folder}/{name}.txt", header=True, quoteAll=True, escape='"')
    return src.read_gtfs(s, folder)["stop_times"].select("trip_id", "stop_id", "stop_sequence",
                                              clock.gtfs_seconds(F.col("departure_time")).alias("dep"))


QUERIES["s8_stop_names"] = lambda s, d: g.stop_names(ad.gtfs(s, d)["stops"])
QUERIES["g14_active_services"] = active


@query("j6_trips_on")
def _(s, d):
    day = active(s, d, one_day(s, "2024-01-15"))
    return g.trips_on(day, ad.gtfs(s, d)["trips"]).select("service_date", "trip_id", "route_id")


QUERIES["g15_scheduled_headways"] = lambda s, d: g.scheduled_headways(
    ad.gtfs(s, d), active(s, d, one_day(s, ad.SERVICE_DAY)), BELLS)
QUERIES["g25_majority_shape"] = lambda s, d: g.majority_shape(ad.gtfs(s, d)["trips"])
QUERIES["g26_longest_trip_axis"] = lambda s, d: g.longest_trip_axis(ad.gtfs(s, d))


@query("g27_display_rank")
def _(s, d):
    # two routes bear the id of a third as their name, one has a name that is no id
    own = F.col("route_id")
    name = F.when(own.isin("1", "39"), "28").when(own == "66", "SL").otherwise(F.col("route_short_name"))
    feed = ad.gtfs(s, d)
    return g.display_rank({**feed, "routes": feed["routes"].withColumn("route_short_name", name)}, "000003", "000007")


QUERIES["g29_feed_stats"] = lambda s, d: g.feed_stats(ad.gtfs(s, d))


@query("g32_route_bounds")
def _(s, d):
    feed = ad.gtfs(s, d)
    return g.route_bounds(feed["trips"], feed["shapes"])


def near(s, d):
    return g.stops_near(ad.schools(s), ad.gtfs(s, d)["stops"])


QUERIES["j3_routes_for_stops"] = lambda s, d: g.routes_for_stops(near(s, d), ad.gtfs(s, d), ["school_id"])
QUERIES["j4_stops_on_route"] = lambda s, d: g.stops_on_route(ad.gtfs(s, d))
QUERIES["j5_stops_near"] = near


@query("t3_nearest_stops")
def _(s, d):
    w = Window.partitionBy("school_id").orderBy("distance_m", "stop_id")
    return near(s, d).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 20).drop("_r")


@query("w6_shape_distance")
def _(s, d):
    return g.shape_distance(ad.gtfs(s, d)["shapes"]).select("shape_id", "shape_pt_sequence", "cum_dist_m")


@query("j13_project_stops")
def _(s, d):
    feed = ad.gtfs(s, d)
    served = feed["stop_times"].join(feed["trips"].select("trip_id", "shape_id"), "trip_id").select(
        "shape_id", "stop_id").distinct().join(feed["stops"], "stop_id")
    return g.project_stops(served, feed["shapes"]).select("shape_id", "stop_id", "shape_pt_sequence")


@query("p17_canonical_stop")
def _(s, d):
    return ad.arrivals(s, d).groupBy(text.canonical_stop(F.col("stop_id"), {"S3": "S2"}).alias("stop_id")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p18_norm_stop_name")
def _(s, d):
    k = F.col("s_suppkey")
    raw = F.concat(ad.pick(["1624 ", "", " ", "55 "], k % 4), F.lit("Blue Hill "),
                   ad.pick(["Avenue", "Street", "Boulevard", "Square"], k % 4),
                   ad.pick([" @ ", " & ", " opposite ", " opp. "], F.floor(k / 4) % 4), F.col("s_name"))
    return ad.table(s, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("stop_id"),
                                             text.norm_stop_name(raw).alias("name"))


@query("w8_axis_rank")
def _(s, d):
    return r.first_appearance(r.stop_pair_order(clean(s, d)), ["route_id"], "stop_id", ["direction_id", "min_order"])


@query("t6_heatmap_axis")
def _(s, d):
    rows = clean(s, d)
    axis = g.longest_trip_axis(ad.gtfs(s, d)).where(F.col("route_id").isin("28", *OTHERS))
    return r.heatmap_axis(r.heatmap_cells(rows), r.stop_pair_order(rows), axis)


def corridor(n: int = 12) -> list[tuple[str, str, str]]:
    return [("Inbound" if i % 2 else "Outbound", f"Supplier#{i:09d}" if i % 3 else f"Suplier {i:08d}",
             f"S{i}" if i % 4 else f"X{i}") for i in range(n)]


QUERIES["j15_validate_corridor"] = lambda s, d: g.validate_corridor(corridor(), ad.gtfs(s, d)["stops"])

# --- scorecard -----------------------------------------------------------------------------------------------


def school_headways(s, d):
    return sc.school_stop_headways(ad.schools(s), ad.gtfs(s, d), records(s, d), BELLS, ad.SERVICE_DAY)


QUERIES["c1_scorecard"] = lambda s, d: sc.scorecard_rows(school_headways(s, d))
QUERIES["w10_key_stop"] = lambda s, d: sc.scorecard_rows(school_headways(s, d)).select(
    "school_id", "time_window", "route_id", "stop_id")


@query("t2_scorecard_order")
def _(s, d):
    w = Window.partitionBy("school_id", "time_window").orderBy(F.asc_nulls_last("ratio"), "route_id")
    return sc.scorecard_rows(school_headways(s, d)).withColumn("pos", F.row_number().over(w))


QUERIES["c9_routes_with_delay"] = lambda s, d: sc.routes_with_delay(sc.scorecard_rows(school_headways(s, d)))


@query("j7_merge_headways")
def _(s, d):
    feed = ad.gtfs(s, d)
    scheduled = g.scheduled_headways(feed, active(s, d, one_day(s, ad.SERVICE_DAY)), BELLS)
    observed = sc.observed_headways(by_bell(s, d), BY_BELL)
    merged = sc.merge_headways(bell_pairs(s, d), scheduled, observed, BY_BELL)
    return merged.select(*BY_BELL, "scheduled_median_min", "observed_median_min", "csv_scheduled_min", "effective_min",
                         "ratio", "flags")


def notes(s, d):
    uid = F.col("user_id")
    return ad.table(s, d, "events").where((F.col("event_type") == "error") & (uid % 3 == 0)).select(
        F.concat(F.lit("S"), (F.floor(uid / 4) % 5).cast("string")).alias("stop_id"),
        ad.pick(ad.ROUTES, uid % 4).alias("route_id"),
        F.when(F.col("event_id") % 2 == 0, "crowding").otherwise("denied_boardings").alias("type"))


@query("j8_with_crowding")
def _(s, d):
    return sc.stop_view(school_headways(s, d), notes(s, d)).select(
        "school_id", "time_window", "route_id", "stop_id", "ratio", "has_delay", "has_crowding", "has_denied_boardings")


def overlay(s, d, day: DataFrame | None = None, route: str | None = None):
    rows = windowed(s, d)
    base = sc.route_stop_headways(rows.where(F.col("route_id") == route) if route else rows)
    return sc.route_overlay(base, ad.gtfs(s, d)["stops"], r.stop_metrics(daily(s, d)),
                            rd.avg_load(ad.ridership(s, d)), day)


QUERIES["c2_route_overlay"] = overlay
QUERIES["j9_route_overlay_day"] = lambda s, d: overlay(s, d, r.on_time_day(clean(s, d), "28", ad.SERVICE_DAY), "28")
QUERIES["j10_pick_load"] = lambda s, d: rd.pick_load(
    sc.route_stop_headways(windowed(s, d)).join(ad.gtfs(s, d)["stops"], "stop_id", "left_semi"),
    rd.avg_load(ad.ridership(s, d))).select("route_id", "stop_id", "direction_id", "ridership_load")


@query("p20_metric_class")
def _(s, d):
    c = m.metric_class
    return overlay(s, d).select(
        "route_id", "stop_id", c("ratio", F.col("ratio")).alias("ratio_color"),
        c("on_time", F.col("on_time_rate")).alias("on_time_color"),
        c("bunching", F.col("bunching_rate")).alias("bunching_color"),
        c("load", F.col("ridership_load")).alias("load_color"))


# --- ridership -------------------------------------------------------------------------------------------------
@query("s9_ridership")
def _(s, d):
    path = work_path(s, "ridership")
    rows = ad.ridership(s, d)
    rows.select(*[(F.col(c) if c in rows.columns else F.lit("a, b")).cast("string").alias(c) for c in src.RIDERSHIP_COLUMNS]
                ).write.csv(path, header=True, quoteAll=True, escape='"')
    return src.read_ridership(s, path).select(
    "route_id", "stop_id", "stop_sequence", "boardings", "alightings", "load", "sample_size")
QUERIES["g23_avg_load"] = lambda s, d: rd.avg_load(ad.ridership(s, d))
QUERIES["g24_ridership_trips"] = lambda s, d: rd.ridership_trips(ad.ridership(s, d))
QUERIES["c4_ridership_stops"] = lambda s, d: rd.trip_stops(
    ad.ridership(s, d), "28", "day_type_01", "1", "08:00:00", "A")
