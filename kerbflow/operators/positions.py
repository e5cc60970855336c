"""Trip timelines along a route shape, vehicle positions, and map segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import clock, text
from kerbflow.functions import metrics as m
from kerbflow.functions.metrics import floor_index
from kerbflow.functions.skew import bucketed_lag
from kerbflow.operators import arrivals as a
from kerbflow.operators import gtfs as g
from kerbflow.operators.streets import settled
from kerbflow.session import cut_lineage

TRIP = ["route_id", "service_date", "half_trip_id"]


def observed_points(arrivals: DataFrame, clock_kind: str = "utc") -> DataFrame:
    """Usable time points of half-trips, one row each, with clocks in seconds of the service day.

    ``clock_kind`` says what the clock text means: ``utc`` shifts it to the agency's zone (rows before local
    midnight become negative and are dropped), ``local`` takes it as it is.
    """
    usable = arrivals.where(F.col("standard_type").isin(a.STANDARD_TYPES)
                            & F.col("direction_id").isin("Inbound", "Outbound") & F.col("time_point_order").isNotNull())
    # each step is worked out once a row: a filter on the seconds would copy the reading of the clock into itself many times
    rows = settled(usable, {f"_{name}": clock.strict_clock_seconds(F.col(name)) for name in ("scheduled", "actual")})

    def seconds(name: str) -> Column:
        raw = F.col(f"_{name}")
        return clock.local_service_seconds(raw, F.col("service_date")).cast("double") if clock_kind == "utc" else raw

    rows = settled(rows, {"scheduled_sec": seconds("scheduled"), "actual_sec": seconds("actual")})
    rows = rows.withColumn("actual_sec", F.when(F.col("actual_sec") >= 0, F.col("actual_sec"))).where(F.col("scheduled_sec") >= 0)
    return a.dedupe_fill(rows)


def trip_directions(points: DataFrame) -> DataFrame:
    """Direction of a half-trip: that of its first time point."""
    first = F.min(F.struct("time_point_order", "scheduled_sec", "stop_id", "direction_id")).alias("f")
    return points.groupBy(*TRIP).agg(first).select(*TRIP, F.col("f.direction_id").alias("direction_id"))


def timeline_points(arrivals: DataFrame, feed: g.Feed, clock_kind: str = "utc") -> DataFrame:
    """Time points with their distance along the route's shape, never decreasing along the trip."""
    return placed_points(cut_lineage(observed_points(arrivals, clock_kind)), feed)


def placed_points(points: DataFrame, feed: g.Feed) -> DataFrame:
    """:func:`observed_points`, read several times here, with their distance along the route's shape.

    Points whose stop has no position, and trips whose (route, direction) has no shape, are dropped.
    """
    named = points.drop("direction_id").join(trip_directions(points), TRIP)
    shape = g.majority_shape(feed["trips"]).select("route_id", F.col("direction_id").alias("_code"), "shape_id")
    named = named.withColumn("_code", text.direction_code(F.col("direction_id"))).join(shape, ["route_id", "_code"])
    stops = feed["stops"].select("stop_id", "stop_lat", "stop_lon")
    wanted = named.select("shape_id", "stop_id").distinct().join(stops, "stop_id")
    along = g.project_stops(wanted, g.shape_distance(feed["shapes"]), ["cum_dist_m"]).select(
        "shape_id", "stop_id", F.col("cum_dist_m").alias("_raw"))
    placed = named.join(along, ["shape_id", "stop_id"])
    # after de-duplication a trip has one row per time point
    so_far = Window.partitionBy(*TRIP).orderBy("time_point_order").rowsBetween(Window.unboundedPreceding, 0)
    return cut_lineage(placed.withColumn("dist_m", F.greatest(F.max("_raw").over(so_far), F.lit(0.0))).drop("_raw", "_code"))


def trip_timelines(points: DataFrame) -> DataFrame:
    """Trips with at least two placed points: clock limits, whether observed, and the stop frames."""
    frame = F.struct("time_point_order", "stop_id", "dist_m", "scheduled_sec", "actual_sec")
    return points.groupBy(*TRIP, "direction_id", "shape_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by("scheduled_sec", "time_point_order").alias("first_sched_sec"),
        F.max_by("scheduled_sec", "time_point_order").alias("last_sched_sec"),
        F.min("actual_sec").alias("first_actual_sec"),
        F.max("actual_sec").alias("last_actual_sec"),
        F.array_sort(F.collect_list(frame)).alias("frames"),
    ).where(F.col("n_points") >= 2)


def timeline_summary(observed: DataFrame, trips: DataFrame) -> DataFrame:
    """Per (route, date): observed half-trips, drawable trips, trips with an actual, clock range."""
    seen = observed.groupBy("route_id", "service_date").agg(F.count_distinct("half_trip_id").alias("observed_trips"))
    drawn = trips.groupBy("route_id", "service_date").agg(
        F.count(F.lit(1)).alias("trips"), F.count("first_actual_sec").alias("matched_trips"),
        F.min("first_sched_sec").alias("min_sched_sec"), F.max("last_sched_sec").alias("max_sched_sec"))
    joined = seen.join(drawn, ["route_id", "service_date"], "left")
    # fixed values: clock range of a day without trips, 05:00 to 26:00
    return joined.select(
        "route_id", "service_date", "observed_trips", F.coalesce("trips", F.lit(0)).alias("trips"),
        F.coalesce("matched_trips", F.lit(0)).alias("matched_trips"),
        F.coalesce("min_sched_sec", F.lit(18000.0)).alias("min_sched_sec"),
        F.coalesce("max_sched_sec", F.lit(93600.0)).alias("max_sched_sec"))


def navigation_order(trips: DataFrame) -> DataFrame:
    """Trips of a (route, date) in browsing order: observed ones first, then by start."""
    w = Window.partitionBy("route_id", "service_date").orderBy(
        F.col("first_actual_sec").isNull(), "first_sched_sec", "half_trip_id")
    return trips.withColumn("pos", F.row_number().over(w))


def trip_lateness(points: DataFrame) -> DataFrame:
    """Median lateness of a trip, the upper middle one for an even count."""
    late = points.where(F.col("actual_sec").isNotNull()).withColumn("late", F.col("actual_sec") - F.col("scheduled_sec"))
    return late.groupBy(*TRIP).agg(floor_index("late", 0.5).alias("lateness_sec"))


def sample_times(lo: Column, hi: Column, step: int, open_end: bool = False) -> Column:
    """Multiples of ``step`` in [lo, hi], or [lo, hi) with ``open_end``."""
    first = F.ceil(lo / step).cast("bigint")
    last = (F.ceil(hi / step) - 1 if open_end else F.floor(hi / step)).cast("bigint")
    ticks = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return F.transform(F.coalesce(ticks, F.array().cast("array<bigint>")), lambda k: k * step)


def active_trips_at(trips: DataFrame, step: int) -> DataFrame:
    """Trips under way at each sample time, and how many of them are inside their observed window."""
    t = F.col("t")
    live = trips.withColumn("t", F.explode(sample_times(F.col("first_sched_sec"), F.col("last_sched_sec"), step)))
    inside = F.coalesce((t >= F.col("first_actual_sec")) & (t <= F.col("last_actual_sec")), F.lit(False))
    return live.groupBy("route_id", "service_date", "t").agg(
        F.count(F.lit(1)).alias("active"), F.sum(inside.cast("bigint")).alias("with_actual"))


def _distance_at(points: DataFrame, time: str, step: int) -> DataFrame:
    """Distance along the shape at each sample time, from one clock.

    Each known point opens an interval to the next one, so a sample meets its bracket inside one row. Before
    the first and after the last known point the distance is held.
    """
    order = Window.partitionBy(*TRIP).orderBy(time, "time_point_order")
    known = points.where(F.col(time).isNotNull()).withColumns({
        "t0": F.col(time), "t1": F.lead(time).over(order), "d1": F.lead("dist_m").over(order),
        "head": F.row_number().over(order) == 1})
    lo = F.when(F.col("head"), F.least("t0", "first_sched_sec")).otherwise(F.col("t0"))
    lo = F.greatest(lo, "first_sched_sec")
    inner = sample_times(lo, F.least("t1", F.col("last_sched_sec") + 1), step, open_end=True)
    tail = sample_times(lo, F.col("last_sched_sec"), step)
    sampled = known.withColumn("t", F.explode(F.when(F.col("t1").isNull(), tail).otherwise(inner))).where(
        F.col("t") <= F.col("last_sched_sec"))
    share = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    moving = F.col("t1").isNotNull() & (F.col("t") > F.col("t0"))
    d = F.when(moving, F.col("dist_m") + share * (F.col("d1") - F.col("dist_m"))).otherwise(F.col("dist_m"))
    return sampled.select(*TRIP, "t", d.alias("d"))


def on_shape(df: DataFrame, shapes: DataFrame, dist: str, lon: str, lat: str, cell_m: float = 250.0) -> DataFrame:
    """Coordinates at a distance along a shape.

    Every vertex closes the segment from the vertex before it, found in buckets of 256 vertices; the first vertex of a
    shape is a segment of no length that holds the distances up to 0. Segments are listed under each ``cell_m`` stretch
    they touch, so the range lookup is an equi-join on (shape, stretch) followed by a filter.
    """
    lagged = bucketed_lag(shapes, ["shape_id"], F.floor(F.col("shape_pt_sequence") / 256), ["shape_pt_sequence"],
                          {"_s0": "cum_dist_m", "_plon": "shape_pt_lon", "_plat": "shape_pt_lat"})
    head = ~F.col("_has_prev")
    start = F.when(head, F.col("cum_dist_m")).otherwise(F.col("_s0"))
    seg = lagged.select(
        "shape_id", start.alias("_s"), F.col("cum_dist_m").alias("_e"),
        F.when(head, F.col("shape_pt_lon")).otherwise(F.col("_plon")).alias("_lon0"),
        F.when(head, F.col("shape_pt_lat")).otherwise(F.col("_plat")).alias("_lat0"),
        F.col("shape_pt_lon").alias("_lon1"), F.col("shape_pt_lat").alias("_lat1"), head.alias("_head"),
        F.explode(F.sequence(F.floor(start / cell_m), F.floor(F.col("cum_dist_m") / cell_m))).alias("_cell"))
    here = F.col(dist)
    hit = ((F.col("_s") < here) & (here <= F.col("_e"))) | (F.col("_head") & (here <= 0))
    located = df.withColumn("_cell", F.floor(F.greatest(here, F.lit(0.0)) / cell_m)).join(seg, ["shape_id", "_cell"])
    f = F.coalesce((here - F.col("_s")) / F.nullif(F.col("_e") - F.col("_s"), F.lit(0.0)), F.lit(0.0))
    return located.where(hit).select(
        *df.columns, (F.col("_lon0") + f * (F.col("_lon1") - F.col("_lon0"))).alias(lon),
        (F.col("_lat0") + f * (F.col("_lat1") - F.col("_lat0"))).alias(lat))


def distances_at(points: DataFrame, trips: DataFrame, step: int) -> DataFrame:
    """Scheduled and actual distance of every trip at each sample time inside its scheduled window.

    The actual distance is ``actualKnown`` inside the observed window, else ``actualMissing``; a trip without
    any actual rides with its schedule.
    """
    limits = trips.select(*TRIP, "shape_id", "first_sched_sec", "last_sched_sec", "first_actual_sec", "last_actual_sec")
    timed = points.drop("shape_id").join(limits, TRIP)
    planned = _distance_at(timed, "scheduled_sec", step).withColumnRenamed("d", "sched_dist_m")
    actual = _distance_at(timed, "actual_sec", step).withColumnRenamed("d", "_actual")
    t = F.col("t")
    known = F.coalesce((t >= F.col("first_actual_sec")) & (t <= F.col("last_actual_sec")), F.lit(False))
    return planned.join(actual, [*TRIP, "t"], "left").join(limits, TRIP).select(
        *TRIP, "shape_id", "t", "sched_dist_m", F.coalesce("_actual", "sched_dist_m").alias("actual_dist_m"),
        F.when(known, "actualKnown").otherwise("actualMissing").alias("kind"))


def positions_at(points: DataFrame, trips: DataFrame, shapes: DataFrame, step: int) -> DataFrame:
    """Scheduled and actual coordinates of every trip at each sample time; ``shapes`` has ``cum_dist_m``."""
    shapes = cut_lineage(shapes)
    where = on_shape(distances_at(points, trips, step), shapes, "sched_dist_m", "sched_lon", "sched_lat")
    return on_shape(where, shapes, "actual_dist_m", "actual_lon", "actual_lat")


def route_segments(overlay: DataFrame, trips: DataFrame, shapes: DataFrame, stops: DataFrame,
                   metric: str = "ratio") -> DataFrame:
    """Line of every overlay stop: the shape from the previous stop's vertex to its own.

    The vertices run backwards where the index falls, and a straight line replaces a missing or too short
    stretch. A route and direction with a single stop is that stop's point. The colour is the stop's class of
    ``metric``. ``overlay``: route, direction, stop, ``time_point_order``, ``lat``, ``lon`` and the metrics.
    """
    shape = g.majority_shape(trips).select("route_id", F.col("direction_id").alias("_code"), "shape_id")
    placed = overlay.withColumn("_code", text.direction_code(F.col("direction_id"))).join(
        shape, ["route_id", "_code"], "left")
    wanted = placed.where(F.col("shape_id").isNotNull()).select("shape_id", "stop_id").distinct().join(stops, "stop_id")
    vertex = g.project_stops(wanted, shapes).select("shape_id", "stop_id", F.col("shape_pt_sequence").alias("_idx"))
    key = ["route_id", "direction_id", "stop_id"]
    group = Window.partitionBy("route_id", "direction_id")  # the stops of one route
    w = group.orderBy("time_point_order", "stop_id")
    here = F.struct("lon", "lat")
    rows = placed.join(vertex, ["shape_id", "stop_id"], "left").withColumns({
        "_pidx": F.lag("_idx").over(w), "_prev": F.lag(here).over(w), "_alone": F.count(F.lit(1)).over(group) == 1})
    low, high = F.least(F.coalesce("_pidx", F.lit(0)), "_idx"), F.greatest(F.coalesce("_pidx", F.lit(0)), "_idx")
    # only the vertices of a stretch meet its stop
    stretch = rows.select(*key, "shape_id", low.alias("_low"), high.alias("_high")).alias("r")
    on = (F.col("r.shape_id") == F.col("p.shape_id")) & F.col("p.shape_pt_sequence").between(F.col("_low"), F.col("_high"))
    point = F.struct(F.col("p.shape_pt_sequence").alias("seq"), F.col("p.shape_pt_lon").alias("lon"), F.col("p.shape_pt_lat").alias("lat"))
    lines = stretch.join(shapes.alias("p"), on).groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("_line"))
    rows = rows.join(lines, key, "left")
    cut = F.transform(F.coalesce("_line", F.array().cast("array<struct<seq:int,lon:double,lat:double>>")),
                      lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    cut = F.when(F.col("_pidx") > F.col("_idx"), F.reverse(cut)).otherwise(cut)
    short = (F.size(cut) < 2) & F.col("_prev").isNotNull()
    along = F.when(short, F.concat(F.array("_prev"), cut, F.array(here))).otherwise(cut)
    straight = F.array(F.coalesce("_prev", here), here)
    with_shape = F.when(F.col("_alone"), F.array(here)).otherwise(along)
    coords = F.when(F.col("shape_id").isNotNull(), with_shape).otherwise(straight)
    value = {"ratio": "ratio", "on_time": "on_time_rate", "bunching": "bunching_rate", "load": "ridership_load"}[metric]
    return rows.select("route_id", "direction_id", "stop_id", "time_point_order", coords.alias("coordinates"),
                       m.metric_class(metric, F.col(value)).alias("color"))
