"""Schedule-feed operators: services, stop patterns, scheduled headways, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import clock, geo, text
from kerbflow.functions.skew import bucketed_lag, bucketed_running

Feed = dict[str, DataFrame]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def stop_names(stops: DataFrame) -> DataFrame:
    name = F.nullif(F.trim("stop_name"), F.lit(""))
    return stops.select("stop_id", F.coalesce(name, "stop_id").alias("stop_name"))


def with_stop_names(df: DataFrame, stops: DataFrame) -> DataFrame:
    """Attach the stop name, the id where the feed has none."""
    joined = df.join(stop_names(stops), "stop_id", "left")
    return joined.withColumn("stop_name", F.coalesce("stop_name", "stop_id"))


def active_services(dates: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Services running on each of ``dates`` (column ``service_date``).

    Every calendar row is unfolded into its days, so meeting the wanted dates is an equi-join. The weekday
    is that of the calendar date alone, no time zone.
    """
    flags = F.array(*[F.col(d) == "1" for d in WEEKDAYS])
    wanted = dates.select("service_date").distinct()
    regular = (
        calendar.withColumn("_on", flags)
        .select("service_id", "_on", F.explode(F.sequence(clock.service_date(F.col("start_date")),
                                                          clock.service_date(F.col("end_date")))).alias("service_date"))
        .where(F.element_at("_on", (F.weekday("service_date") + 1).cast("int")))
        .select("service_date", "service_id")
    )
    changes = exceptions.select(clock.service_date(F.col("date")).alias("service_date"), "service_id",
                                F.coalesce("exception_type", F.lit("1")).alias("exception_type"))
    added = changes.where(F.col("exception_type") == "1").drop("exception_type")
    removed = changes.where(F.col("exception_type") != "1").drop("exception_type")
    keys = ["service_date", "service_id"]
    return regular.unionByName(added).join(removed, keys, "left_anti").join(
        wanted, "service_date", "left_semi").distinct()


def trips_on(active: DataFrame, trips: DataFrame) -> DataFrame:
    return trips.join(active, "service_id").select("service_date", *trips.columns)


def stops_near(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops inside each point's radius with the rounded distance; ``points``: school_id, lat, lon, radius_m."""
    targets = stops.select("stop_id", "stop_name", F.col("stop_lat").cast("double").alias("t_lat"),
                           F.col("stop_lon").cast("double").alias("t_lon"))
    near = geo.within_radius(points.select("school_id", "lat", "lon", "radius_m"), targets)
    return near.select("school_id", "stop_id", "stop_name", F.col("t_lat").alias("stop_lat"),
                       F.col("t_lon").alias("stop_lon"), F.round("distance_exact").cast("int").alias("distance_m"))


def route_stop_pairs(feed: Feed) -> DataFrame:
    """Distinct (route, stop) served by any trip."""
    served = feed["stop_times"].where(F.col("stop_id").isNotNull()).select("trip_id", "stop_id")
    return served.join(feed["trips"].select("trip_id", "route_id"), "trip_id").select("route_id", "stop_id").distinct()


def routes_for_stops(stops: DataFrame, feed: Feed, by: list[str]) -> DataFrame:
    """Routes with at least one trip serving one of ``stops`` (per ``by``), shuttles left out."""
    pairs = route_stop_pairs(feed).where(~F.col("route_id").startswith("Shuttle"))
    hit = pairs.join(stops.select(*by, "stop_id").distinct(), "stop_id").select(*by, "route_id").distinct()
    return hit.join(feed["routes"], "route_id").select(*by, *feed["routes"].columns)


def route_labels(routes: DataFrame) -> DataFrame:
    """The ids a rider's route label stands for: the id itself and every route with that short name."""
    own = routes.select(F.col("route_id").alias("label"), "route_id")
    short = routes.where(F.col("route_short_name").isNotNull()).select(F.col("route_short_name").alias("label"), "route_id")
    return own.unionByName(short).distinct()


def stops_on_route(feed: Feed) -> DataFrame:
    """Stops on the pattern of every route label."""
    return route_stop_pairs(feed).join(route_labels(feed["routes"]), "route_id").select(
        F.col("label").alias("route_id"), "stop_id").distinct()


def windows_of(seconds, windows: dict[str, tuple[str, str]], closed: bool):
    """Array of the names of the windows (a short parameter list) that contain ``seconds``."""
    items = []
    for name, (start, end) in windows.items():
        lo, hi = round(clock.window_hour(start) * 3600), round(clock.window_hour(end) * 3600)
        inside = (seconds >= lo) & ((seconds <= hi) if closed else (seconds < hi))
        items.append(F.when(inside, F.lit(name)))
    return F.array_compact(F.array(*items))


def scheduled_headways(feed: Feed, active: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Median scheduled headway and trip count per (date, window, route, stop); window ends inclusive.

    Departures are first counted per second. The gaps follow from the distinct seconds (a second used ``n``
    times adds ``n - 1`` gaps of zero), so no group is larger than the seconds of its window.
    """
    departures = feed["stop_times"].select(
        "trip_id", "stop_id", clock.gtfs_seconds(F.col("departure_time")).alias("dep")
    ).withColumn("time_window", F.explode(windows_of(F.col("dep"), windows, closed=True)))
    running = trips_on(active, feed["trips"]).select("service_date", "trip_id", "route_id")
    keys = ["service_date", "time_window", "route_id", "stop_id"]
    counts = departures.join(running, "trip_id").groupBy(*keys, "dep").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("dep")
    gaps = counts.withColumn("gap", F.col("dep") - F.lag("dep").over(order)).withColumn(
        "_g", F.explode(F.array(F.struct(F.col("gap"), F.lit(1).cast("bigint").alias("w")),
                                F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("w"))))
    ).select(*keys, "_g.gap", "_g.w").where(F.col("gap").isNotNull() & (F.col("w") > 0))
    return gaps.groupBy(*keys).agg(
        (F.expr("percentile(gap, 0.5D, w)") / 60).alias("scheduled_median_min"),
        (F.sum("w") + 1).alias("trip_count"),
    )


def majority_shape(trips: DataFrame) -> DataFrame:
    """Shape used by most trips of each (route, direction); the smallest id wins a tie."""
    usable = trips.where(F.col("shape_id").isNotNull() & (F.coalesce("direction_id", F.lit("")) != ""))
    n = usable.groupBy("route_id", "direction_id", "shape_id").agg(F.count(F.lit(1)).alias("n_trips"))
    best = F.min(F.struct(F.negative("n_trips").alias("k"), F.col("shape_id"))).alias("b")
    return n.groupBy("route_id", "direction_id").agg(best).select(
        "route_id", "direction_id", "b.shape_id", F.negative("b.k").alias("n_trips"))


def longest_trip_axis(feed: Feed) -> DataFrame:
    """Ordered distinct stops of the longest trip of every route (most stop rows; smallest id on ties)."""
    routes = feed["routes"].select("route_id", F.coalesce("route_short_name", "route_id").alias("label"))
    trips = feed["trips"].select("trip_id", "route_id").join(routes, "route_id").select("trip_id", "label")
    n = feed["stop_times"].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.join(trips, "trip_id").groupBy("label").agg(
        F.min(F.struct(F.negative("n").alias("k"), F.col("trip_id"))).alias("b")
    ).select(F.col("label").alias("route_id"), "b.trip_id")
    seq = F.coalesce(F.col("stop_sequence").cast("string").try_cast("int"), F.lit(0))
    first = feed["stop_times"].join(best, "trip_id").groupBy("route_id", "trip_id", "stop_id").agg(F.min(seq).alias("seq"))
    w = Window.partitionBy("route_id").orderBy("seq", "stop_id")  # the stops of one trip
    return first.withColumn("axis_rank", (F.row_number().over(w) - 1).cast("int")).select(
        "route_id", "trip_id", "stop_id", "axis_rank")


def display_rank(feed: Feed, first_names: str, last_names: str) -> DataFrame:
    """Display order of a route's stops from the median stop sequence per direction.

    Under a name count the trips of the route with that id and of all routes with that short name.
    Each direction is a chain of stops ordered by median sequence. Chains whose first stop name matches
    ``first_names`` come first, those matching ``last_names`` last; a stop keeps its first place.
    """
    names = feed["routes"].select(F.col("route_id").alias("_id"), F.explode(F.array_distinct(F.array(
        F.col("route_id"), F.coalesce("route_short_name", "route_id")))).alias("route_id"))
    trips = feed["trips"].select("trip_id", F.col("route_id").alias("_id"), F.coalesce("direction_id", F.lit("")).alias(
        "direction_id")).join(names, "_id").drop("_id")
    seq = F.coalesce(F.col("stop_sequence").cast("string").try_cast("int"), F.lit(0))
    medians = feed["stop_times"].select("trip_id", "stop_id", seq.alias("seq")).join(trips, "trip_id").groupBy(
        "route_id", "direction_id", "stop_id").agg(F.median("seq").alias("m"))
    heads = medians.groupBy("route_id", "direction_id").agg(F.min(F.struct("m", "stop_id")).alias("h"))
    names = stop_names(feed["stops"]).withColumnRenamed("stop_name", "head_name")
    heads = heads.select("route_id", "direction_id", F.col("h.stop_id").alias("stop_id")).join(names, "stop_id", "left")
    name = F.lower(F.coalesce("head_name", F.lit("")))
    chains = heads.select("route_id", "direction_id", F.struct(
        F.when(name.contains(first_names.lower()), 0).otherwise(1).alias("a"),
        F.when(name.contains(last_names.lower()), 1).otherwise(0).alias("b"),
        F.col("direction_id").alias("d")).alias("chain"))
    place = medians.join(chains, ["route_id", "direction_id"]).groupBy("route_id", "stop_id").agg(
        F.min(F.struct("chain", "m", "stop_id")).alias("p"))
    w = Window.partitionBy("route_id").orderBy("p")  # the stops of one route
    return place.select("route_id", "stop_id", (F.row_number().over(w) - 1).cast("int").alias("display_rank"))


def feed_stats(feed: Feed) -> DataFrame:
    """Row counts of the feed; stop times count distinct trips."""
    counts = [(name, feed[name].agg(F.count(F.lit(1)).alias("n"))) for name in
              ["stops", "routes", "trips", "calendar", "calendar_dates"]]
    counts.append(("stop_times", feed["stop_times"].agg(F.count_distinct("trip_id").alias("n"))))
    out = None
    for name, df in counts:
        part = df.select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def shape_distance(shapes: DataFrame) -> DataFrame:
    """Cumulative metres along each shape.

    Long shapes are cut every 256 vertices, so neither the previous vertex nor the running sum needs a
    whole shape in one task.
    """
    bucket = F.floor(F.col("shape_pt_sequence") / 256)
    lagged = bucketed_lag(shapes, ["shape_id"], bucket, ["shape_pt_sequence"],
                          {"prev_lat": "shape_pt_lat", "prev_lon": "shape_pt_lon"})
    step = geo.haversine_m(F.col("prev_lat"), F.col("prev_lon"), F.col("shape_pt_lat"), F.col("shape_pt_lon"),
                           geo.RADIUS_SHAPE)
    stepped = lagged.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    out = bucketed_running(stepped, ["shape_id"], bucket, ["shape_pt_sequence"], "_step", "cum_dist_m", "sum")
    return out.select("shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon", "cum_dist_m")


def project_stops(stops: DataFrame, shapes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nearest shape vertex of each (shape_id, stop_id): squared degrees, first vertex on ties."""
    keep = keep or ["shape_pt_sequence"]
    points = stops.select("shape_id", "stop_id", F.col("stop_lat").cast("double").alias("lat"),
                          F.col("stop_lon").cast("double").alias("lon")).distinct()
    targets = shapes.withColumnRenamed("shape_pt_lat", "t_lat").withColumnRenamed("shape_pt_lon", "t_lon")
    return geo.nearest(points, targets, ["stop_id"], ["shape_pt_sequence"], keep, by=["shape_id"], metric="degrees")


def route_bounds(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Map extent of every route over the shapes drawn for it (the majority shape per direction)."""
    drawn = majority_shape(trips).select("route_id", "shape_id").distinct()
    return shapes.join(drawn, "shape_id").groupBy("route_id").agg(
        F.min("shape_pt_lon").alias("min_lon"), F.min("shape_pt_lat").alias("min_lat"),
        F.max("shape_pt_lon").alias("max_lon"), F.max("shape_pt_lat").alias("max_lat"))


def validate_corridor(corridor: list[tuple[str, str, str]], stops: DataFrame, k: int = 3,
                      cutoff: float = 0.6) -> DataFrame:
    """Check an expected stop list (direction, name, stop id) against the feed.

    Status is ``missing``, ``mismatched`` or ``ok``; missing stops get the ``k`` most similar names. The
    corridor is a short parameter list and is carried as a literal, so stops are scanned once and only
    similar names leave the scan. Similarity is ``1 - levenshtein / longer length``.
    """
    spark = stops.sparkSession
    names = stop_names(stops).withColumn("_norm", text.norm_stop_name(F.col("stop_name")))
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(corridor)],
                                 "pos int, direction string, expected_name string, stop_id string")
    base = rows.join(names, "stop_id", "left").withColumn("_want", text.norm_stop_name(F.col("expected_name")))
    status = F.when(F.col("stop_name").isNull(), "missing").when(F.col("_want") != F.col("_norm"), "mismatched")
    base = base.withColumn("status", status.otherwise("ok"))
    wanted = F.array(*[F.struct(F.lit(i).alias("pos"), text.norm_stop_name(F.lit(r[1])).alias("want"))
                       for i, r in enumerate(corridor)])
    longer = lambda w: F.greatest(F.length(w["want"]), F.length("_norm"), F.lit(1))
    score = lambda w: 1 - F.levenshtein(w["want"], F.col("_norm")) / longer(w)
    # one candidate per distinct normalised name, the first stop id carrying it
    distinct = names.groupBy("_norm").agg(F.min(F.struct("stop_id", "stop_name")).alias("s"))
    similar = distinct.select("s.*", F.explode(F.filter(
        F.transform(wanted, lambda w: F.struct(w["pos"].alias("pos"), score(w).alias("score"))),
        lambda h: h["score"] >= cutoff)).alias("h")).select("h.pos", "h.score", "stop_id", "stop_name")
    label = F.concat("stop_name", F.lit(" (stop_id="), F.col("stop_id"), F.lit(")"))
    w = Window.partitionBy("pos").orderBy(F.desc("score"), "stop_id")
    missing = base.where(F.col("status") == "missing").select("pos")
    top = similar.join(missing, "pos").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    top = top.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("_r", label.alias("label")))).alias("t"))
    matches = F.coalesce(F.transform("t", lambda x: x["label"]), F.array().cast("array<string>"))
    return base.join(top, "pos", "left").select(
        "direction", "expected_name", "stop_id", "stop_name", "status", F.array_join(matches, "; ").alias("matches"))
