"""Domain tables as deterministic projections of the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUTES = ["28", "1", "39", "66"]
WINDOW = ("07:00", "09:00")
BELLS = {"AM": WINDOW, "PM": ("14:00", "16:00"), "AS": ("16:00", "18:00")}
SERVICE_DAY = "2024-01-10"
SCHOOLS = [("s1", "First school", 42.3226, -71.0894, 1200.0), ("s2", "Second school", 42.31, -71.11, 800.0)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def hms(sec: Column) -> Column:
    sec = sec.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(sec / 3600), F.floor(F.pmod(sec, F.lit(3600)) / 60),
                           F.pmod(sec, F.lit(60)))


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    ev, ts, uid = F.col("event_id"), F.col("ts"), F.col("user_id")
    sched = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint")
    act = F.greatest(F.least(sched + ev * 37 % 600 - 120, F.lit(86399)), F.lit(0))
    kind = F.when(ev % 10 == 0, "Other").when(ev % 10 <= 3, "Schedule").otherwise("Headway")
    stop = F.floor(uid / 4) % 5

    def stamp(sec: Column) -> Column:
        return F.when(ev % 5 == 0, F.concat(F.lit("1900-01-01 "), hms(sec), F.lit(".000"))).otherwise(
            F.concat(F.lit("1900-01-01T"), hms(sec), F.lit("Z")))

    return table(spark, sf, "events").select(
        F.to_date("ts").alias("service_date"),
        pick(ROUTES, uid % 4).alias("route_id"),
        F.when(F.col("event_type").isin("click", "view"), "Inbound").otherwise("Outbound").alias("direction_id"),
        F.concat(F.lit("H"), (uid % 30).cast("string")).alias("half_trip_id"),
        F.concat(F.lit("S"), stop.cast("string")).alias("stop_id"),
        F.concat(F.lit("tp"), stop.cast("string")).alias("time_point_id"),
        F.hour(ts).alias("time_point_order"),
        F.lit("Midpoint").alias("point_type"),
        kind.alias("standard_type"),
        stamp(sched).alias("scheduled"),
        F.when(ev % 17 != 0, stamp(act)).alias("actual"),
        F.when(kind == "Schedule", 600 + ev % 7 * 120).cast("int").alias("scheduled_headway"),
        F.when((kind == "Headway") & (ev % 3 == 0), 60 + ev % 11 * 90).cast("int").alias("headway"),
    )


# --- schedule feed -----------------------------------------------------------------------------------

def line_order() -> list[str]:
    return ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    # bounded by the lines of one order
    w = Window.partitionBy("l_orderkey").orderBy(*line_order())
    return table(spark, sf, "lineitem").withColumn("seq", F.row_number().over(w))


def gtfs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    sk = F.col("s_suppkey")
    stops = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), sk.cast("string")).alias("stop_id"),
        F.col("s_name").alias("stop_name"),
        (42.30 + sk % 37 * 0.002).alias("stop_lat"),
        (-71.12 + sk % 41 * 0.002).alias("stop_lon"),
    )
    nk = F.col("n_nationkey")
    rid = route_of(nk)
    routes = table(spark, sf, "nation").select(
        rid.alias("route_id"), rid.alias("route_short_name"), F.col("n_name").alias("route_long_name"))
    ok = F.col("o_orderkey")
    route = route_of(F.col("o_custkey") % 25)
    direction = (ok % 2).cast("string")
    trips = table(spark, sf, "orders").select(
        F.concat(F.lit("T"), ok.cast("string")).alias("trip_id"),
        route.alias("route_id"),
        F.concat(F.lit("svc"), F.substring("o_orderpriority", 1, 1)).alias("service_id"),
        direction.alias("direction_id"),
        F.concat(route, F.lit("_"), direction, F.when(ok % 5 < 3, "_a").otherwise("_b")).alias("shape_id"),
    )
    dep = hms(18000 + F.col("l_orderkey") * 7 % 1200 * 60 + F.col("seq") * 150)
    stop_times = numbered_lines(spark, sf).select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("trip_id"),
        dep.alias("arrival_time"), dep.alias("departure_time"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("stop_id"),
        F.col("seq").alias("stop_sequence"),
    )
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    calendar = spark.createDataFrame(
        [(f"svc{n}", *flags, "20240101", "20241231") for n, flags in
         [(1, "1111100"), (2, "1111100"), (3, "0000011"), (4, "1111111"), (5, "1010100")]],
        "service_id string, " + ", ".join(f"{d} string" for d in days) + ", start_date string, end_date string")
    exceptions = spark.createDataFrame(
        [("svc1", "20240115", "2"), ("svc3", "20240115", "1")],
        "service_id string, date string, exception_type string")
    n = F.col("shape_pt_sequence")
    shapes = (
        trips.select("shape_id").distinct()
        .withColumn("shape_pt_sequence", F.explode(F.sequence(F.lit(0), F.lit(9))))
        .withColumn("shape_pt_lat", 42.3005 + n % 37 * 0.002)
        .withColumn("shape_pt_lon", -71.1195 + n % 41 * 0.002)
    )
    return {
        "stops": stops, "routes": routes, "trips": trips, "stop_times": stop_times, "calendar": calendar,
        "calendar_dates": exceptions, "shapes": shapes,
    }


def route_of(n: Column) -> Column:
    known = F.element_at(F.array(*[F.lit(r) for r in ROUTES]), F.least(n, F.lit(3)).cast("int") + 1)
    other = F.when(n == 24, "Shuttle24").otherwise(F.concat(F.lit("R"), n.cast("string")))
    return F.when(n < 4, known).otherwise(other)


def schools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHOOLS, "school_id string, name string, lat double, lon double, radius_m double")


# --- ridership -----------------------------------------------------------------------------------------

def ridership(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.substring("o_orderpriority", 1, 1)
    day = F.when(prio.isin("1", "2", "3"), "weekday").when(prio == "4", "saturday").otherwise("sunday")
    joined = numbered_lines(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.lit("Spring 2024").alias("season"),
        route_of(F.col("o_custkey") % 25).alias("route_id"),
        F.col("l_returnflag").alias("route_variant"),
        (F.col("o_orderkey") % 2).cast("string").alias("direction_id"),
        hms((5 + F.col("o_orderkey") % 18) * 3600).alias("trip_start_time"),
        F.concat(F.lit("day_type_0"), prio).alias("day_type_id"),
        day.alias("day_type_name"),
        F.concat(F.lit("Stop "), (F.col("l_suppkey") % 10).cast("string")).alias("stop_name"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("stop_id"),
        F.col("seq").alias("stop_sequence"),
        F.col("l_quantity").alias("boardings"),
        (F.col("l_quantity") * F.col("l_discount")).alias("alightings"),
        (F.col("l_quantity") - F.col("l_quantity") * F.col("l_discount")).alias("load"),
        F.col("l_linenumber").alias("sample_size"),
    )


# --- streets ---------------------------------------------------------------------------------------------

HIGHWAYS = ["primary", "secondary", "tertiary", "residential", "service", "cycleway", "footway", "trunk",
            "unclassified", "living_street", "secondary_link", "pedestrian"]
LANE_TAGS = ["lane", "track", "no", "separate", "shared_lane", None]


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Raw street edges as tagged in the map, one row per line item."""
    q = F.col("l_quantity").cast("int")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    # bounded by the parallel lines of one node pair
    w = Window.partitionBy("u", "v").orderBy("l_orderkey", *line_order())
    return (
        table(spark, sf, "lineitem")
        .withColumn("u", pk).withColumn("v", pk + sk + 1)
        .withColumn("key", (F.row_number().over(w) - 1))
        .select(
            "u", "v", "key",
            F.col("l_orderkey").alias("osmid"),
            F.lit(None).cast("string").alias("name"),
            pick(HIGHWAYS, pk % 12).alias("highway"),
            F.when(F.col("l_returnflag") == "A", 1).otherwise(0).cast("smallint").alias("oneway"),
            F.when(F.col("l_linenumber") == 6, "1; 2").when(F.col("l_linenumber") != 7,
                   F.col("l_linenumber").cast("string")).alias("lanes"),
            pick([None, "25 mph", "30 mph", "40 mph", "signals"], q % 5).alias("maxspeed"),
            pick(LANE_TAGS, sk % 6).alias("cycleway:right"),
            pick(LANE_TAGS, F.floor(sk / 6) % 6).alias("cycleway:left"),
            F.when(sk % 17 == 0, "lane").alias("cycleway:both"),
            pick(["yes", "designated", "no", "dismount", None, None, None, None, None], pk % 9).alias("bicycle"),
            F.when(d == 0, "no").when(d == 1, "lane").when(d == 2, "street_side").alias("parking:both"),
            F.when(t == 0, "no").when(t == 1, "lane").alias("parking:right"),
            F.when(q % 7 == 0, "12'6\"").when(q % 7 == 1, "9").when(q % 7 == 2, "8;10").alias("width"),
            F.when(q % 4 == 0, "1.5").when(q % 4 == 1, "6'").alias("cycleway:right:width"),
            pick(["flex_post", "kerb", "bump", None, None, None, None, None], pk % 8)
            .alias("cycleway:right:separation"),
            (F.col("l_extendedprice") / 100).alias("length"),
        )
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 5
    pk = F.col("p_partkey")
    return table(spark, sf, "part").select(
        pk.alias("osmid"),
        (-71.12 + pk % 41 * 0.002).alias("x"), (42.30 + pk % 37 * 0.002).alias("y"),
        F.when(size == 0, "traffic_signals").when(size == 1, "stop").alias("highway"),
    )


# --- graph -------------------------------------------------------------------------------------------------

def graph(spark: SparkSession, sf: str) -> DataFrame:
    """Rated street graph: about ten edges leave each node, and nodes grow with the part table.

    A street with a node per nation, partly one-way, links two of the nodes; a piece with the regions is cut off.
    """
    part = table(spark, sf, "part")
    pk, size = F.col("p_partkey"), F.col("p_size")
    n_nodes = part.agg(F.floor(F.max(pk) / 10) + 1).first()[0]  # one number
    main = part.select(
        F.floor(pk / 10).alias("u"),
        F.pmod(pk * 7 + size, F.lit(n_nodes)).alias("v"),
        pk.alias("key"),
        (100.0 + size * 40).alias("length"),
        F.when(size == 50, 0).otherwise(1 + pk % 4).cast("int").alias("LTS"),
    )
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    step = table(spark, sf, "nation").select(
        F.when(n == 0, 0).otherwise(n_nodes + n - 1).alias("a"), (n_nodes + n).alias("b"), n.alias("k"),
        (40.0 + n).alias("length"), F.when(n == 20, 3).otherwise(1).alias("LTS"))
    last = step.where("k = 24").select(F.col("b").alias("a"), F.lit(1).cast("bigint").alias("b"), F.lit(25).cast("bigint").alias("k"),
                                       F.lit(65.0).alias("length"), F.lit(1).alias("LTS"))
    street = step.unionAll(last)
    back = street.where(F.col("k") % 6 != 5)
    apart = table(spark, sf, "region").select((n_nodes + 100 + r).alias("a"), (n_nodes + 101 + r).alias("b"), (30 + r).alias("k"),
                                              F.lit(100.0).alias("length"), F.lit(1).alias("LTS"))
    ends = lambda df, u, v: df.select(F.col(u).alias("u"), F.col(v).alias("v"), F.negative("k").alias("key"), "length", "LTS")
    return main.unionAll(ends(street, "a", "b")).unionAll(ends(back, "b", "a")).unionAll(ends(apart, "a", "b"))


def graph_nodes(edges_df: DataFrame) -> DataFrame:
    ids = edges_df.select(F.col("u").alias("osmid")).unionByName(edges_df.select(F.col("v").alias("osmid"))).distinct()
    n = F.col("osmid")
    return ids.select("osmid", (-71.12 + n % 41 * 0.002).alias("x"), (42.30 + n % 37 * 0.002).alias("y"),
                      F.when(n % 50 == 49, 4).otherwise(1).alias("LTS"))
