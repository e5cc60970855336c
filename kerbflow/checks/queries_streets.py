"""Street, graph and timeline queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.checks import adapters as ad
from kerbflow.checks import queries_transit as qt
from kerbflow.functions import clock
from kerbflow.functions.metrics import stress_color
from kerbflow.operators import arrivals as a
from kerbflow.operators import graph as gr
from kerbflow.operators import gtfs as g
from kerbflow.operators import positions as ps
from kerbflow.operators import reliability as r
from kerbflow.operators import streets as st
from kerbflow.operators import stress
from kerbflow.plans import edge_stress as es
from kerbflow.rules import street_rules as sr
from kerbflow.rules.conditions import compile_condition, tag
from kerbflow.rules.stress_tables import TABLES
from kerbflow.session import cut_lineage, work_path
from kerbflow.sinks import writers
from kerbflow.sources import streets as src
from kerbflow.sources import transit as tsrc

QUERIES = {}
ID = ["u", "v", "key"]


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*ID, *[st.column(n) for n in names])


def per_way(*names: str) -> list[str]:
    return [f"{n}_{w}" for n in names for w in st.WAYS]


@query("r1_parking_rules")
def _(s, d):
    out = st.parking(ad.edges(s, d)).withColumns(st.parking_provenance())
    return cols(out, [f"{n}_{side}" for n in ("parking", "parking_rule_num", "parking_rule") for side in st.SIDES])


QUERIES["p1_fold_both"] = lambda s, d: cols(
    st.fold_both(ad.edges(s, d)), ["cycleway:left", "cycleway:right", "parking:left", "parking:right"])


@query("p2_implicit_both")
def _(s, d):
    # the lanes text stands in for an unsuffixed cycleway tag
    return cols(st.fold_both(ad.edges(s, d).withColumn("cycleway", F.col("lanes"))), ["cycleway:left", "cycleway:right"])


@query("p3_suffix_merge")
def _(s, d):
    swapped = ad.edges(s, d).withColumn("cycleway:width:right", F.col("width")).withColumn(
        "cycleway:buffer:left", F.col("maxspeed"))
    return cols(st.fold_both(swapped), ["cycleway:right:width", "cycleway:left:buffer"])


QUERIES["p9_parking_width"] = lambda s, d: cols(
    st.parking(ad.edges(s, d)), ["parking_width_left", "parking_width_right"])
QUERIES["r3_parse_directions"] = lambda s, d: cols(
    es.directed_features(ad.edges(s, d)).withColumn("parse", st.parse_text()),
    [*sr.LANE_TARGETS, *per_way("LTS_bike_access"), "parse"])


@query("r4_conditions")
def _(s, d):
    bicycle, highway = tag("bicycle"), tag("highway")
    tests = {"not_yes": bicycle != "yes", "is_yes": bicycle == "yes",
             "neither": ~((bicycle == "no") | (highway == "primary")), "wide": tag("lanes") >= "3"}
    return ad.edges(s, d).agg(*[F.count_if(compile_condition(c)).alias(n) for n, c in tests.items()])


def right_lane():
    return (tag("cycleway:right") == "lane") & (tag("oneway") == 1)


@query("r5_label_filters")
def _(s, d):
    filters = [("right_lane", right_lane()), ("primary_ok", (tag("bicycle") != "no") & (tag("highway") == "primary"))]
    return st.label_filters(ad.edges(s, d), filters).groupBy("filter_label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["g11_parse_hits"] = lambda s, d: st.parse_hits(st.fold_both(st.parking(ad.edges(s, d))))
QUERIES["p4_prevailing_speed"] = lambda s, d: cols(
    st.prevailing_speed(ad.edges(s, d)).withColumns(st.provenance_columns("speed", sr.speed_rules())),
    ["speed", "speed_rule_num"])
QUERIES["p5_lane_count"] = lambda s, d: cols(st.lane_count(ad.edges(s, d)), ["lane_count", "lane_rule"])
QUERIES["p6_width_feet"] = lambda s, d: ad.edges(s, d).groupBy("width").agg(F.count(F.lit(1)).alias("n")).select(
    "width", st.width_feet(F.col("width")).alias("ft"), st.width_note(F.col("width")).alias("note"), "n")
QUERIES["p7_widths"] = lambda s, d: cols(
    st.widths(es.directed_features(ad.edges(s, d))),
    ["width_street", "width_street_rule", *per_way("bike_width", "bike_width_rule", "buffer", "bike_reach")])
QUERIES["p8_narrow_wide"] = lambda s, d: cols(
    st.narrow_wide(st.widths(es.directed_features(ad.edges(s, d)))), ["street_narrow_wide"])


@query("r2_symmetric_rules")
def _(s, d):
    out = es.measured_features(ad.edges(s, d)).withColumns(
        st.provenance_columns("centerline", sr.centerline_rules()) | st.provenance_columns("ADT", sr.adt_rules()))
    return cols(out, ["centerline", "centerline_rule_num", "ADT", "ADT_rule_num"])


QUERIES["p10_separation_lts"] = lambda s, d: cols(
    stress.separation_lts(es.directed_features(ad.edges(s, d))), per_way("LTS_separation"))
QUERIES["x1_table_stress"] = lambda s, d: cols(
    stress.table_stress(es.measured_features(ad.edges(s, d))), per_way(*[f"LTS_{p.name}" for t in TABLES for p in t.parts]))
QUERIES["j2_lookup_lts"] = lambda s, d: cols(
    stress.table_stress(es.measured_features(ad.edges(s, d))), per_way(*[f"LTS_{t.name}" for t in TABLES]))
QUERIES["g3_combine_lts"] = lambda s, d: cols(es.rated_edges(ad.edges(s, d)), ["LTS_fwd", "LTS_rev", "LTS"])
QUERIES["x5_edge_stress"] = lambda s, d: cols(
    es.edge_stress(ad.edges(s, d)),
    ["LTS_fwd", "LTS_rev", "LTS", "speed", "lane_count", "centerline", "ADT", "street_narrow_wide", "width_street",
     *per_way("bike_reach", "parking", "bike_lane", "separation"), "speed_rule_num", "ADT_rule_num",
     "centerline_rule_num", "zoom", "parse"])
QUERIES["g2_node_lts"] = lambda s, d: stress.node_lts(ad.nodes(s, d), es.rated_edges(ad.edges(s, d)))


@query("j1_out_edges")
def _(s, d):
    out = es.rated_edges(ad.edges(s, d)).groupBy(F.col("u").alias("osmid")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.max("LTS").alias("worst"))
    return ad.nodes(s, d).select("osmid").join(out, "osmid", "left").withColumn(
        "n_edges", F.coalesce("n_edges", F.lit(0)))


QUERIES["p11_stress_color"] = lambda s, d: es.rated_edges(ad.edges(s, d)).groupBy(
    "LTS", stress_color(F.col("LTS")).alias("color")).agg(F.count(F.lit(1)).alias("n"))
QUERIES["p12_travel_minutes"] = lambda s, d: gr.travel_minutes(ad.edges(s, d), 15).select(*ID, "minutes")
COUNTED = ["bike_allowed_fwd", "bike_allowed_rev", "centerline", "lane_count", "oneway", "street_narrow_wide",
           "bike_lane_fwd", "bike_lane_rev", "parking_fwd", "parking_rev", "ADT"]
QUERIES["g10_value_counts"] = lambda s, d: st.value_counts(es.measured_features(ad.edges(s, d)), COUNTED)
QUERIES["g12_table_hits"] = lambda s, d: stress.table_hits(es.measured_features(ad.edges(s, d)))


def regions(s, d) -> DataFrame:
    edges = ad.edges(s, d)
    odd = F.col("u") % 2 == 1
    return stress.union_regions({"north": edges.where(~odd), "south": edges.where(odd).drop("width")})


QUERIES["u1_union_regions"] = lambda s, d: regions(s, d).groupBy("region", "highway").agg(
    F.count(F.lit(1)).alias("n"), F.count("width").alias("with_width"))


@query("k1_edge_table")
def _(s, d):
    path = work_path(s, "edges")
    region = F.when(F.col("u") % 2 == 0, "north").otherwise("south")
    writers.write_edges(es.rated_edges(ad.edges(s, d)).select(*ID, "LTS", region.alias("region")), path)
    return s.read.parquet(path).groupBy("region", "LTS").agg(F.count(F.lit(1)).alias("n"))


@query("k2_stress_geojson")
def _(s, d):
    path = work_path(s, "features")
    writers.write_geojson(writers.feature_table(es.edge_stress(ad.edges(s, d))), path)
    fields = "struct<properties: struct<highway: string, LTS: int, color: string>>"
    return s.read.text(path).select(F.from_json("value", fields).alias("f")).select("f.properties.*").groupBy(
        "highway", "LTS", "color").agg(F.count(F.lit(1)).alias("n"))


@query("k4_filter_geojson")
def _(s, d):
    labelled = st.label_filters(ad.edges(s, d), [("right_lane", right_lane())])
    features = writers.to_geojson(labelled.withColumn("geometry", F.lit(None).cast("array<struct<lon: double, lat: double>>")))
    fields = "struct<properties: struct<filter_label: string, highway: string>>"
    return features.select(F.from_json("value", fields).alias("f")).select("f.properties.*").groupBy(
        "filter_label", "highway").agg(F.count(F.lit(1)).alias("n"))


@query("k5_rule_logs")
def _(s, d):
    path = work_path(s, "log")
    rules = es.measured_features(ad.edges(s, d)).withColumns(st.provenance_columns("ADT", sr.adt_rules()))
    writers.write_log(rules.groupBy(F.col("ADT_rule_num").alias("rule")).agg(F.count(F.lit(1)).alias("n")), path)
    return s.read.schema("rule string, n bigint").csv(path, header=True)


@query("k3_stop_metric_documents")
def _(s, d):
    path = work_path(s, "metrics")
    quarters = qt.quarters(s, d)
    writers.write_stop_metrics(r.stop_metrics(r.stop_day_summary(quarters)), r.stop_metrics_by_hour(quarters), path)
    return tsrc.read_stop_metrics(s, path)


@query("s11_stop_metric_hour")
def _(s, d):
    path = work_path(s, "metrics")
    quarters = qt.quarters(s, d)
    writers.write_stop_metrics(r.stop_metrics(r.stop_day_summary(quarters)), r.stop_metrics_by_hour(quarters), path)
    return tsrc.read_stop_metrics(s, path, 8)


@query("s4_edge_csv")
def _(s, d):
    path = work_path(s, "edge-csv")
    header = [*ID, "osmid", "oneway", "length", "highway", "lanes", "maxspeed", "width"]
    ad.edges(s, d).select(*header).write.csv(path, header=True, quote='"', escape='"')
    return src.read_edges(s, path, ["highway", "maxspeed", "width"], header)


@query("s5_node_csv")
def _(s, d):
    path = work_path(s, "node-csv")
    ad.nodes(s, d).select("osmid", "x", "y", F.lit(None).cast("int").alias("street_count"), "highway",
                          F.lit(None).cast("string").alias("ref")).write.csv(path, header=True)
    return src.read_nodes(s, path).select("osmid", "x", "y", "highway")


@query("s6_arrivals_csv")
def _(s, d):
    path = work_path(s, "arrivals-csv")
    ad.arrivals(s, d).write.csv(path, header=True)
    return tsrc.read_arrivals(s, path)


@query("s10_annotations")
def _(s, d):
    path = work_path(s, "notes")
    item = F.to_json(F.struct(F.col("stop_id").alias("stopId"), F.col("route_id").alias("routeId"), "type"))
    qt.notes(s, d).select(item.alias("value")).write.text(path)
    return tsrc.read_annotations(s, path, multi_line=False).groupBy("stop_id", "route_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("s12_photo_points")
def _(s, d):
    path = work_path(s, "photos")
    uid = F.col("user_id")
    ad.table(s, d, "events").select(
        F.concat(F.lit("/p/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("SourceFile"),
        F.when(F.col("event_id") % 7 != 0, 42.3 + uid * 0.0001).alias("GPSLatitude"),
        (-71.1 + uid * 0.0001).alias("GPSLongitude"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("CreateDate"), "event_id",
    ).repartitionByRange(3, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(path)
    return src.photo_points(src.read_photo_meta(s, path, multi_line=False)).select("id", "lon", "lat", "filename", "datetime", "make")


# --- raw map documents -----------------------------------------------------------------------------------------

def osm_documents(s, d, more_tags: dict | None = None) -> str:
    """Write the lines of every order as a way, 500 numbers a document; returns the folder."""
    path = work_path(s, "osm")
    way = F.col("l_orderkey")
    tags = F.map_filter(F.create_map(
        F.lit("highway"), ad.pick(["primary", "residential", "motorway", "steps", "service", "footway", None], way % 7),
        F.lit("oneway"), F.when(way % 4 == 0, "yes").when(way % 4 == 1, "-1"),
        F.lit("access"), F.when(way % 5 == 0, "private"),
        F.lit("service"), F.when(way % 6 == 4, "parking_aisle").when(way % 6 == 5, "alley"),
        *[c for k, v in (more_tags or {}).items() for c in (F.lit(k), v)]),
        lambda k, v: v.isNotNull())
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("seq", "l_partkey"))), lambda x: x["l_partkey"])
    ways = ad.numbered_lines(s, d).groupBy("l_orderkey").agg(nodes.alias("nodes"))
    element = F.struct(F.lit("way").alias("type"), way.alias("id"), "nodes", tags.alias("tags"))
    # a document per partition slice keeps documents small enough to be read in parallel
    docs = ways.select(F.floor(way / 500).alias("doc"), element.alias("e")).groupBy("doc").agg(
        F.collect_list("e").alias("elements")).select("elements")
    docs.write.json(path)
    return path


def osm_ways(s, d) -> DataFrame:
    return src.read_osm_ways(s, osm_documents(s, d), multi_line=False)


@query("s1_osm_split")
def _(s, d):
    # one way in five has "type" among its tags, some as a key, some as a value
    way = F.col("l_orderkey")
    path = osm_documents(s, d, {"type": F.when(way % 5 == 1, "way"), "note": F.when(way % 7 == 2, "type")})
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    return src.read_osm_ways(s, path).select(
        "way_id", F.size("nodes").alias("n_nodes"), F.element_at("nodes", -1).alias("last_node"), tag("highway").alias("highway"),
        tag("type").alias("kind"), tag("note").alias("note"))


QUERIES["s1_osm_ways"] = lambda s, d: osm_ways(s, d).select(
    "way_id", F.size("nodes").alias("n_nodes"), F.try_element_at("tags", F.lit("highway")).alias("highway"))
QUERIES["s2_street_filter"] = lambda s, d: st.tag_columns(
    st.street_filter(osm_ways(s, d)), ["highway", "service"]).select("way_id", "highway", "service")
QUERIES["s3_segmentize"] = lambda s, d: st.segmentize(st.street_filter(osm_ways(s, d)), ad.nodes(s, d)).select(
    *ID, "osmid", "oneway", "length")


@query("g1_tag_counts")
def _(s, d):
    # a third of the ways are sidewalks, with and without a word on cycling
    k = F.col("way_id")
    walk = F.map_filter(F.create_map(
        F.lit("footway"), F.when(k % 3 == 0, "sidewalk"),
        F.lit("bicycle"), F.when(k % 9 == 0, "yes").when(k % 9 == 3, "dismount").when(k % 4 == 1, "no")),
        lambda _, v: v.isNotNull())
    return st.tag_counts(st.census_filter(osm_ways(s, d).withColumn("tags", F.map_concat("tags", walk))))


# --- graph -----------------------------------------------------------------------------------------------------


def origins(s, d) -> DataFrame:
    """The nodes that suppliers start from, up to 200 of them."""
    return ad.table(s, d, "supplier").select((F.col("s_suppkey") % 200 * 2).alias("origin"))


def network(s, d) -> DataFrame:
    edges = ad.graph(s, d)
    return gr.isochrone_network(gr.travel_minutes(edges, 15), ad.graph_nodes(edges))


def reached(s, d) -> DataFrame:
    return gr.isochrone(network(s, d), origins(s, d), 15.0)


def level_components(s, d) -> DataFrame:
    edges = ad.graph(s, d)
    return gr.level_components(gr.level_edges(edges, ad.graph_nodes(edges)))


QUERIES["j16_stress_subgraph"] = lambda s, d: gr.stress_subgraph(
    ad.graph(s, d), ad.graph_nodes(ad.graph(s, d)), 2).select(*ID)
QUERIES["x2_largest_component"] = lambda s, d: gr.largest_of_levels(level_components(s, d))
QUERIES["x2_component_sizes"] = lambda s, d: gr.level_sizes(level_components(s, d))
QUERIES["x3_network"] = lambda s, d: network(s, d).select("level", *ID)
QUERIES["x3_isochrone"] = reached
QUERIES["x3_lowest_level"] = lambda s, d: gr.lowest_level(reached(s, d))
QUERIES["g28_isochrone_counts"] = lambda s, d: gr.isochrone_counts(reached(s, d))
QUERIES["p22_reach_share"] = lambda s, d: gr.reach_share(gr.isochrone_counts(reached(s, d)))
QUERIES["t8_top_origins"] = lambda s, d: gr.top_origins(gr.isochrone_counts(reached(s, d)))


@query("j12_nearest_node")
def _(s, d):
    k = F.col("c_custkey")
    points = ad.table(s, d, "customer").select(
        k.alias("point_id"), (42.29 + k % 97 * 0.001).alias("lat"), (-71.13 + k % 89 * 0.0012).alias("lon"))
    return gr.nearest_node(points, ad.graph_nodes(ad.graph(s, d))).select("point_id", "osmid", "distance")


@query("x4_isochrone_grid")
def _(s, d):
    return gr.isochrone_grid(network(s, d), ad.graph_nodes(ad.graph(s, d)), 4, 6.03, 600.0)


# --- timelines -------------------------------------------------------------------------------------------------
STEP = 1800


@query("p19_local_service_sec")
def _(s, d):
    rows = ad.arrivals(s, d).where(F.col("standard_type").isin(a.STANDARD_TYPES)).withColumn(
        "s_sec", clock.strict_clock_seconds(F.col("scheduled"))).where(F.col("s_sec").isNotNull())
    local = clock.local_service_seconds(F.col("s_sec"), F.col("service_date")).cast("double").alias("local_sec")
    return rows.groupBy("service_date", "s_sec", local).agg(F.count(F.lit(1)).alias("n"))


def timeline(s, d) -> DataFrame:
    return ps.timeline_points(ad.arrivals(s, d), ad.gtfs(s, d))


def trips(s, d) -> DataFrame:
    return ps.trip_timelines(timeline(s, d))


QUERIES["w5_dedupe_fill"] = lambda s, d: ps.observed_points(ad.arrivals(s, d))
QUERIES["w7_monotone_distance"] = lambda s, d: timeline(s, d).select(*ps.TRIP, "time_point_order", "dist_m")


@query("c5_trip_timelines")
def _(s, d):
    """Trips with their stop frames written out: order, stop, metres along the shape, both clocks."""
    def whole(c):
        return F.coalesce(F.round(c).cast("bigint").cast("string"), F.lit("-"))

    frame = lambda f: F.concat_ws(":", f["time_point_order"], f["stop_id"], whole(f["dist_m"]), whole(f["scheduled_sec"]), whole(f["actual_sec"]))
    return trips(s, d).withColumn("frames", F.array_join(F.transform("frames", frame), ","))




@query("c5_timeline_summary")
def _(s, d):
    observed = cut_lineage(ps.observed_points(ad.arrivals(s, d)))
    return ps.timeline_summary(observed, ps.trip_timelines(ps.placed_points(observed, ad.gtfs(s, d))))


QUERIES["t7_navigation_order"] = lambda s, d: ps.navigation_order(trips(s, d)).select(*ps.TRIP, "pos")
QUERIES["g31_trip_lateness"] = lambda s, d: ps.trip_lateness(timeline(s, d))
QUERIES["g30_active_trips_at"] = lambda s, d: ps.active_trips_at(trips(s, d), STEP)


@query("j14_positions_at")
def _(s, d):
    points = timeline(s, d)
    return ps.distances_at(points, ps.trip_timelines(points), STEP)


@query("c7_vehicle_positions")
def _(s, d):
    points = timeline(s, d)
    return ps.positions_at(points, ps.trip_timelines(points), g.shape_distance(ad.gtfs(s, d)["shapes"]), STEP)


@query("c6_route_segments")
def _(s, d):
    feed = ad.gtfs(s, d)
    lines = ps.route_segments(qt.overlay(s, d), feed["trips"], feed["shapes"], feed["stops"])
    micro = lambda c: F.round(c * 1_000_000).cast("bigint").cast("string")
    line = F.transform("coordinates", lambda p: F.concat_ws(" ", micro(p["lon"]), micro(p["lat"])))
    return lines.select("route_id", "direction_id", "stop_id", F.size("coordinates").alias("n_points"), "color",
                        F.array_join(line, ",").alias("line"),
                        F.round(F.col("coordinates")[0]["lon"], 6).alias("first_lon"))
