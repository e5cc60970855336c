"""Hand-computed cases for the street operators."""

import json
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbflow.functions import geo
from kerbflow.operators import graph as gr
from kerbflow.operators import streets as st
from kerbflow.operators import stress
from kerbflow.plans import edge_stress as es
from kerbflow.rules import street_rules as sr
from kerbflow.rules.conditions import compile_condition, tag
from kerbflow.sinks import writers
from kerbflow.sources import streets as src

TAGS = ["highway", "bicycle", "access", "footway", "service", "lanes", "maxspeed", "width", "cycleway", "cycleway:both",
        "cycleway:left", "cycleway:right", "cycleway:right:oneway", "cycleway:right:width", "cycleway:right:separation",
        "cycleway:right:buffer", "parking:both", "parking:left", "parking:right", "lane_markings"]


def edges(spark, *items):
    schema = "u bigint, v bigint, key int, oneway smallint, " + ", ".join(f"`{t}` string" for t in TAGS)
    return spark.createDataFrame(
        [(i, i + 1, 0, e.get("oneway", 0), *[e.get(t) for t in TAGS]) for i, e in enumerate(items)], schema)


@pytest.fixture(scope="module")
def rated(spark):
    df = edges(
        spark,
        {"highway": "residential", "maxspeed": "25 mph", "lanes": "2"},                                      # 0
        {"highway": "residential", "oneway": 1, "bicycle": "no"},                                              # 1
        {"highway": "primary", "cycleway:right": "track", "lanes": "4", "maxspeed": "30 mph"},                # 2
        {"highway": "tertiary", "cycleway:right": "lane", "cycleway:right:width": "6'6\"", "cycleway:right:buffer": "yes",
         "parking:both": "no", "lanes": "2"},                                                                   # 3
        {"highway": "secondary", "cycleway:left": "no", "parking:left": "no"},                                 # 4
        {"highway": "cycleway"},                                                                                # 5
        {"highway": "residential", "cycleway": "separate"},                                                    # 6
        {"highway": "tertiary", "cycleway:right": "lane", "cycleway:right:buffer": "3'"},                      # 7
        {"highway": "secondary_link"},                                                                          # 8
        {"highway": "residential", "oneway": 1, "cycleway:left": "lane"},                                      # 9
    )
    return {r.u: r.asDict() for r in es.edge_stress(df).collect()}


def test_missing_tags_in_conditions(spark):
    df = spark.createDataFrame([("yes",), (None,)], "a string")
    cases = {"eq": tag("a") == "yes", "ne": tag("a") != "yes", "inv": ~(tag("a") == "no"), "absent": tag("zz") != "x"}
    got = df.select(*[compile_condition(c, {"a"}).alias(n) for n, c in cases.items()]).collect()
    assert [tuple(x) for x in got] == [(True, False, True, True), (False, True, True, True)]


def test_rule_skipped_when_column_absent(spark):
    df = edges(spark, {"highway": "primary"})
    rules = [sr.Rule("x1", tag("nothing") != "a", "no"), sr.Rule("x2", tag("highway") == "primary", "maybe")]
    assert st.apply_rules(df, "x", rules, "yes").first().x == "no"
    assert st.apply_rules(df, "x", rules, "yes", present=set(df.columns)).first().x == "maybe"


def test_two_way_residential(rated):
    r = rated[0]
    assert (r["speed"], r["lane_count"], r["centerline"], r["ADT"], r["ADT_rule_num"]) == (25, 2, "no", 1501, "ADT23")
    assert r["bike_allowed_fwd"] and r["bike_allowed_rev"] and (r["LTS_fwd"], r["LTS"]) == (2, 2)
    assert r["parking_left"] == "yes" and r["zoom"] == 14 and r["parse"] == "c212"


def test_access_zero_wins_and_one_way_rule_always_true(rated):
    r = rated[1]
    assert r["LTS"] == 0 and r["LTS_mixed_fwd"] is None and r["bike_lane_rev"] is False and "c55" in r["parse"]
    # a lane on the left of a one-way street serves its direction; the reverse stays shut
    assert rated[9]["bike_lane_fwd"] is True and rated[9]["bike_allowed_rev"] is False


def test_track_is_separated(rated):
    r = rated[2]
    assert r["separation_fwd"] == "true" and r["LTS_separation_fwd"] == 1 and r["LTS_fwd"] == 1
    # four lanes: 8001 vehicles a day, so the second traffic row at 30 mph
    assert r["ADT"] == 8001 and r["LTS_mixed_rev"] == 4 and r["LTS"] == 4


def test_bike_width_buffer_and_reach(rated):
    r = rated[3]
    assert r["bike_width_fwd"] == 6.5 and r["buffer_fwd"] == 2.0 and r["bike_reach_fwd"] == 8.5
    assert r["bike_width_rule_fwd"] == st.NOTE_FEET and r["LTS_bikelane_noparking_fwd"] == 1
    # without a bike width the buffer tag is not used
    assert rated[7]["bike_width_fwd"] == 5.0 and rated[7]["buffer_fwd"] == 0.0


def test_left_side_parking_recorded_forward(rated):
    assert rated[4]["parking_fwd"] == "no" and rated[4]["parking_rev"] == "no"


def test_unspecified_cycleway_moves_to_sides_and_its_own_rules_stay_dead(rated):
    assert rated[6]["cycleway:right"] == "separate" and rated[6]["zoom_rule_num"] == "zoom01"


def test_speed_zero_has_no_table_stress(rated):
    assert rated[8]["speed"] == 0 and rated[8]["LTS"] is None and rated[5]["LTS"] == 1


def test_parking_rule_order(spark):
    df = st.parking(edges(spark, {"parking:both": "lane", "parking:left": "no"}, {"parking:left": "street_side"}))
    got = df.withColumns(st.parking_provenance()).orderBy("u").collect()
    assert (got[0].parking_left, got[0].parking_rule_num_left, got[0].parking_right) == ("no", "parking1", "yes")
    assert (got[1].parking_rule_num_left, got[1].parking_rule_num_right) == ("parking3", "parking_")


def test_fold_order(spark):
    df = edges(spark, {"cycleway": "track", "cycleway:both": "lane", "cycleway:left": "no"}, {"cycleway:both": "lane"})
    got = st.fold_both(df).orderBy("u").collect()
    assert [(x["cycleway:left"], x["cycleway:right"]) for x in got] == [("track", "track"), ("lane", "lane")]
    assert "cycleway" not in got[0].asDict()


def test_lanes_and_widths(spark):
    df = edges(spark, {"lanes": "2; 3"}, {"lanes": "2;3"}, {"lanes": "2.5"}, {}, {"lanes": "1*4"})
    assert [x.lane_count for x in st.lane_count(df).orderBy("u").collect()] == [3, 3, 2, 2, 4]
    texts = spark.createDataFrame([("10'6\"",), ("9",), ("8;10",), ("6'",), ("wide",), (None,)], "w string")
    got = [x[0] for x in texts.select(st.width_feet(F.col("w"))).collect()]
    assert got == [10.5, 29.53, 32.81, 6.0, None, None]


def test_subtables_take_the_lower(spark):
    df = spark.createDataFrame([(4, 0, 30, 3001, True, "yes", 16.0)],
                               "lane_count int, oneway int, speed int, ADT int, bike_lane_fwd boolean, parking_fwd string, bike_reach_fwd double")
    df = df.withColumns({"bike_allowed_fwd": F.lit(False), "bike_allowed_rev": F.lit(False), "bike_lane_rev": F.lit(False),
                         "parking_rev": F.lit("no"), "bike_width_fwd": F.lit(5.0), "bike_width_rev": F.lit(5.0),
                         "bike_reach_rev": F.lit(0.0), "centerline": F.lit("yes"), "street_narrow_wide": F.lit("x")})
    r = stress.table_stress(df).first()
    assert (r.LTS_bikelane_yesparking_3_fwd, r.LTS_bikelane_yesparking_4_fwd, r.LTS_bikelane_yesparking_fwd) == (3, 3, 3)
    assert r.LTS_mixed_4_fwd is None


def test_node_stress(spark):
    nodes = spark.createDataFrame([(1, "traffic_signals"), (2, "stop"), (3, None), (4, None), (5, "stop")], "osmid bigint, highway string")
    edges_ = spark.createDataFrame([(1, 9, 4), (1, 8, 1), (2, 9, 2), (3, 9, 3), (5, 9, None)], "u bigint, v bigint, LTS int")
    got = {x.osmid: x.LTS for x in stress.node_lts(nodes, edges_).collect()}
    assert got == {1: 2, 2: 1, 3: 3, 4: None, 5: 1}
    both = {x.osmid: x.LTS for x in stress.node_lts(nodes.union(spark.createDataFrame([(9, None)], nodes.schema)), edges_, True).collect()}
    assert both[9] == 4


def test_filter_on_a_rated_edge_stays_small(spark):
    df = es.edge_stress(edges(spark, {"highway": "primary"})).where("LTS > 0 AND highway = 'primary' AND parking_fwd = 'yes'")
    assert df.select("u").count() == 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000


@pytest.mark.parametrize("indent", [None, 1])
def test_large_documents_are_split(spark, tmp_path, indent):
    """Element by element, over many small blocks, as the whole documents."""
    def way(i):
        tags = {"a": ['say "type"', 'say "type', "type"][i % 5 % 3], "type": ["way", "type", "}, {"][i % 3], "b": "type", "id": "5", "c": "[{"} if i % 3 else {"highway": "x,"}
        return {"type": "way", "id": i, "nodes": list(range(i % 50)), **({"tags": tags} if i % 4 else {})}

    def relation(i):
        return {"type": "relation", "id": i, "members": [{"type": "way", "ref": k, "role": "type"} for k in range(30)], "tags": {"type": "route"}}

    def node(i):
        return {"type": "node", "id": i, "lat": 42 + i / 1000, "lon": -71.0, **({"tags": {"type": "b", "highway": "stop"}} if i % 5 == 0 else {})}

    for part, lo in enumerate((0, 400, 800)):
        elements = [f(i) for i in range(lo, lo + 200) for f in (node, way, relation, way)]
        (tmp_path / f"{part}.json").write_text(json.dumps({"version": 0.6, "elements": elements}, indent=indent))
    (tmp_path / "none.json").write_text(json.dumps({"version": 0.6, "elements": []}, indent=indent))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = lambda df: Counter(map(repr, df.collect()))
        for read in (src.read_osm_ways, src.read_osm_nodes):
            ordered = lambda m: read(spark, str(tmp_path), m).select("*") if read is src.read_osm_nodes else read(spark, str(tmp_path), m).withColumn(
                "tags", F.array_sort(F.map_entries("tags")))
            want = rows(ordered(True))
            assert rows(ordered(None)) == want and sum(want.values()) == (600 if read is src.read_osm_nodes else 1200)
        assert spark.read.text(str(tmp_path), lineSep='"type"').rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_documents_laid_out_otherwise_are_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"elements": [{"id": 1, "type": "way", "nodes": [1, 2]}]}')
    assert src.read_osm_ways(spark, str(tmp_path), multi_line=True).count() == 1
    with pytest.raises(Exception, match="multi_line=True"):
        src.read_osm_ways(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text("")
    assert src.read_osm_ways(spark, str(tmp_path)).collect() == []


def test_street_filter_and_segments(spark, tmp_path):
    doc = tmp_path / "osm.json"
    doc.write_text("""{"elements": [
      {"type": "way", "id": 1, "nodes": [1, 2, 3], "tags": {"highway": "primary"}},
      {"type": "way", "id": 2, "nodes": [2, 1], "tags": {"highway": "primary", "oneway": "-1"}},
      {"type": "way", "id": 3, "nodes": [1, 2], "tags": {"highway": "motorway_link"}},
      {"type": "way", "id": 4, "nodes": [1, 2], "tags": {"highway": "service", "service": "parking_aisle"}},
      {"type": "node", "id": 1, "lat": 42.0, "lon": -71.0}, {"type": "node", "id": 2, "lat": 42.001, "lon": -71.0},
      {"type": "node", "id": 3, "lat": 42.002, "lon": -71.0}]}""")
    ways = st.street_filter(src.read_osm_ways(spark, str(doc)))
    assert sorted(x.way_id for x in ways.collect()) == [1, 2]
    segs = st.segmentize(ways, src.read_osm_nodes(spark, str(doc)))
    assert sorted((x.u, x.v, x.key, x.osmid, x.oneway) for x in segs.collect()) == [
        (1, 2, 0, 1, 0), (1, 2, 1, 2, 1), (2, 1, 0, 1, 0), (2, 3, 0, 1, 0), (3, 2, 0, 1, 0)]
    assert segs.first().length == pytest.approx(111.2, abs=0.1)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 340)]
    links = spark.createDataFrame(path + star, "u bigint, v bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(100, 161), 7, *range(300, 340), 999]], "osmid bigint")
    sizes = {x.component: x.n_nodes for x in gr.component_sizes(gr.components(nodes, links)).collect()}
    assert sizes == {100: 61, 7: 41, 999: 1}
    assert gr.largest_component(nodes, links).count() == 61


def test_isochrone_levels(spark):
    roads = spark.createDataFrame([(0, 1, 500.0, 1), (1, 2, 500.0, 2), (0, 2, 3000.0, 1), (2, 3, 9000.0, 1), (0, 4, 1.0, 0)],
                                  "u bigint, v bigint, length double, LTS int")
    reach = gr.isochrone(gr.level_edges(gr.travel_minutes(roads, 15)), spark.createDataFrame([(0,)], "origin bigint"), 15.0)
    got = {(x.level, x.node): x.minutes for x in reach.collect()}
    assert got[(1, 2)] == 12.0 and got[(2, 2)] == 4.0 and (4, 3) not in got and (4, 4) not in got
    assert gr.isochrone_counts(reach).first().lts1 == 3


def test_nearest_against_brute_force(spark):
    nodes = [(i, -71 + (i * 37 % 101) * 0.003, 42 + (i * 53 % 97) * 0.004) for i in range(150)]
    points = [(i, 42 + i * 0.05, -71.2 + i * 0.04) for i in range(12)]
    got = gr.nearest_node(spark.createDataFrame(points, "point_id int, lat double, lon double"),
                          spark.createDataFrame(nodes, "osmid int, x double, y double"))
    from math import asin, cos, radians, sin, sqrt

    def far(p, n):
        h = sin(radians(n[2] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(n[2])) * sin(radians(n[1] - p[2]) / 2) ** 2
        return 2 * 6371000 * asin(sqrt(h))

    want = {p[0]: min(far(p, n) for n in nodes) for p in points}
    assert {x.point_id: x.distance for x in got.collect()} == pytest.approx(want)


def test_nearest_of_equal_distances_is_the_smallest_id(spark):
    """Two nodes as far north as south of a point are a tie, though the last bits of their distances differ."""
    points, nodes = [], []
    for k in range(40):
        lon = -71.1 + k * 0.3
        points.append((k, 42.29 + (11 + 2 * k) * 0.001, lon))
        nodes += [(2 * k, lon, 42.3 + k * 0.002), (2 * k + 1, lon, 42.3 + (k + 1) * 0.002)]
    places, asked = spark.createDataFrame(nodes, "osmid int, x double, y double"), spark.createDataFrame(points, "point_id int, lat double, lon double")
    turned = places.withColumn("osmid", F.col("osmid").bitwiseXOR(F.lit(1)))
    for df in (places, turned):  # whichever side the smaller id is on
        assert {x.point_id: x.osmid for x in gr.nearest_node(asked, df).collect()} == {k: 2 * k for k in range(40)}


def test_nearest_compares_few_pairs(spark, monkeypatch):
    """Points inside a dense town and far from it meet a few of its nodes, not all."""
    seen, real = spark.sparkContext.accumulator(0), geo.haversine_m

    @F.pandas_udf("double")
    def counted(d: pd.Series) -> pd.Series:
        seen.add(len(d))
        return d

    monkeypatch.setattr(geo, "haversine_m", lambda *a: counted(real(*a)))
    nodes = spark.range(3000).select(F.col("id").alias("osmid"), (42.3 + F.col("id") * 37 % 3000 * 3e-7).alias("y"),
                                     (-71.1 + F.col("id") * 53 % 2999 * 3e-7).alias("x"))
    n = F.col("id")
    points = spark.range(400).select(n.alias("point_id"), (42.3 + n % 20 * F.when(n < 200, 4e-5).otherwise(0.03)).alias("lat"),
                                     (-71.1 + F.floor(n / 20) * F.when(n < 200, 9e-5).otherwise(0.02)).alias("lon"))
    assert len(gr.nearest_node(points, nodes).collect()) == 400
    assert seen.value < 20 * 400


def test_nearest_over_many_blocks(spark):
    """Blocks of 32 nodes and points dealt to several tasks give what comparing all pairs gives, also across longitude 180."""
    rng = np.random.default_rng(5)
    town = np.stack([42.3 + rng.random(400) * 0.01, -71.1 + rng.random(400) * 0.01], axis=1)
    world = np.stack([rng.random(400) * 180 - 90, rng.random(400) * 360 - 180], axis=1)
    edge = np.stack([rng.random(100) * 2, 180 - rng.random(100) * 0.5], axis=1)
    targets = np.concatenate([town, world, edge, town[:50]]).tolist()
    asked = np.concatenate([town[::4] + 0.0003, rng.random((200, 2)) * 0.03 + [42.29, -71.11], world[::4] * 0.99,
                            edge[::4] * [1, -1], [[90.0, 0.0], [-90.0, 5.0]], town[:3]]).tolist()
    points = [(i, *p) for i, p in enumerate(asked)]
    odd = [(-1, None, 1.0), (-2, 1.0, None), (-3, float("nan"), 1.0)]
    got = geo.nearest_of_all(
        spark.createDataFrame(points + points[:9] + odd, "point_id int, lat double, lon double"),
        spark.createDataFrame([(i, *p) for i, p in enumerate(targets)] + odd, "osmid int, t_lat double, t_lon double"),
        ["point_id"], ["osmid"], ["osmid"], block_bits=5)
    la, lo = np.radians(np.array(targets)).T
    want = {}
    for i, lat, lon in points:
        a, b = np.radians(lat), np.radians(lon)
        h = np.sin((la - a) / 2) ** 2 + np.cos(a) * np.cos(la) * np.sin((lo - b) / 2) ** 2
        d = 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        k = int(np.flatnonzero(np.round(d, 6) == np.round(d, 6).min())[0])
        want[i] = (k, round(float(d[k]), 5))
    rows = got.collect()
    assert len(rows) == len(points)
    assert {x.point_id: (x.osmid, round(x.distance, 5)) for x in rows} == want
    nothing = spark.createDataFrame([], "osmid int, t_lat double, t_lon double")
    assert geo.nearest_of_all(got.select("point_id", "lat", "lon"), nothing, ["point_id"], ["osmid"], ["osmid"]).count() == 0


def test_only_largest_part_of_each_level(spark):
    roads = spark.createDataFrame([(1, 2, 100.0, 1), (2, 3, 100.0, 1), (8, 9, 100.0, 1), (3, 8, 100.0, 3)],
                                  "u bigint, v bigint, length double, LTS int")
    got = gr.level_edges(roads, only_largest=True).groupBy("level").count().collect()
    assert {x.level: x["count"] for x in got} == {1: 2, 2: 2, 3: 4, 4: 4}


def test_more_rules_than_one_mask_holds(spark):
    """Rules beyond the first mask decide, are named and are counted like the others."""
    never = [sr.LaneRule(f"n{i}", tag("highway") == f"none{i}", {}) for i in range(68)]
    rules = [*never[:66], sr.LaneRule("late", tag("highway") == "primary", {"bike_lane_fwd": True}, 2), *never[66:]]
    target = next(t for t in sr.LANE_TARGETS if t.startswith("bike_lane"))
    rules[66] = sr.LaneRule("late", tag("highway") == "primary", {target: True}, 2)
    df = edges(spark, {"highway": "primary"}, {"highway": "residential"}, {"highway": "none3"})
    got = {r.u: r for r in st.parse_directions(df, rules).select("u", target, "LTS_bike_access_fwd", st.parse_text(rules).alias("ids")).collect()}
    assert (got[0][target], got[0].LTS_bike_access_fwd, got[0].ids) == (True, 2, "late")
    assert (got[1][target], got[1].ids, got[2].ids) == (None, "", "n3")
    assert [tuple(r) for r in st.parse_hits(df, rules).select("rule_id", "target", "n").collect()] == [("late", target, 1)]


def test_photos_are_numbered_by_file_and_position(spark, tmp_path):
    """A larger file that Spark reads first does not change the numbers."""
    entry = '{{"SourceFile": "/p/{0}.jpg", "GPSLatitude": 1.0, "GPSLongitude": 2.0, "CreateDate": "2024"}}\n'
    (tmp_path / "a.json").write_text("".join(entry.format(f"a{i}") for i in range(2)))
    (tmp_path / "b.json").write_text("".join(entry.format(f"b{i}") for i in range(200)))
    got = src.photo_points(src.read_photo_meta(spark, str(tmp_path), multi_line=False)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(202))
    assert [r.filename for r in got] == ["a0.jpg", "a1.jpg", *[f"b{i}.jpg" for i in range(200)]]


def test_origin_counts_only_where_its_level_has_it(spark):
    roads = spark.createDataFrame([(3, 1, 2, 1.0), (4, 1, 2, 1.0)], "level int, u bigint, v bigint, minutes double")
    counts = gr.isochrone_counts(gr.isochrone(roads, spark.createDataFrame([(1,)], "origin bigint"), 5.0)).first()
    assert (counts.lts1, counts.lts2, counts.lts3, counts.lts4) == (0, 0, 2, 2)


def test_line_geometry_both_ways(spark):
    df = spark.createDataFrame([("LINESTRING (-71.5 42.25, -71.25 42.5)",), ("LINESTRING (1 2)",)], "w string")
    points = src.parse_wkt_line(F.col("w"))
    assert [[tuple(p) for p in r[0]] for r in df.select(points).collect()] == [[(-71.5, 42.25), (-71.25, 42.5)], [(1.0, 2.0)]]
    assert df.select(src.wkt_line(points)).first()[0] == "LINESTRING (-71.5 42.25, -71.25 42.5)"


def union_find(links):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        above[y] = x
    return {x: root(x) for x in above}


def test_components_by_contraction(spark):
    """A giant star, a path, a ring, a clique and random links, contracted to the end or finished in one task; ids of two parts."""
    import random

    rng = random.Random(4)
    links = [(5000, i) for i in range(2000)] + [(i, i + 1) for i in range(6000, 6300)] + [(7000 + i, 7000 + (i + 1) % 50) for i in range(50)]
    links += [(8000 + i, 8000 + j) for i in range(12) for j in range(i)] + [(rng.randrange(9000, 9400), rng.randrange(9000, 9400)) for _ in range(220)]
    links += [(3, 3), (6000, 6001)]
    frame = spark.createDataFrame(links, "u bigint, v bigint").repartition(5)
    nodes = spark.createDataFrame([(x,) for x in {x for e in links for x in e} | {1, 99_999}], "osmid bigint")
    expected = {n.osmid: n.osmid for n in nodes.collect()} | union_find(links)
    for rest in (0, 100, gr.REST):
        got = gr.components(nodes, frame, rest).collect()
        assert {x.osmid: x.component for x in got} == expected and len(got) == len(expected)
    levels = frame.withColumn("level", F.explode(F.array(F.lit(1), F.lit(2)))).where("level = 2 OR u < 9000")
    got = {(x.level, x.osmid): x.component for x in gr.level_components(levels).collect()}
    assert got == {(2, k): v for k, v in union_find(links).items()} | {
        (1, k): v for k, v in union_find([e for e in links if e[0] < 9000]).items()}
    assert gr.components(nodes, frame.limit(0)).where("osmid <> component").isEmpty()


def dijkstra(roads, origin, budget):
    import heapq

    out, heap = {}, [(0.0, origin)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in out:
            out[x] = d
            for u, v, m in roads:
                if u == x and d + m <= budget:
                    heapq.heappush(heap, (d + m, v))
    return out


def test_isochrones_over_chains(spark):
    """Chains both ways and one-way, rings, loops at one crossing, dead ends, origins inside chains; against Dijkstra."""
    import random

    rng = random.Random(9)
    for seed in range(2):
        roads = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(2, 9))) for _ in range(18)]
        spare = 100
        for a, b, n, back in ((0, 1, 9, True), (2, 3, 5, False), (4, 4, 6, True), (5, 6, 1, True), (7, 99, 4, True)):
            path = [a, *range(spare, spare + n), b]
            spare += n
            for x, y in zip(path, path[1:]):
                roads.append((x, y, 1.0 + rng.randrange(3)))
                if back:
                    roads.append((y, x, 1.0 + rng.randrange(3)))
        roads += [(300, 301, 1.0), (301, 302, 1.0), (302, 300, 1.0)]
        origins = [0, 2, 7, 103, 300, 12345]
        frame = spark.createDataFrame([(4, u, v, m) for u, v, m in roads], "level int, u bigint, v bigint, minutes double")
        got = gr.isochrone(frame, spark.createDataFrame([(o,) for o in origins], "origin bigint"), 14.0).collect()
        ends = {x for u, v, _ in roads for x in (u, v)}
        want = {(o, n): d for o in origins if o in ends for n, d in dijkstra([r for r in roads if r[0] != r[1]], o, 14.0).items()}
        assert {(x.origin, x.node): x.minutes for x in got} == want and len(got) == len(want), seed
    short, within = gr.contracted(frame.groupBy("level", "u", "v").agg(F.min("minutes").alias("minutes")).where("u <> v"),
                                  spark.createDataFrame([(0,)], "origin bigint"))
    assert short.where("u BETWEEN 100 AND 112 OR v BETWEEN 100 AND 112").isEmpty() and within.where("node = 104").count() == 2


def test_network_keeps_the_largest_part_and_calm_nodes(spark):
    roads = [(1, 2, 1), (2, 3, 1), (3, 4, 2), (4, 5, 1), (5, 6, 1), (6, 7, 1), (20, 21, 1), (21, 22, 1), (2, 9, 0), (9, 8, 1)]
    edges_ = spark.createDataFrame([(u, v, k, 100.0, lts) for k, (u, v, lts) in enumerate(roads)], "u bigint, v bigint, key int, length double, LTS int")
    nodes = spark.createDataFrame([(6, 2), (1, 0), (7, 1)], "osmid bigint, LTS int")
    got = {(x.level, x.u, x.v) for x in gr.isochrone_network(edges_, nodes).collect()}
    # level 1: 1 (unrated) and 6 go; {2, 3} and {4, 5} and {8, 9} tie, the smallest id wins; the piece from 20 left with the base
    assert got == {(1, 2, 3)} | {(k, u, v) for k in (2, 3, 4) for u, v, lts in roads if lts and u < 9 and u != 1}


def test_features_are_written_packed(spark, tmp_path):
    features = spark.range(3000).select(F.col("id").alias("osmid"), F.lit("residential").alias("highway"), (F.col("id") % 4 + 1).cast("int").alias("LTS"))
    table = writers.feature_table(features)
    writers.write_geojson(table, str(tmp_path / "features"))
    files = list((tmp_path / "features").glob("part-*"))
    assert all(f.name.endswith(".gz") for f in files)
    plain = writers.to_geojson(table)
    assert sum(f.stat().st_size for f in files) * 10 < plain.agg(F.sum(F.octet_length("value"))).first()[0]
    assert sorted(spark.read.text(str(tmp_path / "features")).collect()) == sorted(plain.collect())


def test_a_step_passes_by_the_rows_it_does_not_meet(spark, tmp_path):
    keys = ["level", "origin", "node"]
    rows = [(1, 0, n, float(n % 7 + k)) for n in range(300) for k in range(2)]
    schema = "level int, origin bigint, node bigint, minutes double"
    spark.createDataFrame(rows, schema).write.bucketBy(4, *keys).option("path", str(tmp_path / "state")).saveAsTable("step_state")
    try:
        table = spark.table("step_state")
        step = spark.createDataFrame([(1, 0, 7, 0.0), (1, 0, 8, 0.5), (1, 0, 9, 2.5), (1, 0, 999, 4.0), (2, 0, 8, 9.0)], schema)
        found = gr.improving(step, table, keys)
        assert {(r.level, r.node) for r in found.collect()} == {(1, 8), (1, 999), (2, 8)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        state = plan[plan.index("ShuffledHashJoin"):plan.index("step_state")]
        assert not any(step in state for step in ("Aggregate", "Sort ", "hashpartitioning"))
    finally:
        spark.sql("DROP TABLE step_state")
