"""Oracle SQL for the street, graph and timeline queries.

Rule sets are rendered to DuckDB SQL arm by arm, without the shared masks and lookups of the Spark side.
"""

from __future__ import annotations

from kerbflow.checks.oracle_transit import HMS, ORACLE, add
from kerbflow.checks.sql import cte
from kerbflow.rules import street_rules as sr
from kerbflow.rules.conditions import All, Any, Condition, Not, describe
from kerbflow.rules.stress_tables import SPEED_BANDS, TABLES

COLUMNS = {"highway", "oneway", "lanes", "maxspeed", "cycleway:right", "cycleway:left", "bicycle", "parking:both",
           "parking:right", "parking:left", "width", "cycleway:right:width", "cycleway:right:separation", "lane_count",
           "centerline", "street_narrow_wide", "LTS"}


def lit(v: object) -> str:
    return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def cond(c: Condition, known: set[str] = COLUMNS) -> str:
    if isinstance(c, Not):
        return f"NOT {cond(c.part, known)}"
    if isinstance(c, (All, Any)):
        return "(" + (" AND " if isinstance(c, All) else " OR ").join(cond(p, known) for p in c.parts) + ")"
    if c.column not in known:
        return "false"
    if c.op == "in":
        return "(" + " OR ".join(f'"{c.column}" IS NOT DISTINCT FROM {lit(v)}' for v in c.values) + ")"
    return f'coalesce("{c.column}" {c.op} {lit(c.values[0])}, false)'


def first(rules, pick, default, known: set[str] = COLUMNS) -> str:
    arms = " ".join(f"WHEN {cond(r.condition, known)} THEN {lit(pick(r))}" for r in rules)
    return f"CASE {arms} ELSE {lit(default)} END"


def case_of(index: str, values: list) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values) if v is not None) + " END"


HIGHWAYS = ["primary", "secondary", "tertiary", "residential", "service", "cycleway", "footway", "trunk", "unclassified",
            "living_street", "secondary_link", "pedestrian"]
LANE = ["lane", "track", "no", "separate", "shared_lane", None]
cte("edges", f"""
SELECT l_partkey AS u, l_partkey + l_suppkey + 1 AS v,
       row_number() OVER (PARTITION BY l_partkey, l_partkey + l_suppkey + 1 ORDER BY l_orderkey, l_linenumber, l_partkey,
                          l_suppkey, l_quantity, l_extendedprice) - 1 AS key,
       l_orderkey AS osmid, {case_of('l_partkey % 12', HIGHWAYS)} AS highway,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS oneway,
       CASE WHEN l_linenumber = 6 THEN '1; 2' WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS VARCHAR) END AS lanes,
       {case_of('q % 5', [None, '25 mph', '30 mph', '40 mph', 'signals'])} AS maxspeed,
       {case_of('l_suppkey % 6', LANE)} AS "cycleway:right", {case_of('l_suppkey // 6 % 6', LANE)} AS "cycleway:left",
       CASE WHEN l_suppkey % 17 = 0 THEN 'lane' END AS "cycleway:both",
       {case_of('l_partkey % 9', ['yes', 'designated', 'no', 'dismount'])} AS bicycle,
       {case_of('d', ['no', 'lane', 'street_side'])} AS "parking:both", {case_of('t', ['no', 'lane'])} AS "parking:right",
       {case_of('q % 7', ["12'6" + chr(34), '9', '8;10'])} AS width,
       {case_of('q % 4', ['1.5', "6'"])} AS "cycleway:right:width",
       {case_of('l_partkey % 8', ['flex_post', 'kerb', 'bump'])} AS "cycleway:right:separation",
       l_extendedprice / 100 AS length
FROM (SELECT *, CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t
      FROM lineitem)""")
park = {s: sr.parking_rules(s) for s in ("left", "right")}
RAW = COLUMNS - {"parking:left"}
cte("parked", "SELECT *, " + ", ".join(
    f"{first(rules, lambda r: r.value, 'yes', RAW)} AS parking_{s}, {first(rules, lambda r: r.rule_id, 'parking_', RAW)} AS parking_rule_num_{s}, "
    f"{first(rules, lambda r: r.message, 'Assumed', RAW)} AS parking_rule_{s}" for s, rules in park.items()) + " FROM edges")
cte("folded", """
SELECT * EXCLUDE ("cycleway:both", "parking:both", "cycleway:left", "cycleway:right", "parking:right"),
       coalesce("cycleway:both", "cycleway:left") AS "cycleway:left", coalesce("cycleway:both", "cycleway:right") AS "cycleway:right",
       "parking:both" AS "parking:left", coalesce("parking:both", "parking:right") AS "parking:right",
       CASE WHEN parking_left = 'yes' THEN 8.5::DOUBLE ELSE 0 END AS parking_width_left,
       CASE WHEN parking_right = 'yes' THEN 8.5::DOUBLE ELSE 0 END AS parking_width_right FROM parked""")
SOURCES = {"parking_left", "parking_right", "parking_width_left", "parking_width_right", "cycleway:right:width",
           "cycleway:right:separation"}


def lane_value(target: str, value: object) -> str:
    if isinstance(value, sr.Source):
        return f'"{value.column}"' if value.column in SOURCES else "NULL"
    return lit(str(value).lower()) if target.startswith("separation") else str(value).lower()


lanes = sr.lane_rules()
targets = ", ".join(
    "coalesce(" + ", ".join(f"CASE WHEN {r.rule_id} THEN {lane_value(t, r.sets[t])} END" for r in lanes if t in r.sets) + f") AS {t}"
    for t in sr.LANE_TARGETS)
access = "coalesce(" + ", ".join(f"CASE WHEN {r.rule_id} THEN {r.lts} END" for r in lanes if r.lts is not None) + ")"
cte("marked", "SELECT *, " + ", ".join(f"{cond(r.condition)} AS {r.rule_id}" for r in lanes) + " FROM folded")
cte("parsed", f"SELECT * EXCLUDE ({', '.join(r.rule_id for r in lanes)}), {targets}, {access} AS LTS_bike_access_fwd, {access} AS LTS_bike_access_rev, "
    "concat_ws(',', " + ", ".join(f"CASE WHEN {r.rule_id} THEN '{r.rule_id}' END" for r in lanes) + ") AS parse FROM marked")


def feet(x: str) -> str:
    return (f"CASE WHEN contains({x}, '''') THEN CAST(regexp_extract({x}, '^\"*(\\d+)''(\\d*)\"*$', 1) AS DOUBLE) + "
            f"coalesce(TRY_CAST(regexp_extract({x}, '^\"*(\\d+)''(\\d*)\"*$', 2) AS DOUBLE), 0) / 12 "
            f"ELSE round_even(list_max(list_transform(string_split({x}, ';'), lambda w: CAST(w AS DOUBLE))) * 3.28084::DOUBLE, 2) END")


def note(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'No Width' WHEN contains({x}, '''') THEN 'Converted ft-in to decimal feet' "
            "ELSE 'Converted to feet' END")


speed = sr.speed_rules()
cte("sped", f"""
SELECT *, CASE WHEN signed THEN CAST(split_part(maxspeed, ' ', 1) AS INT) ELSE {first(speed, lambda r: r.value, 0)} END AS speed,
       CASE WHEN signed THEN 'speed_' ELSE {first(speed, lambda r: r.rule_id, 'speed_')} END AS speed_rule_num,
       CASE WHEN lanes IS NULL THEN 2 WHEN lanes = '1; 2' THEN 2 ELSE CAST(lanes AS INT) END AS lane_count,
       {first(sr.centerline_rules(), lambda r: r.value, 'yes')} AS centerline,
       {first(sr.centerline_rules(), lambda r: r.rule_id, 'centerline_')} AS centerline_rule_num
FROM (SELECT *, coalesce(maxspeed <> 'signals', false) AS signed FROM parsed)""")
cte("wide0", "SELECT * EXCLUDE (bike_width_fwd, bike_width_rev, buffer_fwd, buffer_rev), "
    f"{feet('width')} AS width_street, {note('width')} AS width_street_rule, " + ", ".join(f"""
    CASE WHEN bike_width_{w} IS NULL THEN 5.0::DOUBLE ELSE {feet(f'bike_width_{w}')} END AS bike_width_{w},
    CASE WHEN bike_width_{w} IS NULL THEN 'Assumed' ELSE {note(f'bike_width_{w}')} END AS bike_width_rule_{w},
    CASE WHEN bike_width_{w} IS NULL THEN 0.0::DOUBLE END AS buffer_{w}""" for w in ("fwd", "rev")) + " FROM sped")
cte("wide", """
SELECT *, bike_width_fwd + coalesce(parking_width_fwd, 0) + coalesce(buffer_fwd, 0) AS bike_reach_fwd,
       bike_width_rev + coalesce(parking_width_rev, 0) + coalesce(buffer_rev, 0) AS bike_reach_rev,
       CASE WHEN oneway <> 1 THEN 'not oneway'
            WHEN (width_street < 30 AND parking_fwd = 'yes' AND parking_rev = 'yes') OR (width_street < 22 AND parking_fwd = 'yes')
              OR (width_street < 22 AND parking_rev = 'yes') OR (width_street < 15 AND parking_fwd = 'no' AND parking_rev = 'no')
            THEN 'narrow' ELSE 'wide' END AS street_narrow_wide FROM wide0""")
cte("adt", f"""
SELECT *, {first(sr.adt_rules(), lambda r: r.value, 1500)} AS ADT, {first(sr.adt_rules(), lambda r: r.rule_id, 'ADT_')} AS ADT_rule_num,
       CASE WHEN separation_fwd IN ('true', 'yes', 'kerb', 'bump') THEN 1 WHEN separation_fwd = 'flex_post' THEN 2 END AS LTS_separation_fwd,
       CASE WHEN separation_rev IN ('true', 'yes', 'kerb', 'bump') THEN 1 WHEN separation_rev = 'flex_post' THEN 2 END AS LTS_separation_rev
FROM wide""")
LOWS = [0.0, *SPEED_BANDS[:-1]]
cells, names, hits = [], {"fwd": [], "rev": []}, []
for table in TABLES:
    for part in table.parts:
        for way in ("fwd", "rev"):
            need = " AND ".join(f"coalesce({n.format(way=way)} = {str(v).lower() if isinstance(v, bool) else lit(v)}, false)"
                                for n, v in table.needs)
            column = table.bucket_column.format(way=way)
            arms = []
            for b, ((lo, hi), levels) in enumerate(zip(part.buckets, part.levels), 1):
                inside = f"{column} >= {lo}" + ("" if hi is None else f" AND {column} < {hi}")
                for k, level in enumerate(levels):
                    arms.append(f"WHEN {inside} AND speed > {LOWS[k]} AND speed < {SPEED_BANDS[k]} THEN {level}")
            where = [f"{column} >= {lo}" + ("" if hi is None else f" AND {column} < {hi}") for lo, hi in part.buckets]
            bucket = "CASE " + " ".join(f"WHEN {w} THEN {b}" for b, w in enumerate(where)) + " END"
            hits += [(part.name, way, i, bucket, f"{cond(c)} AND {need}") for i, c in enumerate(part.conditions, 1)]
            layout = " OR ".join(cond(c) for c in part.conditions)
            cells.append(f"CASE WHEN ({layout}) AND {need} THEN CASE {' '.join(arms)} END END AS LTS_{part.name}_{way}")
            names[way].append(f"LTS_{part.name}_{way}")
cte("tabled", f"SELECT *, {', '.join(cells)} FROM adt")
cte("rated", f"""
SELECT *, greatest(LTS_fwd, LTS_rev) AS LTS FROM (
  SELECT *, least(LTS_bike_access_fwd, LTS_separation_fwd, {', '.join(names['fwd'])}) AS LTS_fwd,
         least(LTS_bike_access_rev, LTS_separation_rev, {', '.join(names['rev'])}) AS LTS_rev FROM tabled)""")
ZOOMED = first(sr.zoom_rules(), lambda r: r.value, 16)
cte("nodes", """
SELECT p_partkey AS osmid, CAST(-71.12 + p_partkey % 41 * 0.002 AS DOUBLE) AS x, CAST(42.30 + p_partkey % 37 * 0.002 AS DOUBLE) AS y,
       CASE p_size % 5 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'stop' END AS highway FROM part""")
cte("node_max", "SELECT u AS osmid, coalesce(max(LTS), 0) AS top FROM rated GROUP BY ALL")
cte("node_rated", """
SELECT n.*, CASE WHEN top > 2 AND highway = 'traffic_signals' THEN 2 WHEN top <= 2 AND highway IN ('traffic_signals', 'stop') THEN 1 ELSE top END AS LTS,
       CASE WHEN top IS NULL THEN 'Node not found in edges' WHEN top > 2 AND highway = 'traffic_signals' THEN 'LTS 3-4 with traffic signals'
            WHEN top <= 2 AND highway IN ('traffic_signals', 'stop') THEN 'LTS 1-2 with traffic signals or stop'
            ELSE 'Node LTS is max intersecting LTS' END AS message
FROM nodes n LEFT JOIN node_max USING (osmid)""")
ID = "u, v, key"

add("r1_parking_rules", f"SELECT {ID}, parking_left, parking_right, parking_rule_num_left, parking_rule_num_right, parking_rule_left, parking_rule_right FROM parked")
add("p1_fold_both", f"""SELECT {ID}, "cycleway:left", "cycleway:right", "parking:left", "parking:right" FROM folded""")
add("p2_implicit_both", """
SELECT u, v, key, coalesce(lanes, "cycleway:both", "cycleway:left") AS "cycleway:left", coalesce(lanes, "cycleway:both", "cycleway:right") AS "cycleway:right" FROM edges""")
add("p3_suffix_merge", """
SELECT u, v, key, coalesce("cycleway:right:width", width) AS "cycleway:right:width", maxspeed AS "cycleway:left:buffer" FROM edges""")
add("p9_parking_width", f"SELECT {ID}, parking_width_left, parking_width_right FROM folded")
add("r3_parse_directions", f"SELECT {ID}, {', '.join(sr.LANE_TARGETS)}, LTS_bike_access_fwd, LTS_bike_access_rev, parse FROM parsed")
add("r4_conditions", f"""
SELECT count(*) FILTER (bicycle IS DISTINCT FROM 'yes') AS not_yes, count(*) FILTER (bicycle = 'yes') AS is_yes,
       count(*) FILTER (NOT coalesce(bicycle = 'no' OR highway = 'primary', false)) AS neither,
       count(*) FILTER (coalesce(lanes >= '3', false)) AS wide FROM edges""")
add("r5_label_filters", """
SELECT CASE WHEN "cycleway:right" = 'lane' AND oneway = 1 THEN 'right_lane' WHEN bicycle IS DISTINCT FROM 'no' AND highway = 'primary' THEN 'primary_ok' END AS filter_label,
       count(*) AS n FROM edges WHERE ("cycleway:right" = 'lane' AND oneway = 1) OR (bicycle IS DISTINCT FROM 'no' AND highway = 'primary') GROUP BY ALL""")
add("g11_parse_hits", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CASE " + " ".join(f"WHEN {r.rule_id} AND {lane_value(t, r.sets[t])} IS NOT NULL THEN '{r.rule_id}'" for r in lanes if t in r.sets)
    + f" END AS rule_id, '{t}' AS target, count(*) AS n FROM marked GROUP BY ALL" for t in sr.LANE_TARGETS) + ") WHERE rule_id IS NOT NULL")
add("p4_prevailing_speed", f"SELECT {ID}, speed, speed_rule_num FROM sped")
add("p5_lane_count", f"SELECT {ID}, lane_count, CASE WHEN lanes IS NULL THEN 'Assumed' ELSE 'OSM' END AS lane_rule FROM sped")
add("p6_width_feet", f"SELECT width, {feet('width')} AS ft, {note('width')} AS note, count(*) AS n FROM edges GROUP BY ALL")
WIDTHS = "bike_width_fwd, bike_width_rev, bike_width_rule_fwd, bike_width_rule_rev, buffer_fwd, buffer_rev, bike_reach_fwd, bike_reach_rev"
add("p7_widths", f"SELECT {ID}, width_street, width_street_rule, {WIDTHS} FROM wide")
add("p8_narrow_wide", f"SELECT {ID}, street_narrow_wide FROM wide")
add("r2_symmetric_rules", f"SELECT {ID}, centerline, centerline_rule_num, ADT, ADT_rule_num FROM adt")
add("p10_separation_lts", f"SELECT {ID}, LTS_separation_fwd, LTS_separation_rev FROM adt")
add("x1_table_stress", f"SELECT {ID}, {', '.join(names['fwd'] + names['rev'])} FROM tabled")
add("j2_lookup_lts", f"SELECT {ID}, " + ", ".join(
    f"least({', '.join(f'LTS_{p.name}_{w}' for p in t.parts)}) AS LTS_{t.name}_{w}" for t in TABLES for w in ("fwd", "rev")) + " FROM tabled")
add("g3_combine_lts", f"SELECT {ID}, LTS_fwd, LTS_rev, LTS FROM rated")
add("x5_edge_stress", f"""
SELECT {ID}, LTS_fwd, LTS_rev, LTS, speed, lane_count, centerline, ADT, street_narrow_wide, width_street, bike_reach_fwd, bike_reach_rev,
       parking_fwd, parking_rev, bike_lane_fwd, bike_lane_rev, separation_fwd, separation_rev, speed_rule_num, ADT_rule_num,
       centerline_rule_num, {ZOOMED} AS zoom, parse FROM rated""")
add("g2_node_lts", "SELECT * FROM node_rated")
add("j1_out_edges", "SELECT n.osmid, count(e.u) AS n_edges, max(e.LTS) AS worst FROM nodes n LEFT JOIN rated e ON e.u = n.osmid GROUP BY ALL")
add("p11_stress_color", """
SELECT LTS, CASE LTS WHEN 1 THEN 'green' WHEN 2 THEN 'deepskyblue' WHEN 3 THEN 'orange' WHEN 4 THEN 'red' ELSE 'grey' END AS color,
       count(*) AS n FROM rated GROUP BY ALL""")
add("p12_travel_minutes", "SELECT u, v, key, length / 250 AS minutes FROM edges")
add("g10_value_counts", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM adt GROUP BY ALL"
    for c in ["bike_allowed_fwd", "bike_allowed_rev", "centerline", "lane_count", "oneway", "street_narrow_wide", "bike_lane_fwd",
              "bike_lane_rev", "parking_fwd", "parking_rev", "ADT"]) + ")")
BAND = "CASE " + " ".join(f"WHEN speed > {lo} AND speed < {hi} THEN {k}" for k, (lo, hi) in enumerate(zip(LOWS, SPEED_BANDS), 1)) + " END"
by_hit = ", ".join(
    f"CASE WHEN {c} AND ({bucket}) IS NOT NULL AND band IS NOT NULL THEN {{'sub_table': '{n}', 'way': '{w}', 'condition': {i}, 'bucket': {bucket}, 'band': band}} END"
    for n, w, i, bucket, c in hits)
add("g12_table_hits", f"""
SELECT h.sub_table AS sub_table, h.way AS way, h.condition AS condition, h.bucket AS bucket, h.band AS band, count(*) AS n
FROM (SELECT unnest([{by_hit}]) AS h FROM (SELECT *, {BAND} AS band FROM adt)) WHERE h IS NOT NULL GROUP BY ALL""")
add("u1_union_regions", """
SELECT 'north' AS region, highway, count(*) AS n, count(width) AS with_width FROM edges WHERE u % 2 = 0 GROUP BY ALL
UNION ALL SELECT 'south', highway, count(*), 0 FROM edges WHERE u % 2 = 1 GROUP BY ALL""")
add("k1_edge_table", "SELECT CASE WHEN u % 2 = 0 THEN 'north' ELSE 'south' END AS region, LTS, count(*) AS n FROM rated GROUP BY ALL")
add("k2_stress_geojson", "SELECT highway, LTS, color, count(*) AS n FROM (SELECT *, CASE LTS WHEN 1 THEN 'green' WHEN 2 THEN 'deepskyblue' WHEN 3 THEN 'orange' WHEN 4 THEN 'red' END AS color FROM rated WHERE LTS > 0) GROUP BY ALL")
add("k4_filter_geojson", """
SELECT filter_label, highway, count(*) AS n FROM (SELECT *, CASE WHEN "cycleway:right" = 'lane' AND oneway = 1 THEN 'right_lane' END AS filter_label FROM edges)
WHERE filter_label IS NOT NULL GROUP BY ALL""")
add("k5_rule_logs", "SELECT ADT_rule_num AS rule, count(*) AS n FROM adt GROUP BY ALL")
add("s4_edge_csv", f"""SELECT {ID}, osmid, oneway, length, highway, maxspeed, width FROM edges""")
add("s5_node_csv", "SELECT osmid, x, y, highway FROM nodes")
# raw map document: one way per order, its nodes the line part keys in line order
cte("way_nodes", "SELECT l_orderkey AS way_id, l_partkey AS node, seq FROM lines")
cte("ways", f"""
SELECT w.*, {case_of('way_id % 7', ['primary', 'residential', 'motorway', 'steps', 'service', 'footway'])} AS highway,
       CASE way_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway_tag, CASE WHEN way_id % 5 = 0 THEN 'private' END AS access,
       CASE way_id % 6 WHEN 4 THEN 'parking_aisle' WHEN 5 THEN 'alley' END AS service
FROM (SELECT way_id, list(node ORDER BY seq) AS nodes FROM way_nodes GROUP BY ALL) w""")
add("s1_osm_ways", "SELECT way_id, len(nodes) AS n_nodes, highway FROM ways")
add("s1_osm_split", """SELECT way_id, len(nodes) AS n_nodes, nodes[-1] AS last_node, highway, CASE WHEN way_id % 5 = 1 THEN 'way' END AS kind,
CASE WHEN way_id % 7 = 2 THEN 'type' END AS note FROM ways""")
cte("streets", """
SELECT * FROM ways WHERE highway IS NOT NULL AND highway NOT IN ('motorway', 'steps') AND coalesce(access, '') <> 'private'
  AND coalesce(service, '') <> 'parking_aisle'""")
add("s2_street_filter", "SELECT way_id, highway, service FROM streets")
cte("segs0", """
SELECT way_id, oneway_tag IS NOT NULL AS one, seq, a, b FROM (
  SELECT way_id, oneway_tag, unnest(range(1, len(nodes))) AS seq, CASE WHEN oneway_tag = '-1' THEN list_reverse(nodes) ELSE nodes END AS ns,
         ns[unnest(range(1, len(nodes)))] AS a, ns[unnest(range(1, len(nodes))) + 1] AS b FROM streets)""")
cte("segs", """
SELECT a AS u, b AS v, way_id AS osmid, CASE WHEN one THEN 1 ELSE 0 END AS oneway, seq, 0 AS back FROM segs0
UNION ALL SELECT b, a, way_id, 0, seq, 1 FROM segs0 WHERE NOT one""")
add("s3_segmentize", """
SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY osmid, seq, back) - 1 AS key, osmid, oneway,
       2 * 6371008.8 * asin(sqrt(sin(radians(q.y - p.y) / 2) ** 2 + cos(radians(p.y)) * cos(radians(q.y)) * sin(radians(q.x - p.x) / 2) ** 2)) AS length
FROM segs JOIN nodes p ON p.osmid = u JOIN nodes q ON q.osmid = v""".replace("osmid, oneway", "segs.osmid, oneway").replace("ORDER BY osmid", "ORDER BY segs.osmid"))
cte("census_ways", """
SELECT *, CASE WHEN way_id % 3 = 0 THEN 'sidewalk' END AS footway,
  CASE WHEN way_id % 9 = 0 THEN 'yes' WHEN way_id % 9 = 3 THEN 'dismount' WHEN way_id % 4 = 1 THEN 'no' END AS bicycle FROM ways""")
add("g1_tag_counts", """
SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN footway IS NOT NULL THEN 'footway' END, CASE WHEN bicycle IS NOT NULL THEN 'bicycle' END, CASE WHEN highway IS NOT NULL THEN 'highway' END, CASE WHEN oneway_tag IS NOT NULL THEN 'oneway' END,
  CASE WHEN access IS NOT NULL THEN 'access' END, CASE WHEN service IS NOT NULL THEN 'service' END], lambda x: x IS NOT NULL)) AS tag FROM census_ways
  WHERE (highway IS NOT NULL AND coalesce(footway, '') <> 'sidewalk' AND coalesce(service, '') <> 'parking_aisle')
     OR (footway = 'sidewalk' AND bicycle NOT IN ('no', 'dismount'))) GROUP BY ALL""")

# --- graph ---------------------------------------------------------------------------------------------------
cte("street", """
SELECT CASE WHEN n_nationkey = 0 THEN 0 ELSE top + n_nationkey - 1 END AS a, top + n_nationkey AS b, n_nationkey AS k, 40 + n_nationkey AS len,
       CASE WHEN n_nationkey = 20 THEN 3 ELSE 1 END AS LTS
FROM nation, (SELECT max(p_partkey) // 10 + 1 AS top FROM part)
UNION ALL SELECT max(p_partkey) // 10 + 25, 1, 25, 65, 1 FROM part""")
cte("graph", """
SELECT p_partkey // 10 AS u, (p_partkey * 7 + p_size) % (SELECT max(p_partkey) // 10 + 1 FROM part) AS v, p_partkey AS key,
       100 + p_size * 40 AS len, CASE WHEN p_size = 50 THEN 0 ELSE 1 + p_partkey % 4 END AS LTS FROM part
UNION ALL SELECT a, b, -k, len, LTS FROM street UNION ALL SELECT b, a, -k, len, LTS FROM street WHERE k % 6 <> 5
UNION ALL SELECT (SELECT max(p_partkey) // 10 + 101 FROM part) + r_regionkey, (SELECT max(p_partkey) // 10 + 102 FROM part) + r_regionkey,
                 -30 - r_regionkey, 100, 1 FROM region""")
cte("gnodes", """
SELECT osmid, CAST(-71.12 + osmid % 41 * 0.002 AS DOUBLE) AS x, CAST(42.30 + osmid % 37 * 0.002 AS DOUBLE) AS y,
       CASE WHEN osmid % 50 = 49 THEN 4 ELSE 1 END AS LTS FROM (SELECT u AS osmid FROM graph UNION SELECT v FROM graph)""")
cte("lvls", "SELECT unnest([1, 2, 3, 4]) AS level")


def largest(name: str, source: str) -> None:
    """Weak components of the nodes of ``source`` (level, u, v, ...) and its edges in the largest one of each level."""
    cte(f"{name}_links", f"SELECT level, u AS a, v AS b FROM {source} UNION SELECT level, v, u FROM {source}")
    cte(f"{name}_closure", f"""/*RECURSIVE*/
SELECT level, a, a AS b FROM {name}_links UNION SELECT c.level, c.a, l.b FROM {name}_closure c JOIN {name}_links l ON l.level = c.level AND l.a = c.b""")
    cte(f"{name}_comp", f"SELECT level, a AS osmid, min(b) AS component FROM {name}_closure GROUP BY ALL")
    cte(f"{name}_most", f"""
SELECT level, component FROM (SELECT level, component, count(*) AS n FROM {name}_comp GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY level ORDER BY n DESC, component) = 1""")
    cte(f"{name}_kept", f"SELECT e.* FROM {source} e JOIN {name}_comp c ON c.level = e.level AND c.osmid = e.u JOIN {name}_most m ON m.level = c.level AND m.component = c.component")


def levels_of(source: str) -> str:
    return f"""
SELECT l.level, g.u, g.v, g.key, g.len, g.LTS FROM {source} g JOIN lvls l ON g.LTS BETWEEN 1 AND l.level
WHERE NOT EXISTS (SELECT 1 FROM gnodes n WHERE n.osmid IN (g.u, g.v) AND (n.LTS > l.level OR n.LTS = 0))"""


cte("whole_graph", "SELECT 0 AS level, u, v, key, len, LTS FROM graph")
largest("base", "whole_graph")
cte("level_graph", levels_of("base_kept"))
largest("net", "level_graph")
cte("bare_levels", levels_of("graph"))
largest("bare", "bare_levels")
cte("starts", "SELECT DISTINCT s_suppkey % 200 * 2 AS origin FROM supplier")
cte("steps", "SELECT level, u, v, min(len) AS len FROM net_kept GROUP BY ALL")
cte("reach", """/*RECURSIVE*/
SELECT level, origin, origin AS node, 0::BIGINT AS spent FROM starts, lvls
WHERE EXISTS (SELECT 1 FROM net_kept g WHERE g.level = lvls.level AND origin IN (g.u, g.v))
UNION SELECT r.level, r.origin, g.v, r.spent + g.len FROM reach r JOIN steps g ON g.level = r.level AND g.u = r.node
WHERE r.spent + g.len <= 3750""")
cte("reached", "SELECT level, origin, node, min(spent) / 250 AS minutes FROM reach GROUP BY ALL")
cte("counts", "SELECT origin, " + ", ".join(f"count(*) FILTER (level = {k}) AS lts{k}" for k in (1, 2, 3, 4)) + " FROM reached GROUP BY ALL")
add("j16_stress_subgraph", """
SELECT g.u, g.v, g.key FROM graph g WHERE LTS BETWEEN 1 AND 2
  AND NOT EXISTS (SELECT 1 FROM gnodes n WHERE n.osmid IN (g.u, g.v) AND (n.LTS > 2 OR n.LTS = 0))""")
add("x2_largest_component", "SELECT level, osmid, component FROM bare_comp JOIN bare_most USING (level, component)")
add("x2_component_sizes", "SELECT level, component, count(*) AS n_nodes FROM bare_comp GROUP BY ALL")
add("x3_network", "SELECT level, u, v, key FROM net_kept")
add("x3_isochrone", "SELECT * FROM reached")
add("x3_lowest_level", "SELECT origin, node, min(level) AS level FROM reached GROUP BY ALL")
add("g28_isochrone_counts", "SELECT * FROM counts")
add("p22_reach_share", "SELECT *, " + ", ".join(f"lts{k} / (SELECT max(lts4) FROM counts) AS share{k}" for k in (1, 2, 3, 4)) + " FROM counts")
add("t8_top_origins", "SELECT * FROM counts ORDER BY lts2 DESC, origin LIMIT 15")


def haversine(la1: str, lo1: str, la2: str, lo2: str) -> str:
    h = f"(sin(radians({la2} - {la1}) / 2) ** 2 + cos(radians({la1})) * cos(radians({la2})) * sin(radians({lo2} - {lo1}) / 2) ** 2)"
    return f"2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h}))"


cte("probe", "SELECT c_custkey AS point_id, CAST(42.29 + c_custkey % 97 * 0.001 AS DOUBLE) AS lat, CAST(-71.13 + c_custkey % 89 * 0.0012 AS DOUBLE) AS lon FROM customer")
add("j12_nearest_node", f"""
SELECT point_id, osmid, d AS distance FROM (SELECT point_id, osmid, {haversine('lat', 'lon', 'y', 'x')} AS d FROM probe, gnodes)
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(d, 6), osmid) = 1""")
cte("grid", """
SELECT i * 5 + j AS point_id, CAST(round(x0 + i * (x1 - x0) / 5, 4) AS DOUBLE) AS lon, CAST(round(y0 + j * (y1 - y0) / 5, 4) AS DOUBLE) AS lat
FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM gnodes), range(5) a(i), range(5) b(j)""")
cte("calm", "SELECT u AS osmid FROM net_kept WHERE level = 1 UNION SELECT v FROM net_kept WHERE level = 1")
cte("snapped", f"""
SELECT point_id, lon, lat, osmid FROM (SELECT *, {haversine('lat', 'lon', 'y', 'x')} AS d FROM grid, gnodes JOIN calm USING (osmid))
WHERE EXISTS (SELECT 1 FROM gnodes n WHERE {haversine('lat', 'lon', 'n.y', 'n.x')} <= 600)
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(d, 6), osmid) = 1""")
cte("greach", """/*RECURSIVE*/
SELECT DISTINCT level, osmid AS origin, osmid AS node, 0::BIGINT AS spent FROM lvls, snapped
WHERE EXISTS (SELECT 1 FROM net_kept g WHERE g.level = lvls.level AND osmid IN (g.u, g.v))
UNION SELECT r.level, r.origin, g.v, r.spent + g.len FROM greach r JOIN steps g ON g.level = r.level AND g.u = r.node
WHERE r.spent + g.len <= 1507""")
add("x4_isochrone_grid", """
SELECT point_id, lon, lat, osmid AS origin, """ + ", ".join(f"c.lts{k}" for k in (1, 2, 3, 4)) + """ FROM snapped JOIN (
SELECT origin, """ + ", ".join(f"count(DISTINCT node) FILTER (level = {k}) AS lts{k}" for k in (1, 2, 3, 4)) + " FROM greach GROUP BY ALL) c ON c.origin = osmid")

# --- timelines -----------------------------------------------------------------------------------------------
LOCAL = "epoch(timezone('America/New_York', timezone('UTC', service_date + to_seconds(CAST({0} AS BIGINT)))) - CAST(service_date AS TIMESTAMP))"
cte("utc_rows", f"""
SELECT *, CAST({LOCAL.format('s_sec')} AS DOUBLE) AS ls, CAST(CASE WHEN a_sec IS NOT NULL THEN {LOCAL.format('a_sec')} END AS DOUBLE) AS la
FROM arrivals WHERE standard_type <> 'Other' AND NOT spaced""")
add("p19_local_service_sec", "SELECT service_date, s_sec, ls AS local_sec, count(*) AS n FROM utc_rows GROUP BY ALL")
cte("utc_kept", "SELECT *, CASE WHEN la >= 0 THEN la END AS act FROM utc_rows WHERE ls >= 0")
cte("obs_points", """
SELECT f.route_id, f.service_date, f.half_trip_id, f.time_point_order, f.direction_id, f.stop_id, f.ls AS scheduled_sec,
       coalesce(f.act, g.act) AS actual_sec
FROM (SELECT * FROM utc_kept QUALIFY row_number() OVER (PARTITION BY route_id, service_date, half_trip_id, time_point_order
      ORDER BY ls, stop_id, direction_id, act NULLS FIRST) = 1) f
LEFT JOIN (SELECT * FROM utc_kept WHERE act IS NOT NULL QUALIFY row_number() OVER (PARTITION BY route_id, service_date, half_trip_id, time_point_order
      ORDER BY ls, stop_id, direction_id, act) = 1) g USING (route_id, service_date, half_trip_id, time_point_order)""")
add("w5_dedupe_fill", "SELECT * FROM obs_points")
cte("trip_dir", """
SELECT route_id, service_date, half_trip_id, direction_id FROM obs_points
QUALIFY row_number() OVER (PARTITION BY route_id, service_date, half_trip_id ORDER BY time_point_order) = 1""")
cte("stop_dist", """
SELECT shape_id, stop_id, cum_dist_m FROM cumdist, stops WHERE stop_id IN ('S0', 'S1', 'S2', 'S3', 'S4')
QUALIFY row_number() OVER (PARTITION BY shape_id, stop_id ORDER BY (shape_pt_lon - stop_lon) ** 2 + (shape_pt_lat - stop_lat) ** 2, shape_pt_sequence) = 1""")
cte("tl_points", """
SELECT o.* EXCLUDE (direction_id), t.direction_id, m.shape_id,
       max(cum_dist_m) OVER (PARTITION BY o.route_id, o.service_date, o.half_trip_id ORDER BY time_point_order) AS dist_m
FROM obs_points o JOIN trip_dir t USING (route_id, service_date, half_trip_id)
JOIN majority m ON m.route_id = o.route_id AND m.direction_id = CASE t.direction_id WHEN 'Inbound' THEN '1' ELSE '0' END
JOIN stop_dist d ON d.shape_id = m.shape_id AND d.stop_id = o.stop_id""")
add("w7_monotone_distance", "SELECT route_id, service_date, half_trip_id, time_point_order, dist_m FROM tl_points")
cte("tl_trips", """
SELECT route_id, service_date, half_trip_id, direction_id, shape_id, count(*) AS n_points,
       list(scheduled_sec ORDER BY time_point_order)[1] AS first_sched_sec, list(scheduled_sec ORDER BY time_point_order)[-1] AS last_sched_sec,
       min(actual_sec) AS first_actual_sec, max(actual_sec) AS last_actual_sec,
       string_agg(concat_ws(':', time_point_order, stop_id, CAST(round(dist_m) AS BIGINT), CAST(round(scheduled_sec) AS BIGINT),
         coalesce(CAST(CAST(round(actual_sec) AS BIGINT) AS VARCHAR), '-')), ',' ORDER BY time_point_order) AS frames
FROM tl_points GROUP BY ALL HAVING count(*) >= 2""")
TRIPS = "route_id, service_date, half_trip_id, direction_id, shape_id, n_points, first_sched_sec, last_sched_sec, first_actual_sec, last_actual_sec, frames"
add("c5_trip_timelines", f"SELECT {TRIPS} FROM tl_trips")
add("c5_timeline_summary", """
SELECT o.route_id, o.service_date, o.n AS observed_trips, coalesce(t.n, 0) AS trips, coalesce(t.m, 0) AS matched_trips,
       coalesce(t.lo, 18000) AS min_sched_sec, coalesce(t.hi, 93600) AS max_sched_sec
FROM (SELECT route_id, service_date, count(DISTINCT half_trip_id) AS n FROM obs_points GROUP BY ALL) o
LEFT JOIN (SELECT route_id, service_date, count(*) AS n, count(first_actual_sec) AS m, min(first_sched_sec) AS lo, max(last_sched_sec) AS hi
           FROM tl_trips GROUP BY ALL) t USING (route_id, service_date)""")
add("t7_navigation_order", """
SELECT route_id, service_date, half_trip_id, row_number() OVER (PARTITION BY route_id, service_date
  ORDER BY first_actual_sec IS NULL, first_sched_sec, half_trip_id) AS pos FROM tl_trips""")
add("g31_trip_lateness", """
SELECT route_id, service_date, half_trip_id, list_sort(list(actual_sec - scheduled_sec))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS lateness_sec
FROM tl_points WHERE actual_sec IS NOT NULL GROUP BY ALL""")
cte("ticks", "SELECT i * 1800 AS t FROM range(60) r(i)")
add("g30_active_trips_at", """
SELECT route_id, service_date, t, count(*) AS active, count(*) FILTER (t >= first_actual_sec AND t <= last_actual_sec) AS with_actual
FROM tl_trips JOIN ticks ON t BETWEEN first_sched_sec AND last_sched_sec GROUP BY ALL""")


def located(axis: str, name: str) -> None:
    key = "route_id, service_date, half_trip_id"
    cte(name, f"""
SELECT {key}, t, CASE WHEN t >= t0 AND t1 IS NOT NULL THEN dist_m + (t - t0) / (t1 - t0) * (d1 - dist_m) ELSE dist_m END AS d
FROM (SELECT {key}, t, k.t0, k.t1, k.dist_m, k.d1,
             row_number() OVER (PARTITION BY {key}, t ORDER BY CASE WHEN k.t0 <= t THEN 0 ELSE 1 END,
                                CASE WHEN k.t0 <= t THEN -k.t0 ELSE k.t0 END, CASE WHEN k.t0 <= t THEN -k.o ELSE k.o END) AS rn
      FROM tl_trips JOIN ticks ON t BETWEEN first_sched_sec AND last_sched_sec
      JOIN (SELECT {key}, {axis} AS t0, time_point_order AS o, dist_m, lead({axis}) OVER w AS t1, lead(dist_m) OVER w AS d1
            FROM tl_points WHERE {axis} IS NOT NULL
            WINDOW w AS (PARTITION BY {key} ORDER BY {axis}, time_point_order)) k USING ({key})) WHERE rn = 1""")


located("scheduled_sec", "at_sched")
located("actual_sec", "at_actual")
cte("placed", """
SELECT s.route_id, s.service_date, s.half_trip_id, t.shape_id, s.t, s.d AS sched_dist_m, coalesce(a.d, s.d) AS actual_dist_m,
       CASE WHEN s.t >= first_actual_sec AND s.t <= last_actual_sec THEN 'actualKnown' ELSE 'actualMissing' END AS kind
FROM at_sched s JOIN tl_trips t USING (route_id, service_date, half_trip_id) LEFT JOIN at_actual a USING (route_id, service_date, half_trip_id, t)""")
add("j14_positions_at", "SELECT * FROM placed")
cte("seg", """
SELECT shape_id, cum_dist_m AS s, lead(cum_dist_m) OVER w AS e, shape_pt_lon AS lon0, shape_pt_lat AS lat0,
       lead(shape_pt_lon) OVER w AS lon1, lead(shape_pt_lat) OVER w AS lat1, row_number() OVER w AS rn
FROM cumdist WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence)""")
add("c7_vehicle_positions", """
SELECT p.*, x.lon0 + (sched_dist_m - x.s) / (x.e - x.s) * (x.lon1 - x.lon0) AS sched_lon, x.lat0 + (sched_dist_m - x.s) / (x.e - x.s) * (x.lat1 - x.lat0) AS sched_lat,
       y.lon0 + (actual_dist_m - y.s) / (y.e - y.s) * (y.lon1 - y.lon0) AS actual_lon, y.lat0 + (actual_dist_m - y.s) / (y.e - y.s) * (y.lat1 - y.lat0) AS actual_lat
FROM placed p JOIN seg x ON x.shape_id = p.shape_id AND ((x.s < sched_dist_m AND sched_dist_m <= x.e) OR (x.rn = 1 AND sched_dist_m <= 0))
JOIN seg y ON y.shape_id = p.shape_id AND ((y.s < actual_dist_m AND actual_dist_m <= y.e) OR (y.rn = 1 AND actual_dist_m <= 0))""")
cte("seg_stops", """
SELECT o.*, m.shape_id, p.shape_pt_sequence AS idx, lag(p.shape_pt_sequence) OVER w AS pidx, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat
FROM overlay o JOIN majority m ON m.route_id = o.route_id AND m.direction_id = CASE o.direction_id WHEN 'Inbound' THEN '1' ELSE '0' END
JOIN (SELECT shape_id, stop_id, shape_pt_sequence FROM shapes, stops WHERE stop_id IN (SELECT stop_id FROM overlay)
      QUALIFY row_number() OVER (PARTITION BY shape_id, stop_id ORDER BY (shape_pt_lon - stop_lon) ** 2 + (shape_pt_lat - stop_lat) ** 2, shape_pt_sequence) = 1) p
  ON p.shape_id = m.shape_id AND p.stop_id = o.stop_id
WINDOW w AS (PARTITION BY o.route_id, o.direction_id ORDER BY time_point_order, o.stop_id)""")
add("c6_route_segments", """
SELECT route_id, direction_id, stop_id, CASE WHEN alone THEN 1 WHEN n < 2 AND pidx IS NOT NULL THEN n + 2 ELSE n END AS n_points,
       CASE WHEN ratio IS NULL THEN '#6b7280' WHEN ratio <= 1 THEN '#16a34a' WHEN ratio <= 1.2 THEN '#ca8a04' ELSE '#dc2626' END AS color,
       round(CASE WHEN alone THEN lon WHEN n < 2 AND pidx IS NOT NULL THEN plon ELSE CAST(-71.1195 + coalesce(pidx, 0) * 0.002 AS DOUBLE) END, 6) AS first_lon,
       array_to_string(CASE WHEN alone THEN [own] WHEN n < 2 AND pidx IS NOT NULL THEN [before] || vertices || [own] ELSE vertices END, ',') AS line
FROM (SELECT *, CAST(round(lon * 1000000) AS BIGINT) || ' ' || CAST(round(lat * 1000000) AS BIGINT) AS own,
             CAST(round(plon * 1000000) AS BIGINT) || ' ' || CAST(round(plat * 1000000) AS BIGINT) AS before,
             list_transform(CASE WHEN idx >= coalesce(pidx, 0) THEN range(coalesce(pidx, 0), idx + 1) ELSE range(pidx, idx - 1, -1) END,
                            lambda i: (i * 2000 - 71119500) || ' ' || (i * 2000 + 42300500)) AS vertices, abs(idx - coalesce(pidx, 0)) + 1 AS n, count(*) OVER (PARTITION BY route_id, direction_id) = 1 AS alone FROM seg_stops)""")

# --- written and read back -----------------------------------------------------------------------------------
METRIC = "route_id, stop_id, direction_id, time_point_order, on_time_rate, bunching_rate, n_obs"
add("k3_stop_metric_documents", f"SELECT {METRIC} FROM stopm")
add("s11_stop_metric_hour", f"SELECT {METRIC} FROM hourly WHERE hour = 8")
add("s10_annotations", """
SELECT stop_id, route_id, CASE WHEN event_id % 2 = 0 THEN 'crowding' ELSE 'denied_boardings' END AS type, count(*) AS n
FROM (SELECT *, 'S' || (user_id // 4) % 5 AS stop_id, CASE user_id % 4 WHEN 0 THEN '28' WHEN 1 THEN '1' WHEN 2 THEN '39' ELSE '66' END AS route_id FROM events)
WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY ALL""")
add("s12_photo_points", """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, CAST(-71.1 + user_id * 0.0001 AS DOUBLE) AS lon, CAST(42.3 + user_id * 0.0001 AS DOUBLE) AS lat, event_id || '.jpg' AS filename,
       strftime(ts, '%Y:%m:%d %H:%M:%S') AS datetime, '' AS make FROM events WHERE event_id % 7 <> 0""")
STAMP = "CASE WHEN spaced THEN '1900-01-01 ' || {0} || '.000' ELSE '1900-01-01T' || {0} || 'Z' END"
S_TEXT, A_TEXT = (STAMP.format(HMS.format(f"CAST({c} AS BIGINT)")) for c in ("s_sec", "a_sec"))
add("s6_arrivals_csv", f"""
SELECT service_date, route_id, direction_id, half_trip_id, stop_id, time_point_id, time_point_order, point_type, standard_type,
       {S_TEXT} AS scheduled, CASE WHEN a_sec IS NOT NULL THEN {A_TEXT} END AS actual, scheduled_headway, headway FROM arrivals""")
