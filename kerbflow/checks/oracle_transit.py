"""Oracle SQL for the transit queries, written directly on the driver's tables."""

from __future__ import annotations

from kerbflow.checks.sql import build, cte

ORACLE: dict[str, str] = {}


def add(name: str, select: str) -> None:
    ORACLE[name] = build(select)


HMS = "printf('%02d:%02d:%02d', ({0}) // 3600, ({0}) % 3600 // 60, ({0}) % 60)"

cte("ev", """
SELECT *, hour(ts) * 3600 + minute(ts) * 60 AS s0,
       greatest(least(hour(ts) * 3600 + minute(ts) * 60 + event_id * 37 % 600 - 120, 86399), 0) AS a0
FROM events""")
cte("arrivals", """
SELECT CAST(ts AS DATE) AS service_date,
       CASE user_id % 4 WHEN 0 THEN '28' WHEN 1 THEN '1' WHEN 2 THEN '39' ELSE '66' END AS route_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'Inbound' ELSE 'Outbound' END AS direction_id,
       'H' || (user_id % 30) AS half_trip_id,
       'S' || (user_id // 4) % 5 AS stop_id,
       'tp' || (user_id // 4) % 5 AS time_point_id,
       hour(ts) AS time_point_order, 'Midpoint' AS point_type,
       CASE WHEN event_id % 10 = 0 THEN 'Other' WHEN event_id % 10 <= 3 THEN 'Schedule' ELSE 'Headway' END AS standard_type,
       CAST(s0 AS DOUBLE) AS s_sec,
       CASE WHEN event_id % 17 <> 0 THEN CAST(a0 AS DOUBLE) END AS a_sec,
       event_id % 5 = 0 AS spaced,
       CASE WHEN event_id % 10 BETWEEN 1 AND 3 THEN 600 + event_id % 7 * 120 END AS scheduled_headway,
       CASE WHEN event_id % 10 >= 4 AND event_id % 3 = 0 THEN 60 + event_id % 11 * 90 END AS headway
FROM ev""")
cte("clean", """
SELECT *, s_sec AS scheduled_sec, a_sec AS actual_sec, s_sec / 3600 AS local_hour,
       scheduled_headway AS shw, headway AS ahw
FROM arrivals WHERE standard_type <> 'Other' AND a_sec IS NOT NULL""")
cte("filled", """
SELECT * EXCLUDE (ahw, pa),
       coalesce(ahw, CASE WHEN actual_sec > pa THEN actual_sec - pa END) AS actual_headway_sec
FROM (SELECT *, lag(actual_sec) OVER w AS pa, lag(scheduled_sec) OVER w AS prev_scheduled_sec FROM clean
      WINDOW w AS (PARTITION BY route_id, stop_id, direction_id, service_date
                   ORDER BY scheduled_sec, actual_sec, half_trip_id, time_point_order, standard_type,
                            headway NULLS FIRST, scheduled_headway NULLS FIRST))""")


def stop_day(name: str, extra: str, gap: str) -> None:
    cte(f"{name}_base", f"""
SELECT route_id, stop_id, direction_id, service_date{extra},
       min(time_point_order) AS time_point_order, count(*) AS n_obs,
       count(*) FILTER (actual_sec - scheduled_sec BETWEEN -60 AND 300) AS on_time_count,
       coalesce(median(shw), median({gap})) AS median_scheduled_headway_sec,
       median(actual_headway_sec) AS median_actual_headway_sec
FROM (SELECT *, CAST(floor(local_hour) AS INT) AS hour FROM filled) GROUP BY ALL""")
    key = "route_id, stop_id, direction_id, service_date" + extra
    cte(name, f"""
SELECT b.*, on_time_count / n_obs AS on_time_rate, bunched_count, bunched_count / n_obs AS bunching_rate
FROM {name}_base b JOIN (
  SELECT {key}, count(*) FILTER (actual_headway_sec < CASE WHEN median_scheduled_headway_sec > 0
         THEN least(median_scheduled_headway_sec * 0.5, 240) ELSE 240 END) AS bunched_count
  FROM (SELECT *, CAST(floor(local_hour) AS INT) AS hour FROM filled) JOIN {name}_base USING ({key})
  GROUP BY {key}) USING ({key})""")


stop_day("daily", "", "scheduled_sec - prev_scheduled_sec")
stop_day("hourly_day", ", hour",
         "CASE WHEN floor(prev_scheduled_sec / 3600) = hour THEN scheduled_sec - prev_scheduled_sec END")
cte("stopm", """
SELECT route_id, stop_id, direction_id, min(time_point_order) AS time_point_order, median(on_time_rate) AS on_time_rate,
       median(bunching_rate) AS bunching_rate, CAST(sum(n_obs) AS BIGINT) AS n_obs
FROM daily GROUP BY ALL HAVING sum(n_obs) >= 5""")
cte("hourly", """
SELECT route_id, stop_id, direction_id, hour, min(time_point_order) AS time_point_order,
       median(on_time_rate) AS on_time_rate, median(bunching_rate) AS bunching_rate, CAST(sum(n_obs) AS BIGINT) AS n_obs
FROM hourly_day GROUP BY ALL HAVING sum(n_obs) >= 5""")
cte("points", """
SELECT * FROM clean QUALIFY row_number() OVER (
  PARTITION BY route_id, service_date, direction_id, half_trip_id, time_point_order
  ORDER BY CASE standard_type WHEN 'Schedule' THEN 0 ELSE 1 END, scheduled_sec, actual_sec, stop_id) = 1""")
cte("strict_points", """
SELECT *, s_sec AS scheduled_sec, a_sec AS actual_sec FROM arrivals
WHERE standard_type <> 'Other' AND NOT spaced QUALIFY row_number() OVER (
  PARTITION BY route_id, service_date, direction_id, half_trip_id, time_point_order
  ORDER BY CASE standard_type WHEN 'Schedule' THEN 0 ELSE 1 END, s_sec, a_sec NULLS FIRST, stop_id) = 1""")


def summaries(name: str, src: str) -> None:
    cte(name, f"""
SELECT route_id, service_date, direction_id, half_trip_id, s1 AS first_sched_sec, (a2 - a1) / 60 AS trip_min,
       (s2 - s1) / 60 AS sched_trip_min, (a2 - a1) - (s2 - s1) > 180 AS delayed
FROM (SELECT route_id, service_date, direction_id, half_trip_id, count(*) AS n,
             list(scheduled_sec ORDER BY time_point_order)[1] AS s1, list(scheduled_sec ORDER BY time_point_order)[-1] AS s2,
             list(actual_sec ORDER BY time_point_order)[1] AS a1, list(actual_sec ORDER BY time_point_order)[-1] AS a2
      FROM {src} GROUP BY ALL)
WHERE n >= 2 AND a2 >= a1 AND s2 > s1""")


summaries("trips_done", "points")
summaries("trips_strict", "strict_points")
cte("strict_rows", """
SELECT *, lag(s_sec) OVER w AS ps, lag(a_sec) OVER w AS pa2 FROM (
  SELECT * FROM arrivals WHERE standard_type <> 'Other' AND NOT spaced
     AND (coalesce(headway, 0) > 0 OR coalesce(scheduled_headway, 0) > 0 OR coalesce(a_sec, 0) > 0))
WINDOW w AS (PARTITION BY route_id, stop_id, direction_id, service_date
             ORDER BY s_sec, a_sec NULLS FIRST, half_trip_id, time_point_order, standard_type,
                      headway NULLS FIRST, scheduled_headway NULLS FIRST)""")
cte("records", """
SELECT route_id, stop_id, direction_id, service_date, half_trip_id, time_point_order, s_sec AS scheduled_sec,
       s_sec / 3600 AS local_hour, ps AS prev_scheduled_sec, ahw AS actual_headway_sec,
       CASE WHEN scheduled_headway > 0 THEN scheduled_headway WHEN s_sec > ps THEN s_sec - ps ELSE 0 END AS scheduled_headway_sec
FROM (SELECT *, CASE WHEN headway > 0 THEN headway WHEN a_sec > 0 AND pa2 > 0 AND a_sec > pa2 THEN a_sec - pa2 END AS ahw
      FROM strict_rows) WHERE ahw > 0""")
cte("bells", "SELECT * FROM (VALUES ('AM', 7, 9), ('PM', 14, 16), ('AS', 16, 18)) b(time_window, lo, hi)")
cte("win_bells", """
SELECT r.*, time_window FROM records r JOIN bells ON local_hour >= lo AND local_hour < hi AND prev_scheduled_sec > 0
  AND prev_scheduled_sec / 3600 >= lo AND prev_scheduled_sec / 3600 < hi""")
cte("win", "SELECT * EXCLUDE (time_window) FROM win_bells WHERE time_window = 'AM'")


def observed(name: str, src: str, keys: str) -> None:
    cte(name, f"""
SELECT {keys}, count(*) AS n, any_value(act) / 60 AS observed_median_min, any_value(p25) / 60 AS p25_min,
       any_value(p75) / 60 AS p75_min,
       count(*) FILTER (actual_headway_sec < CASE WHEN sched > 0 THEN least(sched * 0.5, 240) ELSE 240 END) / count(*) AS bunching_rate,
       any_value(CASE WHEN sched > 0 THEN sched / 60 END) AS csv_scheduled_min
FROM {src} JOIN (
  SELECT {keys}, coalesce(median(scheduled_headway_sec) FILTER (scheduled_headway_sec > 0), 0) AS sched,
         median(actual_headway_sec) AS act,
         list_sort(list(actual_headway_sec))[CAST(floor(count(*) * 0.25) AS INT) + 1] AS p25,
         list_sort(list(actual_headway_sec))[CAST(floor(count(*) * 0.75) AS INT) + 1] AS p75
  FROM {src} GROUP BY {keys}) USING ({keys}) GROUP BY {keys}""")


observed("obs_stop", "win_bells", "time_window, route_id, stop_id")
observed("obs_route", "win_bells", "time_window, route_id")
cte("cells", """
SELECT route_id, stop_id, service_date, count(*) FILTER (actual_sec - scheduled_sec BETWEEN -60 AND 300) AS on_time_count,
       count(*) AS total_trips,
       count(*) FILTER (actual_sec - scheduled_sec BETWEEN -60 AND 300) / count(*) AS on_time_rate
FROM clean GROUP BY ALL HAVING count(*) >= 5""")
cte("pairs_min", "SELECT route_id, stop_id, direction_id, min(time_point_order) AS min_order FROM clean GROUP BY ALL")

# schedule feed
ROUTE = "CASE {0} WHEN 0 THEN '28' WHEN 1 THEN '1' WHEN 2 THEN '39' WHEN 3 THEN '66' WHEN 24 THEN 'Shuttle24' ELSE 'R' || ({0}) END"
cte("stops", """
SELECT 'S' || s_suppkey AS stop_id, s_name AS stop_name, CAST(42.30 + s_suppkey % 37 * 0.002 AS DOUBLE) AS stop_lat,
       CAST(-71.12 + s_suppkey % 41 * 0.002 AS DOUBLE) AS stop_lon FROM supplier""")
cte("routes", f"SELECT {ROUTE.format('n_nationkey')} AS route_id, {ROUTE.format('n_nationkey')} AS route_short_name, "
              "n_name AS route_long_name FROM nation")
cte("trips", f"""
SELECT *, route_id || '_' || direction_id || CASE WHEN o_orderkey % 5 < 3 THEN '_a' ELSE '_b' END AS shape_id
FROM (SELECT o_orderkey, 'T' || o_orderkey AS trip_id, {ROUTE.format('(o_custkey % 25)')} AS route_id,
             'svc' || left(o_orderpriority, 1) AS service_id, CAST(o_orderkey % 2 AS VARCHAR) AS direction_id FROM orders)""")
cte("lines", """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                             l_extendedprice) AS seq FROM lineitem""")
cte("stop_times", """
SELECT 'T' || l_orderkey AS trip_id, 'S' || l_suppkey % 10 AS stop_id, seq AS stop_sequence,
       18000 + l_orderkey * 7 % 1200 * 60 + seq * 150 AS dep FROM lines""")
cte("calendar", """
SELECT * FROM (VALUES ('svc1','1111100'),('svc2','1111100'),('svc3','0000011'),('svc4','1111111'),('svc5','1010100')) t(service_id, flags)""")
cte("days", "SELECT CAST(d AS DATE) AS service_date FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) t(d)")
cte("active", """
SELECT service_date, service_id FROM days, calendar
WHERE flags[isodow(service_date)] = '1' AND NOT (service_id = 'svc1' AND service_date = DATE '2024-01-15')
UNION SELECT DATE '2024-01-15', 'svc3'""")
cte("shapes", """
SELECT shape_id, i AS shape_pt_sequence, CAST(42.3005 + i % 37 * 0.002 AS DOUBLE) AS shape_pt_lat, CAST(-71.1195 + i % 41 * 0.002 AS DOUBLE) AS shape_pt_lon
FROM (SELECT DISTINCT shape_id FROM trips), range(10) r(i)""")
cte("schools", "SELECT school_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, radius_m FROM (VALUES ('s1', 42.3226, -71.0894, 1200), ('s2', 42.31, -71.11, 800)) t(school_id, lat, lon, radius_m)")
cte("near", """
SELECT school_id, stop_id, stop_name, stop_lat, stop_lon, CAST(round(d) AS INT) AS distance_m FROM (
  SELECT *, 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (
    SELECT *, sin(radians(stop_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(stop_lat)) * sin(radians(stop_lon - lon) / 2) ** 2 AS h
    FROM schools, stops)) WHERE d <= radius_m""")
cte("route_stops", "SELECT DISTINCT route_id, stop_id FROM stop_times JOIN trips USING (trip_id)")
cte("school_routes", """
SELECT DISTINCT school_id, route_id, route_short_name, route_long_name
FROM near JOIN route_stops USING (stop_id) JOIN routes USING (route_id) WHERE route_id NOT LIKE 'Shuttle%'""")
cte("sched", """
SELECT time_window, route_id, stop_id, median(gap) / 60 AS scheduled_median_min, count(*) AS trip_count
FROM (SELECT time_window, route_id, stop_id, dep - lag(dep) OVER (PARTITION BY time_window, route_id, stop_id ORDER BY dep) AS gap
      FROM stop_times JOIN trips USING (trip_id) JOIN active USING (service_id) JOIN bells ON dep BETWEEN lo * 3600 AND hi * 3600
      WHERE service_date = DATE '2024-01-10')
GROUP BY ALL HAVING count(*) >= 2""")
cte("majority", """
SELECT route_id, direction_id, shape_id, count(*) AS n_trips FROM trips GROUP BY route_id, direction_id, shape_id
QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, shape_id) = 1""")
cte("axis_trip", """
SELECT route_id, trip_id FROM trips JOIN stop_times USING (trip_id) GROUP BY route_id, trip_id
QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, trip_id) = 1""")
cte("axis", """
SELECT route_id, trip_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY min(stop_sequence), stop_id) - 1 AS axis_rank
FROM axis_trip JOIN stop_times USING (trip_id) GROUP BY route_id, trip_id, stop_id""")
cte("pool", """
SELECT route_id AS own, route_id AS pooled FROM routes
UNION SELECT route_id, CASE WHEN route_id IN ('1', '39') THEN '28' WHEN route_id = '66' THEN 'SL' ELSE route_short_name END FROM routes""")
cte("medseq", """
SELECT pooled AS route_id, direction_id, stop_id, median(stop_sequence) AS m
FROM stop_times JOIN trips USING (trip_id) JOIN pool ON own = route_id GROUP BY ALL""")
cte("heads", """
SELECT route_id, direction_id, stop_name AS head FROM medseq LEFT JOIN stops USING (stop_id)
QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY m, stop_id) = 1""")
cte("ranked_stops", """
SELECT route_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY c) - 1 AS display_rank FROM (
  SELECT route_id, stop_id, c FROM (
    SELECT route_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY
      CASE WHEN head ILIKE '%000003' THEN 0 ELSE 1 END, CASE WHEN head ILIKE '%000007' THEN 1 ELSE 0 END,
      direction_id, m, stop_id) AS c FROM medseq JOIN heads USING (route_id, direction_id))
  QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY c) = 1)""")
cte("merged", """
SELECT n.school_id, o.time_window, o.route_id, o.stop_id, n.stop_name, n.distance_m, r.route_short_name, r.route_long_name,
       coalesce(s.scheduled_median_min, o.csv_scheduled_min, 0) AS effective_min, o.observed_median_min, o.p25_min, o.p75_min,
       o.bunching_rate, o.csv_scheduled_min,
       o.observed_median_min / nullif(coalesce(s.scheduled_median_min, o.csv_scheduled_min, 0), 0) AS ratio,
       CASE WHEN coalesce(s.scheduled_median_min, 0) <= 0 AND o.csv_scheduled_min > 0 THEN 'csv-scheduled' ELSE '' END AS flags
FROM obs_stop o JOIN near n USING (stop_id) JOIN school_routes r ON r.school_id = n.school_id AND r.route_id = o.route_id
LEFT JOIN sched s ON s.time_window = o.time_window AND s.route_id = o.route_id AND s.stop_id = o.stop_id""")
cte("card", """
SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY school_id, time_window, route_id ORDER BY distance_m, stop_id) = 1""")
cte("overlay_base", """
SELECT v.*, CAST(o AS INT) AS time_point_order, p.direction_id FROM (
  SELECT route_id, stop_id, coalesce(median(scheduled_headway_sec) FILTER (scheduled_headway_sec > 0), 0) / 60 AS scheduled_median_min,
         median(actual_headway_sec) / 60 AS actual_median_min,
         coalesce(median(actual_headway_sec) / (median(scheduled_headway_sec) FILTER (scheduled_headway_sec > 0)), 0) AS ratio,
         count(*) AS sample_count FROM win GROUP BY ALL) v
JOIN (SELECT route_id, stop_id, direction_id, min(time_point_order) AS o FROM win GROUP BY route_id, stop_id, direction_id
      QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY count(*) DESC, direction_id) = 1) p
USING (route_id, stop_id)""")
cte("ridership", f"""
SELECT 'Spring 2024' AS season, {ROUTE.format('(o_custkey % 25)')} AS route_id, l_returnflag AS route_variant,
       CAST(o_orderkey % 2 AS VARCHAR) AS direction_id, {HMS.format('(5 + o_orderkey % 18) * 3600')} AS trip_start_time,
       'day_type_0' || left(o_orderpriority, 1) AS day_type_id,
       CASE WHEN left(o_orderpriority, 1) <= '3' THEN 'weekday' WHEN left(o_orderpriority, 1) = '4' THEN 'saturday' ELSE 'sunday' END AS day_type_name,
       'Stop ' || l_suppkey % 10 AS stop_name, 'S' || l_suppkey % 10 AS stop_id, seq AS stop_sequence,
       l_quantity AS boardings, l_quantity * l_discount AS alightings, l_quantity - l_quantity * l_discount AS load,
       l_linenumber AS sample_size FROM lines JOIN orders ON l_orderkey = o_orderkey""")
cte("loads", """
SELECT route_id, direction_id, stop_id, avg(load) AS load FROM ridership WHERE day_type_name LIKE '%week%' GROUP BY ALL""")
cte("overlay", """
SELECT b.*, st.stop_name, st.stop_lat AS lat, st.stop_lon AS lon, sm.on_time_rate, sm.bunching_rate,
       coalesce(own.load, (l0.load + l1.load) / 2, l0.load, l1.load) AS ridership_load
FROM overlay_base b JOIN stops st USING (stop_id) LEFT JOIN stopm sm USING (route_id, stop_id, direction_id)
LEFT JOIN loads own ON own.route_id = b.route_id AND own.stop_id = b.stop_id
  AND own.direction_id = CASE b.direction_id WHEN 'Inbound' THEN '1' ELSE '0' END
LEFT JOIN loads l0 ON l0.route_id = b.route_id AND l0.stop_id = b.stop_id AND l0.direction_id = '0'
LEFT JOIN loads l1 ON l1.route_id = b.route_id AND l1.stop_id = b.stop_id AND l1.direction_id = '1'""")

# --- cleaning and windows ------------------------------------------------------------------------------
add("p13_clean_arrivals", """
SELECT service_date, route_id, direction_id, half_trip_id, stop_id, standard_type, time_point_order, scheduled_sec, actual_sec,
       local_hour, shw AS scheduled_headway_sec, ahw AS actual_headway_sec FROM clean""")
add("p14_on_time", """
SELECT route_id, actual_sec - scheduled_sec BETWEEN -60 AND 300 AS on_time, count(*) AS n FROM clean GROUP BY ALL""")
add("p15_bunching_threshold", """
SELECT scheduled_headway, CAST(CASE WHEN scheduled_headway > 0 THEN least(scheduled_headway * 0.5, 240) ELSE 240 END AS DOUBLE) AS threshold,
       count(*) AS n FROM arrivals GROUP BY ALL""")
add("p16_norm_direction", """
SELECT raw, CASE WHEN lower(trim(raw)) IN ('inbound', '1', '1.0') THEN 'Inbound'
                 WHEN lower(trim(raw)) IN ('outbound', '0', '0.0') THEN 'Outbound' ELSE trim(raw) END AS direction, count(*) AS n
FROM (SELECT CASE user_id % 5 WHEN 0 THEN ' INBOUND ' WHEN 1 THEN '0.0' WHEN 2 THEN '1' WHEN 3 THEN direction_id ELSE ' Loop ' END AS raw
      FROM (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'Inbound' ELSE 'Outbound' END AS direction_id FROM events))
GROUP BY ALL""")
add("p21_date_label", "SELECT strftime(service_date, '%Y-%m-%d (%a)') AS label, count(*) AS n FROM arrivals GROUP BY ALL")
add("w1_fill_actual_headway", """
SELECT route_id, stop_id, direction_id, service_date, half_trip_id, standard_type, scheduled_sec, actual_sec,
       prev_scheduled_sec, actual_headway_sec FROM filled""")
add("w2_headway_records", "SELECT * FROM records")
add("w3_scheduled_diffs", """
SELECT route_id, stop_id, direction_id, service_date, scheduled_sec - prev_scheduled_sec AS gap, count(*) AS n
FROM filled GROUP BY ALL""")
add("w4_dedupe_points", """
SELECT route_id, service_date, direction_id, half_trip_id, time_point_order, stop_id, standard_type, scheduled_sec, actual_sec
FROM points""")
add("w9_worst_stops", """
SELECT stop_id, bunching_rate, n_obs FROM (
  SELECT * FROM daily WHERE route_id = '28' AND n_obs >= 5
  ORDER BY bunching_rate DESC, stop_id, direction_id, service_date LIMIT 5)
QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY bunching_rate DESC, n_obs) = 1""")
DAILY = """route_id, stop_id, direction_id, service_date, time_point_order, n_obs, on_time_count, on_time_rate,
bunched_count, bunching_rate, median_scheduled_headway_sec, median_actual_headway_sec"""
add("g4_stop_day_metrics", f"SELECT {DAILY} FROM daily")
add("g5_stop_metrics", "SELECT * FROM stopm")
add("g6_stop_metrics_by_hour", "SELECT * FROM hourly")
add("g7_route_comparison", """
SELECT route_id, median(on_time_rate) AS on_time_rate, median(bunching_rate) AS bunching_rate, count(on_time_rate) AS n_stop_days
FROM daily GROUP BY ALL HAVING count(on_time_rate) >= 10""")
cte("summary", """
SELECT route_id, n_rows, n_dates, n_stop_days, on_time_rate, bunching_rate, route_id = '28' AS is_focus
FROM (SELECT route_id, count(*) AS n_rows, count(DISTINCT service_date) AS n_dates FROM filled GROUP BY ALL)
LEFT JOIN (SELECT route_id, count(*) AS n_stop_days, median(on_time_rate) AS on_time_rate, median(bunching_rate) AS bunching_rate
           FROM daily WHERE route_id <> '28' OR n_obs >= 5 GROUP BY ALL) USING (route_id)""")
add("g8_reliability_summary", "SELECT * FROM summary")
cte("per_day", """
SELECT route_id, CAST(sum(n) AS BIGINT) AS n_trips, min(n) AS min_per_day, max(n) AS max_per_day, median(n) AS median_per_day,
       avg(n) AS mean_per_day FROM (SELECT route_id, service_date, count(*) AS n FROM trips_done GROUP BY ALL) GROUP BY ALL""")
add("g9_trips_per_day", "SELECT * FROM per_day")
add("g13_trip_summaries", "SELECT * FROM trips_done")
add("g13_trip_series", "SELECT * FROM trips_strict")
add("g16_observed_headways", "SELECT * FROM obs_stop")
add("g16_observed_fallback", """
SELECT p.time_window, p.route_id, p.stop_id, coalesce(s.n, r.n) AS n, coalesce(s.observed_median_min, r.observed_median_min) AS observed_median_min,
       coalesce(s.p25_min, r.p25_min) AS p25_min, coalesce(s.p75_min, r.p75_min) AS p75_min,
       coalesce(s.bunching_rate, r.bunching_rate) AS bunching_rate,
       CASE WHEN s.n IS NOT NULL THEN s.csv_scheduled_min ELSE r.csv_scheduled_min END AS csv_scheduled_min, s.n IS NULL AS is_route_level
FROM (SELECT time_window, route_id, stop_id FROM route_stops, bells) p LEFT JOIN obs_stop s USING (time_window, route_id, stop_id)
JOIN obs_route r ON r.route_id = p.route_id AND r.time_window = p.time_window""")
add("g17_headway_grains", """
SELECT route_id, stop_id, count(*) AS n, median(actual_headway_sec) AS median_actual_sec FROM records
GROUP BY GROUPING SETS ((route_id, stop_id), (route_id))""")
OVERLAY_COLS = "route_id, stop_id, direction_id, time_point_order, scheduled_median_min, actual_median_min, ratio, sample_count"
add("g18_route_stop_headways", f"SELECT {OVERLAY_COLS} FROM overlay_base")
add("g19_heatmap_cells", "SELECT * FROM cells")
add("g20_on_time_day", """
SELECT route_id, stop_id, on_time_rate, total_trips AS n_obs FROM cells WHERE route_id = '28' AND service_date = DATE '2024-01-10'""")
DATES = [f"2024-01-{i:02d}" for i in range(1, 31)]
cells_sql = ", ".join(f"round(avg(on_time_rate) FILTER (service_date = DATE '{d}'), 6) AS \"{d}\"" for d in DATES)
add("g21_heatmap_pivot", f"SELECT route_id, direction_id, stop_id, {cells_sql} FROM daily WHERE n_obs >= 5 GROUP BY ALL")
hours_sql = ", ".join(f"round(avg(on_time_rate) FILTER (hour = {h}), 6) AS h{h:02d}" for h in range(24))
add("g22_heatmap_hour_pivot", f"SELECT route_id, direction_id, stop_id, {hours_sql} FROM hourly GROUP BY ALL")
add("r6_filter_routes", "SELECT route_id, count(*) AS n FROM arrivals WHERE route_id IN ('28', '1', '39') GROUP BY ALL")
add("r7_hour_slice", """
SELECT route_id, stop_id, service_date, scheduled_sec, actual_sec FROM clean WHERE local_hour >= 8 AND local_hour < 9""")
add("r8_headway_window", """
SELECT * FROM win WHERE service_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND direction_id = 'Inbound'""")
add("r9_min_samples", f"SELECT {DAILY} FROM daily WHERE n_obs >= 5")
cte("pattern", "SELECT DISTINCT route_id, 'S' || CAST(substr(stop_id, 2) AS INT) % 3 AS stop_id FROM route_stops WHERE route_id <> '66'")
cte("kept_cells", """
SELECT c.* FROM cells c WHERE EXISTS (SELECT 1 FROM pattern p WHERE p.route_id = c.route_id AND p.stop_id = c.stop_id)
OR NOT EXISTS (SELECT 1 FROM cells d JOIN pattern p USING (route_id, stop_id) WHERE d.route_id = c.route_id)""")
add("r10_guarded_semi", "SELECT * FROM kept_cells")
add("r11_overlay_filter", f"SELECT {OVERLAY_COLS} FROM overlay_base WHERE direction_id = 'Outbound'")
add("c3_drilldown", f"""
SELECT service_date, route_id, direction_id, half_trip_id, stop_id, time_point_id, time_point_order, point_type, standard_type,
       {HMS.format('CAST(s_sec AS BIGINT)')} AS scheduled_time,
       CASE WHEN a_sec IS NOT NULL THEN {HMS.format('CAST(a_sec AS BIGINT)')} END AS actual_time,
       s_sec AS scheduled_sec, a_sec AS actual_sec, coalesce(a_sec - s_sec, 0) AS delay_sec,
       coalesce(a_sec - s_sec BETWEEN -60 AND 300, false) AS is_on_time, scheduled_headway, headway AS actual_headway
FROM arrivals WHERE standard_type <> 'Other' AND route_id = '28' AND stop_id = 'S1' AND service_date = DATE '2024-01-10'""")
add("c8_trip_calendar", """
SELECT *, least(first_sched_sec / 86400, 0.999) AS day_fraction, isodow(service_date) - 1 AS weekday,
       CAST(floor((day(service_date) - 1 + isodow(date_trunc('month', service_date)) - 1) / 7) AS INT) AS week_row FROM trips_done""")
add("t1_arrivals_sorted", """
SELECT route_id, stop_id, direction_id, service_date, scheduled_sec, actual_sec FROM clean ORDER BY ALL""")
add("t4_trip_series_order", """
SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY service_date, first_sched_sec, half_trip_id, direction_id) AS pos
FROM trips_strict""")
add("t5_drilldown_order", """
SELECT half_trip_id, a_sec - s_sec AS delay_sec, row_number() OVER (ORDER BY coalesce(a_sec - s_sec, 0) DESC, s_sec, half_trip_id, time_point_order) AS pos
FROM arrivals WHERE standard_type <> 'Other' AND a_sec IS NOT NULL AND route_id = '28' AND stop_id = 'S1' AND service_date = DATE '2024-01-10'""")
add("u2_service_dates", "SELECT DISTINCT service_date FROM records")
add("j11_with_stop_names", """
SELECT c.*, coalesce(stop_name, c.stop_id) AS stop_name FROM cells c LEFT JOIN stops USING (stop_id)""")
add("x6_reliability_report", """
SELECT 'summary' AS section, route_id AS k1, '' AS k2, '' AS k3, on_time_rate, bunching_rate, n_rows AS n FROM summary
UNION ALL SELECT 'stop', route_id, stop_id, direction_id, on_time_rate, bunching_rate, n_obs FROM stopm
UNION ALL SELECT 'hour', route_id, stop_id, direction_id || '@' || hour, on_time_rate, bunching_rate, n_obs FROM hourly
UNION ALL SELECT 'trips', route_id, '', '', mean_per_day, median_per_day, n_trips FROM per_day""")

# --- schedule feed ---------------------------------------------------------------------------------------
add("s7_gtfs_feed", "SELECT trip_id, stop_id, stop_sequence, dep FROM stop_times")
add("s8_stop_names", "SELECT stop_id, coalesce(nullif(trim(stop_name), ''), stop_id) AS stop_name FROM stops")
add("g14_active_services", "SELECT * FROM active WHERE service_date IN (SELECT CAST(ts AS DATE) FROM events)")
add("j6_trips_on", """
SELECT service_date, trip_id, route_id FROM trips JOIN active USING (service_id) WHERE service_date = DATE '2024-01-15'""")
add("g15_scheduled_headways", "SELECT DATE '2024-01-10' AS service_date, * FROM sched")
add("g25_majority_shape", "SELECT * FROM majority")
add("g26_longest_trip_axis", "SELECT * FROM axis")
add("g27_display_rank", "SELECT * FROM ranked_stops")
add("g29_feed_stats", """
SELECT 'stops' AS table_name, count(*) AS n FROM stops UNION ALL SELECT 'routes', count(*) FROM routes
UNION ALL SELECT 'trips', count(*) FROM trips UNION ALL SELECT 'calendar', 5 UNION ALL SELECT 'calendar_dates', 2
UNION ALL SELECT 'stop_times', count(DISTINCT trip_id) FROM stop_times""")
add("g32_route_bounds", """
SELECT m.route_id, min(shape_pt_lon) AS min_lon, min(shape_pt_lat) AS min_lat, max(shape_pt_lon) AS max_lon, max(shape_pt_lat) AS max_lat
FROM majority m JOIN shapes USING (shape_id) GROUP BY ALL""")
add("j3_routes_for_stops", "SELECT * FROM school_routes")
add("j4_stops_on_route", "SELECT * FROM route_stops")
add("j5_stops_near", "SELECT * FROM near")
add("t3_nearest_stops", "SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY distance_m, stop_id) <= 20")
cte("cumdist", """
SELECT *, sum(coalesce(2 * 6371008.8 * asin(sqrt(h)), 0)) OVER (PARTITION BY shape_id ORDER BY shape_pt_sequence) AS cum_dist_m FROM (
  SELECT *, sin(radians(shape_pt_lat - plat) / 2) ** 2 + cos(radians(shape_pt_lat)) * cos(radians(plat)) * sin(radians(shape_pt_lon - plon) / 2) ** 2 AS h
  FROM (SELECT *, lag(shape_pt_lat) OVER w AS plat, lag(shape_pt_lon) OVER w AS plon FROM shapes
        WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence)))""")
add("w6_shape_distance", "SELECT shape_id, shape_pt_sequence, cum_dist_m FROM cumdist")
cte("projected", """
SELECT shape_id, stop_id, shape_pt_sequence FROM (SELECT DISTINCT shape_id, stop_id FROM trips JOIN stop_times USING (trip_id))
JOIN stops USING (stop_id) JOIN shapes USING (shape_id)
QUALIFY row_number() OVER (PARTITION BY shape_id, stop_id ORDER BY (shape_pt_lon - stop_lon) ** 2 + (shape_pt_lat - stop_lat) ** 2, shape_pt_sequence) = 1""")
add("j13_project_stops", "SELECT * FROM projected")
add("p17_canonical_stop", """
SELECT CASE stop_id WHEN 'S3' THEN 'S2' ELSE stop_id END AS stop_id, count(*) AS n FROM arrivals GROUP BY ALL""")
cte("names18", """
SELECT stop_id, ['1624 ', '', ' ', '55 '][1 + k % 4] || 'Blue Hill ' || ['Avenue', 'Street', 'Boulevard', 'Square'][1 + k % 4]
       || [' @ ', ' & ', ' opposite ', ' opp. '][1 + k // 4 % 4] || s_name AS raw
FROM (SELECT 'S' || s_suppkey AS stop_id, s_suppkey AS k, s_name FROM supplier)""")
NORM = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "regexp_replace(lower(trim(raw)), '[@&]', ' at ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\bavenue\\b', 'ave', 'g'), "
        "'\\bstreet\\b', 'st', 'g'), '\\bboulevard\\b', 'blvd', 'g'), '\\bsquare\\b', 'sq', 'g'), '\\bopposite\\b', 'opp', 'g'), "
        "'^[0-9]+ +', ''), ' +', ' ', 'g'))")
add("p18_norm_stop_name", f"SELECT stop_id, {NORM} AS name FROM names18")
cte("corridor", f"""
SELECT pos, direction, raw AS expected_name, stop_id, {NORM} AS want FROM (
  SELECT i AS pos, CASE WHEN i % 2 = 1 THEN 'Inbound' ELSE 'Outbound' END AS direction,
         printf(CASE WHEN i % 3 <> 0 THEN 'Supplier#%09d' ELSE 'Suplier %08d' END, i) AS raw,
         CASE WHEN i % 4 <> 0 THEN 'S' ELSE 'X' END || i AS stop_id FROM range(12) t(i))""")
cte("named", f"""
SELECT stop_id, raw AS stop_name, {NORM} AS norm FROM (
  SELECT stop_id, coalesce(nullif(trim(stop_name), ''), stop_id) AS raw FROM stops)""")
cte("similar_names", """
SELECT pos, g.stop_id, g.stop_name, 1 - levenshtein(want, norm) / greatest(length(want), length(norm), 1) AS score
FROM corridor, (SELECT norm, min(stop_id) AS stop_id, arg_min(stop_name, stop_id) AS stop_name FROM named GROUP BY norm) g
WHERE 1 - levenshtein(want, norm) / greatest(length(want), length(norm), 1) >= 0.6
QUALIFY row_number() OVER (PARTITION BY pos ORDER BY score DESC, g.stop_id) <= 3""")
add("j15_validate_corridor", """
SELECT direction, expected_name, c.stop_id, n.stop_name,
       CASE WHEN n.stop_name IS NULL THEN 'missing' WHEN want <> norm THEN 'mismatched' ELSE 'ok' END AS status,
       CASE WHEN n.stop_name IS NULL THEN coalesce((SELECT string_agg(s.stop_name || ' (stop_id=' || s.stop_id || ')', '; ' ORDER BY score DESC, s.stop_id)
         FROM similar_names s WHERE s.pos = c.pos), '') ELSE '' END AS matches
FROM corridor c LEFT JOIN named n ON n.stop_id = c.stop_id""")
add("w8_axis_rank", """
SELECT route_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY direction_id, min_order, stop_id) - 1 AS rank FROM (
  SELECT * FROM pairs_min QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY direction_id, min_order) = 1)""")
cte("axis_rows", """
SELECT route_id, stop_id, 0 AS block, axis_rank AS pos FROM axis WHERE route_id IN ('28', '1', '39', '66')
UNION ALL SELECT route_id, stop_id, 1, min(min_order) FROM pairs_min p
WHERE EXISTS (SELECT 1 FROM cells c WHERE c.route_id = p.route_id AND c.stop_id = p.stop_id)
  AND NOT EXISTS (SELECT 1 FROM axis a WHERE a.route_id = p.route_id AND a.stop_id = p.stop_id)
GROUP BY ALL""")
add("t6_heatmap_axis", """
SELECT r.route_id, r.stop_id, row_number() OVER (PARTITION BY r.route_id ORDER BY block, pos, CAST(substr(r.stop_id, 2) AS INT), r.stop_id) - 1 AS row_rank,
       coalesce(p.direction_id, '') AS direction_id, coalesce(p.min_order, 0) AS time_point_order
FROM axis_rows r LEFT JOIN (SELECT * FROM pairs_min QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY direction_id, min_order) = 1) p
USING (route_id, stop_id)""")
CARD = """school_id, time_window, route_id, route_short_name || ' - ' || route_long_name AS route_name, stop_id, stop_name,
effective_min, observed_median_min, p25_min, p75_min, bunching_rate, ratio, flags"""
add("c1_scorecard", f"SELECT {CARD} FROM card")
add("w10_key_stop", "SELECT school_id, time_window, route_id, stop_id FROM card")
add("t2_scorecard_order", f"""
SELECT {CARD}, row_number() OVER (PARTITION BY school_id, time_window ORDER BY ratio NULLS LAST, route_id) AS pos FROM card""")
add("c9_routes_with_delay", "SELECT school_id, time_window, route_id, ratio FROM card WHERE ratio >= 1.2")
add("j7_merge_headways", """
SELECT p.time_window, p.route_id, p.stop_id, s.scheduled_median_min, o.observed_median_min, o.csv_scheduled_min,
       coalesce(s.scheduled_median_min, o.csv_scheduled_min, 0) AS effective_min,
       o.observed_median_min / nullif(coalesce(s.scheduled_median_min, o.csv_scheduled_min, 0), 0) AS ratio,
       concat_ws(',', CASE WHEN coalesce(s.scheduled_median_min, 0) <= 0 AND o.csv_scheduled_min > 0 THEN 'csv-scheduled' END,
                 CASE WHEN o.n IS NULL THEN 'no-archived' END) AS flags
FROM (SELECT time_window, route_id, stop_id FROM route_stops, bells) p
LEFT JOIN sched s USING (time_window, route_id, stop_id) LEFT JOIN obs_stop o USING (time_window, route_id, stop_id)""")
cte("notes", """
SELECT DISTINCT stop_id, route_id, CASE WHEN event_id % 2 = 0 THEN 'crowding' ELSE 'denied_boardings' END AS type
FROM (SELECT *, 'S' || (user_id // 4) % 5 AS stop_id,
             CASE user_id % 4 WHEN 0 THEN '28' WHEN 1 THEN '1' WHEN 2 THEN '39' ELSE '66' END AS route_id FROM events)
WHERE event_type = 'error' AND user_id % 3 = 0""")
add("j8_with_crowding", """
SELECT school_id, time_window, route_id, stop_id, ratio, coalesce(ratio >= 1.2, false) AS has_delay,
       EXISTS (SELECT 1 FROM notes n WHERE n.stop_id = m.stop_id AND n.route_id = m.route_id AND n.type = 'crowding') AS has_crowding,
       EXISTS (SELECT 1 FROM notes n WHERE n.stop_id = m.stop_id AND n.route_id = m.route_id AND n.type = 'denied_boardings') AS has_denied_boardings
FROM merged m""")
add("c2_route_overlay", "SELECT * FROM overlay")
add("j9_route_overlay_day", """
SELECT o.* EXCLUDE (on_time_rate), d.on_time_rate FROM overlay o
LEFT JOIN (SELECT stop_id, on_time_rate FROM cells WHERE route_id = '28' AND service_date = DATE '2024-01-10') d USING (stop_id)
WHERE o.route_id = '28'""")
add("j10_pick_load", """
SELECT route_id, stop_id, direction_id, ridership_load FROM overlay""")
add("p20_metric_class", """
SELECT route_id, stop_id, CASE WHEN ratio IS NULL THEN '#6b7280' WHEN ratio <= 1 THEN '#16a34a' WHEN ratio <= 1.2 THEN '#ca8a04' ELSE '#dc2626' END AS ratio_color,
  CASE WHEN on_time_rate IS NULL THEN '#9ca3af' WHEN on_time_rate >= 0.8 THEN '#16a34a' WHEN on_time_rate >= 0.6 THEN '#ca8a04' ELSE '#dc2626' END AS on_time_color,
  CASE WHEN bunching_rate IS NULL THEN '#9ca3af' WHEN bunching_rate <= 0.1 THEN '#16a34a' WHEN bunching_rate <= 0.25 THEN '#ca8a04' ELSE '#dc2626' END AS bunching_color,
  CASE WHEN ridership_load IS NULL THEN '#9ca3af' ELSE printf('rgb(%d,%d,%d)', CAST(floor(22 + 198 * t + 0.5) AS INT), CAST(floor(163 - 125 * t + 0.5) AS INT), CAST(floor(74 - 36 * t + 0.5) AS INT)) END AS load_color
FROM (SELECT *, greatest(0, least(1, ridership_load / 30)) AS t FROM overlay)""")
# --- ridership ---------------------------------------------------------------------------------------------
add("s9_ridership", "SELECT route_id, stop_id, stop_sequence, boardings, alightings, load, sample_size FROM ridership")
add("g23_avg_load", "SELECT * FROM loads")
add("g24_ridership_trips", """
SELECT route_id, day_type_id, direction_id, trip_start_time, route_variant, min(day_type_name) AS day_type_name, min(season) AS season,
       min(CASE WHEN day_type_name LIKE '%week%' THEN 0 WHEN day_type_name LIKE '%sat%' THEN 1 ELSE 2 END) AS day_order
FROM ridership GROUP BY 1, 2, 3, 4, 5""")
add("c4_ridership_stops", """
SELECT stop_sequence, stop_id, stop_name, boardings, alightings, load, sample_size FROM ridership
WHERE route_id = '28' AND day_type_id = 'day_type_01' AND direction_id = '1' AND trip_start_time = '08:00:00' AND route_variant = 'A'""")
