"""Floating-point result columns of each query, rounded alike on both sides of a comparison."""

DOUBLES = {
    "p13_clean_arrivals": "scheduled_sec actual_sec local_hour",
    "p15_bunching_threshold": "threshold",
    "w1_fill_actual_headway": "scheduled_sec actual_sec prev_scheduled_sec actual_headway_sec",
    "w2_headway_records": "scheduled_sec local_hour prev_scheduled_sec actual_headway_sec scheduled_headway_sec",
    "w3_scheduled_diffs": "gap",
    "w4_dedupe_points": "scheduled_sec actual_sec",
    "w9_worst_stops": "bunching_rate",
    "g4_stop_day_metrics": "on_time_rate bunching_rate median_scheduled_headway_sec median_actual_headway_sec",
    "g5_stop_metrics": "on_time_rate bunching_rate",
    "g6_stop_metrics_by_hour": "on_time_rate bunching_rate",
    "g7_route_comparison": "on_time_rate bunching_rate",
    "g8_reliability_summary": "on_time_rate bunching_rate",
    "g9_trips_per_day": "median_per_day mean_per_day",
    "g13_trip_summaries": "first_sched_sec trip_min sched_trip_min",
    "g13_trip_series": "first_sched_sec trip_min sched_trip_min",
    "g16_observed_headways": "observed_median_min p25_min p75_min bunching_rate csv_scheduled_min",
    "g16_observed_fallback": "observed_median_min p25_min p75_min bunching_rate csv_scheduled_min",
    "g17_headway_grains": "median_actual_sec",
    "g18_route_stop_headways": "scheduled_median_min actual_median_min ratio",
    "g19_heatmap_cells": "on_time_rate",
    "g20_on_time_day": "on_time_rate",
    "r7_hour_slice": "scheduled_sec actual_sec",
    "r8_headway_window": "scheduled_sec local_hour prev_scheduled_sec actual_headway_sec scheduled_headway_sec",
    "r9_min_samples": "on_time_rate bunching_rate median_scheduled_headway_sec median_actual_headway_sec",
    "r10_guarded_semi": "on_time_rate",
    "r11_overlay_filter": "scheduled_median_min actual_median_min ratio",
    "c3_drilldown": "scheduled_sec actual_sec delay_sec",
    "c8_trip_calendar": "first_sched_sec trip_min sched_trip_min day_fraction",
    "t1_arrivals_sorted": "scheduled_sec actual_sec",
    "t4_trip_series_order": "first_sched_sec trip_min sched_trip_min",
    "t5_drilldown_order": "delay_sec",
    "j11_with_stop_names": "on_time_rate",
    "x6_reliability_report": "on_time_rate bunching_rate",
    "g15_scheduled_headways": "scheduled_median_min",
    "g32_route_bounds": "min_lon min_lat max_lon max_lat",
    "j5_stops_near": "stop_lat stop_lon",
    "t3_nearest_stops": "stop_lat stop_lon",
    "w6_shape_distance": "cum_dist_m",
    "c1_scorecard": "effective_min observed_median_min p25_min p75_min bunching_rate ratio",
    "t2_scorecard_order": "effective_min observed_median_min p25_min p75_min bunching_rate ratio",
    "c9_routes_with_delay": "ratio",
    "j7_merge_headways": "scheduled_median_min observed_median_min csv_scheduled_min effective_min ratio",
    "j8_with_crowding": "ratio",
    "c2_route_overlay": "scheduled_median_min actual_median_min ratio lat lon on_time_rate bunching_rate ridership_load",
    "j9_route_overlay_day": "scheduled_median_min actual_median_min ratio lat lon bunching_rate ridership_load on_time_rate",
    "j10_pick_load": "ridership_load",
    "s9_ridership": "boardings alightings load",
    "g23_avg_load": "load",
    "c4_ridership_stops": "boardings alightings load",
    "p9_parking_width": "parking_width_left parking_width_right",
    "r3_parse_directions": "parking_width_fwd parking_width_rev",
    "p6_width_feet": "ft",
    "p7_widths": "width_street bike_width_fwd bike_width_rev buffer_fwd buffer_rev bike_reach_fwd bike_reach_rev",
    "x5_edge_stress": "width_street bike_reach_fwd bike_reach_rev",
    "g2_node_lts": "x y",
    "p12_travel_minutes": "minutes",
    "s4_edge_csv": "length",
    "s5_node_csv": "x y",
    "s3_segmentize": "length",
    "x3_isochrone": "minutes",
    "p22_reach_share": "share1 share2 share3 share4",
    "j12_nearest_node": "distance",
    "x4_isochrone_grid": "lon lat",
    "p19_local_service_sec": "s_sec local_sec",
    "w5_dedupe_fill": "scheduled_sec actual_sec",
    "w7_monotone_distance": "dist_m",
    "c5_trip_timelines": "first_sched_sec last_sched_sec first_actual_sec last_actual_sec",
    "c5_timeline_summary": "min_sched_sec max_sched_sec",
    "g31_trip_lateness": "lateness_sec",
    "j14_positions_at": "sched_dist_m actual_dist_m",
    "c7_vehicle_positions": "sched_dist_m actual_dist_m sched_lon sched_lat actual_lon actual_lat",
    "c6_route_segments": "first_lon",
    "k3_stop_metric_documents": "on_time_rate bunching_rate",
    "s11_stop_metric_hour": "on_time_rate bunching_rate",
    "s12_photo_points": "lon lat",
}


def digits_of(column: str, query: str = "") -> int:
    """Computed metres are compared to the millimetre, everything else, and what is only passed through, to six digits."""
    if query == "s4_edge_csv":
        return 6
    return 3 if column in ("length", "distance") or column.endswith("dist_m") else 6
