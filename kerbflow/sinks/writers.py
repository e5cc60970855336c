"""Writers: edge tables, map features, stop-metric documents, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions.metrics import stress_color
from kerbflow.operators.streets import WAYS, column

# Fields of a map feature, general and per direction.
GENERAL_FIELDS = ["LTS", "osmid", "name", "highway", "speed", "speed_rule", "centerline", "centerline_rule", "ADT",
                  "ADT_rule", "lane_count", "oneway", "street_narrow_wide", "width_street", "width_street_rule", "zoom"]
WAY_FIELDS = ["bike_allowed", "bike_lane", "separation", "parking", "parking_width", "buffer", "buffer_rule",
              "bike_width", "bike_width_rule", "bike_reach", "LTS_mixed", "LTS_bikelane_noparking",
              "LTS_bikelane_yesparking", "LTS_bike_access", "LTS_separation", "LTS"]


def write_edges(edges: DataFrame, path: str) -> None:
    """Edge stress table as Parquet, one folder per region."""
    edges.write.mode("overwrite").partitionBy("region").parquet(path)


def feature_table(edges: DataFrame) -> DataFrame:
    """Rated edges (stress above 0) with the published fields and the map colour."""
    names = GENERAL_FIELDS + [f"{f}_{way}" for way in WAYS for f in WAY_FIELDS]
    missing = {n: F.lit(None).cast("string") for n in [*names, "geometry"] if n not in edges.columns}
    full = edges.withColumns(missing) if missing else edges
    return full.where(F.col("LTS") > 0).select("geometry", *names, stress_color(F.col("LTS")).alias("color"))


def to_geojson(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature per line."""
    coordinates = F.transform(geometry, lambda p: F.array(p["lon"], p["lat"])) if (
        dict(features.dtypes)[geometry].startswith("array")) else F.lit(None).cast("array<array<double>>")
    shape = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    properties = F.struct(*[column(c) for c in features.columns if c != geometry])
    return features.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties")),
        {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """GeoJSON lines in gzip files: every feature spells out all field names, so they shrink to a small part."""
    to_geojson(features).write.text(path, compression="gzip")


def stop_metric_documents(overall: DataFrame, hourly: DataFrame) -> DataFrame:
    """One document per route: ``overall`` list and ``byHour`` map of lists."""
    item = F.struct("stop_id", "direction_id", "time_point_order", "on_time_rate", "bunching_rate", "n_obs")
    # bounded by the stops of one route
    whole = overall.groupBy("route_id").agg(F.array_sort(F.collect_list(item)).alias("overall"))
    hours = hourly.groupBy("route_id", "hour").agg(F.array_sort(F.collect_list(item)).alias("items"))
    by_hour = hours.groupBy("route_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("hour").cast("string"), "items")))).alias("byHour"))
    return whole.join(by_hour, "route_id", "left")


def write_stop_metrics(overall: DataFrame, hourly: DataFrame, path: str) -> None:
    stop_metric_documents(overall, hourly).write.mode("overwrite").json(path, ignoreNullFields="false")


def write_log(rows: DataFrame, path: str) -> None:
    """Rule, table and tag logs as CSV."""
    rows.write.mode("overwrite").csv(path, header=True)
