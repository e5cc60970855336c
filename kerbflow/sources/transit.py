"""Readers for arrivals, schedule feeds, ridership, annotations and stop-metric documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbflow.functions import clock

# Arrivals columns by position.
ARRIVAL_COLUMNS = ["service_date", "route_id", "direction_id", "half_trip_id", "stop_id", "time_point_id",
                   "time_point_order", "point_type", "standard_type", "scheduled", "actual", "scheduled_headway", "headway"]
# Ridership columns by position.
RIDERSHIP_COLUMNS = ["season", "route_id", "route_variant", "direction_id", "trip_start_time", "day_type_id",
                     "day_type_name", "stop_name", "stop_id", "stop_sequence", "boardings", "alightings", "load",
                     "sample_size"]
# Feed files with the columns read; the first is the key a row must have.
GTFS_COLUMNS = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "routes": ["route_id", "route_short_name", "route_long_name"],
    "trips": ["trip_id", "route_id", "service_id", "shape_id", "direction_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
                 "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _positional(spark: SparkSession, path: str, names: list[str], **options: str) -> DataFrame:
    """CSV columns by position; the header is skipped and rows with too few fields are dropped."""
    schema = _text_schema(names).add("_short", T.StringType())
    rows = spark.read.schema(schema).csv(
        path, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_short", **options)
    # a row with more fields than listed is complete; only a row with fewer is dropped. Commas within quotes don't count
    unquoted = F.regexp_replace("_short", '"(?:[^"]|"")*"', "")
    fields = F.size(F.split(unquoted, ","))
    return rows.where(F.col("_short").isNull() | (fields >= len(names))).select(*names)


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Stop arrivals; ``path`` may be a file or a folder of months."""
    raw = _positional(spark, path, ARRIVAL_COLUMNS)
    whole = lambda c: F.col(c).try_cast("double").try_cast("int")
    return raw.withColumns({
        "service_date": clock.service_date(F.col("service_date")),
        "time_point_order": whole("time_point_order"),
        "scheduled_headway": whole("scheduled_headway"),
        "headway": whole("headway"),
    })


def read_ridership(spark: SparkSession, path: str) -> DataFrame:
    raw = _positional(spark, path, RIDERSHIP_COLUMNS, quote='"', escape='"')
    number = {c: F.col(c).try_cast("double") for c in ("boardings", "alightings", "load")}
    whole = {c: F.col(c).try_cast("int") for c in ("stop_sequence", "sample_size")}
    return raw.withColumns(number | whole)


def _or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where its path is not there."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_gtfs(spark: SparkSession, folder: str, suffix: str = ".txt") -> dict[str, DataFrame]:
    """The seven feed tables, by header name; a missing file is an empty table, a missing column NULL.

    Rows without their key are dropped. Defaults: departure = arrival, sequence ``0``, exception ``1``.
    """
    feed = {}
    for name, wanted in GTFS_COLUMNS.items():
        raw = _or_none(lambda path=f"{folder}/{name}{suffix}": spark.read.csv(
            path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
        if raw is None:
            feed[name] = spark.createDataFrame([], _text_schema(wanted))
            continue
        plain = {c.strip().lstrip("﻿"): c for c in raw.columns}
        table = raw.select(*[(F.col(f"`{plain[c]}`") if c in plain else F.lit(None)).cast("string").alias(c)
                             for c in wanted])
        feed[name] = table.where(F.coalesce(wanted[0], F.lit("")) != "")
    times = feed["stop_times"].withColumns({
        "departure_time": F.coalesce("departure_time", "arrival_time"),
        "stop_sequence": F.coalesce("stop_sequence", F.lit("0")).try_cast("int")})
    feed["stop_times"] = times
    feed["stops"] = feed["stops"].withColumns({c: F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon")})
    feed["calendar_dates"] = feed["calendar_dates"].withColumn("exception_type", F.coalesce("exception_type", F.lit("1")))
    numbers = {c: F.col(c).try_cast("double") for c in ("shape_pt_lat", "shape_pt_lon")}
    feed["shapes"] = feed["shapes"].withColumns(numbers | {"shape_pt_sequence": F.col("shape_pt_sequence").try_cast("int")})
    return feed


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Crowding notes from a JSON array or ``{"annotations": [...]}``; malformed entries are skipped."""
    entry = "struct<stopId: string, routeId: string, type: string>"
    schema = f"stopId string, routeId string, type string, annotations array<{entry}>"
    empty = "stop_id string, route_id string, type string"
    docs = _or_none(lambda: spark.read.schema(schema).json(path, multiLine=multi_line))
    if docs is None:
        return spark.createDataFrame([], empty)
    own = F.when(F.col("annotations").isNull(), F.array(F.struct("stopId", "routeId", "type")))
    rows = docs.select(F.explode(F.coalesce("annotations", own)).alias("e"))
    return rows.select(F.col("e.stopId").alias("stop_id"), F.col("e.routeId").alias("route_id"), F.col("e.type").alias("type")
                       ).where(F.col("stop_id").isNotNull() & F.col("route_id").isNotNull() & F.col("type").isNotNull())


STOP_METRIC = ("stop_id string, direction_id string, time_point_order int, on_time_rate double, bunching_rate double, "
               "n_obs bigint")


def read_stop_metrics(spark: SparkSession, path: str, hour: int | None = None) -> DataFrame:
    """Stop metrics of each document: the wanted hour where a document has it, else its overall list."""
    item = f"array<struct<{STOP_METRIC.replace(' ', ': ').replace(',: ', ', ')}>>"
    docs = spark.read.schema(f"route_id string, overall {item}, byHour map<string, {item}>").json(path)
    chosen = F.col("overall")
    if hour is not None and 0 <= hour <= 23:
        chosen = F.coalesce(F.try_element_at("byHour", F.lit(str(hour))), chosen)
    return docs.select("route_id", F.explode(chosen).alias("m")).select("route_id", "m.*")
