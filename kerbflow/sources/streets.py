"""Readers for raw map documents, edge and node tables, and photo metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbflow.functions.skew import bucketed_row_number, bucketed_running
from kerbflow.operators.streets import edge_schema

OSM_ELEMENT = "elements array<struct<type: string, id: bigint, nodes: array<bigint>, lat: double, lon: double, tags: map<string, string>>>"
NODE_SCHEMA = "osmid bigint, x double, y double, street_count int, highway string, ref string"


ELEMENT = "id bigint, nodes array<bigint>, lat double, lon double, tags map<string, string>"
#: what follows the key "type" of an element, where ids are numbers; tags are texts and members have a "ref"
ELEMENT_START = r'^\s*:\s*"(node|way|relation)"\s*,\s*"id"\s*:\s*-?[0-9]'


def read_osm_elements(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Elements of map documents: one document per file, or one per line with ``multi_line=False``."""
    docs = spark.read.schema(OSM_ELEMENT).json(path, multiLine=multi_line)
    return docs.select(F.explode("elements").alias("e")).select("e.*")


def read_osm_split(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Elements of one kind (``way`` or ``node``) of map documents of any size and line layout, each file read by many tasks.

    The files are cut before the value of every key or text "type", which stands first in an element and before its numeric
    id, as map services write it; a document laid out otherwise raises an error. Nothing else is cut but
    a text that ends in a quote mark and "type". Nearly every piece then is an element, with the beginning of the next one behind it, which
    the JSON parser does not look at. Only elements that have "type" among their tags come in several pieces; those pieces alone are
    shuffled, numbered by file, block and place, and put together.
    """
    begin = F.regexp_extract("value", ELEMENT_START, 1)
    pieces = spark.read.text(path, lineSep='"type"').select(
        F.when(F.col("value").rlike(r'"elements"\s*:\s*\[') & ~F.col("value").rlike(r'"elements"\s*:\s*\[\s*(\{\s*$|\])'),
               F.raise_error(F.lit("an element does not begin with its type: read this document with multi_line=True")))
        .otherwise(F.col("value")).alias("value"),
        F.nullif(begin, F.lit("")).alias("kind"), F.col("value").rlike(r"([,:]|:\s*\{)\s*$|\\$").alias("cut"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    own = F.col("kind") == kind
    whole = pieces.where(own & ~F.col("cut")).select("value")
    # what is left: elements that go on in the next piece, relations, and all pieces that begin no element
    parts = pieces.where(F.col("kind").isNull() | (F.col("kind") == "relation") | F.col("cut"))
    parts = parts.withColumn("_start", F.when(F.col("kind").isNotNull(), F.struct("block", "place", "kind")))
    parts = bucketed_running(parts, ["file"], F.struct("block", F.floor(F.col("place") / 4096).alias("_some")), ["block", "place"],
                             "_start", "_of", "max").where(F.col("_of.kind") == kind)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"])
    joined = parts.groupBy("file", "_of").agg(F.array_join(texts, '"type"').alias("value")).select("value")
    element = F.from_json(F.concat(F.lit('{"type"'), F.col("value")), ELEMENT)
    return whole.unionByName(joined).select(element.alias("e")).select("e.*").where(F.col("id").isNotNull())


def _elements(spark: SparkSession, path: str, kind: str, multi_line: bool | None) -> DataFrame:
    if multi_line is None:
        return read_osm_split(spark, path, kind)
    return read_osm_elements(spark, path, multi_line).where(F.col("type") == kind)


def read_osm_ways(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Ways of map documents with their tags, also of one large document in parallel.

    ``multi_line`` reads documents whole: one per file, or one per line with ``False``.
    """
    return _elements(spark, path, "way", multi_line).select(
        F.col("id").alias("way_id"), "nodes", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))


def read_osm_nodes(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return _elements(spark, path, "node", multi_line).select(
        F.col("id").alias("osmid"), F.col("lon").alias("x"), F.col("lat").alias("y"),
        F.try_element_at("tags", F.lit("highway")).alias("highway"))


def parse_wkt_line(wkt: Column) -> Column:
    """``LINESTRING (lon lat, ...)`` to an array of (lon, lat)."""
    inside = F.regexp_extract(wkt, r"\(([^)]*)\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(inside, ","), lambda p: F.struct(
        pair(p)[0].try_cast("double").alias("lon"), F.get(pair(p), F.lit(1)).try_cast("double").alias("lat")))


def wkt_line(points: Column) -> Column:
    text = F.transform(points, lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(text, ", "), F.lit(")"))


def read_edges(spark: SparkSession, path: str, tags: list[str], header: list[str]) -> DataFrame:
    """Edge table from CSV, pruned to the key columns and ``tags``; a quote-quote field is NULL.

    ``header`` is the file's column order: only listed columns are parsed.
    """
    wanted = {f.name: f for f in edge_schema(tags).fields}
    schema = T.StructType([wanted.get(c, T.StructField(c, T.StringType())) for c in header])
    raw = spark.read.schema(schema).csv(path, header=True, nullValue="''", quote='"', escape='"')
    kept = [F.col(f"`{c}`") for c in header if c in wanted]
    if "geometry" in header:
        kept.append(parse_wkt_line(F.col("geometry")).alias("geometry"))
    return raw.select(*kept)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).csv(path, header=True)


def photo_points(meta: DataFrame) -> DataFrame:
    """Photo metadata to point rows: entries without a position dropped, numbered in file order, by time.

    ``meta`` has ``entry_no`` (position in the source) and the metadata fields. The number of photos before
    an entry comes from bucket counts, so no single task numbers the whole collection.
    """
    located = meta.where(F.col("GPSLatitude").isNotNull() & F.col("GPSLongitude").isNotNull())
    numbered = bucketed_row_number(located, [], F.floor(F.col("entry_no") / 1024), ["entry_no"], "_n")
    taken = F.coalesce("DateTimeOriginal", "CreateDate", F.lit(""))
    return numbered.select(
        (F.col("_n") - 1).alias("id"), F.col("GPSLongitude").cast("double").alias("lon"),
        F.col("GPSLatitude").cast("double").alias("lat"),
        F.coalesce("FileName", F.regexp_extract("SourceFile", r"([^/]*)$", 1)).alias("filename"),
        taken.alias("datetime"), F.col("GPSAltitude").alias("altitude"),
        F.coalesce("Make", F.lit("")).alias("make"), F.coalesce("Model", F.lit("")).alias("model"),
    ).orderBy("datetime", "id")


PHOTO_SCHEMA = ("SourceFile string, FileName string, GPSLatitude double, GPSLongitude double, GPSAltitude double, "
                "DateTimeOriginal string, CreateDate string, Make string, Model string")


def read_photo_meta(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Extracted photo metadata documents; ``entry_no`` follows file path and position.

    A task reads one stretch of a file in order, but tasks do not follow the order of the files. So stretches are
    numbered by path and offset (one row each), and rows by their place within the stretch.
    """
    rows = spark.read.schema(PHOTO_SCHEMA).json(path, multiLine=multi_line).select(
        "*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_stretch"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    number = F.row_number().over(Window.orderBy("_stretch"))
    stretches = rows.select("_stretch").distinct().withColumn("_number", number.cast("bigint"))
    return rows.join(stretches, "_stretch").withColumn("entry_no", F.shiftleft("_number", 33) + F.col("_place")).drop(
        "_stretch", "_number", "_place")
