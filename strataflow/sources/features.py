"""Readers of map features and records from files and service answers: one row a feature or record.

Documents are read whole, one row a file (they are answers of services, of bounded pages); files that can't be parsed
give no rows. Geometry stays JSON text, so that any kind fits one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Point elevations at or below this mean no data.
NO_DATA = -1000.0


def documents(spark: SparkSession, folder: str, whitelist: DataFrame | None = None, key: str = "source_id") -> DataFrame:
    """name, key and json of the JSON documents of a folder, by name; with a whitelist (key) only its documents."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").endswith(".json"))
    rows = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.decode("content", "utf-8").alias("json"))
    rows = rows.select("name", F.get_json_object("json", f"$.{key}").alias(key), "json").where(F.try_parse_json("json").isNotNull())
    return rows if whitelist is None else rows.join(whitelist.select(key), key, "left_semi")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (of geometry), geometry and properties (JSON text) of the features of feature collections."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    features = F.explode(F.try_variant_get("v", "$.features", "array<variant>"))
    rows = files.select("path", features.alias("f"))
    return rows.select("path", F.try_variant_get("f", "$.geometry.type", "string").alias("kind"), F.to_json(F.try_variant_get("f", "$.geometry", "variant")).alias("geometry"), F.to_json(F.try_variant_get("f", "$.properties", "variant")).alias("properties"))


def esri_features(answers: DataFrame, json: str) -> DataFrame:
    """The columns of answers, properties, x, y and rings of each feature of a feature service's answer, in its own form
    (attributes and x, y or rings) or as GeoJSON; and more: whether the service holds features beyond its limit."""
    v = F.try_parse_json(json)
    rows = answers.withColumn("__v", v).where("__v is not null")
    more = F.coalesce(F.try_variant_get("__v", "$.exceededTransferLimit", "boolean"), F.try_variant_get("__v", "$.properties.exceededTransferLimit", "boolean"), F.lit(False))
    rows = rows.withColumn("more", more).withColumn("__f", F.explode(F.try_variant_get("__v", "$.features", "array<variant>")))
    get = lambda path, kind: F.try_variant_get("__f", path, kind)
    properties = F.to_json(F.coalesce(get("$.attributes", "variant"), get("$.properties", "variant")))
    point = F.when(get("$.geometry.type", "string") == "Point", get("$.geometry.coordinates", "array<double>"))
    rings = F.coalesce(get("$.geometry.rings", "array<array<array<double>>>"), F.when(get("$.geometry.type", "string") == "Polygon", get("$.geometry.coordinates", "array<array<array<double>>>")))
    return rows.select(*answers.columns, properties.alias("properties"), F.coalesce(get("$.geometry.x", "double"), F.get(point, 0)).alias("x"), F.coalesce(get("$.geometry.y", "double"), F.get(point, 1)).alias("y"), rings.alias("rings"), "more")


def matrix_records(answers: DataFrame, json: str, field: str = "Table") -> DataFrame:
    """The columns of answers and record, a map from column name to text, of tables that come as a row of names and rows
    of values."""
    table = F.from_json(F.get_json_object(json, f"$.{field}"), "array<array<string>>")
    rows = answers.withColumn("__t", table).where(F.size("__t") > 1)
    made = F.explode(F.slice("__t", 2, F.size("__t")))
    return rows.select(*answers.columns, F.get("__t", 0).alias("__names"), made.alias("__row")).where(F.size("__names") == F.size("__row")).select(*answers.columns, F.map_from_arrays("__names", "__row").alias("record"))


def elevation(json: Column, path: str = "$.value") -> Column:
    """A point's elevation in feet, null where the service has no data."""
    value = F.get_json_object(json, path).try_cast("double")
    return F.when(value > NO_DATA, value)


def number_or_null(text: Column) -> Column:
    """A finite number, null for empty and other text."""
    value = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes and sha256 of the files of a folder, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("name")


def feature_collection(df: DataFrame, x: str, y: str) -> DataFrame:
    """Each row as a GeoJSON point feature in a column json; null fields are left out, rows without a place go."""
    properties = F.struct(*(F.col(c) for c in df.columns if c not in (x, y)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.to_json(feature).alias("json"))
