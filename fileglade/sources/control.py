"""Control-plane JSON records: exported views and capacity estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileglade.schema import CAPACITY_FIELDS, VIEW_SCHEMA


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """View records from JSON files, one record per line."""
    return spark.read.schema(VIEW_SCHEMA).json(path)


def parse_views(records: DataFrame, column: str = "record") -> DataFrame:
    """View records from a JSON text column."""
    return records.select(F.from_json(F.col(column), VIEW_SCHEMA).alias("r")).select("r.*")


def _filled(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def normalised_views(views: DataFrame) -> DataFrame:
    """One row per view that has a path, in path order."""
    return (
        views.where(F.col("path") != "")
        .select(
            F.coalesce(_filled("name"), _filled("alias"), F.col("path")).alias("name"),
            "path",
            F.coalesce("protocols", F.array().cast("array<string>")).alias("protocols"),
            F.coalesce(_filled("policy_name"), F.col("policy")).alias("policy"),
            F.coalesce(_filled("tenant_name"), F.col("tenant_id")).alias("tenant"),
        )
        .orderBy("path", "name")
    )


def capacity(records: DataFrame, path: str = "path", column: str = "record") -> DataFrame:
    """Capacity estimates, lifted from ``details`` if the record has one, else from the record.

    A ``details`` that is no object lifts nothing. Values keep their JSON text.
    """
    record = F.col(column)
    has_details = F.array_contains(F.json_object_keys(record), "details")
    details = F.get_json_object(record, "$.details")
    source = F.when(has_details & F.startswith(details, F.lit("{")), details).when(
        ~has_details, record
    )
    fields = T.StructType([T.StructField(f, T.StringType()) for f in CAPACITY_FIELDS])
    return records.select(
        F.col(path).alias("path"),
        F.lit(True).alias("available"),
        F.lit(True).alias("estimate"),
        F.from_json(source, fields).alias("lifted"),
    ).select("path", "available", "estimate", "lifted.*")


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def capacity_variant(records: DataFrame, path: str = "path", column: str = "record") -> DataFrame:
    """:func:`capacity` from records parsed once into VARIANT.

    The record is parsed a single time (broken JSON gives nulls), ``details`` is looked up in the
    parsed value, and each estimate is one path lookup, with no JSON text read again. Fields not
    asked for are kept in the value and can be listed by :func:`record_fields`.
    """
    parsed = F.try_parse_json(F.col(column))
    details = F.try_variant_get(parsed, "$.details", "variant")
    source = F.when(details.isNull(), parsed).when(_is_object(details), details)
    return records.select(
        F.col(path).alias("path"),
        F.lit(True).alias("available"),
        F.lit(True).alias("estimate"),
        *[F.try_variant_get(source, f"$.{f}", "string").alias(f) for f in CAPACITY_FIELDS],
    )


def record_fields(records: DataFrame, path: str = "path", column: str = "record") -> DataFrame:
    """path, key, value (JSON text), is_object: one row for every top-level field of every record,
    known or not; records that are no object, or no JSON, have none."""
    spark = records.sparkSession
    parsed = records.select(F.col(path).alias("path"), F.try_parse_json(F.col(column)).alias("v"))
    parsed = parsed.where(_is_object(F.col("v")))
    fields = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return fields.select(
        "path", "key", F.to_json("value").alias("value"), _is_object(F.col("value")).alias("is_object")
    )
