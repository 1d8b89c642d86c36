"""Declared schemas, column lists and default limits."""

from __future__ import annotations

from pyspark.sql import types as T


def _catalog_schema(time_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("parent_path", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("element_type", T.StringType()),
            T.StructField("size", T.LongType()),
            T.StructField("used", T.LongType()),
            T.StructField("mtime", time_type),
            T.StructField("atime", time_type),
            T.StructField("owner_name", T.StringType()),
            T.StructField("extension", T.StringType()),
            T.StructField("nlinks", T.LongType()),
        ]
    )


# One row per file, directory or other element; (parent_path, name) identifies a row.
CATALOG_SCHEMA = _catalog_schema(T.TimestampNTZType())

# The same table with times as epoch nanoseconds. Parquet TIMESTAMP(NANOS) reads into it
# under spark.sql.legacy.parquet.nanosAsLong=true.
CATALOG_SCHEMA_NS = _catalog_schema(T.LongType())

# Columns and sort keys of a listing, as callers name them.
LISTING_COLUMNS = [
    "name",
    "element_type",
    "size",
    "used",
    "mtime",
    "atime",
    "owner_name",
    "extension",
    "nlinks",
]
ROLLUP_COLUMNS = ["parent_path", "size", "used", "atime", "mtime"]
SORT_KEYS = ("name", "size", "mtime", "atime", "owner_name")
ELEMENT_FILTERS = ("all", "file", "dir", "other")

# Default limits.
PAGE_MIN = 20
PAGE_DEFAULT = 20
PAGE_MAX = 100
ROLLUP_MAX_GROUPS = 10_000
ROLLUP_MAX_DEPTH = 8
PREFETCH_CHILDREN = 8
TREE_CHILDREN = 100
FRONTIER_DEPTH = 2

VIEW_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("protocols", T.ArrayType(T.StringType())),
        T.StructField("policy_name", T.StringType()),
        T.StructField("policy", T.StringType()),
        T.StructField("tenant_name", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
    ]
)

CAPACITY_FIELDS = ("logical", "unique", "usable", "percent", "average_atime")
