"""Rank index of a stored, path-sorted catalog: a page in name order opens the files that hold it.

:func:`~fileglade.sources.catalog.sorted_layout` writes the catalog range-partitioned and sorted
by ``(parent_path, name)``, so in every file the rows of one directory are one stretch of names,
and the stretches of different files do not overlap. The index keeps, for each file, directory
and kind (directory or not), the row count and the first name: one small row per file and
directory, written once beside the table.

A page of a directory in name order (directories first, as listings sort) then needs no sort and
no write: running counts over the directory's index rows tell which files hold the page's
places, only those are read, and a row's place is the count before its file plus its place
among its own kind in that file. A page of 100 rows opens one or two files at any depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileglade.functions.paths import normalize_prefix
from fileglade.operators.listing import Page, page_of
from fileglade.sources.catalog import catalog_reader

__all__ = ["indexed_page", "rank_index"]


def _file():
    return F.col("_metadata.file_path")


def _is_dir():
    return F.coalesce(F.col("element_type") == "DIR", F.lit(False))


def rank_index(stored: DataFrame) -> DataFrame:
    """file, parent_path, is_dir, n, first_name of a stored catalog read from its files."""
    return (
        stored.select("parent_path", "name", _is_dir().alias("is_dir"), _file().alias("file"))
        .groupBy("file", "parent_path", "is_dir")
        .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    )


def indexed_page(
    spark: SparkSession,
    index: DataFrame,
    schema: T.StructType,
    path: str,
    page: int | None = 1,
    page_size: int | None = None,
) -> tuple[DataFrame, Page]:
    """One page of a directory, ascending by name with directories first, from the files that
    hold it; the table must have been written by ``sorted_layout`` and indexed since."""
    prefix = normalize_prefix(path)
    mine = index.where(F.col("parent_path") == prefix)
    total = mine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = page_of(total, page, page_size)
    low, high = wanted.offset, wanted.offset + wanted.size
    order = Window.orderBy(F.col("is_dir").desc(), "first_name")
    placed = mine.withColumn(
        "start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # At most one file for each row of the page, and two more: a handful of rows.
    chosen = placed.where((F.col("start") < high) & (F.col("start") + F.col("n") > low)).select(
        "file", "is_dir", "start"
    ).collect()
    if not chosen:
        return spark.createDataFrame([], schema), wanted
    starts = spark.createDataFrame(
        [(r["file"], r["is_dir"], r["start"]) for r in chosen], "file string, is_dir boolean, start long"
    )
    rows = catalog_reader(spark, schema).parquet(*sorted({r["file"] for r in chosen}))
    within = Window.partitionBy("file", "is_dir").orderBy("name")
    ranked = (
        rows.where(F.col("parent_path") == prefix)
        .select("*", _file().alias("file"), _is_dir().alias("is_dir"))
        .join(F.broadcast(starts), ["file", "is_dir"])
        .withColumn("_place", F.col("start") + F.row_number().over(within) - 1)
    )
    shown = ranked.where((F.col("_place") >= low) & (F.col("_place") < high)).orderBy("_place")
    return shown.select(*schema.fieldNames()), wanted
