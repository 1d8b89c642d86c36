"""Catalog scans: projection and predicates that reach the Parquet reader."""

from __future__ import annotations

import functools
import operator
import os.path

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileglade.functions.paths import normalize_prefix
from fileglade.schema import (
    CATALOG_SCHEMA,
    ELEMENT_FILTERS,
    LISTING_COLUMNS,
    ROLLUP_COLUMNS,
)

PUSHED_PREFIXES = 32


def catalog_reader(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    """Reader with a declared schema; times declared as bigint also accept Parquet nanoseconds."""
    if any(isinstance(f.dataType, T.LongType) for f in schema if f.name in ("mtime", "atime")):
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.schema(schema)


def read_catalog(
    spark: SparkSession, path: str, schema: T.StructType = CATALOG_SCHEMA
) -> DataFrame:
    """The live catalog table. Use CATALOG_SCHEMA_NS for nanosecond times."""
    return catalog_reader(spark, schema).parquet(path)


def sorted_layout(catalog: DataFrame) -> DataFrame:
    """Rows in path order, so that file and page statistics prune directory and subtree reads.

    The range key includes the name: one directory with a third of all rows is cut into many
    partitions like any other stretch of the order.
    """
    return catalog.repartitionByRange("parent_path", "name").sortWithinPartitions(
        "parent_path", "name"
    )


def scan(catalog: DataFrame, columns: list[str], predicate: Column | None = None) -> DataFrame:
    rows = catalog if predicate is None else catalog.where(predicate)
    return rows.select(*columns)


def element_predicate(element: str) -> Column | None:
    """Type filter. A null type counts as other, like everything that is no file or directory."""
    if element not in ELEMENT_FILTERS:
        raise ValueError(f"unknown element filter {element!r}, use one of {ELEMENT_FILTERS}")
    kind = F.col("element_type")
    return {
        "all": None,
        "file": kind == "FILE",
        "dir": kind == "DIR",
        "other": F.coalesce(~kind.isin("FILE", "DIR"), F.lit(True)),
    }[element]


def directory_rows(
    catalog: DataFrame,
    path: str,
    element: str = "all",
    name_contains: str = "",
    columns: list[str] = LISTING_COLUMNS,
) -> DataFrame:
    """Rows of one directory. The name filter is a literal, case-sensitive substring."""
    rows = catalog.where(F.col("parent_path") == normalize_prefix(path))
    wanted = element_predicate(element)
    if wanted is not None:
        rows = rows.where(wanted)
    text = name_contains.strip()
    if text:
        rows = rows.where(F.col("name").contains(text))
    return rows.select(*columns)


def subtree_files(
    catalog: DataFrame, prefix: str, columns: list[str] = ROLLUP_COLUMNS
) -> DataFrame:
    """FILE rows anywhere below a directory."""
    below = F.col("parent_path").startswith(normalize_prefix(prefix))
    return catalog.where((F.col("element_type") == "FILE") & below).select(*columns)


def under_any(prefixes: list[str]) -> Column:
    """Row filter for several subtrees, in a form the Parquet reader takes.

    Beyond a few prefixes it is their common beginning: a coarse filter that keeps every wanted
    row and leaves the exact choice to a join.
    """
    tests = prefixes if len(prefixes) <= PUSHED_PREFIXES else [os.path.commonprefix(prefixes)]
    below = [F.col("parent_path").startswith(p) for p in tests]
    return functools.reduce(operator.or_, below, F.lit(False))


def _after(prefix: str) -> str:
    """The least text greater than every text that starts with ``prefix``."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def prefix_ranges(prefixes: list[str]) -> list[tuple[str, str]]:
    """Sorted, disjoint ``[low, high)`` ranges of texts holding exactly the texts that start with
    one of the prefixes; a prefix inside another adds nothing."""
    ranges: list[tuple[str, str]] = []
    for prefix in sorted(set(prefixes)):
        if ranges and prefix.startswith(ranges[-1][0]):
            continue
        ranges.append((prefix, _after(prefix)))
    return ranges


def in_ranges(column: str, ranges: list[tuple[str, str]]) -> Column:
    """Row filter for a list of ranges, as a balanced tree of comparisons the Parquet reader takes."""
    tests = [(F.col(column) >= low) & (F.col(column) < high) for low, high in ranges]
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + ([tests[-1]] if len(tests) % 2 else [])
    return tests[0]


def innermost_intervals(prefixes: list[str]) -> list[tuple[str, str]]:
    """Sorted disjoint intervals ``(start, prefix)``: from ``start`` on, up to the next start,
    texts belong to the innermost of the prefixes that hold them (an empty prefix: none).

    Nested prefixes cut their outer range into pieces, so there are at most twice as many
    intervals as prefixes and a text finds its innermost prefix by one search.
    """
    points: list[tuple[str, str]] = []
    stack: list[str] = []
    for prefix in sorted(set(prefixes)):
        while stack and not prefix.startswith(stack[-1]):
            done = stack.pop()
            points.append((_after(done), stack[-1] if stack else ""))
        points.append((prefix, prefix))
        stack.append(prefix)
    while stack:
        done = stack.pop()
        points.append((_after(done), stack[-1] if stack else ""))
    merged: dict[str, str] = {}
    for start, owner in points:
        merged[start] = owner  # the last word on a start holds from there on
    return sorted(merged.items())


def innermost_prefix(column: Column, intervals: list[tuple[str, str]]) -> Column:
    """The innermost prefix holding the text, by binary search in the intervals; null if none."""
    if not intervals:
        return F.lit(None).cast("string")
    starts = F.array(*[F.lit(s) for s, _ in intervals])
    owners = F.array(*[F.lit(o) for _, o in intervals])
    steps = max(1, (len(intervals)).bit_length())

    def step(acc: Column, _: Column) -> Column:
        middle = ((acc["low"] + acc["high"] + 1) / 2).cast("int")
        fits = (middle >= 1) & F.coalesce(F.get(starts, middle - 1) <= column, F.lit(False))
        return F.struct(
            F.when(fits, middle).otherwise(acc["low"]).alias("low"),
            F.when(fits, acc["high"]).otherwise(middle - 1).alias("high"),
        )

    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(intervals)).alias("high")), step
    )["low"]
    owner = F.get(owners, found - 1)
    return F.when((found > 0) & (owner != ""), owner)


def child_directories(catalog: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Names of the immediate child directories, in name order if a limit is set."""
    names = directory_rows(catalog, path, "dir", columns=["name"])
    return names if limit is None else names.orderBy("name").limit(limit)
