"""Listing of one directory: filter, cap, count, sort, page - in that order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileglade.functions.text import iso_time
from fileglade.operators.ordering import DEEP_PAGE_ROWS, nth_smallest, sorted_slice
from fileglade.schema import (
    LISTING_COLUMNS,
    PAGE_DEFAULT,
    PAGE_MAX,
    PAGE_MIN,
    SORT_KEYS,
)
from fileglade.sources.catalog import directory_rows


@dataclass(frozen=True)
class Page:
    number: int
    size: int
    pages: int

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size


def page_of(total: int, page: int | None = 1, page_size: int | None = None) -> Page:
    """Clamp a page request to the pages that exist; an empty listing has one page."""
    size = PAGE_DEFAULT if page_size is None else int(page_size)
    size = min(max(size, PAGE_MIN), PAGE_MAX)
    pages = max(1, (total + size - 1) // size)
    return Page(min(max(int(page or 1), 1), pages), size, pages)


def sort_order(sort: str = "name", order: str = "asc") -> list[Column]:
    """Sort columns, nulls last both ways.

    By name, directories come first whatever the direction. Other keys only use that to break ties.
    """
    key = sort if sort in SORT_KEYS else "name"
    descending = order in ("desc", "descending")
    column = F.col(key)
    ordered = column.desc_nulls_last() if descending else column.asc_nulls_last()
    no_directory = (F.col("element_type") != "DIR").asc_nulls_last()
    if key == "name":
        return [no_directory, ordered]
    return [ordered, no_directory, F.col("name").asc_nulls_last()]


def type_counts(rows: DataFrame) -> DataFrame:
    """One row: all elements, directories, files and the rest."""
    kind = F.col("element_type")
    counted = rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(kind == "DIR").alias("total_dirs"),
        F.count_if(kind == "FILE").alias("total_files"),
    )
    rest = F.col("total_rows") - F.col("total_dirs") - F.col("total_files")
    return counted.withColumn("total_other", rest)


def entries(rows: DataFrame) -> DataFrame:
    """Listing columns with ISO times, as shown on a page."""
    shown = {c: F.col(c) for c in LISTING_COLUMNS}
    shown["mtime"] = iso_time(rows, "mtime")
    shown["atime"] = iso_time(rows, "atime")
    return rows.select(*[column.alias(name) for name, column in shown.items()])


@dataclass(frozen=True)
class Listing:
    """Filtered, capped rows of one directory with their counts."""

    rows: DataFrame
    total_rows: int
    total_dirs: int
    total_files: int
    total_other: int
    truncated: bool
    deep_page_rows: int = DEEP_PAGE_ROWS

    def sorted_rows(self, sort: str = "name", order: str = "asc") -> DataFrame:
        return self.rows.orderBy(*sort_order(sort, order))

    def page(
        self,
        page: int | None = 1,
        page_size: int | None = None,
        sort: str = "name",
        order: str = "asc",
    ) -> tuple[DataFrame, Page]:
        """One page. Up to ``deep_page_rows`` leading rows are a top-k in each task; a page beyond
        comes from a range sort with counted partitions, so no task holds what is before it."""
        wanted = page_of(self.total_rows, page, page_size)
        ordered = sort_order(sort, order)
        if wanted.offset + wanted.size <= self.deep_page_rows:
            rows = self.rows.orderBy(*ordered).offset(wanted.offset).limit(wanted.size)
        else:
            rows = sorted_slice(self.rows, ordered, wanted.offset, wanted.size)
        return rows, wanted


def open_listing(
    catalog: DataFrame,
    path: str,
    element: str = "all",
    name_contains: str = "",
    cap: int | None = None,
) -> Listing:
    """Count one directory and, if a cap is asked for, cut it in name order.

    The cap is a cut-off name, found by counting, and so a plain filter that the scan takes: no
    ordered limit of ``cap`` rows per task is ever built. Directories within the cap are counted
    once and left alone.
    """
    rows = directory_rows(catalog, path, element, name_contains)
    counts = type_counts(rows).first()
    truncated = cap is not None and counts["total_rows"] > cap
    if truncated:
        last = nth_smallest(rows, "name", cap, counts["total_rows"])
        rows = rows.where(F.col("name") <= last)
        counts = type_counts(rows).first()
    return Listing(rows=rows, truncated=truncated, **counts.asDict())
