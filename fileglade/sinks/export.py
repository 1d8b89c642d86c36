"""CSV exports of listings and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileglade.functions.paths import slug
from fileglade.functions.text import iso_time, spreadsheet_safe
from fileglade.operators.listing import Listing, sort_order
from fileglade.operators.rollup import ranked
from fileglade.schema import LISTING_COLUMNS


def csv_safe(frame: DataFrame) -> DataFrame:
    """All text columns with spreadsheet formulas neutralised; other types as they are."""
    return frame.select(
        *[
            spreadsheet_safe(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in frame.schema
        ]
    )


def listing_export(rows: DataFrame, sort: str = "name", order: str = "asc") -> DataFrame:
    """The rows of a listing CSV: sorted, times as ISO text, unknown times left null."""
    times = {
        c: F.when(F.col(c).isNotNull(), iso_time(rows, c)).alias(c) for c in ("mtime", "atime")
    }
    shown = rows.orderBy(*sort_order(sort, order)).select(
        *[times.get(c, F.col(c)) for c in LISTING_COLUMNS]
    )
    return csv_safe(shown)


def rollup_export(groups: DataFrame) -> DataFrame:
    """The rows of a rollup CSV: every group, not only the largest."""
    return csv_safe(
        ranked(groups).select(
            F.col("name").alias("folder"),
            "file_count",
            "total_bytes",
            "total_used",
            "last_modified",
            "last_accessed",
        )
    )


def manifest(frame: DataFrame, path: str, rows: int, truncated: bool) -> DataFrame:
    """One row describing a listing export."""
    return frame.sparkSession.createDataFrame(
        [(slug(path), output_name(path, truncated), rows, truncated)],
        "slug string, output string, row_count bigint, truncated boolean",
    )


def output_name(path: str, truncated: bool) -> str:
    """Folder name of a listing export; incomplete data shows in the name."""
    return f"listing-{slug(path)}" + ("-TRUNCATED" if truncated else "")


def write_csv(frame: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """CSV parts in row order (part numbers follow the sort). Text is quoted, blanks are kept."""
    frame.write.mode(mode).csv(
        folder,
        header=True,
        quoteAll=True,
        escape='"',
        nullValue="",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def export_listing(
    listing: Listing, path: str, folder: str, sort: str = "name", order: str = "asc"
) -> str:
    """Write a listing and its manifest; returns the folder of the CSV parts."""
    target = f"{folder.rstrip('/')}/{output_name(path, listing.truncated)}"
    write_csv(listing_export(listing.rows, sort, order), target)
    described = manifest(listing.rows, path, listing.total_rows, listing.truncated)
    described.coalesce(1).write.json(f"{target}.manifest")
    return target


def export_rollup(groups: DataFrame, path: str, folder: str) -> str:
    target = f"{folder.rstrip('/')}/rollup-{slug(path)}"
    write_csv(rollup_export(groups), target)
    return target
