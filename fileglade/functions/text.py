"""Text for people and spreadsheets: sizes, times, safe cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size units in ascending order, each 1024 times the one before.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
NO_VALUE = "—"

# First characters that make a spreadsheet read a cell as a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r", "\n")

_NS = 1_000_000_000
_DAY = 86_400


def iso_from_nanos(nanos: Column) -> Column:
    """Epoch nanoseconds as ``YYYY-MM-DDTHH:MM:SS.nnnnnnnnn``; null gives an empty text."""
    fraction = F.pmod(nanos, F.lit(_NS))
    seconds = F.call_function("div", nanos - fraction, F.lit(_NS))
    second_of_day = F.pmod(seconds, F.lit(_DAY))
    days = F.call_function("div", seconds - second_of_day, F.lit(_DAY)).cast("int")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        days, F.lit(0), F.lit(0), second_of_day
    )
    text = F.concat(
        F.replace(moment.cast("string"), F.lit(" "), F.lit("T")),
        F.lit("."),
        F.lpad(fraction.cast("string"), 9, "0"),
    )
    return F.coalesce(text, F.lit(""))


def iso_from_ntz(moment: Column) -> Column:
    """A zone-less timestamp in the same nine-digit form, whatever the session time zone."""
    text = moment.cast("string")
    whole = F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T"))
    digits = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(
        F.lit("")
    )
    return F.coalesce(F.concat(whole, F.lit("."), F.rpad(digits, 9, "0")), F.lit(""))


def iso_time(frame: DataFrame, column: str) -> Column:
    """ISO text of a time column by its type: epoch nanoseconds, an instant, or zone-less."""
    kind = frame.schema[column].dataType
    if isinstance(kind, T.LongType):
        return iso_from_nanos(F.col(column))
    if isinstance(kind, T.TimestampType):
        return iso_from_nanos(F.unix_micros(F.col(column)) * 1000)
    return iso_from_ntz(F.col(column).cast("timestamp_ntz"))


def newest(first: Column, second: Column) -> Column:
    """The later of two times; null only if both are."""
    return F.greatest(first, second)


def human_size(size: Column) -> Column:
    """Bytes in binary units with one decimal, ties rounded up.

    Quotient and remainder are rounded apart, so 64-bit integers suffice and no decimal or
    floating-point arithmetic is involved.
    """
    text = F.concat(size.cast("string"), F.lit(f" {SIZE_UNITS[0]}"))
    chosen = F.when(size.isNull(), F.lit(NO_VALUE)).when(size < 1024, text)
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scale = 1024**power
        whole = F.call_function("div", size, F.lit(scale))
        rest = F.call_function(
            "div", (size % scale) * F.lit(20) + F.lit(scale), F.lit(2 * scale)
        )
        tenths = whole * 10 + rest
        shown = F.concat(
            F.call_function("div", tenths, F.lit(10)).cast("string"),
            F.lit("."),
            (tenths % 10).cast("string"),
            F.lit(f" {unit}"),
        )
        last = power == len(SIZE_UNITS) - 1
        chosen = chosen.otherwise(shown) if last else chosen.when(size < 1024 * scale, shown)
    return chosen


def spreadsheet_safe(cell: Column) -> Column:
    """Put an apostrophe before text that a spreadsheet would run as a formula."""
    return F.when(
        F.substring(cell, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), cell)
    ).otherwise(cell)
