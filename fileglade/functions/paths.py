"""Path expressions: normalisation, group keys, child paths, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_prefix(path: str) -> str:
    """Directory path with exactly one slash at each end, whatever was given."""
    inner = path.strip("/")
    return f"/{inner}/" if inner else "/"


def normalized(path: Column) -> Column:
    """Column form of :func:`normalize_prefix`."""
    inner = F.btrim(path, F.lit("/"))
    return F.when(inner == "", F.lit("/")).otherwise(F.concat(F.lit("/"), inner, F.lit("/")))


def components(path: str) -> list[str]:
    """What is between the slashes of a directory path; none for the root."""
    return normalize_prefix(path).split("/")[1:-1] if path.strip("/") else []


def slug(path: str) -> str:
    """Text for output names, from the components of the path."""
    return "_".join(components(path)) or "root"


def leading_components(parent_path: Column, prefix: str | Column, depth: int | Column) -> Column:
    """What stands before the ``depth``-th slash below ``prefix``: the group key of most paths."""
    start = F.lit(len(prefix) + 1) if isinstance(prefix, str) else F.length(prefix) + 1
    levels = F.lit(depth) if isinstance(depth, int) else depth
    below = F.substr(parent_path, start)
    return F.call_function("substring_index", below, F.lit("/"), levels)


def group_key(
    parent_path: Column,
    prefix: str | Column,
    depth: int | Column,
    leading: Column | None = None,
) -> Column:
    """First ``depth`` components of ``parent_path`` below ``prefix``; ``.`` if there are none.

    ``leading_components`` is the answer unless it is blank or has a slash too many (a file above
    that depth, an empty component); only then the path is cleaned. Give it as a column of its own
    to have it computed once per row. All of it works on UTF-8 bytes inside whole-stage codegen.
    """
    start = F.lit(len(prefix) + 1) if isinstance(prefix, str) else F.length(prefix) + 1
    levels = F.lit(depth) if isinstance(depth, int) else depth
    slash = F.lit("/")
    if leading is None:
        leading = leading_components(parent_path, prefix, depth)
    clean = (leading != "") & ~F.endswith(leading, slash)
    if not isinstance(depth, int) or depth > 1:
        clean = clean & ~F.startswith(leading, slash) & ~F.contains(leading, F.lit("//"))
    below = F.substr(parent_path, start)
    single = F.when(F.contains(below, F.lit("//")), F.regexp_replace(below, "/+", "/"))
    whole = F.btrim(single.otherwise(below), slash)
    cut = F.call_function("substring_index", whole, slash, levels)
    return F.when(clean, leading).when(cut == "", F.lit(".")).otherwise(cut)


def child_path(parent_path: Column, name: Column) -> Column:
    return F.concat(parent_path, name, F.lit("/"))


def component_count(path: Column) -> Column:
    """Number of components of a normalised directory path (0 for the root)."""
    return _slashes(path) - 1


def ancestors(path: Column) -> Column:
    """Array of ``(position, label, path)`` from the root down to the path itself."""
    parts = F.array_remove(F.split(path, "/"), "")

    def crumb(i: Column) -> Column:
        upto = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
        return F.struct(
            i.cast("bigint").alias("position"),
            F.when(i == 0, F.lit("/")).otherwise(F.get(parts, i - 1)).alias("label"),
            F.when(i == 0, F.lit("/")).otherwise(upto).alias("path"),
        )

    return F.transform(F.sequence(F.lit(0), F.size(parts)), crumb)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _prefix(path: Column, slashes: Column) -> Column:
    head = F.call_function("substring_index", path, F.lit("/"), slashes)
    return F.concat(head, F.lit("/"))


def path_prefixes(path: Column) -> Column:
    """Every prefix of a directory path that ends in a slash, the path itself included."""
    return F.transform(F.sequence(F.lit(1), _slashes(path)), lambda i: _prefix(path, i))


def explode_prefixes(frame: DataFrame, column: str, into: str) -> DataFrame:
    """One row per prefix of :func:`path_prefixes`. Only their numbers are exploded, so that the
    whole step is generated code."""
    path = F.col(column)
    numbered = frame.withColumn("_slashes", F.explode(F.sequence(F.lit(1), _slashes(path))))
    return numbered.withColumn(into, _prefix(path, F.col("_slashes"))).drop("_slashes")
