"""Listings and tree levels joined with rollup results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.functions.text import human_size


def annotated_listing(
    page: DataFrame,
    children: DataFrame | None,
    children_truncated: bool = False,
) -> DataFrame:
    """Directory rows with the totals of the rollup child of the same name.

    State of a directory: ``stats`` (found), ``truncated`` (the result was cut, so it may be
    a smaller one), ``newer`` (absent from a complete result) or ``none`` (no rollup). The type
    test is part of the join condition: a file may share a directory's name. Children come with
    their top-k limit, from which Spark knows their size and chooses the join.
    """
    is_dir = F.col("element_type") == "DIR"
    if children is None:
        return page.select(
            *page.columns,
            F.lit(None).cast("bigint").alias("rollup_files"),
            F.lit(None).cast("bigint").alias("rollup_bytes"),
            F.when(is_dir, F.lit("none")).alias("rollup_state"),
        )
    found = children.select(
        F.col("name").alias("_child"),
        F.col("file_count").alias("rollup_files"),
        F.col("total_bytes").alias("rollup_bytes"),
    )
    absent = "truncated" if children_truncated else "newer"
    joined = page.join(found, is_dir & (F.col("name") == F.col("_child")), "left")
    state = F.when(is_dir, F.when(F.col("_child").isNotNull(), "stats").otherwise(absent))
    return joined.withColumn("rollup_state", state).drop("_child")


def annotated_tree(nodes: DataFrame, children: DataFrame, prefix: str) -> DataFrame:
    """Size badges for tree nodes (column ``path``) after a rollup of ``prefix``.

    Direct children show their bytes, or an empty text if the rollup lacks them; deeper nodes and
    nodes elsewhere are not touched (null).
    """
    path = F.col("path")
    label = F.substr(path, F.lit(len(prefix) + 1))
    inner = F.rtrim(label, F.lit("/"))
    direct = path.startswith(prefix) & (path != prefix) & ~F.contains(inner, F.lit("/"))
    found = children.select(F.col("name").alias("_child"), F.col("total_bytes").alias("_bytes"))
    joined = nodes.join(found, direct & (inner == F.col("_child")), "left")
    badge = F.when(F.col("_child").isNotNull(), human_size(F.col("_bytes"))).otherwise("")
    return joined.withColumn("badge", F.when(direct, badge)).drop("_child", "_bytes")
