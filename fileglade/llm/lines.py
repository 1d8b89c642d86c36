"""Line dedup by site-relative frequency: lines on too large a share of a host's pages go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import materialised, salted_join

#: A line goes if it is on this share of its host's pages or more, and on MIN_COUNT of them.
RATIO, MIN_COUNT = 0.1, 5
VISIBLE = r"[^\x20\x09-\x0D]"


def page_lines(docs: DataFrame, host: str) -> DataFrame:
    """One row for each page and different visible line: doc_id, host, hash of the line."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(VISIBLE))
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    return docs.select("doc_id", F.col(host).alias("host"), F.explode(hashes).alias("line"))


def boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_count: int = MIN_COUNT
) -> DataFrame:
    """The boilerplate of each host, written: host, line, share of the host's pages.

    Both counts are summed in the map tasks first. A host has at most (lines for each page) /
    ``ratio`` such lines.
    """
    spark = docs.sparkSession
    totals = docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    # A host with fewer pages than ``min_count`` can't have such a line.
    totals = materialised(totals.filter(F.col("pages") >= min_count), spark)
    counts = page_lines(docs, host).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = salted_join(counts.filter(F.col("n") >= min_count), totals, ["host"], F.col("line"))
    share = F.col("n") / F.col("pages")
    found = counts.select("host", "line", share.alias("share")).filter(F.col("share") >= ratio)
    return materialised(found, spark)


def without_boilerplate(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """Documents without the boilerplate lines of their host, with ``n_lines`` and ``n_dropped``.

    A page is a row, repeated ones too; a line counts once for each page. Lines are compared as
    they stand; blank ones never go. A null host is a host like others. A null text stays null and
    has no lines; a text of which all lines go becomes empty. Columns of the input named like a
    result are replaced. The text is shuffled once, by document.
    """
    common = boilerplate(docs, host, **limits)
    lines = page_lines(docs, host)
    salt = F.xxhash64("doc_id")
    hits = salted_join(lines, common, ["host", "line"], salt).filter(F.col("share").isNotNull())
    drops = hits.groupBy("doc_id", "host").agg(F.collect_set("line").alias("__lines"))
    drops = drops.select(F.col("doc_id").alias("__doc"), F.col("host").alias("__host"), "__lines")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col(host).eqNullSafe(F.col("__host"))
    joined = docs.drop("n_lines", "n_dropped").join(drops, same, "left")
    split = F.split("text", "\n")
    keep = F.filter(split, lambda x: ~F.array_contains("__lines", F.xxhash64(x)) | ~x.rlike(VISIBLE))
    cut = F.col("__lines").isNotNull()
    joined = joined.withColumn("__kept", F.when(cut, keep))
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.when(cut, F.col("n_lines") - F.size("__kept")).otherwise(0).cast("long"))
        .withColumn("text", F.when(cut, F.array_join("__kept", "\n")).otherwise(F.col("text")))
        .drop("__doc", "__host", "__lines", "__kept")
    )
