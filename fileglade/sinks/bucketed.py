"""Ready listings as bucketed tables: rows and their directory counts meet without a shuffle.

A snapshot's ready directories are written twice, both bucketed by ``parent_path`` into the same
number of buckets: the rows, sorted by ``(parent_path, name)`` inside each bucket, and one row of
counts per directory, stored beside it. Spark knows both layouts from the catalog, so joining
rows with their counts, or a bucketed request list with either, plans no Exchange: each task
reads one bucket of each side. A directory with a third of all rows is one bucket's stretch of
sorted files, read in file splits.

Tables live in the session catalog with their files below ``spark.checkpoint.dir`` (a path of
their own), so every executor reaches them and nothing goes to a machine's local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileglade.sources.storage import shared_folder

__all__ = ["BucketedListings"]


class BucketedListings:
    """Bucketed rows and counts of the ready directories of each snapshot."""

    def __init__(self, spark: SparkSession, buckets: int = 64):
        self.spark = spark
        self.buckets = buckets
        self.folder = shared_folder(spark)
        self.tag = uuid.uuid4().hex[:8]
        self._names: dict[str, tuple[str, str]] = {}

    def _save(self, frame: DataFrame, name: str, *sort: str) -> None:
        writer = frame.write.mode("overwrite").option("path", f"{self.folder}/{name}").bucketBy(
            self.buckets, "parent_path"
        )
        if sort:
            writer = writer.sortBy(*sort)
        writer.saveAsTable(name)

    def add(self, catalog: DataFrame, wanted: DataFrame, snapshot: str) -> None:
        """Writes the rows and counts of the directories in ``wanted`` (column ``path``)."""
        key = "".join(c if c.isalnum() else "_" for c in snapshot)
        rows_name, counts_name = f"ready_rows_{key}_{self.tag}", f"ready_counts_{key}_{self.tag}"
        paths = wanted.select(F.col("path").alias("parent_path")).distinct()
        rows = catalog.join(paths, "parent_path", "left_semi")
        self._save(rows, rows_name, "parent_path", "name")
        stored = self.spark.table(rows_name)
        counts = stored.groupBy("parent_path").agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col("element_type") == "DIR").alias("total_dirs"),
            F.count_if(F.col("element_type") == "FILE").alias("total_files"),
        )
        self._save(counts, counts_name)
        self._names[snapshot] = (rows_name, counts_name)

    def rows(self, snapshot: str) -> DataFrame:
        return self.spark.table(self._names[snapshot][0])

    def counts(self, snapshot: str) -> DataFrame:
        return self.spark.table(self._names[snapshot][1])

    def with_counts(self, snapshot: str) -> DataFrame:
        """Every ready row with its directory's counts: a bucket-to-bucket join."""
        return self.rows(snapshot).join(self.counts(snapshot), "parent_path")
