"""Listings made ready per snapshot, so that opening a directory reads one small partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileglade.operators.hierarchy import not_yet_materialised
from fileglade.schema import CATALOG_SCHEMA
from fileglade.sources.catalog import catalog_reader
from fileglade.sources.storage import child_names, exists

_BROADCAST_DIRS = 10_000
_READY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("path", "snapshot", "part")]
)


class ListingStore:
    """Complete listings below ``<root>/rows/snapshot=<name>/part=<id>/shard=<n>``.

    ``shard`` is a hash of the directory: a lookup prunes to one of them. Rows are range-sorted
    inside, so a huge directory is many files of its shard. Each run adds a ``part``; what it
    covered is recorded in ``<root>/ready`` after its rows have committed, so a failed run is
    never seen and a run for more directories only adds the missing ones.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        shards: int = 64,
        schema: T.StructType = CATALOG_SCHEMA,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.shards = shards
        self.schema = schema

    def _shard(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.shards)).cast("int")

    def _read(self, kind: str, schema: T.StructType, *below: str) -> DataFrame:
        """A partitioned table of the store, or one folder of it: nothing else is even listed."""
        base = f"{self.root}/{kind}"
        folder = "/".join([base, *below])
        if not child_names(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return catalog_reader(self.spark, schema).option("basePath", base).parquet(folder)

    def ready(self, snapshot: str | None = None) -> DataFrame:
        """Directories whose listings are complete, by snapshot and part."""
        below = () if snapshot is None else (f"snapshot={snapshot}",)
        return self._read("ready", _READY, *below)

    def add(self, catalog: DataFrame, wanted: DataFrame, snapshot: str, part: str) -> None:
        """Write the listings of the directories in ``wanted`` (column ``path``).

        A snapshot does not change, so a part that is ready is left alone; one that failed is
        written anew. The directories still missing are written down first: their count decides
        whether they may be broadcast.
        """
        place = f"snapshot={snapshot}/part={part}"
        if exists(self.spark, f"{self.root}/ready/{place}/_SUCCESS"):
            return
        missing = not_yet_materialised(
            wanted.select(F.lit(snapshot).alias("snapshot"), "path"), self.ready(snapshot)
        )
        missing.select("path").write.mode("overwrite").parquet(f"{self.root}/wanted/{place}")
        todo = self.spark.read.schema("path string").parquet(f"{self.root}/wanted/{place}")
        count = todo.count()
        if count == 0:
            return
        paths = todo.select(F.col("path").alias("parent_path"))
        if count <= _BROADCAST_DIRS:
            paths = F.broadcast(paths)
        bounds = todo.agg(F.min("path"), F.max("path")).first()
        parent = F.col("parent_path")
        rows = (
            catalog.select(*self.schema.names)
            .where((parent >= bounds[0]) & (parent <= bounds[1]))
            .join(paths, "parent_path", "left_semi")
            .withColumn("shard", self._shard(F.col("parent_path")))
        )
        (
            rows.repartitionByRange("shard", "parent_path", "name")
            .sortWithinPartitions("shard", "parent_path", "name")
            .write.mode("overwrite")
            .partitionBy("shard")
            .parquet(f"{self.root}/rows/{place}")
        )
        todo.write.mode("overwrite").parquet(f"{self.root}/ready/{place}")

    def _stored(self, *below: str) -> DataFrame:
        placed = [
            T.StructField("snapshot", T.StringType()),
            T.StructField("part", T.StringType()),
            T.StructField("shard", T.IntegerType()),
        ]
        return self._read("rows", T.StructType([*self.schema.fields, *placed]), *below)

    def rows(self, snapshot: str) -> DataFrame:
        """All ready rows of a snapshot; leftovers of failed runs are left out."""
        # Overlapping runs may both have stored a directory: the least part counts.
        ready = self.ready(snapshot).groupBy("snapshot", F.col("path").alias("parent_path")).agg(
            F.min("part").alias("part")
        )
        keys = ["snapshot", "part", "parent_path"]
        return self._stored(f"snapshot={snapshot}").join(ready, keys, "left_semi")

    def directory(self, snapshot: str, path: str) -> DataFrame | None:
        """Catalog rows of one ready directory, or None if it has to come from the catalog."""
        found = self.ready(snapshot).where(F.col("path") == path).select("part").collect()
        if not found:
            return None
        held = min(found)
        shard = F.col("shard") == self._shard(F.lit(path))
        return self._stored(f"snapshot={snapshot}", f"part={held['part']}").where(
            shard & (F.col("parent_path") == path)
        )
