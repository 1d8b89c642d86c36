"""Point-in-time copies of the catalog: naming, publishing, pinning, falling back."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileglade.schema import CATALOG_SCHEMA
from fileglade.sources.catalog import catalog_reader, read_catalog, sorted_layout
from fileglade.sources.storage import child_names, exists

log = logging.getLogger(__name__)

_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def newest_snapshot(names: DataFrame, prefix: str = "", column: str = "name") -> DataFrame:
    """One row: the newest snapshot name of a listing, null if there is none.

    Names end in a zero-padded UTC time, so within one prefix the greatest text is the newest.
    """
    bare = F.regexp_replace(F.btrim(F.col(column), F.lit("/")), "^[.]snapshot/", "")
    return (
        names.select(bare.alias("snapshot"))
        .where(F.col("snapshot").startswith(prefix))
        .agg(F.max("snapshot").alias("snapshot"))
    )


class SnapshotStore:
    """Snapshots below ``<root>/snapshots/snapshot=<name>``, the live table in ``<root>/live``.

    A snapshot counts only once its own job has committed (``_SUCCESS``). After that a one-line
    announcement is put in ``<root>/announced``; streams follow those instead of data files.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = CATALOG_SCHEMA):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    @property
    def announcements(self) -> str:
        return f"{self.root}/announced"

    def _folder(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a snapshot name: {name!r}")
        return f"{self.root}/snapshots/snapshot={name}"

    def publish(self, catalog: DataFrame, name: str) -> None:
        """Write a snapshot once: a finished one is never changed, so what was derived from it
        stays right. Left-overs of a failed try are written over."""
        folder = self._folder(name)
        if self.usable(name):
            raise FileExistsError(f"snapshot {name} is published already")
        sorted_layout(catalog.select(*self.schema.names)).write.mode("overwrite").parquet(folder)
        line = self.spark.range(1).coalesce(1).select(F.lit(name).alias("value"))
        line.write.mode("append").text(self.announcements)

    def publish_live(self, catalog: DataFrame) -> None:
        rows = sorted_layout(catalog.select(*self.schema.names))
        rows.write.mode("overwrite").parquet(f"{self.root}/live")

    def _published(self, prefix: str) -> list[str]:
        folders = child_names(self.spark, f"{self.root}/snapshots")
        found = [f.removeprefix("snapshot=") for f in folders if f.startswith("snapshot=")]
        return sorted(n for n in found if n.startswith(prefix))

    def names(self, prefix: str = "") -> list[str]:
        return [n for n in self._published(prefix) if self.usable(n)]

    def newest(self, prefix: str = "") -> str | None:
        return next((n for n in reversed(self._published(prefix)) if self.usable(n)), None)

    def usable(self, name: str) -> bool:
        return exists(self.spark, f"{self._folder(name)}/_SUCCESS")

    def read(self, snapshot: str | None) -> tuple[DataFrame, str | None]:
        """Catalog rows with their ``snapshot`` column, and the snapshot they really come from.

        Resolved before planning. Only the pinned folder is listed; an absent or unfinished
        snapshot falls back to the live table and is reported as None.
        """
        if snapshot and self.usable(snapshot):
            base = f"{self.root}/snapshots"
            pinned = T.StructType([*self.schema.fields, T.StructField("snapshot", T.StringType())])
            reader = catalog_reader(self.spark, pinned).option("basePath", base)
            rows = reader.parquet(self._folder(snapshot))
            return rows.where(F.col("snapshot") == snapshot), snapshot
        if snapshot:
            log.warning("snapshot %s is absent or unfinished: using the live table", snapshot)
        live = read_catalog(self.spark, f"{self.root}/live", self.schema)
        return live.withColumn("snapshot", F.lit(None).cast("string")), None
