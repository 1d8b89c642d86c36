"""Snapshot-arrival refresh: rollups and listings of every new snapshot, current marker last."""

from __future__ import annotations

import hashlib
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fileglade.functions.paths import normalize_prefix
from fileglade.operators.hierarchy import capped_frontier, frontier, left_out
from fileglade.operators.incremental import directory_state, refreshed_groups
from fileglade.operators.rollup import check_request, rollup_many
from fileglade.schema import FRONTIER_DEPTH
from fileglade.sinks.listings import ListingStore
from fileglade.sources.snapshots import SnapshotStore
from fileglade.sources.storage import child_names, exists, make_folder, materialised, remove

log = logging.getLogger(__name__)

_COUNTS = ("file_count", "total_bytes", "total_used")


@dataclass(frozen=True)
class RefreshPlan:
    """What to keep ready for every snapshot."""

    rollups: list[tuple[str, int]]
    roots: list[str] = field(default_factory=list)
    depth: int = FRONTIER_DEPTH
    max_dirs: int | None = None


class SnapshotRefresh:
    """Follows the announcements of a snapshot store.

    A micro-batch only names snapshots; their rows are read again as a batch from the committed
    folder, so half a snapshot is never aggregated. Each snapshot has its own folders and is
    finished once for a plan; a replayed batch completes what failed and leaves the rest alone.
    The marker names the plan's rollups and roots: a snapshot finished under a smaller plan is
    refreshed again for the larger one, and until then only the rollups it holds are served.

    Rollups are incremental: beside its groups each snapshot keeps the state of its directories,
    and the next one starts from the newest earlier snapshot finished with the same rollups,
    folding in only the directories that changed (see :mod:`fileglade.operators.incremental`).
    """

    def __init__(
        self,
        spark: SparkSession,
        store: SnapshotStore,
        root: str,
        plan: RefreshPlan,
        shards: int = 64,
    ):
        self.spark = spark
        self.store = store
        self.root = root.rstrip("/")
        self.plan = plan
        for prefix, depth in plan.rollups:
            check_request(prefix, depth, allow_root=True)
        self.listings = ListingStore(spark, f"{self.root}/listings", shards, store.schema)

    def start(self, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Process what has been announced and stop, or poll, e.g. ``every="60 seconds"``."""
        make_folder(self.spark, self.store.announcements)
        arrivals = self.spark.readStream.schema("value string").text(self.store.announcements)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return (
            arrivals.writeStream.foreachBatch(self._batch)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def _batch(self, arrivals: DataFrame, _batch_id: int) -> None:
        """Any arrival brings all usable snapshots up to date: an announcement that was lost, or
        came before its snapshot could be read, is made up for by the next one."""
        if arrivals.isEmpty():
            return
        for name in sorted(self.store.names()):
            self.refresh(name)

    def finished(self, name: str) -> bool:
        return exists(self.spark, f"{self.root}/current/{name}/_SUCCESS")

    def _pairs(self) -> list[str]:
        return sorted({f"{normalize_prefix(p)}|{d}" for p, d in self.plan.rollups})

    def _roots_key(self) -> str:
        text = f"{sorted(self.plan.roots)}|{self.plan.depth}|{self.plan.max_dirs}"
        return hashlib.sha1(text.encode()).hexdigest()[:12]

    def _marker(self, name: str):
        """The marker row of a finished snapshot, or None."""
        if not self.finished(name):
            return None
        return self.spark.read.parquet(f"{self.root}/current/{name}").first()

    def _covers(self, name: str) -> bool:
        marker = self._marker(name)
        if marker is None or "pairs" not in marker.asDict():
            return False
        roots = marker["roots_key"] == self._roots_key() or not self.plan.roots
        return set(self._pairs()) <= set(marker["pairs"] or []) and roots

    def _previous(self, name: str) -> str | None:
        """The newest earlier snapshot finished with exactly this plan's rollups and a state."""
        earlier = sorted((n for n in child_names(self.spark, f"{self.root}/current") if n < name), reverse=True)
        for other in earlier:
            marker = self._marker(other)
            if marker is not None and "pairs" in marker.asDict() and sorted(marker["pairs"] or []) == self._pairs():
                if exists(self.spark, f"{self.root}/dirs/snapshot={other}/_SUCCESS"):
                    return other
        return None

    def refresh(self, name: str) -> None:
        """Write the outputs of one snapshot unless they are all there for this plan."""
        if self._covers(name):
            return
        remove(self.spark, f"{self.root}/current/{name}")  # not served while it is redone
        catalog, _ = self.store.read(name)
        state = materialised(directory_state(catalog, self.plan.rollups), self.spark)
        before = self._previous(name)
        if before is None:
            groups = rollup_many(catalog, self.plan.rollups)
        else:
            old = self.rollups(before).drop("snapshot")
            old_state = self.spark.read.parquet(f"{self.root}/dirs/snapshot={before}")
            groups = refreshed_groups(catalog, self.plan.rollups, old, old_state, state)
        groups.write.mode("overwrite").parquet(f"{self.root}/rollups/snapshot={name}")
        state.write.mode("overwrite").parquet(f"{self.root}/dirs/snapshot={name}")
        left = 0
        if self.plan.roots:
            reached = frontier(catalog, self.plan.roots, self.plan.depth)
            wanted = capped_frontier(reached, self.plan.max_dirs)
            left = left_out(reached, self.plan.max_dirs)
            self.listings.add(catalog, wanted, name, part=f"refresh-{self._roots_key()}")
            if left:
                log.warning("snapshot %s: %d directories were left out", name, left)
        marker = self.spark.range(1).coalesce(1).select(
            F.lit(name).alias("snapshot"),
            F.lit(left).cast("bigint").alias("dirs_left"),
            F.array(*[F.lit(p) for p in self._pairs()]).cast("array<string>").alias("pairs"),
            F.lit(self._roots_key()).alias("roots_key"),
        )
        marker.write.mode("overwrite").parquet(f"{self.root}/current/{name}")

    def current(self) -> str | None:
        """Newest snapshot whose outputs are all written."""
        started = sorted(child_names(self.spark, f"{self.root}/current"), reverse=True)
        return next((name for name in started if self.finished(name)), None)

    def rollups(self, snapshot: str) -> DataFrame:
        """Refreshed rollup groups of a finished snapshot; none if it is not finished."""
        schema = T.StructType(
            [
                T.StructField("prefix", T.StringType()),
                T.StructField("depth", T.IntegerType()),
                T.StructField("name", T.StringType()),
                *[T.StructField(c, T.LongType()) for c in _COUNTS],
                *[self.store.schema[c] for c in ("mtime", "atime")],
                T.StructField("snapshot", T.StringType()),
            ]
        )
        if not self.finished(snapshot):
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/rollups"
        reader = self.spark.read.schema(schema).option("basePath", base)
        return reader.parquet(f"{base}/snapshot={snapshot}")

    def groups(self, snapshot: str, prefix: str, depth: int) -> DataFrame | None:
        """One refreshed rollup, or None if it has to be computed."""
        marker = self._marker(snapshot)
        if marker is None or f"{prefix}|{depth}" not in set(marker.asDict().get("pairs") or []):
            return None
        wanted = (F.col("prefix") == prefix) & (F.col("depth") == depth)
        return self.rollups(snapshot).where(wanted).drop("snapshot", "prefix", "depth")
