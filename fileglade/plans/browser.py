"""The request-level API: listings, rollups and exports of one catalog."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileglade.functions.paths import child_path, normalize_prefix
from fileglade.operators import rollup as ru
from fileglade.operators.annotate import annotated_listing
from fileglade.operators.hierarchy import (
    capped_frontier,
    frontier,
    not_yet_materialised,
    tree_level,
)
from fileglade.operators.listing import Listing, Page, entries, open_listing
from fileglade.schema import (
    FRONTIER_DEPTH,
    PREFETCH_CHILDREN,
    ROLLUP_MAX_GROUPS,
    TREE_CHILDREN,
)
from fileglade.sinks.export import export_listing, export_rollup
from fileglade.sinks.listings import ListingStore
from fileglade.sources.catalog import child_directories
from fileglade.sources.snapshots import SnapshotStore
from fileglade.sources.storage import materialised
from fileglade.streaming.refresh import SnapshotRefresh


@dataclass(frozen=True)
class ListingPage:
    path: str
    snapshot: str | None
    entries: DataFrame
    page: Page
    listing: Listing


@dataclass(frozen=True)
class RollupResult:
    """A computed rollup. ``groups`` is a written table, so nothing is scanned twice."""

    path: str
    depth: int
    snapshot: str | None
    groups: DataFrame
    rows_scanned: int
    total_children: int

    def children(self, child_limit: int | None = None) -> DataFrame:
        return ru.children(self.groups, child_limit)

    def children_truncated(self, child_limit: int | None = None) -> bool:
        return child_limit is not None and self.total_children > child_limit

    def totals(self) -> DataFrame:
        return ru.totals(self.groups)

    def envelope(self, child_limit: int | None = None) -> DataFrame:
        """One nested row: path, snapshot, rows scanned, children in rank order, totals."""
        return envelope(
            self.children(child_limit),
            self.totals(),
            path=self.path,
            catalog_snapshot=self.snapshot,
            rows_scanned=self.rows_scanned,
            total_children=self.total_children,
            children_truncated=self.children_truncated(child_limit),
        )


def envelope(top: DataFrame, totals: DataFrame, **facts) -> DataFrame:
    """Children (already limited) and totals as one row, with constant columns added."""
    shown = ["name", "file_count", "total_bytes", "total_used", "last_modified", "last_accessed"]
    by_rank = F.struct((-F.col("total_bytes")).alias("rank"), F.col("name").alias("tie"))
    child = F.struct(*shown).alias("c")
    nested = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(by_rank.alias("at"), child))),
            lambda item: item.c,
        ).alias("children")
    )
    one = totals.select(F.struct(*totals.columns).alias("totals")).scalar()
    constants = [
        F.lit(value).cast("string" if value is None else _kind(value)).alias(name)
        for name, value in facts.items()
    ]
    return nested.select(*constants, "children", one.alias("totals"))


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "bigint" if isinstance(value, int) else "string"


class CatalogBrowser:
    """Answers requests from the newest snapshot, with ready-made listings where there are any."""

    def __init__(
        self,
        spark: SparkSession,
        store: SnapshotStore,
        listings: ListingStore | None = None,
        refresh: SnapshotRefresh | None = None,
        snapshot_prefix: str = "",
        pin: bool = True,
        allow_root: bool = False,
        listing_cap: int | None = None,
        max_groups: int = ROLLUP_MAX_GROUPS,
        newest: Callable[[], str | None] | None = None,
    ):
        self.spark = spark
        self.store = store
        self.listings = listings or (refresh.listings if refresh else None)
        self.refresh = refresh
        self.allow_root = allow_root
        self.listing_cap = listing_cap
        self.max_groups = max_groups
        self.pin = pin
        self.newest = newest or (lambda: store.newest(snapshot_prefix))

    def _catalog(self) -> tuple[DataFrame, str | None]:
        """One snapshot for everything a request reads."""
        return self.store.read(self.newest() if self.pin else None)

    def _open(self, path: str, type: str, name_filter: str) -> tuple[Listing, str | None]:
        catalog, snapshot = self._catalog()
        if self.listings is not None and snapshot is not None:
            ready = self.listings.directory(snapshot, normalize_prefix(path))
            catalog = catalog if ready is None else ready
        return open_listing(catalog, path, type, name_filter, self.listing_cap), snapshot

    def listing(
        self,
        path: str,
        page: int | None = 1,
        page_size: int | None = None,
        sort: str = "name",
        order: str = "asc",
        type: str = "all",
        name_filter: str = "",
    ) -> ListingPage:
        listing, snapshot = self._open(path, type, name_filter)
        rows, at = listing.page(page, page_size, sort, order)
        return ListingPage(normalize_prefix(path), snapshot, entries(rows), at, listing)

    def annotated(
        self, shown: ListingPage, result: RollupResult | None, child_limit: int | None = None
    ) -> DataFrame:
        """A page whose directories carry the totals of a rollup of the same directory."""
        if result is None:
            return annotated_listing(shown.entries, None)
        return annotated_listing(
            shown.entries, result.children(child_limit), result.children_truncated(child_limit)
        )

    def tree(self, path: str, n: int = TREE_CHILDREN) -> DataFrame:
        """First child directories of a directory and how many more there are."""
        return tree_level(self._catalog()[0], path, n)

    def to_fetch(self, path: str, n: int = PREFETCH_CHILDREN) -> DataFrame:
        """First child directories of a directory whose listings are not ready yet."""
        catalog, snapshot = self._catalog()
        prefix = normalize_prefix(path)
        children = child_directories(catalog, prefix, n).select(
            F.lit(snapshot).cast("string").alias("snapshot"),
            child_path(F.lit(prefix), F.col("name")).alias("path"),
        )
        if self.listings is None or snapshot is None:
            return children
        return not_yet_materialised(children, self.listings.ready(snapshot))

    def prepare(
        self,
        roots: list[str],
        depth: int = FRONTIER_DEPTH,
        max_dirs: int | None = None,
    ) -> str | None:
        """Make the listings of a frontier ready for the current snapshot, skipping those that
        are. Returns the snapshot; None, and nothing done, if reads are not pinned to one."""
        if self.listings is None:
            raise ValueError("no listing store given")
        catalog, snapshot = self._catalog()
        if snapshot is not None:
            wanted = capped_frontier(frontier(catalog, roots, depth), max_dirs)
            self.listings.add(catalog, wanted, snapshot, part=uuid.uuid4().hex)
        return snapshot

    def rollup(self, path: str, depth: int = 1) -> RollupResult:
        """The refreshed rollup if there is one, else a scan of the subtree.

        Raises RollupTooWide.
        """
        prefix = ru.check_request(path, depth, self.allow_root)
        catalog, snapshot = self._catalog()
        grouped = None
        if self.refresh is not None and snapshot is not None:
            grouped = self.refresh.groups(snapshot, prefix, depth)
        if grouped is None:
            grouped = ru.rollup_groups(catalog, prefix, depth)
        groups = materialised(grouped.limit(self.max_groups + 1), self.spark)
        seen = groups.agg(
            F.count(F.lit(1)).alias("children"),
            F.coalesce(F.sum("file_count"), F.lit(0)).alias("rows"),
        ).first()
        if seen["children"] > self.max_groups:
            raise ru.RollupTooWide(ru.too_wide_message(self.max_groups))
        return RollupResult(prefix, depth, snapshot, groups, seen["rows"], seen["children"])

    def export_listing(
        self,
        path: str,
        folder: str,
        sort: str = "name",
        order: str = "asc",
        type: str = "all",
        name_filter: str = "",
    ) -> str:
        listing, _ = self._open(path, type, name_filter)
        return export_listing(listing, path, folder, sort, order)

    def export_rollup(self, path: str, folder: str, depth: int = 1) -> str:
        result = self.rollup(path, depth)
        return export_rollup(result.groups, path, folder)
