"""One query per operator, each over the catalog derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fileglade.functions import paths as P
from fileglade.functions import text as X
from fileglade.operators import annotate, hierarchy, listing
from fileglade.operators import rollup as ru
from fileglade.operators.incremental import directory_state, refreshed_groups
from fileglade.operators.intervals import subtree_totals
from fileglade.plans.browser import envelope
from fileglade.schema import CATALOG_SCHEMA, ROLLUP_COLUMNS
from fileglade.sinks import export
from fileglade.sinks.bucketed import BucketedListings
from fileglade.sinks.listings import ListingStore
from fileglade.sinks.name_index import directory_files, name_postings, search
from fileglade.sinks.rank_index import indexed_page, rank_index
from fileglade.sources import catalog as cat
from fileglade.sources import control
from fileglade.sources.derived import derived_catalog
from fileglade.sources.snapshots import SnapshotStore, newest_snapshot
from fileglade.sources.storage import materialised, shared_folder
from fileglade.streaming.arrivals import ARRIVALS, follow_arrivals
from fileglade.streaming.refresh import RefreshPlan, SnapshotRefresh

Query = Callable[[SparkSession, str], DataFrame]

OLDER = "files_2031-02-03_04_05_06_UTC"
NEWER = "files_2031-02-04_10_20_30_UTC"
EVENTS_CAP = 1000
MANY_ROLLUPS = [("/", 2), ("/documents/", 1), ("/orders/", 2), ("/lineitem/A/", 2), ("/home/", 1)]
#: A thousand roots in two branches, some inside others, some missing from the catalog.
RANGE_ROOTS = (
    [f"/documents/src{i}/" for i in range(700)]
    + [f"/documents/src{i}/x/" for i in range(24)]
    + [f"/lineitem/{flag}/" for flag in "ANR"]
    + [f"/lineitem/{flag}/{year}/" for flag in "ANR" for year in range(1992, 1999)]
    + [f"/lineitem/{flag}/{year}/{month:02d}/" for flag in "ANR" for year in range(1992, 1999) for month in range(1, 13)]
)
MANY_ROOTS = [f"/documents/src{i}/" for i in range(40)] + ["/lineitem/", "/lineitem/A/"]


def _table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables.rstrip('/')}/{name}.parquet")


def _flag(frame: DataFrame, **facts) -> DataFrame:
    return frame.select("*", *[F.lit(v).alias(k) for k, v in facts.items()])


# ---- scans ------------------------------------------------------------------------------------


def catalog_scan(spark, tables):
    owned = (F.col("element_type") == "FILE") & (F.col("owner_name") == "user3")
    return cat.scan(derived_catalog(spark, tables), ["parent_path", "name", "size"], owned)


def dir_scan(spark, tables):
    rows = cat.directory_rows(derived_catalog(spark, tables, "/documents/"), "documents")
    return listing.entries(rows)


def subtree_files(spark, tables):
    rows = cat.subtree_files(derived_catalog(spark, tables, "/lineitem/"), "/lineitem")
    times = {c: X.iso_time(rows, c).alias(c) for c in ("mtime", "atime")}
    return rows.select(*[times.get(c, F.col(c)) for c in ROLLUP_COLUMNS])


def child_dirs(spark, tables):
    return cat.child_directories(derived_catalog(spark, tables, "/documents/"), "/documents/", 10)


# ---- snapshots --------------------------------------------------------------------------------


def snapshot_newest(spark, tables):
    stamp = F.date_format("ts", "yyyy-MM-dd_HH_mm_ss")
    names = _table(spark, tables, "events").select(
        F.concat(F.lit(".snapshot/files_"), stamp, F.lit("_UTC/")).alias("name")
    )
    return newest_snapshot(names, "files_")


def _written(spark: SparkSession, tables: str) -> DataFrame:
    """The whole derived catalog, computed once for jobs that read it several times."""
    return materialised(derived_catalog(spark, tables), spark)


def _store(spark: SparkSession, tables: str, newer: bool) -> SnapshotStore:
    """A snapshot before data reduction, and either a newer one or the live table."""
    store = SnapshotStore(spark, shared_folder(spark))
    now = _written(spark, tables)
    store.publish(now.withColumn("used", F.col("size")), OLDER)
    if newer:
        store.publish(now, NEWER)
    else:
        store.publish_live(now)
    return store


def _by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("snapshot", "element_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("total_used"),
    )


def arrivals_deduplicated(spark, tables):
    """Every event announces the snapshot of its hour, many times over; each is kept once."""
    folder = shared_folder(spark)
    announced = _table(spark, tables, "events").select(
        F.concat(F.lit("files_"), F.date_format("ts", "yyyy-MM-dd_HH")).alias("snapshot"),
        F.col("ts").cast("timestamp").alias("announced_at"),
    )
    announced.repartition(4).write.json(f"{folder}/announced")
    query = follow_arrivals(spark, f"{folder}/announced", f"{folder}/kept", f"{folder}/progress")
    query.awaitTermination()
    return spark.read.schema(ARRIVALS).parquet(f"{folder}/kept").select("snapshot")


def snapshot_pinned_read(spark, tables):
    rows, _ = _store(spark, tables, newer=True).read(OLDER)
    return _by_type(rows)


def snapshot_fallback(spark, tables):
    rows, _ = _store(spark, tables, newer=False).read(NEWER)
    return _by_type(rows)


def snapshot_refresh(spark, tables):
    store = _store(spark, tables, newer=True)
    plan = RefreshPlan(
        rollups=[("/", 1), ("/lineitem/", 2), ("/documents/", 2)], roots=["/documents/"], depth=1
    )
    folder = shared_folder(spark)
    refresh = SnapshotRefresh(spark, store, folder, plan, shards=4)
    query = refresh.start(f"{folder}/progress")
    query.awaitTermination()
    groups = refresh.rollups(OLDER).unionByName(refresh.rollups(NEWER))
    return _named(groups, "snapshot", "prefix", "depth").withColumn(
        "is_current", F.col("snapshot") == refresh.current()
    )


INCREMENTAL_ROLLUPS = [("/", 2), ("/orders/", 2), ("/lineitem/", 1), ("/documents/", 1)]


def changed_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog a day later: files ending in 3.dat and all of /orders/F/ are gone, files ending
    in 5.csv grew and were modified, those ending in 1.csv have a .bak copy beside them, and
    /documents/ has a new empty directory."""
    name, files = F.col("name"), F.col("element_type") == "FILE"
    grown = files & name.endswith("5.csv")
    kept = catalog.where(~(files & (name.endswith("3.dat") | F.col("parent_path").startswith("/orders/F/"))))
    kept = kept.withColumn("size", F.when(grown, F.col("size") * 2 + 1).otherwise(F.col("size"))).withColumn(
        "mtime", F.when(grown, F.col("mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime"))
    )
    copies = catalog.where(files & name.endswith("1.csv")).withColumn("name", F.concat(name, F.lit(".bak")))
    fresh = catalog.sparkSession.createDataFrame(
        [("/documents/", "fresh-empty", "DIR", 4096, 4096, None, None, "root", "", 2)], CATALOG_SCHEMA
    )
    return kept.unionByName(copies).unionByName(fresh)


def refresh_incremental(spark, tables):
    old = _written(spark, tables)
    old_groups = materialised(ru.rollup_many(old, INCREMENTAL_ROLLUPS), spark)
    old_state = materialised(directory_state(old, INCREMENTAL_ROLLUPS), spark)
    groups = refreshed_groups(changed_catalog(old), INCREMENTAL_ROLLUPS, old_groups, old_state)
    return _named(groups, "prefix", "depth")


# ---- control-plane records ---------------------------------------------------------------------


def views_normalised(spark, tables):
    key = F.col("c_custkey")
    record = F.struct(
        F.when(key % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("alias-"), key.cast("string"))).alias("alias"),
        F.when(key % 5 != 0, F.concat(F.lit("/views/"), key.cast("string"))).alias("path"),
        F.when(key % 7 != 0, F.array(F.lit("NFS"), F.col("c_mktsegment"))).alias("protocols"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).alias("policy_name"),
        F.lit("default").alias("policy"),
        F.when(key % 6 == 0, F.lit("")).when(key % 6 == 1, F.col("c_name")).alias("tenant_name"),
        F.col("c_nationkey").alias("tenant_id"),
    )
    records = _table(spark, tables, "customer").select(F.to_json(record).alias("record"))
    views = control.normalised_views(control.parse_views(records))
    return views.withColumn("protocols", F.array_join("protocols", ","))


def capacity_extract(spark, tables):
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    values = F.struct(
        (price * 3).alias("logical"),
        price.alias("unique"),
        F.when(key % 3 == 0, price * 2).alias("usable"),
        (key % 100).alias("percent"),
        F.col("o_orderpriority").alias("average_atime"),
    )
    nested = F.to_json(F.struct(values.alias("details"), (-price).alias("logical")))
    broken = F.to_json(F.struct(F.array(price).alias("details"), price.alias("logical")))
    status = F.col("o_orderstatus")
    record = F.when(status == "F", nested).when(status == "O", F.to_json(values)).otherwise(broken)
    records = _table(spark, tables, "orders").select(
        F.concat(F.lit("/orders/"), key.cast("string"), F.lit("/")).alias("path"),
        record.alias("record"),
    )
    return control.capacity(records)


def _capacity_records(spark: SparkSession, tables: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    values = F.struct(
        (price * 3).alias("logical"),
        price.alias("unique"),
        F.when(key % 3 == 0, price * 2).alias("usable"),
        (key % 100).alias("percent"),
        F.col("o_orderpriority").alias("average_atime"),
    )
    nested = F.to_json(F.struct(values.alias("details"), (-price).alias("logical")))
    broken = F.to_json(F.struct(F.array(price).alias("details"), price.alias("logical")))
    status = F.col("o_orderstatus")
    record = F.when(status == "F", nested).when(status == "O", F.to_json(values)).otherwise(broken)
    return _table(spark, tables, "orders").select(
        F.concat(F.lit("/orders/"), key.cast("string"), F.lit("/")).alias("path"),
        record.alias("record"),
    )


def control_variant(spark, tables):
    return control.capacity_variant(_capacity_records(spark, tables))


def control_fields(spark, tables):
    fields = control.record_fields(_capacity_records(spark, tables))
    return fields.groupBy("key").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("is_object").alias("objects")
    )


# ---- exports -----------------------------------------------------------------------------------


def export_listing(spark, tables):
    found = listing.open_listing(derived_catalog(spark, tables, "/parts/"), "/parts/")
    return export.listing_export(found.rows)


def export_manifest(spark, tables):
    found = listing.open_listing(
        derived_catalog(spark, tables, "/events/"), "/events/", cap=EVENTS_CAP
    )
    return export.manifest(found.rows, "/events/", found.total_rows, found.truncated)


def export_rollup(spark, tables):
    groups = ru.rollup_groups(derived_catalog(spark, tables, "/orders/"), "/orders/", 2)
    return export.rollup_export(groups)


def csv_safe(spark, tables):
    parts = derived_catalog(spark, tables, "/parts/").where(F.col("element_type") == "FILE")
    texts = _table(spark, tables, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("cell_id"),
        F.col("text").alias("cell"),
        F.col("n_chars").alias("amount"),
    )
    names = parts.select(
        F.col("name").alias("cell_id"), F.col("name").alias("cell"), F.col("size").alias("amount")
    )
    return export.csv_safe(texts.unionAll(names))


# ---- listings ----------------------------------------------------------------------------------


def _page(path: str, cap: int | None = None, **request) -> Query:
    def query(spark, tables):
        source = derived_catalog(spark, tables, path)
        found = listing.open_listing(source, path, cap=cap)
        rows, at = found.page(**request)
        return _flag(listing.entries(rows), page=at.number, pages=at.pages)

    return query


def _whole(
    path: str, element: str = "all", name_filter: str = "", cap: int | None = None
) -> Query:
    def query(spark, tables):
        source = derived_catalog(spark, tables, path)
        found = listing.open_listing(source, path, element, name_filter, cap)
        return _flag(listing.entries(found.rows), truncated=found.truncated)

    return query


def _meta(path: str, source_path: str | None = None, name_filter: str = "", **request) -> Query:
    def query(spark, tables):
        source = derived_catalog(spark, tables, source_path or path)
        found = listing.open_listing(source, path, name_contains=name_filter)
        at = listing.page_of(found.total_rows, **request)
        row = (
            found.total_rows,
            found.total_dirs,
            found.total_files,
            found.total_other,
            at.number,
            at.size,
            at.pages,
            found.truncated,
        )
        return spark.createDataFrame(
            [row],
            "total_rows bigint, total_dirs bigint, total_files bigint, total_other bigint, "
            "page bigint, page_size bigint, pages bigint, truncated boolean",
        )

    return query


def listing_page_indexed(spark, tables):
    """A deep page in name order from the rank index of the stored, path-sorted catalog."""
    folder = shared_folder(spark)
    cat.sorted_layout(derived_catalog(spark, tables)).write.parquet(f"{folder}/table")
    rank_index(cat.read_catalog(spark, f"{folder}/table")).write.parquet(f"{folder}/rank")
    index = spark.read.parquet(f"{folder}/rank")
    rows, at = indexed_page(spark, index, CATALOG_SCHEMA, "/events/", page=7, page_size=100)
    return _flag(listing.entries(rows), page=at.number, pages=at.pages)


def name_search_indexed(spark, tables):
    """A name filter answered from the files whose three-character postings hold the needle."""
    folder = shared_folder(spark)
    cat.sorted_layout(derived_catalog(spark, tables)).write.parquet(f"{folder}/table")
    stored = cat.read_catalog(spark, f"{folder}/table")
    name_postings(stored).write.parquet(f"{folder}/postings")
    directory_files(stored).write.parquet(f"{folder}/files")
    postings, files = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/files")
    rows = search(spark, postings, files, CATALOG_SCHEMA, "/events/", " 99 ")
    return _flag(listing.entries(rows), truncated=False)


def listing_counts(spark, tables):
    source = derived_catalog(spark, tables, "/documents/")
    return listing.type_counts(cat.directory_rows(source, "/documents/", name_contains="1"))


def listing_json(spark, tables):
    rows = cat.directory_rows(derived_catalog(spark, tables, "/documents/"), "/documents/")
    shown = listing.entries(rows)
    text = F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"})
    return shown.select("name", text.alias("entry"))


# ---- rollups -----------------------------------------------------------------------------------


def _named(groups: DataFrame, *keys: str) -> DataFrame:
    return groups.select(
        *keys,
        "name",
        "file_count",
        "total_bytes",
        "total_used",
        X.iso_time(groups, "mtime").alias("last_modified"),
        X.iso_time(groups, "atime").alias("last_accessed"),
    )


def _groups(spark: SparkSession, tables: str, path: str, depth: int) -> DataFrame:
    prefix = ru.check_request(path, depth, allow_root=True)
    return ru.rollup_groups(derived_catalog(spark, tables, prefix), prefix, depth)


def _rollup(path: str, depth: int) -> Query:
    return lambda spark, tables: _named(_groups(spark, tables, path, depth))


def rollup_empty_dirs(spark, tables):
    requests = [("/", 1), ("/lineitem/", 2), ("/home/", 1), ("/documents/", 1)]
    groups = ru.rollup_many(derived_catalog(spark, tables), requests)
    return _named(groups.where(F.col("file_count") == 0), "prefix", "depth")


def rollup_many(spark, tables):
    groups = ru.rollup_many(derived_catalog(spark, tables), MANY_ROLLUPS)
    return _named(groups, "prefix", "depth")


def rollup_merge(spark, tables):
    parts = [_groups(spark, tables, path, 1) for path in ("/lineitem/", "/orders/")]
    return _named(ru.merge_groups(parts[0].unionByName(parts[1]), ["name"]))


def rollup_totals(spark, tables):
    return ru.totals(_groups(spark, tables, "/documents/", 2))


def rollup_guard(spark, tables):
    groups = _groups(spark, tables, "/documents/", 2)
    limits = (10, 10_000)
    probes = [
        groups.limit(most + 1)
        .agg(F.count(F.lit(1)).alias("groups_seen"))
        .select(
            F.lit(most).cast("bigint").alias("max_groups"),
            "groups_seen",
            (F.col("groups_seen") > most).alias("too_wide"),
        )
        for most in limits
    ]
    return probes[0].unionAll(probes[1])


def rows_scanned(spark, tables):
    progress = Observation()
    source = derived_catalog(spark, tables, "/lineitem/")
    groups = ru.rollup_groups(source, "/lineitem/", 1, progress)
    groups.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(progress.get["rows_scanned"],)], "rows_scanned bigint")


def rollup_topk(spark, tables):
    k = 5
    groups = ru.guarded(_groups(spark, tables, "/documents/", 2))
    return ru.children(groups, k).withColumn("children_truncated", F.col("total_children") > k)


def rollup_ranked(spark, tables):
    return ru.ranked(ru.with_rank(_groups(spark, tables, "/", 3)))


def rollup_share(spark, tables):
    return ru.with_share(ru.children(_groups(spark, tables, "/documents/", 1)))


def rollup_share_wide(spark, tables):
    """More groups than any default limit: a directory for each customer."""
    placed = F.col("o_custkey").cast("string")
    source = _table(spark, tables, "orders").select(
        F.concat(F.lit("/customers/c"), placed, F.lit("/")).alias("parent_path"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("FILE").alias("element_type"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
        F.floor("o_totalprice").cast("bigint").alias("used"),
        F.col("o_orderdate").alias("mtime"),
        F.col("o_orderdate").alias("atime"),
        F.lit("user").alias("owner_name"),
        F.lit("").alias("extension"),
        F.lit(1).cast("bigint").alias("nlinks"),
    )
    return ru.with_share(ru.children(ru.rollup_groups(source, "/customers/", 1)))


def rollup_envelope(spark, tables):
    groups = materialised(_groups(spark, tables, "/orders/", 1), spark)
    seen = groups.agg(F.sum("file_count").alias("files"), F.count(F.lit(1)).alias("n")).first()
    k = 2
    whole = envelope(
        ru.children(groups, k),
        ru.totals(groups),
        path="/orders/",
        catalog_snapshot=OLDER,
        rows_scanned=seen["files"],
        total_children=seen["n"],
        children_truncated=seen["n"] > k,
    )
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return whole.select(text.alias("envelope"))


def rollup_all_dirs(spark, tables):
    totals = ru.rollup_all_directories(derived_catalog(spark, tables))
    return _named(totals.withColumnRenamed("path", "name"))


def rollup_all_dirs_ranges(spark, tables):
    totals = subtree_totals(derived_catalog(spark, tables))
    return _named(totals.withColumnRenamed("path", "name"))


# ---- expressions -------------------------------------------------------------------------------


def normalize_prefix(spark, tables):
    pages = _table(spark, tables, "pages")
    urls = pages.select("page_id", F.explode(_url_forms(F.col("url"))).alias("given"))
    return urls.select("page_id", "given", P.normalized(F.col("given")).alias("path"))


def _url_forms(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.array(url, path, F.concat(F.lit("//"), path, F.lit("//")))


def group_key(spark, tables):
    files = derived_catalog(spark, tables).where(F.col("element_type") == "FILE")
    parent = F.col("parent_path")
    depth = F.explode(F.array(*[F.lit(d) for d in (1, 2, 3, 8)])).alias("depth")
    keyed = files.groupBy("parent_path").agg(F.count(F.lit(1)).alias("n")).select("*", depth)
    return keyed.select(
        "parent_path",
        "n",
        F.col("depth").cast("bigint").alias("depth"),
        P.group_key(parent, "/", F.col("depth")).alias("key"),
    )


def ns_to_iso(spark, tables):
    # Days from 1995 on, so that older lines give negative times.
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    nanos = days * 86_400_000_000_000 + F.col("l_partkey") * 1_000_003 + F.col("l_linenumber")
    lines = _table(spark, tables, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 13 != 0, nanos).alias("nanos")
    )
    return lines.select("*", X.iso_from_nanos(F.col("nanos")).alias("iso"))


def human_size(spark, tables):
    scale = F.element_at(
        F.array(*[F.lit(1024**p) for p in (0, 0, 1, 2, 3, 4, 4)]), F.col("l_linenumber")
    )
    lines = _table(spark, tables, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 13 != 0, F.floor("l_extendedprice") * scale)
        .cast("bigint")
        .alias("size"),
    )
    return lines.select("*", X.human_size(F.col("size")).alias("size_text"))


def newest(spark, tables):
    files = derived_catalog(spark, tables, "/documents/").where(F.col("element_type") == "FILE")
    later = files.withColumn("later", X.newest(F.col("atime"), F.col("mtime")))
    return later.select("name", X.iso_time(later, "later").alias("newest"))


def ancestors(spark, tables):
    files = derived_catalog(spark, tables).where(F.col("element_type") == "FILE")
    return hierarchy.breadcrumbs(files.select("parent_path").distinct(), "parent_path")


def expand_to(spark, tables):
    files = derived_catalog(spark, tables, "/lineitem/").where(F.col("element_type") == "FILE")
    return hierarchy.expand_to(files.select("parent_path").distinct(), "/lineitem/A", "parent_path")


# ---- hierarchy ---------------------------------------------------------------------------------

_ROOTS = ["/lineitem", "/documents/", "/lineitem/A/"]


def frontier(spark, tables):
    return hierarchy.frontier(derived_catalog(spark, tables), _ROOTS, 2)


def frontier_many_roots(spark, tables):
    return hierarchy.frontier(derived_catalog(spark, tables), MANY_ROOTS, 1)


def frontier_ranges(spark, tables):
    return hierarchy.frontier_ranges(derived_catalog(spark, tables), RANGE_ROOTS, 2)


def frontier_capped(spark, tables):
    return hierarchy.capped_frontier(frontier(spark, tables), 50)


def frontier_missing(spark, tables):
    source = derived_catalog(spark, tables)
    snapshot = F.lit(NEWER).alias("snapshot")
    ready = hierarchy.frontier(source, _ROOTS, 1).select(snapshot, "path")
    wanted = hierarchy.frontier(source, _ROOTS, 2).select(snapshot, "path", "level")
    return hierarchy.not_yet_materialised(wanted, ready)


def materialised_listing(spark, tables):
    source = _written(spark, tables)
    store = ListingStore(spark, shared_folder(spark), shards=4)
    for part, depth in (("first", 0), ("second", 1)):
        wanted = hierarchy.frontier(source, ["/documents/", "/events/"], depth)
        store.add(source, hierarchy.capped_frontier(wanted), NEWER, part)
    rows = store.rows(NEWER)
    return rows.select(
        "snapshot", "parent_path", "name", "element_type", "size", "used", "owner_name"
    )


def listing_ready(spark, tables):
    source = _written(spark, tables)
    store = ListingStore(spark, shared_folder(spark), shards=4)
    wanted = hierarchy.frontier(source, ["/documents/", "/lineitem/"], 1)
    store.add(source, hierarchy.capped_frontier(wanted), NEWER, "only")
    found = listing.open_listing(store.directory(NEWER, "/documents/"), "/documents/")
    rows, at = found.page(1, 40, "size", "desc")
    return _flag(listing.entries(rows), page=at.number, pages=at.pages)


def ready_bucketed(spark, tables):
    source = _written(spark, tables)
    store = BucketedListings(spark, buckets=8)
    store.add(source, hierarchy.frontier(source, ["/documents/", "/lineitem/"], 1), NEWER)
    return store.with_counts(NEWER).select(
        "parent_path", "name", "element_type", "size", "total_rows", "total_dirs", "total_files"
    )


def first_children(spark, tables):
    return hierarchy.first_children(derived_catalog(spark, tables), 8)


def tree_level(spark, tables):
    return hierarchy.tree_levels(derived_catalog(spark, tables), 5)


def _annotated(k: int | None) -> Query:
    def query(spark, tables):
        source = derived_catalog(spark, tables, "/documents/")
        rows, _ = listing.open_listing(source, "/documents/").page(1, 100)
        groups = materialised(ru.rollup_groups(source, "/documents/", 1), spark)
        cut = k is not None and ru.is_too_wide(groups, k)
        shown = rows.select("name", "element_type", "size")
        return annotate.annotated_listing(shown, ru.children(groups, k), children_truncated=cut)

    return query


def listing_unannotated(spark, tables):
    source = derived_catalog(spark, tables, "/documents/")
    rows, _ = listing.open_listing(source, "/documents/").page(1, 100)
    return annotate.annotated_listing(rows.select("name", "element_type", "size"), None)


def tree_annotated(spark, tables):
    source = derived_catalog(spark, tables)
    nodes = hierarchy.directories(source).select("path")
    k = 3
    top = ru.children(ru.rollup_groups(source, "/lineitem/", 1), k)
    return annotate.annotated_tree(nodes, top, "/lineitem/")


DOCS = "/documents/"

QUERIES: dict[str, Query] = {
    "catalog_scan": catalog_scan,
    "dir_scan": dir_scan,
    "subtree_files": subtree_files,
    "child_dirs": child_dirs,
    "snapshot_newest": snapshot_newest,
    "snapshot_pinned_read": snapshot_pinned_read,
    "snapshot_fallback": snapshot_fallback,
    "snapshot_refresh": snapshot_refresh,
    "arrivals_deduplicated": arrivals_deduplicated,
    "refresh_incremental": refresh_incremental,
    "views_normalised": views_normalised,
    "capacity_extract": capacity_extract,
    "control_variant": control_variant,
    "control_fields": control_fields,
    "export_listing": export_listing,
    "export_manifest": export_manifest,
    "export_rollup": export_rollup,
    "csv_safe": csv_safe,
    "listing_type_file": _whole(DOCS, "file"),
    "listing_type_dir": _whole(DOCS, "dir"),
    "listing_type_other": _whole(DOCS, "other"),
    "listing_name_filter": _whole("/events/", name_filter=" 99 "),
    "name_search_indexed": name_search_indexed,
    "listing_cap": _whole("/events/", cap=EVENTS_CAP),
    "listing_filter_escapes_cap": _whole("/events/", name_filter="777", cap=EVENTS_CAP),
    "listing_counts": listing_counts,
    "listing_json": listing_json,
    "listing_sort_name_asc": _page(DOCS, page=2, page_size=30),
    "listing_sort_name_desc": _page(DOCS, page=2, page_size=30, order="desc"),
    "listing_sort_size_desc": _page(DOCS, page=2, page_size=30, sort="size", order="desc"),
    "listing_sort_size_asc": _page(DOCS, page=2, page_size=30, sort="size"),
    "listing_sort_mtime": _page("/events/", page=3, page_size=50, sort="mtime"),
    "listing_sort_mtime_desc": _page("/events/", page=3, page_size=50, sort="mtime", order="desc"),
    "listing_sort_atime": _page(DOCS, page=4, page_size=30, sort="atime", order="descending"),
    "listing_sort_owner": _page(DOCS, page=1, page_size=30, sort="owner_name", order="up"),
    "listing_page": _page(DOCS, page=1, page_size=5000),
    "listing_page_last": _page("/events/", page=10**6, page_size=100, sort="size"),
    "listing_page_capped": _page(
        "/events/", cap=EVENTS_CAP, page=2, page_size=100, sort="size", order="desc"
    ),
    "listing_page_indexed": listing_page_indexed,
    "listing_page_meta": _meta("/events/", page=10**6, page_size=7),
    "listing_unknown": _meta("/no/such/dir", source_path="/", page=3),
    "rollup_depth1": _rollup("/lineitem/", 1),
    "rollup_depth2": _rollup("lineitem", 2),
    "rollup_root": _rollup("/", 1),
    "rollup_root_depth3": _rollup("/", 3),
    "rollup_flat": _rollup("/events/", 1),
    "rollup_null_sizes": _rollup(DOCS, 2),
    "rollup_empty_dirs": rollup_empty_dirs,
    "rollup_many": rollup_many,
    "rollup_merge": rollup_merge,
    "rollup_totals": rollup_totals,
    "rollup_guard": rollup_guard,
    "rows_scanned": rows_scanned,
    "rollup_topk": rollup_topk,
    "rollup_ranked": rollup_ranked,
    "rollup_share": rollup_share,
    "rollup_share_wide": rollup_share_wide,
    "rollup_envelope": rollup_envelope,
    "rollup_all_dirs": rollup_all_dirs,
    "rollup_all_dirs_ranges": rollup_all_dirs_ranges,
    "normalize_prefix": normalize_prefix,
    "group_key": group_key,
    "ns_to_iso": ns_to_iso,
    "human_size": human_size,
    "newest": newest,
    "ancestors": ancestors,
    "expand_to": expand_to,
    "frontier": frontier,
    "frontier_many_roots": frontier_many_roots,
    "frontier_capped": frontier_capped,
    "frontier_ranges": frontier_ranges,
    "frontier_missing": frontier_missing,
    "materialised_listing": materialised_listing,
    "listing_ready": listing_ready,
    "ready_bucketed": ready_bucketed,
    "first_children": first_children,
    "tree_level": tree_level,
    "listing_annotated": _annotated(12),
    "listing_annotated_complete": _annotated(None),
    "listing_unannotated": listing_unannotated,
    "tree_annotated": tree_annotated,
}
