"""Times the headline requests on the given tables; prints one JSON line.

The catalog is derived from the tables and written once in path order (``layout_write``). Requests
then run against that table, as a deployment would, each once after a short warm-up of the JVM.
Queries named ``derived_*`` start from the given tables instead.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fileglade.operators import hierarchy, listing  # noqa: E402
from fileglade.operators import rollup as ru  # noqa: E402
from fileglade.plans.browser import CatalogBrowser  # noqa: E402
from fileglade.sinks.export import csv_safe, listing_export  # noqa: E402
from fileglade.sinks.listings import ListingStore  # noqa: E402
from fileglade.sources.derived import derived_catalog  # noqa: E402
from fileglade.sources.snapshots import SnapshotStore  # noqa: E402
from workload.queries import NEWER, QUERIES  # noqa: E402


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    tables = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    store = SnapshotStore(spark, f"{folder}/store")
    ready = ListingStore(spark, f"{folder}/ready", shards=16)
    plain = CatalogBrowser(spark, store, allow_root=True)
    prepared = CatalogBrowser(spark, store, ready)
    wanted = ["/documents/", "/events/"]

    run(derived_catalog(spark, tables, "/parts/"))

    def catalog():
        return store.read(NEWER)[0]

    def ready_listings():
        reached = hierarchy.frontier(catalog(), wanted, 1)
        ready.add(catalog(), hierarchy.capped_frontier(reached), NEWER, "bench")

    def page(browser, path, **request):
        return lambda: browser.listing(path, **request).entries.collect()

    def rollup(path, depth):
        return lambda: plain.rollup(path, depth).children().collect()

    def capped():
        found = listing.open_listing(catalog(), "/events/", cap=5_000)
        found.page(3, 100, "size", "desc")[0].collect()

    steps = {
        "layout_write": lambda: store.publish(derived_catalog(spark, tables), NEWER),
        "rollup_lineitem_d1": rollup("/lineitem/", 1),
        "rollup_lineitem_d2": rollup("/lineitem/", 2),
        "rollup_root_d1": rollup("/", 1),
        "rollup_root_d3": rollup("/", 3),
        "rollup_events_flat": rollup("/events/", 1),
        "rollup_many": lambda: run(
            ru.rollup_many(catalog(), [("/", 1), ("/lineitem/", 2), ("/documents/", 2)])
        ),
        "rollup_all_dirs": lambda: run(ru.rollup_all_directories(catalog())),
        "listing_documents": page(plain, "/documents/"),
        "listing_events_by_size": page(
            plain, "/events/", page=40, page_size=100, sort="size", order="desc"
        ),
        "listing_name_filter": page(plain, "/events/", name_filter="999"),
        "listing_small_dir": page(plain, "/orders/F/1-URGENT/", sort="mtime"),
        "listing_capped_page": capped,
        "frontier": lambda: run(
            hierarchy.frontier(catalog(), ["/lineitem/", "/documents/"], 2)
        ),
        "first_children": lambda: run(hierarchy.first_children(catalog())),
        "tree_levels": lambda: run(hierarchy.tree_levels(catalog())),
        "ready_listings_write": ready_listings,
        "listing_ready": page(prepared, "/documents/"),
        "export_listing_rows": lambda: run(
            listing_export(listing.open_listing(catalog(), "/events/").rows, "size", "desc")
        ),
        "csv_safe_all": lambda: run(csv_safe(catalog())),
        "derived_rollup_root": lambda: run(QUERIES["rollup_root"](spark, tables)),
        "derived_rollup_depth2": lambda: run(QUERIES["rollup_depth2"](spark, tables)),
        "derived_listing_page": lambda: run(QUERIES["listing_page"](spark, tables)),
        "derived_frontier": lambda: run(QUERIES["frontier"](spark, tables)),
    }
    times = {}
    for name, step in steps.items():
        started = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline requests",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(tables.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
