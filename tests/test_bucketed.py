"""Bucketed ready listings: rows meet their counts without an Exchange."""

from pyspark.sql import functions as F

from fileglade.operators import hierarchy
from fileglade.sinks.bucketed import BucketedListings


def test_rows_and_counts_join_without_exchange(spark, stored):
    store = BucketedListings(spark, buckets=4)
    wanted = hierarchy.frontier(stored, ["/documents/", "/events/"], 1)
    store.add(stored, wanted, "s1")
    joined = store.with_counts("s1")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for counts too large to broadcast
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    paths = [r["path"] for r in wanted.collect()]
    direct = stored.where(F.col("parent_path").isin(paths))
    assert joined.count() == direct.count()
    counts = {r["parent_path"]: r["total_rows"] for r in store.counts("s1").collect()}
    want = {r["parent_path"]: r["count"] for r in direct.groupBy("parent_path").count().collect()}
    assert counts == want
