"""Announcements deduplicated within the watermark: repeats and late ones go, state is bounded."""

import datetime as dt

from fileglade.streaming.arrivals import ARRIVALS, follow_arrivals


def write(spark, folder, rows):
    frame = spark.createDataFrame([(s, dt.datetime(2031, 5, 6, h, m)) for s, h, m in rows], ARRIVALS)
    frame.coalesce(1).write.mode("append").json(folder)


def run(spark, tmp_path):
    query = follow_arrivals(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), delay="10 minutes"
    )
    query.awaitTermination()
    return query


def test_repeats_and_late_announcements(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [("files_a", 10, 0), ("files_a", 10, 5), ("files_b", 10, 30)])
    run(spark, tmp_path)
    write(spark, str(tmp_path / "in"), [("files_a", 10, 10), ("files_c", 12, 0), ("files_c", 12, 1)])
    query = run(spark, tmp_path)
    kept = spark.read.schema(ARRIVALS).parquet(str(tmp_path / "out"))
    assert sorted(r.snapshot for r in kept.collect()) == ["files_a", "files_b", "files_c"]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states and max(states) <= 2  # files_a has left the state
