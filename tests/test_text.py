import datetime
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from fileglade.functions import text as X


def _iso(nanos):
    if nanos is None:
        return ""
    moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=nanos // 10**9)
    return f"{moment.isoformat()}.{nanos % 10**9:09d}"


def test_iso_from_nanos(spark):
    rng = random.Random(3)
    values = [0, 1_712_345_678_987_654_321, None, -1, -(10**9), 10**9 - 1, 1_741_503_600 * 10**9]
    values += [rng.randint(-(2 * 10**18), 4 * 10**18) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "n bigint")
    rows = frame.select("n", X.iso_from_nanos(F.col("n")).alias("iso")).collect()
    assert [r["iso"] for r in rows] == [_iso(v) for v in values]
    assert rows[1]["iso"] == "2024-04-05T19:34:38.987654321"


def test_iso_from_ntz_is_free_of_the_session_zone(spark):
    # 02:30 does not exist on that day in the session's time zone.
    moments = [
        datetime.datetime(2025, 3, 9, 2, 30),
        datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999),
        datetime.datetime(2024, 1, 1, 0, 0, 0, 120_000),
        None,
    ]
    frame = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    rows = frame.select(X.iso_from_ntz(F.col("t")).alias("iso")).collect()
    assert [r["iso"] for r in rows] == [
        "2025-03-09T02:30:00.000000000",
        "1969-12-31T23:59:59.999999000",
        "2024-01-01T00:00:00.120000000",
        "",
    ]


def test_iso_time_follows_the_column_type(spark):
    frame = spark.sql(
        "select 1712345678987654321L as n, timestamp '2024-04-05 19:34:38.5Z' as t, "
        "timestamp_ntz '2024-04-05 19:34:38.5' as z, cast(null as timestamp) as e"
    )
    row = frame.select(*[X.iso_time(frame, c).alias(c) for c in frame.columns]).first()
    assert tuple(row) == (
        "2024-04-05T19:34:38.987654321",
        "2024-04-05T19:34:38.500000000",
        "2024-04-05T19:34:38.500000000",
        "",
    )


def _human(n):
    if n is None:
        return "—"
    for power, unit in enumerate(["B", "KiB", "MiB", "GiB", "TiB", "PiB"]):
        if n < 1024 ** (power + 1) or unit == "PiB":
            if unit == "B":
                return f"{n} B"
            value = Decimal(n) / Decimal(1024**power)
            return f"{value.quantize(Decimal('0.1'), ROUND_HALF_UP)} {unit}"


def test_human_size(spark):
    rng = random.Random(5)
    values = [None, 0, 1, -5, 1023, 1024, 1075, 1_048_575, 1_048_576, 2**63 - 1]
    for power in range(1, 6):
        values += [1024**power * k + d for k in (1, 3) for d in (-1, 0, 1)]
        values += [1024**power + 1024**power // 20 * k for k in range(1, 8)]
    values += [rng.randint(0, 2**63 - 1) >> rng.randint(0, 62) for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "n bigint")
    rows = frame.select(X.human_size(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == [_human(v) for v in values]
    assert "1024.0 KiB" in [r["s"] for r in rows]


def test_newest(spark):
    frame = spark.createDataFrame([(1, 2), (None, 2), (1, None), (None, None)], "a int, b int")
    assert [r[0] for r in frame.select(X.newest(F.col("a"), F.col("b"))).collect()] == [2, 2, 1, None]


def test_spreadsheet_safe(spark):
    cells = ["=SUM(B2)", "+44 170", "-minus", "@handle", "\ttabbed", "\rback", "\nnext", "plain", "", None, "k=v", "'=quoted"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    rows = frame.select(X.spreadsheet_safe(F.col("c")).alias("c")).collect()
    expected = ["'" + c if c and c[0] in "=+-@\t\r\n" else c for c in cells]
    assert [r["c"] for r in rows] == expected
