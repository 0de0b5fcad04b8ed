from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import bars as B, quality as Y, sessions as S
from barloom.sources import sinks

D = dt.date


def business_days(start, end, skip=()):
    return [d.date() for d in pd.bdate_range(start, end) if d.date() not in skip]


def calendar(spark, start="2024-01-02", end="2024-12-31", skip=()):
    return S.session_calendar(spark.createDataFrame([(d,) for d in business_days(start, end, skip)], "session date"))


def ramp(spark, days, security="A"):
    rows = [(security, d, 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 1_000_000 + 1000 * i) for i, d in enumerate(days)]
    return spark.createDataFrame(
        rows, "security_id string, session date, open double, high double, low double, close double, volume long"
    )


def test_trailing_incomplete_week_is_hidden(spark):
    cal = calendar(spark, end="2024-03-29")
    days = business_days("2024-01-02", "2024-02-14")
    weekly = B.period_bars(ramp(spark, days), cal, "weekly").orderBy("session").collect()
    assert weekly[-1]["session"] == D(2024, 2, 9)
    days = business_days("2024-01-02", "2024-02-16")
    weekly = B.period_bars(ramp(spark, days), cal, "weekly").orderBy("session").collect()
    assert weekly[-1]["session"] == D(2024, 2, 16)
    monthly = B.period_bars(ramp(spark, days), cal, "monthly").orderBy("session").collect()
    assert [r["session"] for r in monthly] == [D(2024, 1, 31)]


def test_holiday_friday_labels_thursday(spark):
    friday = D(2024, 3, 29)
    cal = calendar(spark, end="2024-04-30", skip=(friday,))
    days = business_days("2024-03-18", "2024-04-05", skip=(friday,))
    labels = [r["session"] for r in B.period_bars(ramp(spark, days), cal, "weekly").orderBy("session").collect()]
    assert labels == [D(2024, 3, 22), D(2024, 3, 28), D(2024, 4, 5)]


def test_half_day_close_decides_last_completed(spark):
    closes = spark.createDataFrame(
        [
            (D(2025, 11, 26), dt.datetime(2025, 11, 26, 21, 0)),
            (D(2025, 11, 28), dt.datetime(2025, 11, 28, 18, 0)),
        ],
        "session date, close_ts timestamp",
    )
    instants = spark.createDataFrame(
        [(1, dt.datetime(2025, 11, 28, 17, 0)), (2, dt.datetime(2025, 11, 28, 18, 5))], "id int, ts timestamp"
    )
    got = {r["id"]: r["completed_session"] for r in S.last_completed(instants, closes).collect()}
    assert got == {1: D(2025, 11, 26), 2: D(2025, 11, 28)}


def test_split_is_60_20_20_with_purges(spark):
    cal = calendar(spark, "2024-01-02", "2025-01-03")
    n = cal.count()
    got = {r["kind"]: r["session_count"] for r in S.split_windows(cal).collect()}
    dev, oos = n * 3 // 5, n * 4 // 5
    assert got == {
        "development": dev - 21,
        "development_validation_purge": 21,
        "validation": oos - dev - 21,
        "validation_oos_purge": 21,
        "oos": n - oos,
    }


def quality_rows(spark, **change):
    days = [D(2026, 6, 25), D(2026, 6, 26), D(2026, 6, 29), D(2026, 6, 30)]
    rows = [["A", i, d, 100.0, 101.0, 99.0, 100.5, 1000] for i, d in enumerate(days)]
    for field, (row, value) in change.items():
        at = {"open": 3, "high": 4, "low": 5, "close": 6, "volume": 7, "session": 2}[field]
        rows[row][at] = value
    return rows


SCHEMA = "security_id string, pos long, session date, open double, high double, low double, close double, volume long"


def report(spark, rows):
    cal = calendar(spark, "2026-06-22", "2026-07-03")
    return Y.quality_report(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), cal, "pos").first()


def test_quality_one_defect_at_a_time(spark):
    clean = report(spark, quality_rows(spark))
    assert clean["ok"] and clean["errors"] == [] and clean["warnings"] == []
    assert report(spark, quality_rows(spark, close=(1, None)))["errors"] == ["NaN values on 1 bar(s)"]
    assert "non-positive price(s)" in report(spark, quality_rows(spark, low=(1, -1.0)))["errors"]
    assert report(spark, quality_rows(spark, high=(2, 90.0)))["errors"] == ["inconsistent OHLC range on 1 bar(s)"]
    assert report(spark, quality_rows(spark, volume=(0, -100)))["errors"] == ["negative volume"]
    assert report(spark, quality_rows(spark, volume=(0, 0)))["warnings"] == ["1 zero-volume bar(s)"]
    rows = quality_rows(spark)
    assert report(spark, rows[:1] + rows[2:])["errors"] == ["1 missing session(s), e.g. 2026-06-26"]
    assert report(spark, rows + [["A", 4, D(2026, 6, 30), 100.0, 101.0, 99.0, 100.5, 1000]])["errors"] == ["duplicate dates"]
    backward = [[r[0], -r[1], *r[2:]] for r in rows]
    assert report(spark, backward)["errors"] == ["index not sorted"]
    jump = [r[:3] + [x * 2 for x in r[3:7]] + r[7:] if i == 3 else r for i, r in enumerate(rows)]
    found = report(spark, jump)
    assert found["ok"] and found["warnings"] == ["1 extreme move(s) >50%, e.g. 2026-06-30 (100%)"]


def test_vendor_rows_keep_the_last_duplicate(spark):
    rows = spark.createDataFrame(
        [("A", 1, "2026-06-29 00:00:00", 1.0, 1.0, 1.0, 200.0, 1), ("A", 2, "2026-06-29 00:00:00", 1.0, 1.0, 1.0, 201.0, 1)],
        "Security_Id string, Seq int, Session string, Open double, High double, Low double, Close double, Volume long",
    )
    kept = B.normalize_vendor_rows(rows, ["Seq"]).collect()
    assert len(kept) == 1 and kept[0]["close"] == 201.0


def test_refused_write_leaves_stored_bars(spark, tmp_path):
    path = str(tmp_path / "store")
    days = business_days("2026-06-22", "2026-06-25")
    both = ramp(spark, days, "A").unionByName(ramp(spark, days, "B"))
    ok = spark.createDataFrame([("A", True), ("B", True)], "security_id string, ok boolean")
    sinks.write_bars(both, ok, F.lit(D(2026, 6, 23)), path)
    stored = sinks.read_bars(spark, path)
    assert stored.count() == 4 and stored.agg(F.max("session")).first()[0] == D(2026, 6, 23)
    bad = spark.createDataFrame([("A", True), ("B", False)], "security_id string, ok boolean")
    sinks.write_bars(both, bad, F.lit(D(2026, 6, 25)), path)
    counts = {r["security_id"]: r["count"] for r in sinks.read_bars(spark, path).groupBy("security_id").count().collect()}
    assert counts == {"A": 4, "B": 2}


def test_publish_once_is_idempotent_and_refuses_changes(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    path = str(tmp_path / "part")
    assert sinks.publish_once(df, path) == "written"
    assert sinks.publish_once(df, path) == "unchanged"
    with pytest.raises(ValueError):
        sinks.publish_once(df.where("id = 1"), path)
