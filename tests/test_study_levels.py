from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.plans import study
from test_bars_and_sessions import business_days, calendar


def test_levels_of_a_signal_are_worked_out_once_for_all_its_rules(spark):
    """Paths and exits were made again for each rule that fired, twelve times in the worst case."""
    days = business_days("2020-01-02", "2021-08-31")
    wave = [100 + 8 * math.sin(i / 9) + i / 30 for i in range(len(days))]
    rows = [("a", d, w, w + 1, w - 1, w + 0.3, 1000) for d, w in zip(days, wave, strict=True)]
    bars = spark.createDataFrame(rows, "security_id string, session date, open double, high double, low double, close double, volume bigint")
    cal = calendar(spark, "2020-01-02", "2021-12-31")
    levels, entries = study.study_levels(bars, cal), study.study_entries(bars, cal)
    key = ["security_id", "signal_session", "stop_slug", "target_slug"]
    counted = levels.agg(F.count("*").alias("n"), F.count_distinct(*key).alias("d"), F.sum(F.size("rules")).alias("r")).first()
    assert counted.n == counted.d > 0 and counted.r > counted.n
    assert entries.count() == counted.r == entries.select("strategy_id", "signal_session").distinct().count()
