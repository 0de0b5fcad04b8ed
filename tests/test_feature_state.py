from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators.feature_state import FeatureState, FeatureStore
from barloom.plans import grid, study
from test_bars_and_sessions import business_days, calendar
from test_features_and_rules import noisy

EVERY_KIND = (
    *grid.FEATURES,
    X.Feature("weekly_sma3", "weekly", "sma", "close", 3),
    X.Feature("weekly_atr3", "weekly", "atr", "close", 3),
    X.Feature("monthly_high2", "monthly", "rolling_max", "high", 2),
    X.Feature("weekly_volume2", "weekly", "sma", "volume", 2),
    X.Feature("daily_volume_ema3", "daily", "ema", "volume", 3),
)


def gappy(spark, end="2024-09-30"):
    """Two securities without gaps and one that skips many sessions, week and month ends among them."""
    days = business_days("2023-09-01", end)
    rare = [d for i, d in enumerate(days) if i % 4 == 1 or i % 11 == 0]
    a, b = noisy(spark, days, 1, "A"), noisy(spark, rare, 2, "B")
    holes = noisy(spark, days, 3, "C").withColumn("close", F.when(F.dayofmonth("session") % 9 != 0, F.col("close")))
    return a.union(b).union(holes).cache()


def compare(state_rows, full):
    names = [c for c in state_rows.columns if c not in ("before", "close")]
    got = {r["security_id"]: r for r in state_rows.select(*names).collect()}
    want = {r["security_id"]: r for r in full.select(*names).collect()}
    assert set(got) == set(want) and got
    for security, row in want.items():
        for name in names:
            mine, theirs = got[security][name], row[name]
            if isinstance(theirs, float):
                assert mine is not None and abs(mine - theirs) < 1e-9 * max(1, abs(theirs)), (security, name)
            else:
                assert mine == theirs, (security, name)


def test_state_gives_the_features_of_a_full_recomputation(spark, tmp_path):
    cal, bars = calendar(spark, "2023-08-01", "2024-12-31").cache(), gappy(spark)
    kind = FeatureState(EVERY_KIND, grid.ADV_LOOKBACK)
    store = FeatureStore(spark, str(tmp_path / "state"), kind)
    store.take("2024-08-27", bars, cal)
    for day in business_days("2024-08-28", "2024-09-04"):
        states = store.take(day, bars, cal)
        past = bars.where(F.col("session") <= F.lit(day))
        full = X.feature_matrix(past, cal, EVERY_KIND).withColumn("adv", X.average_dollar_volume(grid.ADV_LOOKBACK))
        compare(kind.matrix(states, F.lit(day)), full.where(F.col("session") == F.lit(day)))
    assert store.versions()[0] == "2024-08-27" and len(store.versions()) == 7


def test_one_batch_of_many_sessions_equals_single_sessions(spark, tmp_path):
    cal, bars = calendar(spark, "2023-08-01", "2024-12-31").cache(), gappy(spark)
    kind = study.feature_state()
    at_once = kind.advance(kind.empty(spark), bars.where("session <= DATE '2024-03-06'"), cal)
    store = FeatureStore(spark, str(tmp_path / "state"), kind)
    for day in ("2024-02-28", "2024-03-01", "2024-03-04", "2024-03-05", "2024-03-06"):
        states = store.take(day, bars, cal)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, states.collect()))


def test_signals_of_a_session_need_no_history(spark, tmp_path):
    cal, bars = calendar(spark, "2023-08-01", "2024-12-31").cache(), gappy(spark)
    store = FeatureStore(spark, str(tmp_path / "state"), study.feature_state())
    store.take("2024-06-10", bars, cal)
    columns = ("rule", "security_id", "signal_session", "entry_session", "weekly_available", "monthly_available")
    found = 0
    for day in business_days("2024-06-11", "2024-06-18"):
        only = bars.where(F.col("session") == F.lit(day))
        got = study.session_signals(store.take(day, only, cal), cal, F.lit(day)).select(*columns)
        past = study.study_signals(bars.where(F.col("session") <= F.lit(day)), cal)
        want = past.where(F.col("signal_session") == F.lit(day)).select(*columns)
        assert sorted(got.collect()) == sorted(want.collect())
        found += got.count()
    assert found > 0


def test_session_taken_again_and_late_bars_change_nothing(spark, tmp_path):
    cal, bars = calendar(spark, "2023-08-01", "2024-12-31").cache(), gappy(spark)
    store = FeatureStore(spark, str(tmp_path / "state"), study.feature_state())
    store.take("2024-06-10", bars, cal)
    first = sorted(map(str, store.take("2024-06-11", bars, cal).collect()))
    assert sorted(map(str, store.take("2024-06-11", bars, cal).collect())) == first
    # a folder that a crash left without its mark of completion is not read, and is replaced
    broken = tmp_path / "state" / "session=2024-06-11" / "_SUCCESS"
    broken.unlink()
    assert store.versions() == ["2024-06-10"]
    assert sorted(map(str, store.take("2024-06-11", bars, cal).collect())) == first
    late = store.kind.advance(store.read("2024-06-11"), bars.where("session <= DATE '2024-06-11'"), cal)
    assert sorted(map(str, late.collect())) == first


def test_empty_inputs(spark, tmp_path):
    cal, bars = calendar(spark, "2023-08-01", "2024-12-31").cache(), gappy(spark)
    store = FeatureStore(spark, str(tmp_path / "state"), study.feature_state())
    assert store.versions() == [] and store.read(None).count() == 0
    states = store.take(dt.date(2023, 8, 15), bars.where("false"), cal)
    assert states.count() == 0 and study.session_signals(states, cal, F.lit(dt.date(2023, 8, 15))).count() == 0


def test_history_is_taken_without_values_of_bars_that_no_row_keeps(spark, monkeypatch):
    """Every bar of the history was given all features, though a state keeps those of its two newest bars."""
    cal, bars = calendar(spark, "2023-08-01", "2024-12-31").cache(), gappy(spark)
    kind = study.feature_state()
    days = [r.session for r in bars.where("session <= DATE '2024-03-06'").select("session").distinct().orderBy("session").collect()][-3:]
    states = kind.advance(kind.empty(spark), bars.where(F.col("session") < F.lit(days[0])), cal)
    for day in days:
        states = kind.advance(states, bars.where(F.col("session") == F.lit(day)), cal).localCheckpoint()
    asked, plain = [], FeatureState.after
    monkeypatch.setattr(FeatureState, "after", lambda self, state, bar, *a, **k: asked.append(k.get("values", True)) or plain(self, state, bar, *a, **k))
    fresh = study.feature_state()
    at_once = fresh.advance(fresh.empty(spark), bars.where("session <= DATE '2024-03-06'"), cal)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, states.collect()))
    assert False in asked
