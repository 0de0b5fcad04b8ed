from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom.functions.canonical import decimal_string, tie_break
from barloom.operators import eligibility as E, equity as Q, exits as X, metrics as T, overlap as O, ranking as R, schedule as SC
from test_bars_and_sessions import business_days, calendar

D = dt.date


def bars(spark, change=None, n=25):
    days = business_days("2024-01-02", "2024-03-29")[:n]
    rows = []
    for i, d in enumerate(days):
        o, h, lo, c = (change or {}).get(i, (100.0, 101.0, 99.0, 100.0))
        rows.append(("A", d, o, h, lo, c, 1000))
    schema = "security_id string, session date, open double, high double, low double, close double, volume long"
    return spark.createDataFrame(rows, schema), days


@pytest.mark.parametrize(
    "change, reason, price, held",
    [
        ({1: (90.0, 101.0, 89.0, 100.0)}, "gap_stop", 90.0, 2),
        ({1: (110.0, 111.0, 99.0, 100.0)}, "gap_target", 110.0, 2),
        ({0: (100.0, 109.0, 94.0, 100.0)}, "stop", 95.0, 1),
        ({1: (100.0, 109.0, 99.0, 100.0)}, "target", 108.0, 2),
        ({}, "time", 100.0, 21),
    ],
)
def test_first_touch_order(spark, change, reason, price, held):
    frame, days = bars(spark, change)
    entry = spark.createDataFrame([("A", days[0], 95.0, 108.0)], "security_id string, entry_session date, stop double, target double")
    row = X.label_outcomes(entry, frame, 21).first()
    assert (row["exit_reason"], row["exit_price"], row["sessions_held"]) == (reason, price, held)


def levels(spark, **values):
    base = dict(entry_price=101.0, stop_kind="entry_minus_fact_multiple", stop_fact="atr", stop_multiple=1.5,
                target_kind="entry_plus_risk_multiple", target_fact=None, target_multiple=1.75, atr=3.0, support=94.0)
    base.update(values)
    schema = ("entry_price double, stop_kind string, stop_fact string, stop_multiple double, target_kind string, "
              "target_fact string, target_multiple double, atr double, support double")
    df = spark.createDataFrame([tuple(base.values())], schema)
    fact = lambda name: F.when(name == "atr", F.col("atr")).when(name == "support", F.col("support"))
    return E.with_geometry(df, fact).withColumn("reason", E.geometry_reason(E.Limits())).first()


def test_geometry_golden_levels(spark):
    row = levels(spark)
    assert (row["stop"], row["target"], row["reward_risk"], row["reason"]) == (96.5, 108.875, 1.75, None)


def test_reward_risk_limit_is_strict(spark):
    assert levels(spark, stop_kind="fact_value", stop_fact="support", stop_multiple=1.0, target_multiple=1.5)["reason"] == "invalid_geometry"
    assert levels(spark, stop_fact="missing")["reason"] == "missing_geometry"


def test_blackout_boundary(spark):
    rows = [(n, True, True, D(2024, 1, 3), D(2024, 1, 4), D(2024, 1, 3), 10.0, 3e7) for n in (None, 2, 3)]
    df = spark.createDataFrame(rows, "sessions_before int, strategy_bound boolean, inputs_bound boolean, signal_session date, entry_session date, latest_fact date, signal_close double, adv double")
    reason = E.rejection_reason(E.Limits(), F.lit(D(2024, 1, 1)), F.lit(D(2024, 2, 1)), F.lit(D(2024, 2, 1)))
    got = {r["sessions_before"]: r["r"] for r in df.withColumn("r", reason).collect()}
    assert got == {None: None, 2: "earnings_blackout", 3: None}


def one_trade(spark, cal, entry, leave, exit_price):
    ord_of = {r["session"]: r["ord"] for r in cal.collect()}
    row = ("s", "c1", "A", "AAA", entry, entry, leave, ord_of[entry], ord_of[leave], "filled", "filled", 100,
           Decimal("100.00"), Decimal(exit_price), (Decimal(exit_price) - 100) * 100, "target")
    return spark.createDataFrame([row], "strategy_id string, candidate_id string, security_id string, symbol string, signal_session date, entry_session date, exit_session date, entry_ord int, exit_ord int, status string, reason string, quantity long, entry_price decimal(18,2), exit_price decimal(18,2), gross_pnl decimal(18,2), exit_reason string")


def test_single_trade_metrics(spark):
    cal = calendar(spark, "2024-01-02", "2024-01-05")
    trade = one_trade(spark, cal, D(2024, 1, 2), D(2024, 1, 3), "110.00")
    capital = F.lit(100_000).cast("decimal(28,2)")
    curve = Q.realized_equity(trade, cal, 100_000)
    core = T.core_result(curve, capital).first()
    assert core["gross_profit"] == 1000 and core["gross_return"] == 0.01 and core["maximum_drawdown"] == 0
    assert core["profit_drawdown_status"] == "positive_return_no_drawdown" and core["profit_drawdown"] is None
    turn = T.turnover(trade, curve, capital).first()
    assert turn["turned_over"] == 21_000 and turn["profit_per_dollar"] == pytest.approx(1000 / 21000)
    held = T.trade_distributions(trade).where("kind = 'holding_sessions'").first()
    assert held["median"] == 2


def test_strategies_without_trades_are_in_the_field(spark):
    cal = calendar(spark, "2024-01-02", "2024-01-12")
    trade = one_trade(spark, cal, D(2024, 1, 2), D(2024, 1, 4), "90.00")
    field = spark.createDataFrame([("s",), ("idle",), ("idle",)], "strategy_id string")
    capital = F.lit(100_000).cast("decimal(28,2)")
    core = {r["strategy_id"]: r for r in T.core_result(Q.realized_equity(trade, cal, 100_000, strategies=field), capital).collect()}
    assert core.keys() == {"s", "idle"} and core["idle"]["ending_equity"] == 100_000 and core["idle"]["maximum_drawdown"] == 0
    split = cal.select("session", F.when(F.col("session") < "2024-01-08", "first").otherwise("second").alias("kind"))
    got = R.leaderboards(R.window_results(trade, split, capital, field)).collect()
    rows = {(r["kind"], r["strategy_id"]): (r["gross_profit"], r["trades"], r["profit_rank"]) for r in got}
    assert len(got) == 4 and rows["first", "idle"] == (0, 0, 1) and rows["first", "s"] == (-1000, 1, 2)
    assert {rows["second", s][:2] for s in ("s", "idle")} == {(0, 0)}
    nothing = trade.limit(0)
    assert {r["trades"] for r in R.window_results(nothing, split, capital, field).collect()} == {0}
    checks = T.invariants(nothing, nothing, Q.realized_equity(nothing, cal, 100_000, strategies=field), capital)
    assert checks.count() == 14 and checks.where("NOT holds OR holds IS NULL").isEmpty()


def test_trade_carried_over_year_end(spark):
    cal = calendar(spark, "2023-12-28", "2024-01-03")
    trade = one_trade(spark, cal, D(2023, 12, 28), D(2024, 1, 2), "110.00")
    days = business_days("2023-12-28", "2024-01-03")
    closes = {D(2023, 12, 28): 102.0, D(2023, 12, 29): 105.0}
    frame = spark.createDataFrame([("A", d, closes.get(d, 110.0)) for d in days], "security_id string, session date, close double")
    curve = Q.equity_curve(trade, frame, cal, 100_000)
    got = {r["year"]: r for r in T.yearly(trade, curve, F.lit(100_000).cast("decimal(28,2)")).collect()}
    assert got[2023]["gross_profit"] == 500 and got[2023]["realized"] == 0
    assert got[2024]["starting_equity"] == 100_500 and got[2024]["gross_profit"] == 500 and got[2024]["realized"] == 1000


def test_ranks_are_unique_and_undefined_is_last(spark):
    rows = [("w", "a", 10.0, 0.1, 2.0, "defined"), ("w", "b", 10.0, 0.1, 2.0, "defined"), ("w", "c", 0.0, 0.0, None, "undefined"),
            ("w", "d", 5.0, 0.0, None, "positive_return_no_drawdown")]
    df = spark.createDataFrame(rows, "kind string, identity string, gross_profit double, maximum_drawdown double, profit_drawdown double, profit_drawdown_status string")
    got = {r["identity"]: (r["profit_rank"], r["drawdown_rank"], r["ratio_rank"]) for r in R.leaderboards(df).collect()}
    assert got == {"a": (1, 3, 2), "b": (2, 4, 3), "c": (4, 1, 4), "d": (3, 2, 1)}


def test_overlap_null_policies(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "m string, k int")
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "left_member string, right_member string")
    plain = {r["left_member"]: r for r in O.jaccard(pairs, members, ["k"], "m").collect()}
    assert plain["a"]["intersection"] == 1 and plain["a"]["jaccard"] == pytest.approx(1 / 3)
    assert plain["c"]["union"] == 0 and plain["c"]["jaccard"] is None
    zero = O.jaccard(pairs, members, ["k"], "m", empty=F.lit(0.0)).where("left_member = 'c'").first()
    assert zero["jaccard"] == 0.0


def test_snapshot_intervals_golden(spark):
    snaps = spark.createDataFrame([(1, D(2025, 1, 6)), (2, D(2025, 1, 7))], "snap int, snapshot_session date")
    events = spark.createDataFrame([("A", D(2025, 2, 3), 1), ("A", D(2025, 2, 4), 2)], "security_id string, event_session date, snap int")
    got = {(r["event_session"], r["known_session"], r["superseded_session"]) for r in SC.snapshot_intervals(snaps, events).collect()}
    assert got == {(D(2025, 2, 3), D(2025, 1, 6), D(2025, 1, 7)), (D(2025, 2, 4), D(2025, 1, 7), None)}


def test_snapshot_intervals_reappearing_and_passed(spark):
    snaps = spark.createDataFrame([(i, D(2025, 1, 5 + i)) for i in range(1, 6)], "snap int, snapshot_session date")
    events = spark.createDataFrame(
        [("A", D(2025, 2, 3), 1), ("A", D(2025, 2, 3), 3), ("B", D(2025, 1, 6), 1), ("B", D(2025, 1, 6), 4)],
        "security_id string, event_session date, snap int",
    )
    got = sorted((r["security_id"], r["known_session"], r["superseded_session"]) for r in SC.snapshot_intervals(snaps, events).collect() if r["superseded_session"])
    assert got == [("A", D(2025, 1, 6), D(2025, 1, 7)), ("A", D(2025, 1, 8), D(2025, 1, 9))]
    passed = [r for r in SC.snapshot_intervals(snaps, events).collect() if r["security_id"] == "B"]
    assert len(passed) == 1 and passed[0]["superseded_session"] is None


def test_canonical_text(spark):
    rows = [("100.000",), ("0.1000",), ("100",), ("1.05",), ("0.0000001",), ("0.00",)]
    df = spark.createDataFrame(rows, "t string").select(decimal_string(F.col("t").cast("decimal(20,7)")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["100", "0.1", "100", "1.05", "0.0000001", "0"]


def test_tie_break_matches_python(spark):
    import hashlib
    import json

    df = spark.range(1).select(tie_break("d", F.lit("a" * 64), F.lit(D(2024, 2, 14)), F.lit("ID-1")).alias("h"))
    payload = {"permanent_id": "ID-1", "signal_session": "2024-02-14", "strategy_revision_identity": "a" * 64}
    text = json.dumps({"domain": "d", "payload": payload}, sort_keys=True, separators=(",", ":"))
    assert df.first()["h"] == hashlib.sha256(text.encode()).hexdigest()


def test_paths_are_made_after_the_last_exchange(spark):
    """Every entry's path of 21 bars crossed the network, twenty times the bars themselves."""
    days = business_days("2024-01-02", "2024-02-12")
    bars = spark.createDataFrame([(s, d, 100.0, 101.0, 99.0, 100.0) for s in "ab" for d in days], "security_id string, session date, open double, high double, low double, close double")
    twice = [("a", days[0], 95.0, 105.0, 1), ("a", days[0], 99.5, 105.0, 2), ("b", days[3], 95.0, 100.5, 3), ("b", days[3], 95.0, 100.5, 3), ("c", days[0], 1.0, 2.0, 4), ("a", None, 1.0, 2.0, 5)]
    entries = spark.createDataFrame(twice, "security_id string, entry_session date, stop double, target double, k int")
    out = X.label_outcomes(entries, bars, 21)
    got = sorted((r.k, r.exit_reason, r.sessions_held) for r in out.collect())
    assert got == [(1, "time", 21), (2, "stop", 1), (3, "target", 1), (3, "target", 1)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Window") < plan.index("Join")
