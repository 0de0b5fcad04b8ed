"""Schedules, eligibility, levels, sizing and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.operators import eligibility as E, exits as X, schedule as SC, signals as SG
from barloom.plans import study
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_SIG_KEYS = "(SELECT DISTINCT security_id, signal_session, entry_session, signal_ord, daily_close, adv20 FROM v_signals)"


def _keys(spark, sf):
    cal = M.calendar(spark, sf)
    signals = study.study_signals(M.bars(spark, sf), cal)
    cols = ["security_id", "signal_session", "entry_session", "signal_ord", "daily_close", "adv"]
    return signals.select(*cols).distinct(), cal


@q("next_scheduled_event", with_views(f"""
SELECT k.security_id, CAST(k.signal_session AS VARCHAR) AS signal_session, CAST(n.next_event AS VARCHAR) AS next_event,
  (SELECT max(ord) FROM v_calendar WHERE session <= n.next_event) - k.signal_ord - 1 AS sessions_before
FROM {_SIG_KEYS} k LEFT JOIN v_next_event n USING (security_id, signal_session)""", recursive=True))
def next_scheduled_event(spark, sf):
    keys, cal = _keys(spark, sf)
    events = SC.next_known_event(M.schedule(spark, sf), cal)
    return present(
        keys.join(events, ["security_id", "signal_ord"], "left").select(
            "security_id", "signal_session", "next_event", "sessions_before"
        )
    )


@q("blackout_eligibility", with_views(f"""
SELECT security_id, CAST(signal_session AS VARCHAR) AS signal_session, sessions_before <= 2 AS blackout
FROM (SELECT k.security_id, k.signal_session, (SELECT max(ord) FROM v_calendar WHERE session <= n.next_event) - k.signal_ord - 1 AS sessions_before
      FROM {_SIG_KEYS} k JOIN v_next_event n USING (security_id, signal_session))""", recursive=True))
def blackout_eligibility(spark, sf):
    keys, cal = _keys(spark, sf)
    events = SC.next_known_event(M.schedule(spark, sf), cal)
    return present(
        keys.join(events, ["security_id", "signal_ord"]).select(
            "security_id", "signal_session", (F.col("sessions_before") <= 2).alias("blackout")
        )
    )


@q("eligibility_reasons", with_views(f"""
SELECT reason, count(*) AS n, CAST(min(signal_session) AS VARCHAR) AS first_session FROM (
  SELECT signal_session, CASE WHEN security_id = 'S7' THEN 'strategy_binding' WHEN security_id = 'S8' THEN 'input_manifest_binding'
    WHEN NOT (signal_session >= DATE '1996-01-01' AND signal_session < DATE '2001-01-01') OR entry_session >= DATE '2001-01-01' THEN 'outside_evaluation_range'
    WHEN signal_session > DATE '2000-12-15' THEN 'source_fact_after_cutoff'
    WHEN daily_close < 100.5 THEN 'minimum_signal_price' WHEN adv20 < 3000000 THEN 'minimum_average_dollar_volume'
    WHEN sessions_before <= 2 THEN 'earnings_blackout' END AS reason
  FROM (SELECT k.*, (SELECT max(ord) FROM v_calendar WHERE session <= n.next_event) - k.signal_ord - 1 AS sessions_before
        FROM {_SIG_KEYS} k LEFT JOIN v_next_event n USING (security_id, signal_session))) GROUP BY reason""", recursive=True))
def eligibility_reasons(spark, sf):
    keys, cal = _keys(spark, sf)
    events = SC.next_known_event(M.schedule(spark, sf), cal)
    rows = (
        keys.join(events, ["security_id", "signal_ord"], "left")
        .withColumn("strategy_bound", F.col("security_id") != "S7")
        .withColumn("inputs_bound", F.col("security_id") != "S8")
        .withColumn("latest_fact", F.col("signal_session"))
        .withColumn("signal_close", F.col("daily_close"))
    )
    limits = E.Limits(minimum_price=100.5, minimum_adv=3_000_000.0)
    day = lambda text: F.to_date(F.lit(text))
    reason = E.rejection_reason(limits, day("1996-01-01"), day("2001-01-01"), day("2000-12-15"))
    return present(
        rows.withColumn("reason", reason)
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"), F.min("signal_session").alias("first_session"))
    )


@q("geometry_levels", with_views("""
SELECT strategy_id, security_id, CAST(signal_session AS VARCHAR) AS signal_session, entry_price, round(stop, 6) AS stop, round(target, 6) AS target,
       round((target - entry_price) / risk, 6) AS reward_risk, round(risk / entry_price, 6) AS stop_fraction
FROM v_levels WHERE geometry_reason IS NULL""", recursive=True))
def geometry_levels(spark, sf):
    entries = study.study_entries(M.bars(spark, sf), M.calendar(spark, sf)).where("geometry_reason IS NULL")
    return present(
        entries.select(
            "strategy_id", "security_id", "signal_session", "entry_price", "stop", "target", "reward_risk", "stop_fraction"
        ),
        6,
    )


@q("geometry_validity", with_views("""
SELECT strategy_id, coalesce(geometry_reason, 'valid') AS outcome, count(*) AS n FROM v_levels GROUP BY 1, 2""", recursive=True))
def geometry_validity(spark, sf):
    entries = study.study_entries(M.bars(spark, sf), M.calendar(spark, sf))
    outcome = F.coalesce("geometry_reason", F.lit("valid"))
    return present(entries.groupBy("strategy_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


@q("opening_recheck", with_views("""
SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN opened < 101 THEN 'minimum_price'
    WHEN entry_price <> opened OR opened - stop <= 0 OR target - opened <= 0 OR (opened - stop) / opened > CAST(0.12 AS DOUBLE)
      OR (target - opened) / (opened - stop) <= 1.5 THEN 'opening_geometry_invalid' ELSE 'ok' END AS outcome
  FROM (SELECT *, entry_price + CASE WHEN signal_ord % 5 = 0 THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS opened FROM v_levels WHERE geometry_reason IS NULL)) GROUP BY outcome""",
   recursive=True))
def opening_recheck(spark, sf):
    entries = study.study_entries(M.bars(spark, sf), M.calendar(spark, sf)).where("geometry_reason IS NULL")
    moved = entries.withColumn(
        "opened", F.col("entry_price") + F.when(F.col("signal_ord") % 5 == 0, 0.25).otherwise(0.0)
    )
    reason = E.opening_reason(E.Limits(minimum_price=101.0), F.col("opened"))
    return present(
        moved.groupBy(F.coalesce(reason, F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    )


@q("position_size", with_views("""
SELECT strategy_id, security_id, CAST(signal_session AS VARCHAR) AS signal_session,
  CAST(least(floor(100000 * CAST(0.0075 AS DOUBLE) / (entry_price - stop)), floor(100000 * CAST(0.15 AS DOUBLE) / entry_price),
    floor(greatest(CAST(0 AS DOUBLE), 100000 * CAST(0.8 AS DOUBLE) - signal_ord % 90 * 1000) / entry_price),
    floor((signal_ord % 40 + 1) * CAST(1000 AS DOUBLE) / entry_price)) AS BIGINT) AS quantity
FROM v_levels WHERE geometry_reason IS NULL""", recursive=True))
def position_size(spark, sf):
    entries = study.study_entries(M.bars(spark, sf), M.calendar(spark, sf)).where("geometry_reason IS NULL")
    deployed = (F.col("signal_ord") % 90 * 1000).cast("double")
    cash = (F.col("signal_ord") % 40 + 1) * 1000.0
    size = E.share_quantity(E.Limits(), F.col("entry_price"), F.col("stop"), F.lit(100_000.0), deployed, cash)
    return present(
        entries.select("strategy_id", "security_id", "signal_session", size.cast("bigint").alias("quantity"))
    )


@q("first_touch_exits", with_views("""
SELECT l.strategy_id, l.security_id, CAST(l.signal_session AS VARCHAR) AS signal_session, CAST(x.session AS VARCHAR) AS exit_session,
       x.reason AS exit_reason, round(x.price, 6) AS exit_price, x.i + 1 AS sessions_held
FROM (SELECT * FROM v_levels WHERE geometry_reason IS NULL) l
LEFT JOIN v_exits x USING (strategy_id, security_id, signal_session)""", recursive=True))
def first_touch_exits(spark, sf):
    out = study.study_outcomes(M.bars(spark, sf), M.calendar(spark, sf)).where("geometry_reason IS NULL")
    return present(
        out.select(
            "strategy_id", "security_id", "signal_session", F.col("exit.session").alias("exit_session"),
            F.col("exit.reason").alias("exit_reason"), F.col("exit.price").alias("exit_price"),
            F.col("exit.held").alias("sessions_held"),
        ),
        6,
    )


@q("full_forward_window", with_views("""
SELECT e.security_id, CAST(e.session AS VARCHAR) AS entry_session, coalesce(x.session < DATE '2000-06-30', false) AS full_window
FROM v_daily_rn e LEFT JOIN v_daily_rn x ON x.security_id = e.security_id AND x.rn = e.rn + 20"""))
def full_forward_window(spark, sf):
    ahead = X.with_forward_path(M.bars(spark, sf), 21)
    full = X.full_window(F.col("path"), 21, F.to_date(F.lit("2000-06-30")))
    return present(ahead.select("security_id", F.col("session").alias("entry_session"), full.alias("full_window")))


@q("labelled_entries", with_views("""
WITH t AS (SELECT p.security_id, p.entry, p.session, p.i, CASE WHEN i > 0 AND open <= stop THEN 'gap_stop' WHEN i > 0 AND open >= target THEN 'gap_target'
     WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' WHEN i = 20 THEN 'time' END AS reason,
     CASE WHEN i > 0 AND (open <= stop OR open >= target) THEN open WHEN low <= stop THEN stop WHEN high >= target THEN target ELSE close END AS price
  FROM (SELECT e.security_id, e.session AS entry, b.session, b.rn - e.rn AS i, b.open, b.high, b.low, b.close, e.open - 3 AS stop, e.open + 4 AS target
        FROM v_daily_rn e JOIN v_daily_rn b ON b.security_id = e.security_id AND b.rn BETWEEN e.rn AND e.rn + 20) p)
SELECT e.security_id, CAST(e.session AS VARCHAR) AS entry_session, CAST(x.session AS VARCHAR) AS exit_session, x.reason AS exit_reason,
       round(x.price, 6) AS exit_price, x.i + 1 AS sessions_held
FROM v_daily_rn e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, entry ORDER BY i) AS k FROM t WHERE reason IS NOT NULL) WHERE k = 1) x
  ON x.security_id = e.security_id AND x.entry = e.session""".replace("WITH t AS (", "SELECT * FROM (WITH t AS (", 1) + ")"))
def labelled_entries(spark, sf):
    bars = M.bars(spark, sf)
    entries = bars.select(
        "security_id", F.col("session").alias("entry_session"), (F.col("open") - 3).alias("stop"),
        (F.col("open") + 4).alias("target"),
    )
    out = X.label_outcomes(entries, bars, 21)
    return present(out.drop("stop", "target"), 6)


@q("session_admission", with_views("""
SELECT strategy_id, candidate_id, CAST(entry_session AS VARCHAR) AS entry_session, rk AS priority_rank, CAST(rn AS DOUBLE) AS running_notional,
       rk <= 8 AND rn <= 15000 AS admitted
FROM (SELECT *, sum(quantity * entry_price) OVER (PARTITION BY strategy_id, entry_session ORDER BY rk) AS rn
      FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, entry_session ORDER BY entry_price DESC, candidate_id) AS rk FROM v_firsts))""",
   v_firsts="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, entry_session, security_id ORDER BY entry_price DESC, candidate_id) AS k
      FROM v_trades) WHERE k = 1"""))
def session_admission(spark, sf):
    trades = M.trades(spark, sf)
    # one candidate per security: the best-priced, ties by candidate id
    best = F.min(F.struct((-F.col("entry_price")).alias("p"), F.col("candidate_id"), F.col("quantity")))
    once = (
        trades.groupBy("strategy_id", "entry_session", "security_id")
        .agg(best.alias("b"))
        .select(
            "strategy_id", "entry_session", "security_id", F.col("b.candidate_id").alias("candidate_id"),
            F.col("b.quantity").alias("quantity"), (-F.col("b.p")).cast("decimal(18,2)").alias("entry_price"),
        )
    )
    keys = ["strategy_id", "entry_session"]
    ranked = SG.priority_order(once, keys, "entry_price", "candidate_id", width=0.5)
    notional = (F.col("quantity").cast("decimal(10,0)") * F.col("entry_price")).cast("decimal(18,2)")
    return present(
        SG.admit(ranked, keys, "priority_rank", notional, slots=8, cap=15000).select(
            "strategy_id", "candidate_id", "entry_session", "priority_rank", "running_notional", "admitted"
        )
    )


@q("study_evaluation", with_views("""
SELECT l.strategy_id, count(*) AS candidates, count(*) FILTER (WHERE geometry_reason = 'missing_geometry') AS missing_geometry,
  count(*) FILTER (WHERE geometry_reason = 'invalid_geometry') AS invalid_geometry, count(x.reason) AS closed,
  count(*) FILTER (WHERE x.reason = 'gap_stop') AS gap_stop, count(*) FILTER (WHERE x.reason = 'gap_target') AS gap_target,
  count(*) FILTER (WHERE x.reason = 'stop') AS stop, count(*) FILTER (WHERE x.reason = 'target') AS target,
  count(*) FILTER (WHERE x.reason = 'time') AS time, round(avg(x.price / l.entry_price - 1), 8) AS mean_return,
  round(avg(x.i + 1), 8) AS mean_held, count(*) FILTER (WHERE x.price / l.entry_price - 1 > 0) AS winners
FROM v_levels l LEFT JOIN v_exits x USING (strategy_id, security_id, signal_session) GROUP BY l.strategy_id""", recursive=True))
def study_evaluation(spark, sf):
    return present(study.evaluate(M.bars(spark, sf), M.calendar(spark, sf)), 8)
