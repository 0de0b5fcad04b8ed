"""Conditions, signals, priority, levels and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.functions.canonical import tie_break
from barloom.operators import features as X, rules as R, signals as SG
from barloom.plans import flagship, grid, study
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}
TIE = "barloom/tie-break/v1"


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _close_features(spark, sf):
    specs = [f for f in grid.FEATURES if f.name in ("daily_close", "daily_sma10", "daily_return5")]
    return X.with_features(M.bars(spark, sf), specs, {c: c for c in X.SOURCES}, ["security_id"])


def _fired(df, condition, *names):
    hit = df.withColumn("hit", R.condition_column(condition)).where("hit")
    return present(hit.select("security_id", "session", *names), 6)


_LAG = "SELECT *, lag(daily_close) OVER w AS pc, lag(daily_sma10) OVER w AS ps, lag(daily_return5) OVER w AS pr FROM v_feat WINDOW w AS (PARTITION BY security_id ORDER BY session)"
_CS = "SELECT security_id, CAST(session AS VARCHAR) AS session, daily_close, round(daily_sma10, 6) AS daily_sma10 FROM v_lag1"


@q("cross_above", with_views(f"{_CS} WHERE daily_close > daily_sma10 AND pc <= ps", v_lag1=_LAG))
def cross_above(spark, sf):
    c = R.Condition("daily_close", "crosses_above", feature="daily_sma10")
    return _fired(_close_features(spark, sf), c, "daily_close", "daily_sma10")


@q("cross_below", with_views(f"{_CS} WHERE daily_close < daily_sma10 AND pc >= ps", v_lag1=_LAG))
def cross_below(spark, sf):
    c = R.Condition("daily_close", "crosses_below", feature="daily_sma10")
    return _fired(_close_features(spark, sf), c, "daily_close", "daily_sma10")


@q("threshold_cross", with_views("""
SELECT security_id, CAST(session AS VARCHAR) AS session, round(daily_return5, 6) AS daily_return5
FROM v_lag1 WHERE daily_return5 > 0 AND pr <= 0""", v_lag1=_LAG))
def threshold_cross(spark, sf):
    c = R.Condition("daily_return5", "crosses_above", threshold=0.0)
    return _fired(_close_features(spark, sf), c, "daily_return5")


@q("comparators", with_views("""
SELECT count(*) FILTER (WHERE daily_close > daily_sma10) AS gt, count(*) FILTER (WHERE daily_close >= daily_sma10) AS gte,
       count(*) FILTER (WHERE daily_close < daily_sma10) AS lt, count(*) FILTER (WHERE daily_close <= 105.5) AS lte, count(*) AS bars FROM v_feat"""))
def comparators(spark, sf):
    df = _close_features(spark, sf)
    sma = {"feature": "daily_sma10"}
    return df.select(
        *[R.condition_column(R.Condition("daily_close", op, **sma)).alias(op) for op in ("gt", "gte", "lt")],
        R.condition_column(R.Condition("daily_close", "lte", threshold=105.5)).alias("lte"),
    ).agg(*[F.count_if(op).alias(op) for op in ("gt", "gte", "lt", "lte")], F.count(F.lit(1)).alias("bars"))


_TIE_SQL = """sha256('{"domain":"' || 'barloom/tie-break/v1' || '","payload":{"permanent_id":"' || security_id ||
 '","signal_session":"' || CAST(signal_session AS VARCHAR) || '","strategy_revision_identity":"' || sha256(rule) || '"}}')"""


@q("where_when_signals", with_views(f"""
SELECT security_id, CAST(signal_session AS VARCHAR) AS signal_session, CAST(entry_session AS VARCHAR) AS entry_session,
  daily_close, round(daily_sma10, 6) AS daily_sma10, weekly_close, round(weekly_ema13, 6) AS weekly_ema13,
  round(daily_return20, 6) AS daily_return20,
  row_number() OVER (PARTITION BY signal_session ORDER BY daily_return20 DESC, {_TIE_SQL}) AS priority_rank
FROM v_signals WHERE rule = 'weekly-ema13-above__close-cross-sma10'""", recursive=True))
def where_when_signals(spark, sf):
    return present(flagship.weekly_trend_crosses(M.bars(spark, sf), M.calendar(spark, sf), TIE), 6)


@q("signals_by_rule", with_views("""
SELECT rule, security_id, CAST(signal_session AS VARCHAR) AS signal_session, CAST(entry_session AS VARCHAR) AS entry_session,
       daily_close, round(adv20, 2) AS adv, round(daily_return20, 8) AS priority
FROM v_signals WHERE signal_session >= DATE '1996-01-01' AND signal_session < DATE '2001-01-01' AND entry_session < DATE '2001-01-01'""",
   recursive=True))
def signals_by_rule(spark, sf):
    signals = study.study_signals(M.bars(spark, sf), M.calendar(spark, sf))
    start, end = F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("2001-01-01"))
    kept = SG.in_range(signals, start, end, end)
    return present(
        kept.select(
            "rule", "security_id", "signal_session", "entry_session", "daily_close", "adv",
            F.col("daily_return20").alias("priority"),
        ),
        8, adv=2,
    )


@q("signal_priority", with_views(f"""
SELECT rule, security_id, CAST(signal_session AS VARCHAR) AS signal_session, {_TIE_SQL} AS tie,
       row_number() OVER (PARTITION BY rule, signal_session ORDER BY daily_return20 DESC, {_TIE_SQL}) AS priority_rank
FROM v_signals""", recursive=True))
def signal_priority(spark, sf):
    cal = M.calendar(spark, sf)
    fired = SG.rules_fired(study.study_matrix(M.bars(spark, sf), cal), grid.rules(), grid.PRIORITY, "adv")
    tie = tie_break(TIE, F.sha2(F.col("rule"), 256), F.col("signal_session"), F.col("security_id"))
    return present(SG.rules_in_order(SG.with_entry_session(fired, cal), grid.PRIORITY, tie))


_FRAMES = {f.name: f.timeframe for f in grid.FEATURES}


def _available(fact: str) -> str:
    return "signal_session" if _FRAMES[fact] == "daily" else f"{_FRAMES[fact]}_available"


@q("signal_facts", with_views("SELECT rule, security_id, CAST(signal_session AS VARCHAR) AS signal_session, name, round(value, 6) AS value,"
   " CAST(available AS VARCHAR) AS available FROM (" + " UNION ALL ".join(
       f"SELECT rule, security_id, signal_session, '{fact}' AS name, {fact} AS value, {_available(fact)} AS available FROM v_signals WHERE rule = '{rule.name}'"
       for rule in grid.rules() for fact in rule.facts) + ")", recursive=True))
def signal_facts(spark, sf):
    """Facts behind every signal of every rule: all facts as one map, of which a rule keeps its own."""
    signals = study.study_signals(M.bars(spark, sf), M.calendar(spark, sf))
    names = sorted({fact for rule in grid.rules() for fact in rule.facts})
    of_rule = F.create_map(*[x for rule in grid.rules() for x in (F.lit(rule.name), F.array(*map(F.lit, rule.facts)))])
    facts = signals.withColumn("facts", SG.facts_map(names, {n: _available(n) for n in names}, "signal_session"))
    own = F.map_filter("facts", lambda name, _: F.array_contains(F.try_element_at(of_rule, F.col("rule")), name))
    return present(
        facts.select("rule", "security_id", "signal_session", F.explode(own).alias("name", "fact")).select(
            "rule", "security_id", "signal_session", "name", F.col("fact.value").alias("value"),
            F.col("fact.available_session").alias("available"),
        ),
        6,
    )


@q("strategy_grid", with_views("""
SELECT rule || '__' || stop_slug || '__target-' || target_slug AS strategy_id, count(*) AS signals,
       count(DISTINCT security_id) AS securities, CAST(min(signal_session) AS VARCHAR) AS first_signal
FROM v_signals CROSS JOIN v_grid GROUP BY 1""", recursive=True))
def strategy_grid(spark, sf):
    signals = study.study_signals(M.bars(spark, sf), M.calendar(spark, sf))
    per_rule = signals.groupBy("rule").agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_distinct("security_id").alias("securities"),
        F.min("signal_session").alias("first_signal"),
    )
    table = F.broadcast(grid.grid_table(spark).select("rule", "strategy_id"))
    return present(per_rule.join(table, "rule").drop("rule"))
