"""Rolling features, as-of alignment and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import _roll, ema_sql, with_views
from barloom.operators import asof, bars as B, features as X
from barloom.plans import grid
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_K = ["security_id"]


def _pick(df, *names, digits=6):
    return present(df.select("security_id", "session", *names), digits)


@q("sma_min_max", with_views(f"""
SELECT security_id, CAST(session AS VARCHAR) AS session, round({_roll('avg', 'close', 10)}, 6) AS sma10,
       {_roll('min', 'low', 20)} AS low20, {_roll('max', 'high', 20)} AS high20 FROM v_bars"""))
def sma_min_max(spark, sf):
    return _pick(
        M.bars(spark, sf)
        .withColumn("sma10", X.rolling(F.avg, F.col("close"), 10, _K, "session"))
        .withColumn("low20", X.rolling(F.min, F.col("low"), 20, _K, "session"))
        .withColumn("high20", X.rolling(F.max, F.col("high"), 20, _K, "session")),
        "sma10", "low20", "high20",
    )


@q("ema", with_views("""
SELECT f.security_id, CAST(f.session AS VARCHAR) AS session, round(CASE WHEN f.rn >= 5 THEN f.y END, 6) AS ema5,
       round(CASE WHEN s.rn >= 13 THEN s.y END, 6) AS ema13, round(f.y, 6) AS ema5_warm
FROM v_ema5 f JOIN v_ema13d s USING (security_id, rn)""", recursive=True, v_ema13d=ema_sql("v_daily_rn", 13).format(self="v_ema13d")))
def ema(spark, sf):
    df = X.with_ema(M.bars(spark, sf), F.col("close"), 5, "ema5", _K, "session")
    df = X.with_ema(df, F.col("close"), 13, "ema13", _K, "session")
    df = X.with_ema(df, F.col("close"), 5, "ema5_warm", _K, "session", full_only=False)
    return _pick(df, "ema5", "ema13", "ema5_warm")


@q("lag_return", with_views("""
SELECT security_id, CAST(session AS VARCHAR) AS session, round(daily_return5, 8) AS return5, round(daily_return20, 8) AS return20 FROM v_feat"""))
def lag_return(spark, sf):
    return _pick(
        M.bars(spark, sf)
        .withColumn("return5", X.lag_return(F.col("close"), 5, _K, "session"))
        .withColumn("return20", X.lag_return(F.col("close"), 20, _K, "session")),
        "return5", "return20", digits=8,
    )


@q("atr", with_views("SELECT security_id, CAST(session AS VARCHAR) AS session, round(daily_atr14, 6) AS atr14 FROM v_feat"))
def atr(spark, sf):
    spec = [X.Feature("atr14", "daily", "atr", "close", 14)]
    return _pick(X.with_features(M.bars(spark, sf), spec, {c: c for c in X.SOURCES}, _K), "atr14")


@q("avg_dollar_volume", with_views("SELECT security_id, CAST(session AS VARCHAR) AS session, round(adv20, 2) AS adv20 FROM v_feat"))
def avg_dollar_volume(spark, sf):
    return _pick(M.bars(spark, sf).withColumn("adv20", X.average_dollar_volume(20)), "adv20", digits=2)


@q("asof_weekly_to_daily", with_views("""
SELECT b.security_id, CAST(b.session AS VARCHAR) AS session, CAST(w.session AS VARCHAR) AS week_session, w.close AS week_close
FROM v_bars b ASOF LEFT JOIN v_weekly w ON w.security_id = b.security_id AND w.session <= b.session"""))
def asof_weekly(spark, sf):
    bars = M.bars(spark, sf)
    weekly = B.period_bars(bars, M.calendar(spark, sf), "weekly")
    weekly = weekly.select("security_id", F.col("session").alias("week_session"), F.col("close").alias("week_close"))
    return present(
        asof.asof_backward(bars.select("security_id", "session"), weekly, _K, "session", "week_session", ["week_close"])
    )


@q("asof_split_hot_key", with_views("""
SELECT e.event_id, e.user_id, CAST(p.event_id AS BIGINT) AS purchase_id, round(p.value, 2) AS purchase_value
FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
  ON p.user_id = e.user_id AND p.event_id <= e.event_id"""))
def asof_split(spark, sf):
    events = M.table(spark, sf, "events")
    buys = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value")
    )
    return present(
        asof.asof_backward(
            events.select("event_id", "user_id"), buys, ["user_id"], "event_id", "purchase_id", ["purchase_value"],
            slice_of=lambda moment: F.floor(moment / 4096),
        ),
        2,
    )


_MATRIX = [f.name for f in grid.FEATURES]
_AVAIL = ["weekly_available", "monthly_available"]


@q("feature_matrix", with_views(f"""
SELECT security_id, CAST(session AS VARCHAR) AS session, {', '.join(f'round({c}, 6) AS {c}' for c in _MATRIX)},
       {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _AVAIL)} FROM v_matrix""", recursive=True))
def feature_matrix(spark, sf):
    return _pick(
        X.feature_matrix(M.bars(spark, sf), M.calendar(spark, sf), grid.FEATURES), *_MATRIX, *_AVAIL
    )
