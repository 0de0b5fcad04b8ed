"""Bars, calendar and hygiene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.operators import bars as B, sessions as S
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_BAR = "security_id, CAST(session AS VARCHAR) AS session, open, high, low, close, volume"


@q("bars_daily", with_views(f"SELECT {_BAR} FROM v_bars"))
def bars_daily(spark, sf):
    return present(M.bars(spark, sf))


@q("bars_weekly_completed", with_views(f"SELECT {_BAR} FROM v_weekly"))
def bars_weekly(spark, sf):
    return present(B.period_bars(M.bars(spark, sf), M.calendar(spark, sf), "weekly"))


@q("bars_monthly_completed", with_views(f"SELECT {_BAR} FROM v_monthly"))
def bars_monthly(spark, sf):
    return present(B.period_bars(M.bars(spark, sf), M.calendar(spark, sf), "monthly"))


@q("bars_dedupe_keep_last", with_views("""
SELECT security_id, CAST(session AS VARCHAR) AS session, open, high, low, close, volume FROM (
  SELECT security_id, session, CAST(price_c AS DOUBLE) / 100 AS open, CAST(price_c + tax_c * 10 AS DOUBLE) / 100 AS high,
         CAST(price_c - disc_c * 10 AS DOUBLE) / 100 AS low, CAST(price_c + (tax_c - disc_c) * 10 AS DOUBLE) / 100 AS close,
         qty * 1000 AS volume,
         row_number() OVER (PARTITION BY security_id, session ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn
  FROM v_lines) WHERE rn = 1"""))
def bars_dedupe(spark, sf):
    vendor = M.prints(spark, sf)
    vendor = vendor.select(
        *M.TICK, "security_id", F.col("session").alias("Session"), F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
        F.col("volume").alias("Volume"),
    )
    return present(B.normalize_vendor_rows(vendor, M.TICK))


@q("bars_hygiene", with_views(f"""
SELECT {_BAR} FROM (SELECT security_id, session, open, high, CASE WHEN volume % 7000 = 0 THEN NULL ELSE low END AS low,
  CASE WHEN volume % 5000 = 0 THEN -close ELSE close END AS close, volume FROM v_bars)
WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""))
def bars_hygiene(spark, sf):
    dirty = (
        M.bars(spark, sf)
        .withColumn("low", F.when(F.col("volume") % 7000 != 0, F.col("low")))
        .withColumn("close", F.when(F.col("volume") % 5000 == 0, -F.col("close")).otherwise(F.col("close")))
    )
    lo, hi = F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("2000-12-31"))
    return present(B.hygiene(dirty, lo, hi))


_MANIFEST = """SELECT security_id, min(session) AS first_session, max(session) AS last_session, count(*) AS n_bars
FROM v_bars GROUP BY security_id"""
_MCOLS = "security_id, CAST(first_session AS VARCHAR) AS first_session, CAST(last_session AS VARCHAR) AS last_session, n_bars"


@q("bar_manifest", with_views(f"SELECT {_MCOLS} FROM v_manifest", v_manifest=_MANIFEST))
def bar_manifest(spark, sf):
    return present(B.bar_manifest(M.bars(spark, sf)))


@q("min_history", with_views(f"SELECT {_MCOLS} FROM v_manifest WHERE n_bars >= 300", v_manifest=_MANIFEST))
def min_history(spark, sf):
    return present(B.minimum_history(M.bars(spark, sf), 300))


@q("fresh_securities", with_views(f"SELECT {_MCOLS} FROM v_manifest WHERE last_session >= DATE '2001-10-29'", v_manifest=_MANIFEST))
def fresh_securities(spark, sf):
    return present(B.fresh(M.bars(spark, sf), F.to_date(F.lit("2001-10-29"))))


@q("cutoff_freeze", with_views("""
SELECT r.security_id, CAST(first_session AS VARCHAR) AS first_session, CAST(last_session AS VARCHAR) AS last_session, n_bars,
       CASE WHEN n_bars IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT 'S' || s_suppkey AS security_id FROM supplier) r
LEFT JOIN (SELECT security_id, min(session) AS first_session, max(session) AS last_session, count(*) AS n_bars
           FROM v_bars WHERE session <= DATE '1995-02-10' GROUP BY security_id) m USING (security_id)"""))
def cutoff_freeze(spark, sf):
    roster = M.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"))
    return present(B.frozen_roster(M.bars(spark, sf), roster, F.to_date(F.lit("1995-02-10"))))


@q("completed_bars_only", with_views(f"SELECT {_BAR} FROM v_bars WHERE session <= DATE '2001-06-29'"))
def completed_bars_only(spark, sf):
    return present(B.completed_only(M.bars(spark, sf), F.to_date(F.lit("2001-06-29"))))


@q("calendar_next_session", with_views("""
SELECT CAST(session AS VARCHAR) AS session, ord, CAST(next_session AS VARCHAR) AS next_session,
       CAST(week_end AS VARCHAR) AS week_end, CAST(month AS VARCHAR) AS month FROM v_calendar"""))
def calendar_next_session(spark, sf):
    return present(M.calendar(spark, sf).select("session", "ord", "next_session", "week_end", "month"))


@q("sessions_in_range", with_views("""
SELECT CAST(session AS VARCHAR) AS session, ord FROM v_calendar
WHERE session BETWEEN DATE '1997-03-15' AND DATE '1998-03-15'"""))
def sessions_in_range(spark, sf):
    cal = M.calendar(spark, sf)
    return present(
        S.sessions_in_range(cal, F.to_date(F.lit("1997-03-15")), F.to_date(F.lit("1998-03-15"))).select("session", "ord")
    )


@q("session_distance", with_views("""
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR)[1:10] AS start_day, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS VARCHAR) AS end_day,
       (SELECT max(ord) FROM v_calendar WHERE session <= CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER))
     - (SELECT max(ord) FROM v_calendar WHERE session <= CAST(o_orderdate AS DATE)) AS distance
FROM orders"""))
def session_distance(spark, sf):
    orders = M.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start_day"))
    orders = orders.withColumn("end_day", F.date_add("start_day", (F.col("o_orderkey") % 40).cast("int")))
    cal = M.calendar(spark, sf)
    return present(S.session_distance(orders, cal, "start_day", "end_day", "distance"))


@q("roll_to_session", with_views("""
SELECT o_orderkey, CAST(d AS VARCHAR) AS day, CAST((SELECT min(session) FROM v_calendar WHERE session >= d) AS VARCHAR) AS next_session,
       CAST((SELECT max(session) FROM v_calendar WHERE session <= d) AS VARCHAR) AS prev_session
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""))
def roll_to_session(spark, sf):
    orders = M.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    roll = S.roll_table(M.calendar(spark, sf)).select("day", "next_session", "prev_session")
    return present(orders.join(S.small(roll), "day", "left"))


@q("last_completed", """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE isodow(ts) <= 5),
closes AS (SELECT session, session + INTERVAL 16 HOUR AS close_ts FROM days)
SELECT event_id, CAST((SELECT max(session) FROM closes WHERE close_ts <= ts) AS VARCHAR) AS completed_session FROM events""")
def last_completed(spark, sf):
    events = M.table(spark, sf, "events").select("event_id", "ts")
    days = events.select(F.to_date("ts").alias("session")).where(F.dayofweek("session").between(2, 6)).distinct()
    closes = days.withColumn("close_ts", F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS"))
    return present(S.last_completed(events, closes).select("event_id", "completed_session"))


@q("chronological_split", with_views("""
SELECT kind, CAST(min(session) AS VARCHAR) AS start_session, count(*) AS session_count,
       CAST(coalesce((SELECT min(session) FROM v_calendar WHERE ord > max(s.ord)), max(session) + 1) AS VARCHAR) AS end_exclusive
FROM (SELECT session, ord, CASE WHEN ord <= n * 3 // 5 - 21 THEN 'development' WHEN ord <= n * 3 // 5 THEN 'development_validation_purge'
        WHEN ord <= n * 4 // 5 - 21 THEN 'validation' WHEN ord <= n * 4 // 5 THEN 'validation_oos_purge' ELSE 'oos' END AS kind
      FROM (SELECT session, ord, count(*) OVER () AS n FROM v_calendar)) s GROUP BY kind"""))
def chronological_split(spark, sf):
    return present(S.split_windows(M.calendar(spark, sf)))


@q("study_range", with_views("""
SELECT CAST(max(first_session) AS VARCHAR) AS evaluation_start,
       CAST((SELECT session FROM v_calendar WHERE session <= DATE '2001-10-31' ORDER BY session DESC LIMIT 1 OFFSET 20) AS VARCHAR) AS evaluation_end_exclusive,
       '2001-11-01' AS coverage_end_exclusive, count(*) FILTER (WHERE last_session <> DATE '2001-10-31') AS late_members
FROM v_manifest""", v_manifest=_MANIFEST))
def study_range(spark, sf):
    manifest = B.bar_manifest(M.bars(spark, sf))
    return present(S.study_range(manifest, M.calendar(spark, sf), F.to_date(F.lit("2001-10-31"))))
