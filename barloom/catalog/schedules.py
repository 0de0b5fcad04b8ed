"""Event schedules: provider rows, normalization, snapshot intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import view, with_views
from barloom.operators import schedule as SC
from barloom.operators.sessions import small
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


view("v_provider", """
SELECT 'S' || o_custkey AS security_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) + CAST(o_custkey % 80 AS INTEGER) AS date,
  CASE WHEN o_orderpriority < '3' THEN 'OFFICIAL' ELSE 'ESTIMATED' END AS date_type,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'Q' || quarter(o_orderdate) END AS fiscal_quarter,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 500 END AS eps_actual, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 450 END AS eps_forecast,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 9000 END AS revenue_actual, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 8000 END AS revenue_forecast,
  o_orderkey AS row_id FROM orders""")
view("v_rolled", """
SELECT p.*, (SELECT min(session) FROM v_calendar c WHERE c.session >= p.date) AS event_session,
 to_json({'date': CAST(date AS VARCHAR), 'date_type': date_type, 'eps_actual': eps_actual, 'eps_forecast': eps_forecast, 'fiscal_quarter': fiscal_quarter,
  'revenue_actual': revenue_actual, 'revenue_forecast': revenue_forecast, 'row_id': row_id, 'security_id': security_id}) AS txt
FROM v_provider p WHERE date BETWEEN (SELECT min(session) FROM v_calendar) AND (SELECT max(session) FROM v_calendar)""")
view("v_best", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY security_id, event_session) AS provider_row_count,
  row_number() OVER (PARTITION BY security_id, event_session ORDER BY (date_type = 'OFFICIAL') DESC, (fiscal_quarter IS NOT NULL) DESC,
    (eps_actual IS NOT NULL)::INT + (eps_forecast IS NOT NULL)::INT + (revenue_actual IS NOT NULL)::INT + (revenue_forecast IS NOT NULL)::INT DESC, CAST(txt AS VARCHAR) DESC) AS k
  FROM v_rolled) WHERE k = 1""")


def _provider(spark, sf):
    key = F.col("o_orderkey")
    day = F.date_add(F.trunc(F.to_date("o_orderdate"), "quarter"), (F.col("o_custkey") % 80).cast("int"))
    return M.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("security_id"),
        day.alias("date"),
        F.when(F.col("o_orderpriority") < "3", "OFFICIAL").otherwise("ESTIMATED").alias("date_type"),
        F.when(key % 4 != 0, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))).alias("fiscal_quarter"),
        F.when(F.col("o_orderstatus") == "F", key % 500).alias("eps_actual"),
        F.when(key % 2 == 0, key % 450).alias("eps_forecast"),
        F.when(F.col("o_orderstatus") == "P", key % 9000).alias("revenue_actual"),
        F.when(key % 5 == 0, key % 8000).alias("revenue_forecast"),
        key.alias("row_id"),
    )


@q("best_provider_row", with_views("""
SELECT security_id, CAST(event_session AS VARCHAR) AS event_session, row_id, date_type, fiscal_quarter, provider_row_count FROM v_best
WHERE event_session >= DATE '1995-01-02' AND event_session < DATE '2001-11-03'"""))
def best_provider_row(spark, sf):
    day = lambda t: F.to_date(F.lit(t))
    out = SC.normalize_events(_provider(spark, sf), M.calendar(spark, sf), day("1999-06-15"), day("1995-01-02"), day("2001-11-03"))
    return present(out.select("security_id", "event_session", "row_id", "date_type", "fiscal_quarter", "provider_row_count"))


@q("earnings_normalized", with_views("""
SELECT security_id, CAST(event_session AS VARCHAR) AS event_session, row_id, CASE WHEN h THEN 'historical_result' ELSE 'scheduled_snapshot' END AS knowledge_kind,
  CAST(CASE WHEN h THEN event_session ELSE DATE '1999-06-18' END AS VARCHAR) AS known_session, NOT h AND DATE '1999-06-18' > event_session AS violation
FROM (SELECT *, date <= DATE '1999-06-19' AND (eps_actual IS NOT NULL OR revenue_actual IS NOT NULL) AS h FROM v_best)
WHERE event_session >= DATE '1996-01-01' AND event_session < DATE '2001-01-01'"""))
def earnings_normalized(spark, sf):
    day = lambda t: F.to_date(F.lit(t))
    out = SC.normalize_events(_provider(spark, sf), M.calendar(spark, sf), day("1999-06-19"), day("1996-01-01"), day("2001-01-01"))
    return present(out.select("security_id", "event_session", "row_id", "knowledge_kind", "known_session", "violation"))


view("v_snaps", """
SELECT row_number() OVER (ORDER BY session) AS snap, session, month FROM (SELECT month, min(session) AS session FROM v_calendar GROUP BY month)""")
view("v_seen", """
SELECT DISTINCT o.security_id, o.event_session, s.snap FROM v_schedule o JOIN v_snaps s
 ON s.month BETWEEN date_trunc('month', o.event_session - 200) AND date_trunc('month', o.event_session + 20)
WHERE (o.event_id + s.snap) % 5 <> 0""")
view("v_dense", """
SELECT e.security_id, e.event_session, s.snap, s.session, p.snap IS NOT NULL AS present FROM (SELECT security_id, event_session, min(snap) AS lo FROM v_seen GROUP BY 1, 2) e
JOIN v_snaps s ON s.snap >= e.lo LEFT JOIN v_seen p ON p.security_id = e.security_id AND p.event_session = e.event_session AND p.snap = s.snap""")
view("v_runs", """
SELECT *, CAST(sum(CAST(closes AS INTEGER)) OVER (PARTITION BY security_id, event_session ORDER BY snap) AS BIGINT) AS grp FROM (
  SELECT *, NOT present AND lag(present) OVER (PARTITION BY security_id, event_session ORDER BY snap) AND event_session >= session AS closes FROM v_dense)""")
view("v_intervals", """
SELECT security_id, event_session, known_session, superseded_session FROM (
  SELECT security_id, event_session, grp, min(session) FILTER (WHERE present) AS known_session,
    lead(min(session) FILTER (WHERE closes)) OVER (PARTITION BY security_id, event_session ORDER BY grp) AS superseded_session
  FROM v_runs GROUP BY security_id, event_session, grp) WHERE known_session IS NOT NULL""")


def _snapshots(spark, sf):
    from pyspark.sql import Window

    months = M.calendar(spark, sf).groupBy("month").agg(F.min("session").alias("snapshot_session"))
    snaps = months.withColumn("snap", F.row_number().over(Window.orderBy("snapshot_session")))
    rows = M.schedule(spark, sf)
    spans = F.sequence(
        F.trunc(F.date_sub("event_session", 200), "MM"), F.trunc(F.date_add("event_session", 20), "MM"), F.expr("INTERVAL 1 MONTH")
    )
    seen = (
        rows.select("security_id", "event_session", "event_id", F.explode(spans).alias("month"))
        .join(small(snaps.select("month", "snap")), "month")
        .where((F.col("event_id") + F.col("snap")) % 5 != 0)
        .select("security_id", "event_session", "snap")
    )
    return snaps.select("snap", "snapshot_session"), seen


@q("snapshot_intervals", with_views("""
SELECT security_id, CAST(event_session AS VARCHAR) AS event_session, CAST(known_session AS VARCHAR) AS known_session,
  CAST(superseded_session AS VARCHAR) AS superseded_session FROM v_intervals"""))
def snapshot_intervals(spark, sf):
    snaps, seen = _snapshots(spark, sf)
    return present(SC.snapshot_intervals(snaps, seen))


@q("snapshot_intervals_with_history", with_views("""
SELECT security_id, CAST(event_session AS VARCHAR) AS event_session, CAST(known_session AS VARCHAR) AS known_session,
  CAST(superseded_session AS VARCHAR) AS superseded_session FROM v_intervals
UNION ALL SELECT security_id, CAST(event_session AS VARCHAR), CAST(last(known_session ORDER BY event_id) AS VARCHAR), NULL FROM v_schedule WHERE event_id % 2 = 0 GROUP BY security_id, event_session"""))
def snapshot_intervals_with_history(spark, sf):
    snaps, seen = _snapshots(spark, sf)
    past = M.schedule(spark, sf).where("event_id % 2 = 0").withColumnRenamed("event_id", "snap")
    return present(SC.with_historical(SC.snapshot_intervals(snaps, seen), past))


@q("coverage_merge", with_views("""
SELECT security_id, CAST(min(known_session) AS VARCHAR) AS coverage_start, CAST(max(event_session) AS VARCHAR) AS coverage_end FROM v_schedule GROUP BY 1"""))
def coverage_merge(spark, sf):
    rows = M.schedule(spark, sf).select(
        "security_id", F.col("known_session").alias("coverage_start"), F.col("event_session").alias("coverage_end")
    )
    return present(SC.merged_coverage(rows))
