"""Ledger replay, tails, segments and allotment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.operators import ledger as L
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_STATE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY coalesce(try_cast(seqtext AS BIGINT), 0) DESC, seq) AS k
 FROM (SELECT *, CASE WHEN seq % 11 = 0 THEN 'bad' ELSE CAST(seq // 3 AS VARCHAR) END AS seqtext FROM v_ledger WHERE seq % 13 <> 0)) WHERE k = 1"""


def _state(spark, sf):
    rows = M.ledger(spark, sf).withColumn(
        "seqtext", F.when(F.col("seq") % 11 == 0, "bad").otherwise(F.floor(F.col("seq") / 3).cast("string"))
    )
    keyed = rows.withColumn("entry_id", F.when(F.col("seq") % 13 != 0, F.col("entry_id")))
    return L.latest_state(keyed, "entry_id", "seqtext", "seq")


@q("latest_state", with_views("SELECT entry_id, seq, seqtext, family, status, amount_c FROM v_state", v_state=_STATE))
def latest_state(spark, sf):
    return present(_state(spark, sf).select("entry_id", "seq", "seqtext", "family", "status", "amount_c"))


@q("ledger_tiles", with_views("""
SELECT CAST(coalesce(sum(pnl) FILTER (WHERE status = 'closed'), 0) AS BIGINT) AS realized_pnl, count(*) FILTER (WHERE status = 'open') AS open_count,
  CAST(coalesce(sum(amount_c) FILTER (WHERE status = 'open'), 0) AS BIGINT) AS deployed,
  round(CAST(count(*) FILTER (WHERE status = 'closed' AND pnl > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE status = 'closed'), 0), 8) AS win_rate
FROM (SELECT *, amount_c - 2000 AS pnl FROM v_state)""", v_state=_STATE))
def ledger_tiles(spark, sf):
    state = _state(spark, sf).withColumn("pnl", F.col("amount_c") - 2000).withColumn("deployed", F.col("amount_c"))
    return present(L.stat_tiles(state), 8)


@q("tail_rows", with_views("SELECT * FROM (SELECT seq, entry_id, status FROM v_ledger ORDER BY seq DESC LIMIT 50)"))
def tail_rows(spark, sf):
    return present(L.tail_rows(M.ledger(spark, sf).select("seq", "entry_id", "status"), "seq", 50))


_SEG = "SELECT event_id AS pos, DATE '2024-01-01' + CAST(event_id % 37 + event_id % 11 AS INTEGER) AS session FROM events"


@q("restart_segments", with_views("""
SELECT segment, count(*) AS n, CAST(min(session) AS VARCHAR) AS first_session, min(pos) AS first_pos FROM (
 SELECT *, CAST(sum(CAST(restart AS INTEGER)) OVER (ORDER BY pos) AS BIGINT) AS segment FROM (
  SELECT *, coalesce(session <= lag(session) OVER (ORDER BY pos), false) AS restart FROM v_seg)) GROUP BY segment""", v_seg=_SEG))
def restart_segments(spark, sf):
    i = F.col("event_id")
    rows = M.table(spark, sf, "events").select(
        i.alias("pos"), F.date_add(F.to_date(F.lit("2024-01-01")), (i % 37 + i % 11).cast("int")).alias("session")
    )
    return present(
        L.restart_segments(rows, "pos", "session", 1024)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first_session"), F.min("pos").alias("first_pos"))
    )


@q("ordered_allotment", """
WITH owners AS (SELECT user_id AS owner, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events GROUP BY 1),
r AS (SELECT owner, n, sum(n) OVER (ORDER BY owner) - n AS lo, sum(n) OVER (ORDER BY owner) AS hi FROM owners)
SELECT e.event_id AS row_index, r.owner FROM events e JOIN r ON e.event_id >= r.lo AND e.event_id < r.hi""")
def ordered_allotment(spark, sf):
    events = M.table(spark, sf, "events")
    owners = events.groupBy(F.col("user_id").alias("owner")).agg(F.count_if(F.col("event_type") != "view").alias("n"))
    total = owners.agg(F.sum("n")).scalar()
    rows = events.select(F.col("event_id").alias("row_index")).where(F.col("row_index") < total)
    return present(L.ordered_allotment(owners, rows, "owner", "n", "row_index", 1024))


@q("membership_filter", with_views("""
SELECT entry_id, count(*) AS n, CAST(sum(amount_c) AS BIGINT) AS amount FROM v_ledger WHERE entry_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 30) GROUP BY 1"""))
def membership_filter(spark, sf):
    members = M.table(spark, sf, "events").where("event_type = 'purchase' AND value > 30").select(F.col("user_id").alias("entry_id"))
    rows = L.membership(M.ledger(spark, sf), members.distinct(), "entry_id")
    return present(rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_c").alias("amount")))


@q("forward_sessions", with_views("""
SELECT CAST(session AS VARCHAR) AS session, CAST(sum(records) AS BIGINT) AS records, count(*) = 5 AS complete FROM (
 SELECT CAST(ts AS DATE) AS session, family AS kind, count(*) AS records FROM v_ledger WHERE NOT (family = 'error' AND day(ts) % 6 = 0) GROUP BY 1, 2) GROUP BY 1
ORDER BY 1 DESC LIMIT 20"""))
def forward_sessions(spark, sf):
    rows = M.ledger(spark, sf).where("NOT (family = 'error' AND day(ts) % 6 = 0)")
    manifests = rows.groupBy(F.to_date("ts").alias("session"), F.col("family").alias("kind")).agg(F.count(F.lit(1)).alias("records"))
    return present(L.session_list(manifests, F.lit(5), 20))
