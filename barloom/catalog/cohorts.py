"""Cohort curves, breadth, leave-one-out, books and evidence tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.performance import capital
from barloom.catalog.views_sql import view, with_views
from barloom.operators import cohorts as C, equity as Q, metrics as T
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


view("v_sizes", "SELECT cohort, count(*) AS n FROM v_members GROUP BY 1")
view("v_coh", """
SELECT m.cohort, r.session, sum(r.equity) AS equity, s.n, 100000 * s.n AS start
FROM v_members m JOIN v_real r USING (strategy_id) JOIN v_sizes s USING (cohort) GROUP BY m.cohort, r.session, s.n""")
view("v_results", """
SELECT strategy_id, ending - 100000 AS profit, CAST(ending - 100000 AS DOUBLE) / 100000 AS ret, coalesce(n, 0) AS trades
FROM v_core LEFT JOIN (SELECT strategy_id, count(*) AS n FROM v_trades GROUP BY 1) USING (strategy_id)""")
view("v_books", """
SELECT strategy_id, count(*) FILTER (WHERE exit_session <= DATE '1995-03-31') AS closed,
  count(*) FILTER (WHERE entry_session <= DATE '1995-03-31' AND exit_session > DATE '1995-03-31') AS opened,
  100000 + coalesce(sum(gross_pnl) FILTER (WHERE exit_session <= DATE '1995-03-31'), 0) AS cur
FROM v_trades GROUP BY 1""")


def _real(spark, sf):
    return Q.realized_equity(M.trades(spark, sf), M.calendar(spark, sf), M.CAPITAL, strategies=M.strategies(spark, sf))


def _results(spark, sf):
    trades = M.trades(spark, sf)
    counts = trades.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades"))
    return T.core_result(_real(spark, sf), capital()).join(counts, "strategy_id", "left").fillna(0, ["trades"])


def _books(spark, sf):
    trades = M.trades(spark, sf)
    return C.books_as_of(trades, F.to_date(F.lit("1995-03-31")), M.CAPITAL)


@q("cohort_equity", with_views("""
SELECT cohort, CAST(session AS VARCHAR) AS session, CAST(equity AS DOUBLE) AS equity, n AS member_count, CAST(start AS DOUBLE) AS starting_capital,
  CAST(peak AS DOUBLE) AS peak, round(1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE), 8) AS drawdown, round(CAST(equity AS DOUBLE) / start * 100, 6) AS normalized_index,
  round(CAST(equity AS DOUBLE) / start - 1, 8) AS gross_return
FROM (SELECT *, max(equity) OVER (PARTITION BY cohort ORDER BY session) AS peak FROM v_coh)"""))
def cohort_equity(spark, sf):
    return present(C.cohort_curve(M.cohort_members(spark, sf), _real(spark, sf), M.CAPITAL), 8, normalized_index=6)


@q("cohort_curve_declared_capital", with_views("""
SELECT cohort, CAST(session AS VARCHAR) AS session, CAST(equity AS DOUBLE) AS equity, n AS member_count, CAST(start AS DOUBLE) AS starting_capital,
  CAST(peak AS DOUBLE) AS peak, round(1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE), 8) AS drawdown, round(CAST(equity AS DOUBLE) / start * 100, 6) AS normalized_index,
  round(CAST(equity AS DOUBLE) / start - 1, 8) AS gross_return
FROM (SELECT *, greatest(start, max(equity) OVER (PARTITION BY cohort ORDER BY session)) AS peak FROM (
  SELECT m.cohort, r.session, sum(r.equity) AS equity, count(*) AS k, s.n, 100000 * s.n AS start
  FROM v_members m JOIN v_real r USING (strategy_id) JOIN v_sizes s USING (cohort)
  WHERE NOT (r.strategy_id = 'Brand#5' AND r.ord % 10 = 3) GROUP BY m.cohort, r.session, s.n) WHERE k = n)"""))
def cohort_curve_declared(spark, sf):
    recorded = _real(spark, sf).where("NOT (strategy_id = 'Brand#5' AND ord % 10 = 3)")
    return present(C.forward_cohort_curve(M.cohort_members(spark, sf), recorded, M.CAPITAL), 8, normalized_index=6)


@q("leave_one_out", with_views("""
SELECT cohort, omitted, CAST(ending AS DOUBLE) AS ending_equity, CAST(ending - start AS DOUBLE) AS gross_profit, round(dd, 8) AS maximum_drawdown,
  CAST(ddm AS DOUBLE) AS maximum_drawdown_money, round(CASE WHEN dd <> 0 THEN CAST(ending - start AS DOUBLE) / start / dd END, 6) AS profit_drawdown
FROM (SELECT cohort, omitted, start, last(equity ORDER BY session) AS ending, max(1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE)) AS dd, max(peak - equity) AS ddm
  FROM (SELECT *, max(equity) OVER (PARTITION BY cohort, omitted ORDER BY session) AS peak FROM (
    SELECT o.cohort, o.strategy_id AS omitted, r.session, sum(r.equity) AS equity, 100000 * count(*) AS start
    FROM v_members o JOIN v_members k ON k.cohort = o.cohort AND k.strategy_id <> o.strategy_id
    JOIN v_real r ON r.strategy_id = k.strategy_id GROUP BY 1, 2, 3)) GROUP BY 1, 2, 3)"""))
def leave_one_out(spark, sf):
    curves = C.leave_one_out(M.cohort_members(spark, sf), _real(spark, sf), M.CAPITAL)
    out = Q.curve_summary(curves, ["cohort", "omitted"], F.col("starting_capital"))
    return present(out.drop("starting_capital", "gross_return"), 8, profit_drawdown=6)


@q("cohort_breadth", with_views("""
SELECT cohort, count(*) AS member_count, count(*) FILTER (WHERE profit > 0) AS positive, count(*) FILTER (WHERE profit < 0) AS negative,
  count(*) FILTER (WHERE profit = 0) AS flat, round(median(ret), 8) AS median_return, CAST(sum(greatest(profit, 0)) AS DOUBLE) AS gains,
  CAST(sum(greatest(-profit, 0)) AS DOUBLE) AS losses, CAST(sum(trades) AS BIGINT) AS closed_trades,
  round(CAST(sum(greatest(-profit, 0)) AS DOUBLE) / nullif(CAST(sum(greatest(profit, 0)) AS DOUBLE), 0), 8) AS losses_share_of_gains,
  round(CAST(max(profit) FILTER (WHERE profit > 0) AS DOUBLE) / nullif(CAST(sum(greatest(profit, 0)) AS DOUBLE), 0), 8) AS largest_share,
  round(CAST(sum(profit) FILTER (WHERE profit > 0 AND k <= 3) AS DOUBLE) / nullif(CAST(sum(greatest(profit, 0)) AS DOUBLE), 0), 8) AS top_three_share
FROM (SELECT m.cohort, r.*, row_number() OVER (PARTITION BY m.cohort ORDER BY profit DESC, strategy_id) AS k FROM v_members m JOIN v_results r USING (strategy_id)) GROUP BY 1"""))
def cohort_breadth(spark, sf):
    return present(C.breadth(M.cohort_members(spark, sf), _results(spark, sf)), 8)


@q("cohort_report", with_views("""
SELECT cohort, string_agg(strategy_id, ',' ORDER BY profit DESC, strategy_id) AS members, count(*) FILTER (WHERE profit > 0) AS positive, count(*) AS member_count
FROM v_members JOIN v_results USING (strategy_id) GROUP BY 1"""))
def cohort_report(spark, sf):
    report = C.cohort_report(M.cohort_members(spark, sf), _results(spark, sf))
    return present(report.withColumn("members", F.array_join("members", ",")))


_TIER = "CASE WHEN minimum_closed >= 30 THEN 'decision_ready' WHEN minimum_closed >= 20 THEN 'descriptive_20' WHEN minimum_closed >= 10 THEN 'descriptive_10' ELSE 'pre_10' END"
_SUM = """SELECT cohort, count(*) AS member_count, count(cur) AS members_resolved, CAST(coalesce(sum(closed), 0) AS BIGINT) AS closed_trades,
  coalesce(min(closed), 0) AS minimum_closed, CAST(coalesce(sum(opened), 0) AS BIGINT) AS open_positions,
  CASE WHEN count(cur) = count(*) THEN CAST(100000 * count(*) AS DOUBLE) END AS starting_capital,
  CASE WHEN count(cur) = count(*) THEN CAST(sum(cur) AS DOUBLE) END AS current_equity FROM v_members LEFT JOIN v_books USING (strategy_id) GROUP BY 1"""


@q("cohort_summary", with_views(f"SELECT *, {_TIER} AS evidence_tier FROM v_csum", v_csum=_SUM))
def cohort_summary(spark, sf):
    return present(C.cohort_summary(M.cohort_members(spark, sf), _books(spark, sf)))


@q("evidence_tiers", with_views(f"""
SELECT cohort, minimum_closed, CASE WHEN cohort = 'FRINGE' THEN 'diagnostic_' || CASE WHEN minimum_closed >= 30 THEN '30' ELSE {_TIER} END ELSE {_TIER} END AS status,
  CASE WHEN min(minimum_closed) OVER () >= 30 THEN 'ready' ELSE 'not_ready' END AS readiness FROM v_csum""", v_csum=_SUM))
def evidence_tiers(spark, sf):
    return present(C.charter_status(C.cohort_summary(M.cohort_members(spark, sf), _books(spark, sf)), "FRINGE"))


@q("run_overview", with_views("""
SELECT count(*) AS books, CAST(sum(closed) AS BIGINT) AS closed_trades, min(closed) AS minimum_closed, CAST(sum(opened) AS BIGINT) AS open_positions,
  CAST(100000 * count(*) AS DOUBLE) AS starting_equity, CAST(sum(cur) AS DOUBLE) AS current_equity, count(*) FILTER (WHERE cur > 100000) AS books_up FROM v_books"""))
def run_overview(spark, sf):
    return present(C.run_overview(_books(spark, sf)))


@q("cohort_algebra", with_views("""
SELECT strategy_id, CASE WHEN bool_or(cohort = 'ALL') AND NOT bool_or(cohort = 'CORE') AND NOT bool_or(cohort = 'FRINGE') THEN 'not_in_any_part'
  WHEN NOT bool_or(cohort = 'ALL') THEN 'not_in_whole' WHEN bool_or(cohort = 'CORE') AND bool_or(cohort = 'FRINGE') THEN 'in_both_parts' END AS problem
FROM (SELECT * FROM v_members WHERE NOT (cohort = 'CORE' AND strategy_id = 'Brand#3') AND NOT (cohort = 'ALL' AND strategy_id = 'Brand#20')
      UNION ALL SELECT 'CORE', strategy_id FROM v_members WHERE cohort = 'FRINGE' AND strategy_id = 'Brand#21')
GROUP BY 1 HAVING strategy_id IN ('Brand#3', 'Brand#20', 'Brand#21')"""))
def cohort_algebra(spark, sf):
    members = M.cohort_members(spark, sf)
    damaged = members.where(
        "NOT (cohort = 'CORE' AND strategy_id = 'Brand#3') AND NOT (cohort = 'ALL' AND strategy_id = 'Brand#20')"
    ).unionByName(members.where("cohort = 'FRINGE' AND strategy_id = 'Brand#21'").withColumn("cohort", F.lit("CORE")))
    return present(C.cohort_algebra(damaged, "ALL", "CORE", "FRINGE"))
