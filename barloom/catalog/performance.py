"""Equity, drawdown and performance metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import view, with_views
from barloom.operators import equity as Q, metrics as T
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def capital():
    return F.lit(M.CAPITAL).cast("decimal(28,2)")


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


view("v_real", """
SELECT strategy_id, ord, session, 100000 + coalesce(sum(pnl) OVER (PARTITION BY strategy_id ORDER BY ord), 0) AS equity
FROM (SELECT strategy_id, ord, session FROM v_strategies CROSS JOIN v_calendar)
LEFT JOIN (SELECT strategy_id, exit_ord AS ord, sum(gross_pnl) AS pnl FROM v_trades GROUP BY 1, 2) USING (strategy_id, ord)""")
view("v_marked", """
SELECT t.strategy_id, c.ord, sum(t.quantity * CAST(b.close AS DECIMAL(12,2))) AS value
FROM v_trades t JOIN v_calendar c ON c.ord >= t.entry_ord AND c.ord < t.exit_ord
ASOF JOIN v_bars b ON b.security_id = t.security_id AND b.session <= c.session GROUP BY 1, 2""")
view("v_curve", """
SELECT g.strategy_id, g.ord, g.session, 100000 + coalesce(sum(flow) OVER (PARTITION BY g.strategy_id ORDER BY g.ord), 0) AS cash,
       coalesce(value, 0) AS position_value
FROM (SELECT strategy_id, ord, session FROM v_strategies CROSS JOIN v_calendar) g
LEFT JOIN (SELECT strategy_id, ord, sum(amount) AS flow FROM (
   SELECT strategy_id, entry_ord AS ord, -quantity * entry_price AS amount FROM v_trades UNION ALL
   SELECT strategy_id, exit_ord, quantity * exit_price FROM v_trades) GROUP BY 1, 2) f USING (strategy_id, ord)
LEFT JOIN v_marked v USING (strategy_id, ord)""")
view("v_deep", """
SELECT *, greatest(100000, max(equity) OVER (PARTITION BY strategy_id ORDER BY session)) AS peak0,
       max(equity) OVER (PARTITION BY strategy_id ORDER BY session) AS peak FROM v_real""")
view("v_core", """
SELECT strategy_id, last(equity ORDER BY session) AS ending, max(1 - CAST(equity AS DOUBLE) / CAST(peak0 AS DOUBLE)) AS dd,
       max(peak0 - equity) AS ddm FROM v_deep GROUP BY strategy_id""")


def _real(spark, sf):
    cal = M.calendar(spark, sf)
    return Q.realized_equity(M.trades(spark, sf), cal, M.CAPITAL, strategies=M.strategies(spark, sf))


@q("equity_curve", with_views("""
SELECT strategy_id, CAST(session AS VARCHAR) AS session, CAST(cash AS DOUBLE) AS cash, CAST(position_value AS DOUBLE) AS position_value,
       CAST(cash + position_value AS DOUBLE) AS equity,
       round(coalesce(CAST(position_value AS DOUBLE) / nullif(CAST(cash + position_value AS DOUBLE), 0), 0), 8) AS deployed_fraction FROM v_curve"""))
def equity_curve(spark, sf):
    curve = Q.equity_curve(M.trades(spark, sf), M.bars(spark, sf), M.calendar(spark, sf), M.CAPITAL, M.strategies(spark, sf))
    return present(curve.drop("ord"), deployed_fraction=8)


@q("equity_sorted", with_views("""
SELECT strategy_id, CAST(session AS VARCHAR) AS session, CAST(equity AS DOUBLE) AS equity,
       row_number() OVER (PARTITION BY strategy_id ORDER BY session) AS position FROM v_real"""))
def equity_sorted(spark, sf):
    curve = _real(spark, sf)
    return present(curve.select("strategy_id", "session", "equity", F.col("ord").alias("position")).orderBy("strategy_id", "session"))


@q("drawdown_pct", with_views("""
SELECT strategy_id, round(max(1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE)), 8) AS from_first_value,
       round(max(1 - CAST(equity AS DOUBLE) / CAST(peak0 AS DOUBLE)), 8) AS from_capital FROM v_deep GROUP BY strategy_id"""))
def drawdown_pct(spark, sf):
    curve = _real(spark, sf)
    first = Q.with_drawdown(curve, ["strategy_id"], "session").groupBy("strategy_id").agg(F.max("drawdown").alias("from_first_value"))
    whole = Q.with_drawdown(curve, ["strategy_id"], "session", start=capital()).groupBy("strategy_id").agg(
        F.max("drawdown").alias("from_capital")
    )
    return present(first.join(whole, "strategy_id"), 8)


@q("drawdown_dollars", with_views("""
SELECT strategy_id, CAST(max(peak - equity) AS DOUBLE) AS worst, CAST(arg_min(session, (-(peak - equity), session)) AS VARCHAR) AS worst_session
FROM v_deep GROUP BY strategy_id"""))
def drawdown_dollars(spark, sf):
    deep = Q.with_drawdown(_real(spark, sf), ["strategy_id"], "session")
    return present(
        deep.groupBy("strategy_id").agg(
            F.max("drawdown_money").alias("worst"),
            F.min_by("session", F.struct(-F.col("drawdown_money"), F.col("session"))).alias("worst_session"),
        )
    )


@q("curve_summary", with_views("""
SELECT strategy_id, CAST(ending AS DOUBLE) AS ending_equity, CAST(ending - 100000 AS DOUBLE) AS gross_profit,
       round(CAST(ending - 100000 AS DOUBLE) / 100000, 8) AS gross_return, CAST(ddm AS DOUBLE) AS maximum_drawdown_money, round(dd, 8) AS maximum_drawdown,
       round(CASE WHEN dd <> 0 THEN CAST(ending - 100000 AS DOUBLE) / 100000 / dd END, 6) AS profit_drawdown
FROM (SELECT strategy_id, last(equity ORDER BY session) AS ending, max(1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE)) AS dd,
             max(peak - equity) AS ddm FROM v_deep GROUP BY strategy_id)"""))
def curve_summary(spark, sf):
    return present(Q.curve_summary(_real(spark, sf), ["strategy_id"], capital()).drop("starting_capital"), 8, profit_drawdown=6)


@q("performance_metrics", with_views("""
SELECT strategy_id, CAST(ending AS DOUBLE) AS ending_equity, CAST(ending - 100000 AS DOUBLE) AS gross_profit,
       round(CAST(ending - 100000 AS DOUBLE) / 100000, 8) AS gross_return, round(dd, 8) AS maximum_drawdown,
       CASE WHEN dd = 0 AND ending > 100000 THEN 'positive_return_no_drawdown' WHEN dd = 0 THEN 'undefined' ELSE 'defined' END AS profit_drawdown_status,
       round(CASE WHEN dd <> 0 THEN CAST(ending - 100000 AS DOUBLE) / 100000 / dd END, 6) AS profit_drawdown FROM v_core"""))
def performance_metrics(spark, sf):
    return present(
        T.core_result(_real(spark, sf), capital()).drop("starting_capital", "maximum_drawdown_money"), 8, profit_drawdown=6
    )


@q("turnover_breakeven", with_views("""
SELECT strategy_id, CAST(turned AS DOUBLE) AS turned_over, round(CAST(turned AS DOUBLE) / (2 * mean_eq), 8) AS turnover,
       round(profit / nullif(CAST(turned AS DOUBLE), 0), 8) AS profit_per_dollar,
       CASE WHEN turned = 0 THEN 'undefined_no_turnover' WHEN profit > 0 THEN 'defined' ELSE 'not_applicable_nonpositive_profit' END AS break_even_status,
       round(CASE WHEN profit > 0 THEN profit / nullif(CAST(turned AS DOUBLE), 0) END, 8) AS break_even_cost
FROM (SELECT strategy_id, coalesce(sum(quantity * entry_price) + sum(quantity * exit_price), 0) AS turned
      FROM v_strategies LEFT JOIN v_trades USING (strategy_id) GROUP BY 1)
JOIN (SELECT strategy_id, CAST(sum(equity) AS DOUBLE) / count(*) AS mean_eq, CAST(last(equity ORDER BY session) - 100000 AS DOUBLE) AS profit
      FROM v_real GROUP BY 1) USING (strategy_id)"""))
def turnover_breakeven(spark, sf):
    return present(T.turnover(M.candidates(spark, sf), _real(spark, sf), capital()), 8)


@q("trade_distributions", with_views("""
SELECT strategy_id, kind, count(*) AS count, CAST(sum(value) AS DOUBLE) AS total, round(CAST(sum(value) AS DOUBLE) / count(*), 8) AS mean,
       CAST(min(value) AS DOUBLE) AS minimum, CAST(max(value) AS DOUBLE) AS maximum, round(median(CAST(value AS DOUBLE)), 6) AS median
FROM (SELECT strategy_id, 'winners' AS kind, gross_pnl AS value FROM v_trades WHERE gross_pnl > 0 UNION ALL
      SELECT strategy_id, 'losers', gross_pnl FROM v_trades WHERE gross_pnl < 0 UNION ALL
      SELECT strategy_id, 'holding_sessions', exit_ord - entry_ord + 1 FROM v_trades) GROUP BY 1, 2"""))
def trade_distributions(spark, sf):
    return present(T.trade_distributions(M.trades(spark, sf)), mean=8, median=6)


@q("exposure", with_views("""
SELECT strategy_id, round(avg(f), 8) AS mean, round(max(f), 8) AS maximum FROM (
  SELECT strategy_id, coalesce(CAST(position_value AS DOUBLE) / nullif(CAST(cash + position_value AS DOUBLE), 0), 0) AS f FROM v_curve) GROUP BY 1"""))
def exposure(spark, sf):
    curve = Q.equity_curve(M.trades(spark, sf), M.bars(spark, sf), M.calendar(spark, sf), M.CAPITAL, M.strategies(spark, sf))
    return present(T.exposure(curve), 8)


@q("yearly_metrics", with_views("""
SELECT y.strategy_id, y.year, CAST(y.start AS DOUBLE) AS starting_equity, CAST(y.ending AS DOUBLE) AS ending_equity, CAST(y.ending - y.start AS DOUBLE) AS gross_profit,
       round(CAST(y.ending - y.start AS DOUBLE) / CAST(y.start AS DOUBLE), 8) AS gross_return,
       CAST(coalesce((SELECT sum(gross_pnl) FROM v_trades t WHERE t.strategy_id = y.strategy_id AND year(t.exit_session) = y.year), 0) AS DOUBLE) AS realized,
       round(d.dd, 8) AS maximum_drawdown,
       coalesce((SELECT count(*) FROM v_trades t WHERE t.strategy_id = y.strategy_id AND year(t.exit_session) = y.year), 0) AS trade_count
FROM v_years y JOIN (
  SELECT r.strategy_id, year(r.session) AS year, max(1 - CAST(equity AS DOUBLE) / CAST(greatest(r.start, r.run) AS DOUBLE)) AS dd
  FROM (SELECT r.*, y.start, max(equity) OVER (PARTITION BY r.strategy_id, year(r.session) ORDER BY r.session) AS run
        FROM v_real r JOIN v_years y ON y.strategy_id = r.strategy_id AND y.year = year(r.session)) r GROUP BY 1, 2) d
 ON d.strategy_id = y.strategy_id AND d.year = y.year""",
   v_years="""SELECT strategy_id, year, ending, coalesce(lag(ending) OVER (PARTITION BY strategy_id ORDER BY year), 100000) AS start
     FROM (SELECT strategy_id, year(session) AS year, last(equity ORDER BY session) AS ending FROM v_real GROUP BY 1, 2)"""))
def yearly_metrics(spark, sf):
    return present(T.yearly(M.trades(spark, sf), _real(spark, sf), capital()), 8)


@q("pnl_concentration", with_views("""
SELECT strategy_id, kind, key, CAST(sum(gross_pnl) AS DOUBLE) AS gross_pnl FROM (
  SELECT strategy_id, 'entry_session' AS kind, CAST(entry_session AS VARCHAR) AS key, gross_pnl FROM v_trades UNION ALL
  SELECT strategy_id, 'entry_month', strftime(entry_session, '%Y-%m'), gross_pnl FROM v_trades UNION ALL
  SELECT strategy_id, 'exit_session', CAST(exit_session AS VARCHAR), gross_pnl FROM v_trades UNION ALL
  SELECT strategy_id, 'security_id', security_id, gross_pnl FROM v_trades UNION ALL
  SELECT strategy_id, 'symbol', symbol, gross_pnl FROM v_trades) GROUP BY 1, 2, 3"""))
def pnl_concentration(spark, sf):
    return present(T.concentration(M.trades(spark, sf)))


@q("rejection_counts", with_views("SELECT strategy_id, reason, count(*) AS n FROM v_cand WHERE status = 'rejected' GROUP BY 1, 2"))
def rejection_counts(spark, sf):
    return present(T.rejections(M.candidates(spark, sf)))


@q("order_counts", with_views("""
SELECT strategy_id, count(*) AS orders, count(*) FILTER (WHERE status = 'filled') AS filled,
       count(*) FILTER (WHERE status = 'rejected') AS rejected FROM v_cand GROUP BY 1"""))
def order_counts(spark, sf):
    return present(T.order_counts(M.candidates(spark, sf)))


@q("signal_sets", with_views("""
SELECT strategy_id, security_id, CAST(signal_session AS VARCHAR) AS signal_session, bool_or(status = 'filled') AS filled
FROM v_cand GROUP BY 1, 2, 3"""))
def signal_sets(spark, sf):
    return present(T.signal_sets(M.candidates(spark, sf)))


@q("trade_to_strategy", with_views("""
SELECT strategy_id, CAST(signal_session AS VARCHAR) AS signal_session, exit_reason, count(*) AS trades, CAST(sum(gross_pnl) AS DOUBLE) AS gross_pnl
FROM v_trades GROUP BY 1, 2, 3"""))
def trade_to_strategy(spark, sf):
    cand = M.candidates(spark, sf)
    bare = cand.where("status = 'filled'").select("candidate_id", "exit_reason", "gross_pnl")
    owner = cand.select("candidate_id", "strategy_id", "signal_session")
    return present(
        bare.join(owner, "candidate_id")
        .groupBy("strategy_id", "signal_session", "exit_reason")
        .agg(F.count(F.lit(1)).alias("trades"), F.sum("gross_pnl").alias("gross_pnl"))
    )


@q("reconciliation_audit", with_views("""
SELECT r.strategy_id, r.ending = 100000 + coalesce(t.pnl, 0) AS ending_matches, coalesce(c.filled, 0) = coalesce(t.n, 0) AS fills_match,
  coalesce(c.n, 0) = coalesce(c.filled + c.rejected, 0) AS orders_covered
FROM (SELECT strategy_id, last(equity ORDER BY session) AS ending FROM v_real GROUP BY 1) r
LEFT JOIN (SELECT strategy_id, sum(gross_pnl) AS pnl, count(*) AS n FROM v_trades GROUP BY 1) t USING (strategy_id)
LEFT JOIN (SELECT strategy_id, count(*) AS n, count(*) FILTER (WHERE status = 'filled') AS filled, count(*) FILTER (WHERE status = 'rejected') AS rejected
      FROM v_cand GROUP BY 1) c USING (strategy_id)"""))
def reconciliation_audit(spark, sf):
    return present(T.reconciliation(M.candidates(spark, sf), M.trades(spark, sf), _real(spark, sf), capital()))


@q("metric_invariants", with_views("""
SELECT strategy_id, rule, true AS holds FROM v_strategies CROSS JOIN (VALUES ('drawdown_not_negative'),
 ('profit_reconciles'), ('counts_cover'), ('trades_are_fills'), ('outcomes_cover'), ('gains_and_losses_sum'), ('ratio_matches_status')) r(rule)"""))
def metric_invariants(spark, sf):
    return present(T.invariants(M.candidates(spark, sf), M.trades(spark, sf), _real(spark, sf), capital()))
