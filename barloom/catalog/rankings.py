"""Leaderboards, selections, overlap and rank stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.performance import capital
from barloom.catalog.views_sql import view, with_views
from barloom.operators import overlap as O, ranking as R, sessions as S
from barloom.session import persist_table
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


view("v_split", """
SELECT session, ord, CASE WHEN ord <= n * 3 // 5 - 21 THEN 'development' WHEN ord <= n * 3 // 5 THEN 'development_validation_purge'
  WHEN ord <= n * 4 // 5 - 21 THEN 'validation' WHEN ord <= n * 4 // 5 THEN 'validation_oos_purge' ELSE 'oos' END AS kind
FROM (SELECT session, ord, count(*) OVER () AS n FROM v_calendar)""")
view("v_win", """
SELECT kind, strategy_id, session, closed, 100000 + sum(pnl) OVER (PARTITION BY kind, strategy_id ORDER BY session) AS equity
FROM (SELECT s.kind, strategy_id, exit_session AS session, sum(gross_pnl) AS pnl, count(*) AS closed
      FROM v_trades t JOIN v_split s ON s.session = t.entry_session GROUP BY 1, 2, 3)""")
view("v_traded", """
SELECT kind, strategy_id, last(equity ORDER BY session) - 100000 AS profit,
  max(1 - CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE)) AS dd, CAST(sum(closed) AS BIGINT) AS trades
FROM (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY kind, strategy_id ORDER BY session)) AS peak FROM v_win) GROUP BY 1, 2""")
view("v_rev0", """
SELECT kind, strategy_id, sha256(strategy_id) AS identity, coalesce(t.profit, 0) AS profit, coalesce(t.dd, 0) AS dd, coalesce(t.trades, 0) AS trades
FROM (SELECT DISTINCT kind FROM v_split) CROSS JOIN v_strategies LEFT JOIN v_traded t USING (kind, strategy_id)""")
view("v_rev", """
SELECT *, CASE WHEN dd = 0 AND profit > 0 THEN 0 WHEN dd = 0 THEN 2 ELSE 1 END AS st,
       CASE WHEN dd <> 0 THEN CAST(profit AS DOUBLE) / 100000 / dd END AS ratio FROM v_rev0""")
view("v_ranked", """
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY profit DESC, identity) AS profit_rank,
  row_number() OVER (PARTITION BY kind ORDER BY dd, identity) AS drawdown_rank,
  row_number() OVER (PARTITION BY kind ORDER BY st, coalesce(ratio, 0) DESC, identity) AS ratio_rank FROM v_rev""")
view("v_wide", """
SELECT d.strategy_id, d.identity, d.profit AS dp, v.profit AS vp, d.trades AS development_trades, v.trades AS validation_trades,
  d.profit_rank AS development_profit_rank, d.drawdown_rank AS development_drawdown_rank, d.ratio_rank AS development_ratio_rank,
  v.profit_rank AS validation_profit_rank, v.drawdown_rank AS validation_drawdown_rank, v.ratio_rank AS validation_ratio_rank
FROM (SELECT * FROM v_ranked WHERE kind = 'development') d JOIN (SELECT * FROM v_ranked WHERE kind = 'validation') v USING (strategy_id)""")
view("v_axis", """
UNPIVOT (SELECT kind, strategy_id, identity, trades, profit_rank AS profit, drawdown_rank AS drawdown, ratio_rank AS ratio FROM v_ranked)
ON profit, drawdown, ratio INTO NAME axis VALUE place""")
view("v_both", """
SELECT strategy_id, axis, d.identity, d.place AS development_rank, v.place AS validation_rank, greatest(d.place, v.place) AS worse,
       d.trades AS development_trades, v.trades AS validation_trades,
       list_position(['profit', 'drawdown', 'ratio'], axis) AS axis_order,
       ['Gross profit', 'Lowest maximum drawdown', 'Profit/drawdown'][list_position(['profit', 'drawdown', 'ratio'], axis)] AS metric
FROM v_axis d JOIN v_axis v USING (strategy_id, axis) WHERE d.kind = 'development' AND v.kind = 'validation'""")
view("v_options", """
SELECT unnest(CASE WHEN axes_in_top > 1 THEN ['A', 'B'] WHEN axes_in_top = 1 THEN ['A'] ELSE [] END || CASE WHEN best_worse <= 20 THEN ['C'] ELSE [] END) AS option,
       strategy_id
FROM (SELECT strategy_id, count_if(validation_rank <= 5) AS axes_in_top, min(worse) AS best_worse FROM v_both GROUP BY strategy_id)""")
view("v_keys", """
SELECT DISTINCT s.kind AS win, strategy_id AS identity, security_id || '|' || CAST(signal_session AS VARCHAR) AS signal_key
FROM v_trades t JOIN v_split s ON s.session = t.entry_session WHERE s.kind IN ('development', 'validation')""")


def _ranked(spark, sf):
    split = S.chronological_split(M.calendar(spark, sf))
    return R.leaderboards(R.window_results(M.trades(spark, sf), split, capital(), M.strategies(spark, sf)))


def _wide(spark, sf):
    return R.compare_windows(_ranked(spark, sf), "development", "validation")


_RANKS = "profit_rank, drawdown_rank, ratio_rank"


@q("leaderboards", with_views(f"""
SELECT kind, strategy_id, identity, CAST(profit AS DOUBLE) AS gross_profit, round(dd, 8) AS maximum_drawdown, round(ratio, 6) AS profit_drawdown,
       trades, {_RANKS} FROM v_ranked"""))
def leaderboards(spark, sf):
    return present(
        _ranked(spark, sf).select(
            "kind", "strategy_id", "identity", "gross_profit", "maximum_drawdown", "profit_drawdown", "trades",
            "profit_rank", "drawdown_rank", "ratio_rank",
        ),
        8, profit_drawdown=6,
    )


@q("top_n_per_axis", with_views(" UNION ALL ".join(
    f"SELECT kind, '{axis}' AS axis, strategy_id, {axis}_rank AS rank FROM v_ranked WHERE {axis}_rank <= 5" for axis in ("profit", "drawdown", "ratio"))))
def top_n_per_axis(spark, sf):
    ranked = persist_table(_ranked(spark, sf), "ranked")
    tops = [
        R.top_of_axis(ranked, axis).select("kind", F.lit(axis).alias("axis"), "strategy_id", F.col(f"{axis}_rank").alias("rank"))
        for axis in ("profit", "drawdown", "ratio")
    ]
    return present(tops[0].unionByName(tops[1]).unionByName(tops[2]))


@q("topn_union", with_views(f"""
SELECT kind, strategy_id, identity, {_RANKS} FROM v_ranked WHERE profit_rank <= 5 OR drawdown_rank <= 5 OR ratio_rank <= 5"""))
def topn_union(spark, sf):
    return present(
        R.top_union(_ranked(spark, sf)).select("kind", "strategy_id", "identity", "profit_rank", "drawdown_rank", "ratio_rank")
    )


@q("window_alignment", with_views("""
SELECT strategy_id, development_trades, validation_trades, true AS aligned FROM v_wide"""))
def window_alignment(spark, sf):
    return present(_wide(spark, sf).select("strategy_id", "development_trades", "validation_trades", "aligned"))


@q("rank_scatter", with_views("""
SELECT strategy_id, left(identity, 12) AS identity_prefix, metric, development_rank, validation_rank, development_trades, validation_trades,
  if(worse <= 20, 'Yes', 'No') AS shared FROM v_both"""))
def rank_scatter(spark, sf):
    return present(R.rank_scatter(_wide(spark, sf)))


@q("top20_continuity", with_views("""
SELECT metric, unnest(['Shared top', 'Not shared']) AS continuity, unnest([stay, 20 - stay]) AS revisions
FROM (SELECT metric, CAST(count_if(worse <= 20) AS BIGINT) AS stay FROM v_both GROUP BY metric)"""))
def top20_continuity(spark, sf):
    return present(R.continuity(_wide(spark, sf)))


@q("shared_top_sets", with_views("""
SELECT strategy_id, string_agg(axis, ',' ORDER BY axis_order) AS axes FROM v_both WHERE worse <= 10 GROUP BY strategy_id"""))
def shared_top_sets(spark, sf):
    return present(R.shared_sets(_wide(spark, sf), 10).withColumn("axes", F.array_join("axes", ",")))


@q("selection_options", with_views("SELECT option, strategy_id FROM v_options"))
def selection_options(spark, sf):
    return present(R.selection_options(_wide(spark, sf)).select("option", "strategy_id"))


@q("option_revisions", with_views("""
SELECT option, strategy_id, development_trades, validation_trades, development_profit_rank, validation_profit_rank FROM v_options JOIN v_wide USING (strategy_id)"""))
def option_revisions(spark, sf):
    wide = _wide(spark, sf)
    members = R.selection_options(wide)
    return present(
        members.join(wide.drop("identity"), "strategy_id").select(
            "option", "strategy_id", "development_trades", "validation_trades", "development_profit_rank", "validation_profit_rank"
        )
    )


def _window_keys(spark, sf):
    """Distinct signals by window and strategy, written once: the overlaps read them several times."""
    split = S.chronological_split(M.calendar(spark, sf)).where("kind IN ('development', 'validation')")
    kinds = split.select(F.col("session").alias("entry_session"), F.col("kind").alias("win"))
    keys = M.trades(spark, sf).join(S.small(kinds), "entry_session").select("win", "strategy_id", "security_id", "signal_session")
    return persist_table(keys.distinct(), "window-keys")


def _option_pairs(spark, sf, empty=None):
    options = persist_table(R.selection_options(_wide(spark, sf)).select("option", "strategy_id"), "options")
    pairs = O.unordered_pairs(options, "strategy_id", ["option"])
    windows = F.explode(F.array(F.lit("development"), F.lit("validation")))
    both = pairs.select("left_member", "right_member").distinct().withColumn("win", windows)
    ratios = O.jaccard(both, _window_keys(spark, sf), ["security_id", "signal_session"], "strategy_id", ["win"], empty)
    return pairs.join(ratios, ["left_member", "right_member"])


_PAIR_SQL = """
SELECT p.*, coalesce(c.n, 0) AS intersection, coalesce(x.n, 0) AS lc, coalesce(y.n, 0) AS rc
FROM (SELECT option, win, l.strategy_id AS left_member, r.strategy_id AS right_member
      FROM v_options l JOIN v_options r USING (option), (SELECT unnest(['development', 'validation']) AS win)
      WHERE l.strategy_id < r.strategy_id) p
LEFT JOIN v_common c ON (c.win, c.l, c.r) = (p.win, left_member, right_member)
LEFT JOIN v_set_size x ON (x.win, x.identity) = (p.win, left_member)
LEFT JOIN v_set_size y ON (y.win, y.identity) = (p.win, right_member)"""
view("v_set_size", "SELECT win, identity, count(*) AS n FROM v_keys GROUP BY win, identity")
view("v_common", """
SELECT a.win, a.identity AS l, b.identity AS r, count(*) AS n FROM v_keys a JOIN v_keys b USING (win, signal_key)
WHERE a.identity < b.identity GROUP BY 1, 2, 3""")


@q("option_pair_overlap", with_views("""
SELECT option, win, left_member, right_member, intersection, lc + rc - intersection AS "union", round(CAST(intersection AS DOUBLE) / nullif(lc + rc - intersection, 0), 8) AS jaccard
FROM v_pairs""", v_pairs=_PAIR_SQL))
def option_pair_overlap(spark, sf):
    return present(_option_pairs(spark, sf), 8)


@q("option_overlap_bp", with_views("""
SELECT option, win, CAST(round(avg(CAST(intersection AS DOUBLE) / nullif(lc + rc - intersection, 0)) * 10000) AS BIGINT) AS mean_overlap_bp,
 CAST(round(max(CAST(intersection AS DOUBLE) / nullif(lc + rc - intersection, 0)) * 10000) AS BIGINT) AS maximum_overlap_bp, count(*) AS pair_count
FROM v_pairs GROUP BY 1, 2""", v_pairs=_PAIR_SQL))
def option_overlap_bp(spark, sf):
    return present(O.overlap_summary(_option_pairs(spark, sf), ["option", "win"]))


@q("option_overlap_mean", with_views("""
SELECT option, win, round(avg(coalesce(CAST(intersection AS DOUBLE) / nullif(lc + rc - intersection, 0), 0)), 8) AS mean_overlap,
 round(max(coalesce(CAST(intersection AS DOUBLE) / nullif(lc + rc - intersection, 0), 0)), 8) AS maximum_overlap FROM v_pairs GROUP BY 1, 2""", v_pairs=_PAIR_SQL))
def option_overlap_mean(spark, sf):
    pairs = _option_pairs(spark, sf, empty=F.lit(0.0))
    return present(
        pairs.groupBy("option", "win").agg(F.avg("jaccard").alias("mean_overlap"), F.max("jaccard").alias("maximum_overlap")), 8
    )


@q("pair_jaccard", with_views("""
SELECT l.strategy_id AS left_member, r.strategy_id AS right_member, coalesce(x.ci, 0) AS candidate_intersection, l.c + r.c - coalesce(x.ci, 0) AS candidate_union,
  round(CAST(coalesce(x.ci, 0) AS DOUBLE) / (l.c + r.c - coalesce(x.ci, 0)), 8) AS candidate_jaccard,
  coalesce(x.fi, 0) AS filled_intersection, round(CAST(coalesce(x.fi, 0) AS DOUBLE) / nullif(l.f + r.f - coalesce(x.fi, 0), 0), 8) AS filled_jaccard
FROM v_size l JOIN v_size r ON l.strategy_id < r.strategy_id LEFT JOIN (
  SELECT a.strategy_id AS l, b.strategy_id AS r, count(*) AS ci, count(*) FILTER (WHERE a.filled AND b.filled) AS fi
  FROM v_sig a JOIN v_sig b ON a.security_id = b.security_id AND a.signal_session = b.signal_session AND a.strategy_id < b.strategy_id GROUP BY 1, 2) x
 ON x.l = l.strategy_id AND x.r = r.strategy_id""",
   v_sig="SELECT strategy_id, security_id, signal_session, bool_or(status = 'filled') AS filled FROM v_cand GROUP BY 1, 2, 3",
   v_size="SELECT strategy_id, count(*) AS c, count(*) FILTER (WHERE filled) AS f FROM v_sig GROUP BY 1"))
def pair_jaccard(spark, sf):
    keys = ["security_id", "signal_session"]
    signals = M.candidates(spark, sf).groupBy("strategy_id", *keys).agg(F.bool_or(F.col("status") == "filled").alias("filled"))
    signals = persist_table(signals, "signals")
    pairs = O.unordered_pairs(signals.select("strategy_id").distinct(), "strategy_id")
    every = O.jaccard(pairs, signals, keys, "strategy_id")
    filled = O.jaccard(pairs, signals.where("filled"), keys, "strategy_id")
    both = every.alias("c").join(filled.alias("f"), ["left_member", "right_member"])
    return present(
        both.select(
            "left_member", "right_member", F.col("c.intersection").alias("candidate_intersection"),
            F.col("c.union").alias("candidate_union"), F.col("c.jaccard").alias("candidate_jaccard"),
            F.col("f.intersection").alias("filled_intersection"), F.col("f.jaccard").alias("filled_jaccard"),
        ),
        8,
    )


_PROJ = """
SELECT l.strategy_id AS left_member, r.strategy_id AS right_member,
 round(coalesce(CAST(len(list_intersect(l.sec, r.sec)) AS DOUBLE) / nullif(len(list_distinct(l.sec || r.sec)), 0), 0), 8) AS symbol_jaccard,
 round(coalesce(CAST(len(list_intersect(l.ses, r.ses)) AS DOUBLE) / nullif(len(list_distinct(l.ses || r.ses)), 0), 0), 8) AS session_jaccard,
 round(coalesce(CAST(len(list_intersect(l.k, r.k)) AS DOUBLE) / nullif(len(list_distinct(l.k || r.k)), 0), 0), 8) AS filled_jaccard,
 len(list_intersect(l.k, r.k)) AS shared
FROM v_lists l JOIN v_lists r ON l.strategy_id < r.strategy_id"""


@q("projection_jaccard", with_views(_PROJ, v_lists="""
SELECT strategy_id, list(DISTINCT security_id) AS sec, list(DISTINCT signal_session) AS ses,
       list(DISTINCT security_id || '|' || CAST(signal_session AS VARCHAR)) AS k FROM v_trades GROUP BY 1"""))
def projection_jaccard(spark, sf):
    trades = persist_table(M.trades(spark, sf).select("strategy_id", "security_id", "signal_session").distinct(), "trade-keys")
    pairs = O.unordered_pairs(trades.select("strategy_id").distinct(), "strategy_id")
    zero = F.lit(0.0)
    on = ["left_member", "right_member"]
    security = O.jaccard(pairs, trades, ["security_id"], "strategy_id", empty=zero).select(*on, F.col("jaccard").alias("symbol_jaccard"))
    session = O.jaccard(pairs, trades, ["signal_session"], "strategy_id", empty=zero).select(*on, F.col("jaccard").alias("session_jaccard"))
    both = O.jaccard(pairs, trades, ["security_id", "signal_session"], "strategy_id", empty=zero).select(
        *on, F.col("jaccard").alias("filled_jaccard"), F.col("intersection").alias("shared")
    )
    return present(security.join(session, on).join(both, on), 8)


@q("spearman_rank", with_views("""
SELECT axis, round(corr(development_rank, validation_rank), 8) AS rho FROM v_both GROUP BY axis"""))
def spearman_rank(spark, sf):
    return present(R.spearman(_wide(spark, sf)), 8)


@q("sign_agreement", with_views("""
SELECT CASE WHEN dp > 0 THEN 'positive' ELSE 'not_positive' END AS development, CASE WHEN vp > 0 THEN 'positive' ELSE 'not_positive' END AS validation,
       count(*) AS n FROM v_wide GROUP BY 1, 2"""))
def sign_agreement(spark, sf):
    return present(R.sign_agreement(_wide(spark, sf)))
