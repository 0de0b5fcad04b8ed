"""Common table expressions for the check SQL: the same derived views as plain SQL."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def with_views(body: str, recursive: bool = False, **local: str) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    known = {**VIEWS, **{k: v.strip() for k, v in local.items()}}
    ordered: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in known:
            if name not in ordered and name not in seen and re.search(rf"\b{name}\b", text):
                visit(known[name], (*seen, name))
                ordered.append(name)

    visit(body, ())
    ctes = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body.strip()}" if ordered else body.strip()


view("v_days", """
SELECT d, isodow(d) AS w, month(d) AS m, day(d) AS k, year(d) AS y,
       CAST(strftime(d, '%m%d') AS INTEGER) AS md, CAST(strftime(d - 1, '%m%d') AS INTEGER) AS before, CAST(strftime(d + 1, '%m%d') AS INTEGER) AS after
FROM (SELECT CAST(unnest(generate_series(CAST(min(l_shipdate) AS DATE) - 7, CAST(max(l_shipdate) AS DATE) + 60, INTERVAL 1 DAY)) AS DATE) AS d FROM lineitem)""")

view("v_easter", """
SELECT y, make_date(y, 3, 22) + CAST(p + q - CASE WHEN q = 6 AND (p = 29 OR p = 28 AND y % 19 > 10) THEN 7 ELSE 0 END AS INTEGER) AS easter
FROM (SELECT y, p, (2 * (y % 4) + 4 * (y % 7) + 6 * p + 5) % 7 AS q FROM (SELECT DISTINCT y, (19 * (y % 19) + 24) % 30 AS p FROM v_days))""")

view("v_open_days", """
SELECT d AS session FROM v_days JOIN v_easter USING (y)
WHERE w <= 5 AND d <> easter - 2
  AND NOT (md IN (101, 704, 1225) OR md = 619 AND y >= 2022)
  AND NOT (w = 1 AND (before IN (101, 704, 1225) OR before = 619 AND y >= 2022))
  AND NOT (w = 5 AND (after IN (704, 1225) OR after = 619 AND y >= 2022))
  AND NOT (w = 1 AND (m = 1 AND y >= 1998 OR m = 2) AND (k - 1) // 7 = 2)
  AND NOT (w = 1 AND (m = 5 AND k >= 25 OR m = 9 AND k <= 7))
  AND NOT (w = 4 AND m = 11 AND (k - 1) // 7 = 3)""")

view("v_lines", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus,
       'S' || l_suppkey AS security_id, o.session AS session,
       10000 + CAST(round(l_extendedprice * 100) AS BIGINT) // 10000 AS price_c,
       CAST(round(l_discount * 100) AS BIGINT) AS disc_c,
       CAST(round(l_tax * 100) AS BIGINT) AS tax_c,
       CAST(l_quantity AS BIGINT) AS qty
FROM lineitem ASOF JOIN v_open_days o ON CAST(l_shipdate AS DATE) <= o.session""")

view("v_calendar", """
SELECT session, row_number() OVER (ORDER BY session) AS ord, lead(session) OVER (ORDER BY session) AS next_session,
       lag(session) OVER (ORDER BY session) AS prev_session,
       session + CAST((12 - isodow(session)) % 7 AS INTEGER) AS week_end,
       CAST(date_trunc('month', session) AS DATE) AS month
FROM v_open_days""")

view("v_bars", """
SELECT security_id, session,
       CAST(first(price_c ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS DOUBLE) / 100 AS open,
       CAST(max(price_c + tax_c * 10) AS DOUBLE) / 100 AS high,
       CAST(min(price_c - disc_c * 10) AS DOUBLE) / 100 AS low,
       CAST(last(price_c + (tax_c - disc_c) * 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS DOUBLE) / 100 AS close,
       CAST(sum(qty * 1000) AS BIGINT) AS volume
FROM v_lines GROUP BY security_id, session""")

_PERIOD = """
SELECT security_id, max(session) AS session,
       first(open ORDER BY session) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY session) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM (SELECT b.*, c.{key} AS period, max(c.{key}) OVER (PARTITION BY b.security_id) AS last_period,
             max(b.session) OVER (PARTITION BY b.security_id) AS last_bar
      FROM v_bars b JOIN v_calendar c USING (session)) p
WHERE NOT (period = last_period AND EXISTS
      (SELECT 1 FROM v_calendar x WHERE x.{key} = p.period AND x.session > p.last_bar))
GROUP BY security_id, period"""
view("v_weekly", _PERIOD.format(key="week_end"))
view("v_monthly", _PERIOD.format(key="month"))

view("v_cand", """
SELECT p_brand AS strategy_id,
       l_orderkey || '-' || l_linenumber || '-' || l.l_partkey || '-' || l_suppkey || '-' ||
         CAST(round(l_extendedprice * 100) AS BIGINT) AS candidate_id,
       security_id, p_type AS symbol, s.session AS signal_session, e.session AS entry_session,
       x.session AS exit_session, e.ord AS entry_ord, x.ord AS exit_ord,
       CASE WHEN l_linestatus = 'F' THEN 'filled' ELSE 'rejected' END AS status,
       CASE WHEN l_linestatus = 'F' THEN 'filled'
            WHEN l_linenumber % 4 = 0 THEN 'earnings_blackout'
            WHEN l_linenumber % 4 = 1 THEN 'minimum_signal_price'
            WHEN l_linenumber % 4 = 2 THEN 'missing_entry_bar' ELSE 'portfolio_cap' END AS reason,
       qty AS quantity,
       CAST(price_c AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS entry_price,
       CAST(price_c + (disc_c - 5) * 10 AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS exit_price,
       CAST((disc_c - 5) * 10 * qty AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS gross_pnl,
       CASE l_returnflag WHEN 'A' THEN 'stop' WHEN 'N' THEN 'target' ELSE 'time' END AS exit_reason
FROM v_lines l
JOIN v_calendar s ON s.session = l.session
JOIN v_calendar e ON e.ord = s.ord + 1
JOIN v_calendar x ON x.ord = e.ord + l_orderkey % 21
JOIN part ON p_partkey = l.l_partkey""")
view("v_trades", "SELECT * FROM v_cand WHERE status = 'filled'")

view("v_strategies", "SELECT DISTINCT p_brand AS strategy_id FROM part WHERE p_brand IS NOT NULL UNION SELECT 'Brand#99'")

view("v_members", """
SELECT 'ALL' AS cohort, strategy_id FROM v_strategies
UNION ALL
SELECT CASE WHEN CAST(regexp_extract(strategy_id, '(\\d+)$', 1) AS INTEGER) <= 13 THEN 'CORE' ELSE 'FRINGE' END,
       strategy_id FROM v_strategies""")

view("v_schedule", """
SELECT 'S' || o_custkey AS security_id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_session,
       CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER) AS known_session,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER)
            + CAST(1 + o_orderkey % 7 AS INTEGER) END AS superseded_session
FROM orders""")

view("v_ledger", """
SELECT user_id AS entry_id, event_id AS seq, ts, event_type AS family,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'closed' WHEN event_type = 'error' THEN 'cancelled'
            ELSE 'open' END AS status,
       CAST(round(value * 100) AS BIGINT) AS amount_c, props
FROM events""")


def ema_sql(source: str, span: int, value: str = "close") -> str:
    """Recursive EMA over an ordered (security_id, session, rn, value) source."""
    a = f"(CAST(2 AS DOUBLE) / {span + 1})"
    return f"""
SELECT security_id, rn, session, {value} AS y FROM {source} WHERE rn = 1
UNION ALL
SELECT s.security_id, s.rn, s.session, {a} * s.{value} + (1 - {a}) * e.y
FROM {{self}} e JOIN {source} s ON s.security_id = e.security_id AND s.rn = e.rn + 1"""


for _name, _from in (("v_daily_rn", "v_bars"), ("v_weekly_rn", "v_weekly"), ("v_monthly_rn", "v_monthly")):
    view(_name, f"SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session) AS rn FROM {_from}")
view("v_ema5", ema_sql("v_daily_rn", 5).format(self="v_ema5"))
view("v_wema13", ema_sql("v_weekly_rn", 13).format(self="v_wema13"))
view("v_mema6", ema_sql("v_monthly_rn", 6).format(self="v_mema6"))

_P = "OVER (PARTITION BY security_id ORDER BY session)"


def _roll(fn: str, x: str, n: int) -> str:
    frame = f"OVER (PARTITION BY security_id ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {frame} >= {n} THEN {fn}({x}) {frame} END"


view("v_tr", f"""
SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr
FROM (SELECT *, lag(close) {_P} AS prev_close FROM v_daily_rn)""")
view("v_feat", f"""
SELECT t.security_id, t.session, t.rn, t.open, t.high, t.low, t.close, t.volume,
       close AS daily_close, {_roll('avg', 'close', 10)} AS daily_sma10,
       close / lag(close, 5) {_P} - 1 AS daily_return5, close / lag(close, 20) {_P} - 1 AS daily_return20,
       {_roll('avg', 'tr', 14)} AS daily_atr14, {_roll('min', 'low', 10)} AS daily_rolling_low10,
       {_roll('min', 'low', 20)} AS daily_rolling_low20, {_roll('max', 'high', 20)} AS daily_rolling_high20,
       {_roll('avg', 'close * volume', 20)} AS adv20
FROM v_tr t""")
view("v_week_feat", """
SELECT w.security_id, w.session AS weekly_available, w.close AS weekly_close,
       CASE WHEN w.rn >= 13 THEN e.y END AS weekly_ema13
FROM v_weekly_rn w JOIN v_wema13 e USING (security_id, rn)""")
view("v_month_feat", """
SELECT w.security_id, w.session AS monthly_available, w.close AS monthly_close,
       CASE WHEN w.rn >= 6 THEN e.y END AS monthly_ema6
FROM v_monthly_rn w JOIN v_mema6 e USING (security_id, rn)""")
view("v_matrix", """
SELECT f.*, CASE WHEN f.rn >= 5 THEN e.y END AS daily_ema5, w.weekly_available, w.weekly_close, w.weekly_ema13,
       m.monthly_available, m.monthly_close, m.monthly_ema6
FROM v_feat f JOIN v_ema5 e ON e.security_id = f.security_id AND e.rn = f.rn
ASOF LEFT JOIN v_week_feat w ON w.security_id = f.security_id AND w.weekly_available <= f.session
ASOF LEFT JOIN v_month_feat m ON m.security_id = f.security_id AND m.monthly_available <= f.session""")

_RULES = [
    (f"{frame}-{avg}{n}-{word}__{slug}", f"{frame}_close {op} {frame}_{avg}{n}", cond)
    for frame, avg, n in (("weekly", "ema", 13), ("monthly", "ema", 6))
    for word, op in (("above", ">"), ("below", "<"))
    for slug, cond in (
        ("close-cross-ema5", "daily_close > daily_ema5 AND prev_close <= prev_ema5"),
        ("close-cross-sma10", "daily_close > daily_sma10 AND prev_close <= prev_sma10"),
        ("return5-cross-zero", "daily_return5 > 0 AND prev_return5 <= 0"),
    )
]
view("v_lagged", f"""
SELECT *, lag(daily_close) {_P} AS prev_close, lag(daily_ema5) {_P} AS prev_ema5,
       lag(daily_sma10) {_P} AS prev_sma10, lag(daily_return5) {_P} AS prev_return5 FROM v_matrix""")
view("v_hits", "SELECT * FROM (SELECT unnest([" + ", ".join(
    f"CASE WHEN {where} AND {when} THEN '{name}' END" for name, where, when in _RULES)
    + "]) AS rule, m.* FROM v_lagged m WHERE daily_return20 IS NOT NULL AND adv20 IS NOT NULL) WHERE rule IS NOT NULL")
view("v_signals", """
SELECT h.*, c.ord AS signal_ord, c.session AS signal_session, c.next_session AS entry_session
FROM v_hits h JOIN v_calendar c ON c.session = h.session""")
view("v_grid", "SELECT * FROM (VALUES " + ", ".join(
    f"('{stop}', '{target}', {sfact}, {tkind})"
    for sfact, stop in enumerate(("atr14x1", "atr14x1p5", "rolling-low10", "rolling-low20"), 1)
    for tkind, target in enumerate(("risk1p75", "risk2p5", "rolling-high20"), 1))
    + ") g(stop_slug, target_slug, stop_fact_value, target_kind)")
view("v_levels0", """
SELECT s.*, s.rule || '__' || g.stop_slug || '__target-' || g.target_slug AS strategy_id, g.stop_slug, g.target_slug, target_kind,
       e.open AS entry_price,
       CASE stop_fact_value WHEN 1 THEN e.open - daily_atr14 * 1.0 WHEN 2 THEN e.open - daily_atr14 * 1.5
            WHEN 3 THEN daily_rolling_low10 ELSE daily_rolling_low20 END AS stop
FROM v_signals s CROSS JOIN v_grid g
LEFT JOIN v_bars e ON e.security_id = s.security_id AND e.session = s.entry_session""")
view("v_levels1", """
SELECT *, entry_price - stop AS risk, CASE target_kind WHEN 1 THEN entry_price + (entry_price - stop) * CAST(1.75 AS DOUBLE)
            WHEN 2 THEN entry_price + (entry_price - stop) * CAST(2.5 AS DOUBLE) ELSE daily_rolling_high20 END AS target
FROM v_levels0""")
view("v_levels", """
SELECT *, CASE WHEN entry_price IS NULL OR stop IS NULL OR target IS NULL THEN 'missing_geometry'
     WHEN NOT (stop > 0 AND stop < entry_price AND target > entry_price AND risk / entry_price <= CAST(0.12 AS DOUBLE)
               AND (target - entry_price) / risk > 1.5) THEN 'invalid_geometry' END AS geometry_reason
FROM v_levels1""")
view("v_next_event", """
SELECT c.security_id, c.signal_session, c.entry_session, min(s.event_session) AS next_event
FROM (SELECT DISTINCT security_id, signal_session, entry_session FROM v_signals) c
JOIN v_schedule s ON s.security_id = c.security_id AND s.event_session >= c.entry_session
 AND s.known_session <= c.signal_session AND c.signal_session < coalesce(s.superseded_session, DATE '9999-12-31')
GROUP BY 1, 2, 3""")
view("v_path", """
SELECT l.security_id, l.strategy_id, l.signal_session, b.session, b.open, b.high, b.low, b.close,
       b.rn - e.rn AS i, l.stop, l.target
FROM (SELECT * FROM v_levels WHERE geometry_reason IS NULL) l
JOIN v_daily_rn e ON e.security_id = l.security_id AND e.session = l.entry_session
JOIN v_daily_rn b ON b.security_id = l.security_id AND b.rn BETWEEN e.rn AND e.rn + 20""")
view("v_touch", """
SELECT *, CASE WHEN i > 0 AND open <= stop THEN 'gap_stop' WHEN i > 0 AND open >= target THEN 'gap_target'
               WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' WHEN i = 20 THEN 'time' END AS reason,
       CASE WHEN i > 0 AND (open <= stop OR open >= target) THEN open WHEN low <= stop THEN stop
            WHEN high >= target THEN target ELSE close END AS price
FROM v_path""")
view("v_exits", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, security_id, signal_session ORDER BY i) AS k
               FROM v_touch WHERE reason IS NOT NULL) WHERE k = 1""")
