"""Quality and integrity queries on deliberately damaged copies of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import view, with_views
from barloom.functions.canonical import canonical_json
from barloom.operators import bars as B, integrity as I, quality as Y
from barloom.operators.scaled import bucketed_running
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


view("v_dirty0", """
SELECT security_id, session, CAST(substr(security_id, 2) AS BIGINT) % 10 AS k, (session - DATE '1990-01-01') * 2 AS pos,
  open, high, low, close, volume FROM v_bars WHERE CAST(substr(security_id, 2) AS BIGINT) % 10 <> 0 OR session >= DATE '2001-11-01'""")
view("v_dirty", """
SELECT security_id, session, CASE WHEN k = 5 THEN -pos ELSE pos END AS pos, open,
  CASE WHEN k = 3 AND volume % 11000 = 0 THEN low - 5 ELSE high END AS high, CASE WHEN k = 2 AND volume % 9000 = 0 THEN -1 ELSE low END AS low,
  CASE WHEN k = 1 AND volume % 7000 = 0 THEN NULL WHEN k = 8 AND volume % 8000 = 0 THEN close * 2 ELSE close END AS close,
  CASE WHEN k = 6 AND volume % 17000 = 0 THEN -volume WHEN k = 7 AND volume % 3000 = 0 THEN 0 ELSE volume END AS volume FROM v_dirty0
UNION ALL SELECT security_id, session, pos + 1, open, high, low, close, volume FROM v_dirty0 WHERE k = 4 AND volume % 13000 = 0""")
view("v_order", """
SELECT s.security_id, s.unsorted, d.duplicated FROM (
  SELECT security_id, coalesce(bool_or(session < before), false) AS unsorted FROM (SELECT *, lag(session) OVER (PARTITION BY security_id ORDER BY pos) AS before FROM v_dirty) GROUP BY 1) s
JOIN (SELECT security_id, max(n) > 1 AS duplicated FROM (SELECT security_id, session, count(*) AS n FROM v_dirty GROUP BY 1, 2) GROUP BY 1) d USING (security_id)""")
view("v_clean", "SELECT v_dirty.* FROM v_dirty JOIN v_order USING (security_id) WHERE NOT unsorted AND NOT duplicated")
view("v_missing", """
SELECT r.security_id, c.session FROM (SELECT security_id, min(session) AS lo, max(session) AS hi FROM v_clean GROUP BY 1) r
JOIN v_calendar c ON c.session BETWEEN r.lo AND r.hi
WHERE NOT EXISTS (SELECT 1 FROM v_clean x WHERE x.security_id = r.security_id AND x.session = c.session)""")
view("v_moves", """
SELECT security_id, session, close, abs(close / before - 1) AS move FROM (
  SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY session) AS before FROM v_clean) WHERE abs(close / before - 1) > 0.5""")


def _dirty(spark, sf):
    k = F.substring("security_id", 2, 20).cast("long") % 10
    bars = M.bars(spark, sf).withColumn("k", k)
    bars = bars.where((F.col("k") != 0) | (F.col("session") >= F.to_date(F.lit("2001-11-01"))))
    bars = bars.withColumn("pos", F.date_diff("session", F.to_date(F.lit("1990-01-01"))) * 2)
    v = F.col("volume")

    def hurt(kind, divisor):
        return (F.col("k") == kind) & (v % divisor == 0)

    twice = bars.where(hurt(4, 13000)).withColumn("pos", F.col("pos") + 1)
    damaged = bars.select(
        "security_id", "session", F.when(F.col("k") == 5, -F.col("pos")).otherwise(F.col("pos")).alias("pos"), "open",
        F.when(hurt(3, 11000), F.col("low") - 5).otherwise(F.col("high")).alias("high"),
        F.when(hurt(2, 9000), F.lit(-1.0)).otherwise(F.col("low")).alias("low"),
        F.when(hurt(8, 8000), F.col("close") * 2).when(~hurt(1, 7000), F.col("close")).alias("close"),
        F.when(hurt(6, 17000), -v).when(hurt(7, 3000), F.lit(0)).otherwise(v).alias("volume"),
    )
    return damaged.unionByName(twice.select(damaged.columns))


@q("quality_report", with_views("""
SELECT c.security_id, concat_ws('; ', CASE WHEN nulls > 0 THEN 'NaN values on ' || nulls || ' bar(s)' END, CASE WHEN nonpos > 0 THEN 'non-positive price(s)' END,
  CASE WHEN neg > 0 THEN 'negative volume' END, CASE WHEN bad > 0 THEN 'inconsistent OHLC range on ' || bad || ' bar(s)' END,
  CASE WHEN unsorted THEN 'index not sorted' END, CASE WHEN duplicated THEN 'duplicate dates' END,
  CASE WHEN m.n > 0 THEN m.n || ' missing session(s), e.g. ' || CAST(m.lo AS VARCHAR) END) AS errors,
  concat_ws('; ', CASE WHEN x.n > 0 THEN x.n || ' extreme move(s) >50%, e.g. ' || CAST(x.lo AS VARCHAR) || ' (' || CAST(round(x.mv * 100) AS BIGINT) || '%)' END,
   CASE WHEN NOT unsorted AND NOT duplicated AND zero > 0 THEN zero || ' zero-volume bar(s)' END) AS warnings,
  nulls = 0 AND nonpos = 0 AND neg = 0 AND bad = 0 AND NOT unsorted AND NOT duplicated AND coalesce(m.n, 0) = 0 AS ok
FROM (SELECT security_id, count(*) FILTER (WHERE close IS NULL) AS nulls, count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS nonpos,
   count(*) FILTER (WHERE volume < 0) AS neg, count(*) FILTER (WHERE volume = 0) AS zero,
   count(*) FILTER (WHERE high < low OR high < greatest(open, high, low, close) - CAST(1e-9 AS DOUBLE) OR low > least(open, high, low, close) + CAST(1e-9 AS DOUBLE)) AS bad FROM v_dirty GROUP BY 1) c
JOIN v_order o USING (security_id) LEFT JOIN (SELECT security_id, count(*) AS n, min(session) AS lo FROM v_missing GROUP BY 1) m USING (security_id)
LEFT JOIN (SELECT security_id, count(*) AS n, min(session) AS lo, first(move ORDER BY session) AS mv FROM v_moves GROUP BY 1) x USING (security_id)"""))
def quality_report(spark, sf):
    report = Y.quality_report(_dirty(spark, sf), M.calendar(spark, sf), "pos")
    return present(report.withColumn("errors", F.array_join("errors", "; ")).withColumn("warnings", F.array_join("warnings", "; ")))


@q("quarantined_bars", with_views("""
SELECT security_id, count(*) AS n FROM v_bars b WHERE NOT EXISTS (SELECT 1 FROM v_moves m WHERE m.security_id = b.security_id)
 AND security_id IN (SELECT security_id FROM v_clean) GROUP BY 1"""))
def quarantined_bars(spark, sf):
    dirty = _dirty(spark, sf)
    order = Y.order_problems(dirty, "pos")
    clean = dirty.join(order.where("NOT unsorted AND NOT duplicated"), "security_id", "left_semi")
    jumps = Y.extreme_moves(clean).select("security_id").distinct().withColumn("jump", F.lit(True))
    report = clean.select("security_id").distinct().join(jumps, "security_id", "left").withColumn("ok", F.col("jump").isNull())
    kept = Y.quarantine(M.bars(spark, sf), report)
    return present(kept.groupBy("security_id").agg(F.count(F.lit(1)).alias("n")))


@q("missing_sessions", with_views("SELECT security_id, CAST(session AS VARCHAR) AS session FROM v_missing"))
def missing_sessions(spark, sf):
    dirty = _dirty(spark, sf)
    order = Y.order_problems(dirty, "pos")
    clean = dirty.join(order.where("NOT unsorted AND NOT duplicated"), "security_id", "left_semi")
    return present(Y.missing_sessions(clean, M.calendar(spark, sf)))


@q("extreme_moves", with_views("SELECT security_id, CAST(session AS VARCHAR) AS session, close, round(move, 8) AS move FROM v_moves"))
def extreme_moves(spark, sf):
    dirty = _dirty(spark, sf)
    order = Y.order_problems(dirty, "pos")
    clean = dirty.join(order.where("NOT unsorted AND NOT duplicated"), "security_id", "left_semi")
    return present(Y.extreme_moves(clean), move=8)


@q("order_dup_checks", with_views("SELECT security_id, unsorted, duplicated FROM v_order"))
def order_dup_checks(spark, sf):
    return present(Y.order_problems(_dirty(spark, sf), "pos"))


@q("bar_validity", with_views("""
SELECT security_id, count(*) AS bars, count(*) FILTER (WHERE high < low OR high < greatest(open, high, low, close) - CAST(1e-9 AS DOUBLE) OR low > least(open, high, low, close) + CAST(1e-9 AS DOUBLE)) AS invalid
FROM v_dirty GROUP BY 1"""))
def bar_validity(spark, sf):
    return present(
        _dirty(spark, sf).groupBy("security_id").agg(
            F.count(F.lit(1)).alias("bars"), F.count_if(~Y.valid_range()).alias("invalid")
        )
    )


_OBS = "SELECT security_id, min(session) AS first_session, max(session) AS last_session, count(*) AS n_bars FROM v_bars GROUP BY 1"


@q("inventory_reconcile", with_views("""
SELECT security_id, problem, detail FROM (
  SELECT coalesce(r.security_id, d.security_id, o.security_id) AS security_id,
   unnest([CASE WHEN r.security_id IS NULL THEN 'not_in_roster' END, CASE WHEN d.security_id IS NULL THEN 'absent_from_manifest' END, CASE WHEN o.security_id IS NULL THEN 'no_bars' END,
     CASE WHEN d.first_session <> o.first_session THEN 'first_session_mismatch' END, CASE WHEN d.n_bars <> o.n_bars THEN 'n_bars_mismatch' END]) AS problem,
   unnest([NULL, NULL, NULL, CAST(d.first_session AS VARCHAR) || ' vs ' || CAST(o.first_session AS VARCHAR), d.n_bars || ' vs ' || o.n_bars]) AS detail
  FROM (SELECT 'S' || s_suppkey AS security_id FROM supplier WHERE s_suppkey % 17 <> 5) r
  FULL JOIN (SELECT security_id, CASE WHEN security_id LIKE '%7' THEN first_session + 1 ELSE first_session END AS first_session, CASE WHEN security_id LIKE '%3' THEN n_bars + 2 ELSE n_bars END AS n_bars
             FROM v_obs WHERE security_id NOT LIKE '%9') d ON d.security_id = r.security_id
  FULL JOIN (SELECT * FROM v_obs WHERE security_id NOT LIKE '%4') o ON o.security_id = coalesce(r.security_id, d.security_id)) WHERE problem IS NOT NULL""", v_obs=_OBS))
def inventory_reconcile(spark, sf):
    observed = B.bar_manifest(M.bars(spark, sf))
    roster = M.table(spark, sf, "supplier").where("s_suppkey % 17 <> 5")
    roster = roster.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"))
    sid = F.col("security_id")
    declared = observed.where(~sid.endswith("9")).select(
        "security_id",
        F.when(sid.endswith("7"), F.date_add("first_session", 1)).otherwise(F.col("first_session")).alias("first_session"),
        F.when(sid.endswith("3"), F.col("n_bars") + 2).otherwise(F.col("n_bars")).alias("n_bars"),
    )
    return present(
        I.reconcile_inventory(roster, declared, observed.where(~sid.endswith("4")), ["first_session", "n_bars"])
    )


_IVL = """SELECT security_id, min(event_session) AS start, max(event_session) - 200 AS "end" FROM v_schedule GROUP BY 1
UNION ALL SELECT security_id, max(event_session) - 100, max(event_session) FROM v_schedule GROUP BY 1"""


@q("interval_coverage", with_views("""
SELECT security_id, event_id, CAST(event_session AS VARCHAR) AS event_session FROM v_schedule s
WHERE NOT EXISTS (SELECT 1 FROM v_ivl i WHERE i.security_id = s.security_id AND i.start <= s.event_session AND s.event_session < i."end")""", v_ivl=_IVL))
def interval_coverage(spark, sf):
    facts = M.schedule(spark, sf).select("security_id", "event_id", "event_session")
    by = facts.groupBy("security_id").agg(F.min("event_session").alias("lo"), F.max("event_session").alias("hi"))
    pieces = F.array(
        F.struct(F.col("lo").alias("start"), F.date_sub("hi", 200).alias("end")),
        F.struct(F.date_sub("hi", 100).alias("start"), F.col("hi").alias("end")),
    )
    intervals = by.select("security_id", F.inline(pieces))
    return present(I.uncovered_facts(facts, intervals, "security_id", "event_session"))


@q("symbol_interval_coverage", with_views("""
SELECT security_id FROM (SELECT DISTINCT security_id FROM v_schedule) s WHERE NOT EXISTS (
  SELECT 1 FROM v_ivl i WHERE i.security_id = s.security_id AND i.start <= DATE '1996-06-30' AND i."end" > DATE '1999-12-31')""", v_ivl=_IVL))
def symbol_interval_coverage(spark, sf):
    facts = M.schedule(spark, sf).select("security_id", "event_session")
    by = facts.groupBy("security_id").agg(F.min("event_session").alias("lo"), F.max("event_session").alias("hi"))
    pieces = F.array(
        F.struct(F.col("lo").alias("start"), F.date_sub("hi", 200).alias("end")),
        F.struct(F.date_sub("hi", 100).alias("start"), F.col("hi").alias("end")),
    )
    intervals = by.select("security_id", F.inline(pieces))
    need = by.select(
        "security_id", F.to_date(F.lit("1996-06-30")).alias("need_start"), F.to_date(F.lit("1999-12-31")).alias("need_end")
    )
    return present(I.uncovered_ranges(need, intervals, "security_id"))


@q("calendar_diff", with_views("""
SELECT CAST(session AS VARCHAR) AS session, 'left_only' AS side FROM v_calendar WHERE session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
  AND session NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'right_only' FROM orders WHERE o_orderkey % 3 = 0
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND CAST(o_orderdate AS DATE) NOT IN (SELECT session FROM v_calendar)"""))
def calendar_diff(spark, sf):
    other = M.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.to_date("o_orderdate").alias("session")).distinct()
    lo, hi = F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1999-12-31"))
    return present(I.calendar_differences(M.calendar(spark, sf), other, lo, hi))


@q("manifest_field_compare", """
WITH m AS (SELECT o_orderpriority AS kind, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, max(o_custkey) AS top FROM orders GROUP BY 1),
e AS (SELECT kind, CASE WHEN kind LIKE '1%' THEN n + 1 ELSE n END AS n, CASE WHEN kind NOT LIKE '2%' THEN first_day END AS first_day, top FROM m WHERE kind NOT LIKE '5%')
SELECT m.kind, unnest(['n', 'first_day', 'top']) AS field, unnest([CAST(e.n AS VARCHAR), CAST(e.first_day AS VARCHAR), CAST(e.top AS VARCHAR)]) AS expected,
  unnest([CAST(m.n AS VARCHAR), CAST(m.first_day AS VARCHAR), CAST(m.top AS VARCHAR)]) AS actual FROM m LEFT JOIN e USING (kind)
QUALIFY expected IS DISTINCT FROM actual""".replace("QUALIFY expected IS DISTINCT FROM actual", "").replace("SELECT m.kind, unnest", "SELECT * FROM (SELECT m.kind, unnest") + ") WHERE expected IS DISTINCT FROM actual")
def manifest_field_compare(spark, sf):
    actual = M.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max("o_custkey").alias("top")
    )
    kind = F.col("kind")
    expected = actual.where(~kind.startswith("5")).select(
        "kind",
        F.when(kind.startswith("1"), F.col("n") + 1).otherwise(F.col("n")).alias("n"),
        F.when(~kind.startswith("2"), F.col("first_day")).alias("first_day"),
        "top",
    )
    return present(I.compare_fields(expected, actual, "kind", ["n", "first_day", "top"]))


@q("symbol_id_map", with_views("""
SELECT 'only_in_bars' AS "check", security_id FROM (SELECT DISTINCT security_id FROM v_bars) b WHERE security_id NOT IN (SELECT 'S' || c_custkey FROM customer WHERE c_custkey % 9 <> 0)
UNION ALL SELECT 'only_in_master', 'S' || c_custkey FROM customer WHERE c_custkey % 9 <> 0 AND 'S' || c_custkey NOT IN (SELECT security_id FROM v_bars)"""))
def symbol_id_map(spark, sf):
    master = M.table(spark, sf, "customer").where("c_custkey % 9 <> 0")
    master = master.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("security_id"))
    return present(I.cover_differences(B.bar_manifest(M.bars(spark, sf)), master, "security_id", "bars", "master"))


@q("unique_resolution", """
SELECT symbol, count(id) AS matches, CASE WHEN count(id) = 0 THEN 'unresolved' WHEN min(id) = max(id) THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN min(id) = max(id) THEN min(id) END AS id
FROM (SELECT upper(trim(replace(p_name, ' ', '-'))) || '/' || p_size AS symbol, CASE WHEN p_type IN ('ECONOMY', 'PROMO') AND regexp_matches(p_brand, '^Brand#[0-9]{1,2}$') AND p_retailprice > 950 THEN p_partkey END AS id FROM part) GROUP BY 1""")
def unique_resolution(spark, sf):
    eligible = F.col("p_type").isin("ECONOMY", "PROMO") & F.col("p_brand").rlike("^Brand#[0-9]{1,2}$") & (F.col("p_retailprice") > 950)
    symbol = F.concat(F.upper(F.trim(F.replace("p_name", F.lit(" "), F.lit("-")))), F.lit("/"), F.col("p_size").cast("string"))
    rows = M.table(spark, sf, "part").select(symbol.alias("symbol"), F.when(eligible, F.col("p_partkey")).alias("id"))
    return present(I.resolve_unique(rows, "symbol", "id"))


@q("referential_checks", with_views("""
SELECT 'trade_without_candidate' AS "check", candidate_id FROM v_trades WHERE quantity % 10 = 7 AND signal_session < DATE '1995-06-30'
UNION ALL SELECT 'geometry_without_order', candidate_id FROM v_cand WHERE quantity % 10 = 7 AND signal_session < DATE '1995-06-30' AND reason = 'portfolio_cap'"""))
def referential_checks(spark, sf):
    cand = M.candidates(spark, sf)
    kept = cand.where("NOT (quantity % 10 = 7 AND signal_session < DATE '1995-06-30')").select("candidate_id")
    trades = cand.where("status = 'filled'").select("candidate_id")
    geometry = cand.where("reason = 'portfolio_cap'").select("candidate_id")
    return present(
        I.missing_references(trades, kept, "candidate_id", "trade_without_candidate").unionByName(
            I.missing_references(geometry, kept, "candidate_id", "geometry_without_order")
        )
    )


_CHAIN = """
SELECT *, CASE WHEN seq % 101 = 0 THEN 'x' || h WHEN seq % 89 = 0 AND sequence > 1 THEN NULL ELSE p END AS previous_hash, CASE WHEN seq % 97 = 0 THEN sha256('tampered') ELSE h END AS event_hash
FROM (SELECT *, lag(h) OVER (PARTITION BY entry_id ORDER BY seq) AS p, row_number() OVER (PARTITION BY entry_id ORDER BY seq) AS sequence
      FROM (SELECT entry_id, seq, status, amount_c, sha256('{"amount":' || amount_c || ',"entry":' || entry_id || ',"seq":' || seq || ',"status":"' || status || '"}') AS h FROM v_ledger))"""


@q("chain_verify", with_views("""
SELECT entry_id, sequence, problem FROM (SELECT e.entry_id, e.sequence, unnest([CASE WHEN e.sequence > 1 AND b.event_hash IS NULL THEN 'gap_before' END,
   CASE WHEN e.sequence = 1 AND e.previous_hash IS NOT NULL THEN 'first_has_previous' END,
   CASE WHEN b.event_hash IS NOT NULL AND e.previous_hash IS DISTINCT FROM b.event_hash THEN 'previous_mismatch' END,
   CASE WHEN e.event_hash <> e.h THEN 'hash_mismatch' END]) AS problem
 FROM v_broken e LEFT JOIN v_broken b ON b.entry_id = e.entry_id AND b.sequence = e.sequence - 1) WHERE problem IS NOT NULL""",
   v_chain=_CHAIN, v_broken="SELECT * FROM v_chain WHERE seq % 83 <> 0"))
def chain_verify(spark, sf):
    body = canonical_json(amount=F.col("amount_c"), entry=F.col("entry_id"), seq=F.col("seq"), status=F.col("status"))
    rows = M.ledger(spark, sf).select("entry_id", "seq", "status", "amount_c").withColumn("h", F.sha2(body, 256))
    chain = bucketed_running(
        rows, ["entry_id"], [F.col("seq")], F.floor(F.col("seq") / 65536), {"sequence": F.lit(1).cast("long")}
    )
    before = chain.select("entry_id", (F.col("sequence") + 1).alias("sequence"), F.col("h").alias("p"))
    chain = chain.join(before, ["entry_id", "sequence"], "left")
    seq = F.col("seq")
    broken = (
        chain.withColumn(
            "previous_hash",
            F.when(seq % 101 == 0, F.concat(F.lit("x"), F.col("h"))).when(~((seq % 89 == 0) & (F.col("sequence") > 1)), F.col("p")),
        )
        .withColumn("event_hash", F.when(seq % 97 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("h")))
        .where(seq % 83 != 0)
        .drop("h", "p")
    )
    return present(I.chain_violations(broken, "entry_id", F.sha2(body, 256)))


@q("record_counts", with_views("""
SELECT 'candidates' AS kind, count(*) AS records FROM v_cand UNION ALL SELECT 'orders', count(*) FROM v_cand WHERE status = 'filled'
UNION ALL SELECT 'bars', count(*) FROM v_bars UNION ALL SELECT 'ledger', count(*) FROM events"""))
def record_counts(spark, sf):
    return present(
        I.record_counts(
            candidates=M.candidates(spark, sf), orders=M.trades(spark, sf), bars=M.bars(spark, sf), ledger=M.ledger(spark, sf)
        )
    )


@q("snapshot_complete", with_views("""
SELECT count(*) FILTER (WHERE o.security_id IS NULL) AS missing, count(*) FILTER (WHERE r.security_id IS NULL) AS extra,
  count(*) FILTER (WHERE o.last_session <> DATE '2001-11-02') AS stale, false AS complete
FROM (SELECT 'S' || s_suppkey AS security_id FROM supplier WHERE s_suppkey % 17 <> 5) r FULL JOIN (SELECT * FROM v_obs WHERE security_id NOT LIKE '%4') o USING (security_id)""", v_obs=_OBS))
def snapshot_complete(spark, sf):
    roster = M.table(spark, sf, "supplier").where("s_suppkey % 17 <> 5")
    roster = roster.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("security_id"))
    observed = B.bar_manifest(M.bars(spark, sf)).where(~F.col("security_id").endswith("4"))
    return present(I.snapshot_complete(roster, observed, F.to_date(F.lit("2001-11-02"))))
