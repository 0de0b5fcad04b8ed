"""Rosters, masters, coverage, record sinks and trade payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.operators import bars as B, instruments as IN, masters as MS
from barloom.session import work_dir
from barloom.sources import json_lines as J, market_views as M, sinks

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_SYMBOL = "CASE WHEN p_partkey % 50 = 7 THEN p_name ELSE upper(replace(p_name, ' ', '-')) || '-' || p_partkey END"


def _symbols(spark, sf):
    plain = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), F.col("p_partkey").cast("string"))
    symbol = F.when(F.col("p_partkey") % 50 == 7, F.col("p_name")).otherwise(plain)
    return M.table(spark, sf, "part").select(symbol.alias("symbol"), "p_partkey")


@q("roster_check", f"""
SELECT symbol, CASE WHEN n > 1 THEN 'duplicate' ELSE 'not_canonical' END AS problem FROM (SELECT symbol, count(*) AS n FROM (SELECT {_SYMBOL} AS symbol FROM part) GROUP BY 1)
WHERE n > 1 OR symbol <> upper(trim(symbol)) UNION ALL SELECT NULL, 'count_mismatch'""")
def roster_check(spark, sf):
    declared = F.count(F.lit(1)) + 1
    return present(MS.roster_violations(_symbols(spark, sf), "symbol", declared))


@q("fill_plan", """
SELECT name, pos FROM (SELECT p_name || '-' || p_size AS name, min(p_partkey) AS pos FROM part GROUP BY 1)
WHERE name NOT IN (SELECT p_name || '-' || p_size FROM part WHERE p_type = 'PROMO') ORDER BY pos, name LIMIT 100""")
def fill_plan(spark, sf):
    name = F.concat(F.col("p_name"), F.lit("-"), F.col("p_size").cast("string"))
    pool = M.table(spark, sf, "part").select(name.alias("name"), F.col("p_partkey").alias("pos"), "p_type")
    return present(MS.fill_plan(pool.drop("p_type"), pool.where("p_type = 'PROMO'"), "name", "pos", 100))


_RESP = """SELECT 'S' || c_custkey AS symbol, CASE WHEN c_custkey % 11 = 0 THEN 'S' || c_custkey WHEN c_custkey % 7 = 0 THEN 'BBG' || (c_custkey - 1) ELSE 'BBG' || c_custkey END AS permanent_id FROM customer WHERE c_custkey % 13 <> 5
UNION ALL SELECT 'S' || c_custkey, 'BBX' || c_custkey FROM customer WHERE c_custkey % 17 = 3"""


@q("security_master", with_views("""
SELECT symbol, permanent_id, CAST(first_session AS VARCHAR) AS start, '1995-02-01' AS end_exclusive,
  CASE WHEN n IS NULL THEN 'unresolved' WHEN permanent_id IS NULL THEN 'ambiguous' WHEN uses > 1 THEN 'shared_id' WHEN permanent_id = symbol THEN 'id_is_ticker'
       WHEN first_session >= DATE '1995-02-01' THEN 'empty_interval' END AS problem
FROM (SELECT security_id AS symbol, min(session) AS first_session FROM v_bars GROUP BY 1) m LEFT JOIN v_res r USING (symbol)
LEFT JOIN (SELECT permanent_id, count(*) AS uses FROM v_res WHERE permanent_id IS NOT NULL GROUP BY 1) u USING (permanent_id)""",
   v_res="SELECT symbol, count(*) AS n, CASE WHEN min(permanent_id) = max(permanent_id) THEN min(permanent_id) END AS permanent_id FROM v_resp GROUP BY 1", v_resp=_RESP))
def security_master(spark, sf):
    k = F.col("c_custkey")
    sid = F.concat(F.lit("S"), k.cast("string"))
    customers = M.table(spark, sf, "customer")
    found = F.when(k % 11 == 0, sid).when(k % 7 == 0, F.concat(F.lit("BBG"), (k - 1).cast("string")))
    first = customers.where(k % 13 != 5).select(
        sid.alias("symbol"), found.otherwise(F.concat(F.lit("BBG"), k.cast("string"))).alias("permanent_id")
    )
    second = customers.where(k % 17 == 3).select(
        sid.alias("symbol"), F.concat(F.lit("BBX"), k.cast("string")).alias("permanent_id")
    )
    manifest = B.bar_manifest(M.bars(spark, sf)).select(F.col("security_id").alias("symbol"), "first_session")
    return present(MS.security_master(first.unionByName(second), manifest, F.to_date(F.lit("1995-02-01"))))


@q("constant_coverage", with_views("""
SELECT DISTINCT security_id, '1995-03-01' AS coverage_start, '2001-11-03' AS coverage_end FROM v_bars"""))
def constant_coverage(spark, sf):
    day = lambda t: F.to_date(F.lit(t))
    return present(MS.constant_coverage(M.bars(spark, sf), day("1995-03-01"), day("2001-11-03")))


@q("trade_payload", with_views("""
SELECT candidate_id, CAST(signal_session AS VARCHAR) AS signal_session, '{"price":"' || CAST(quantity AS VARCHAR) || '","size":"' || CAST(quantity * 2 AS VARCHAR) || '"}' AS facts,
 CASE WHEN quantity % 2 = 0 THEN CAST(entry_price - 1 AS DOUBLE) END AS stop, CASE WHEN quantity % 2 = 0 THEN CAST(entry_price + 2 AS DOUBLE) END AS target FROM v_trades"""))
def trade_payload(spark, sf):
    cand = M.candidates(spark, sf)
    q_ = F.col("quantity")

    def fact(name, value):
        return F.lit(name), F.struct(value.alias("value"), F.col("signal_session").alias("available_session"))

    facts = F.create_map(*fact("price", q_), *fact("size", q_ * 2))
    told = cand.select("candidate_id", "signal_session", facts.alias("signal_facts"))
    levels = cand.where(q_ % 2 == 0).select(
        "candidate_id", (F.col("entry_price") - 1).alias("stop"), (F.col("entry_price") + 2).alias("target")
    )
    trades = cand.where("status = 'filled'").select("candidate_id")
    return present(MS.trade_payload(trades, told, levels).withColumn("facts", F.to_json("facts")))


@q("record_sinks", with_views("""
SELECT 'orders' AS kind, count(*) AS records, CAST(sum(quantity) AS BIGINT) AS quantity FROM v_cand UNION ALL
SELECT 'trades', count(*), CAST(sum(quantity) AS BIGINT) FROM v_trades"""))
def record_sinks(spark, sf):
    """Write one JSON-lines table per kind and read both back strictly."""
    path = work_dir(spark, "records")
    orders = M.candidates(spark, sf).select("candidate_id", "strategy_id", "quantity", "status")
    sinks.write_records(path, orders=orders, trades=orders.where("status = 'filled'"))
    back = None
    for kind in ("orders", "trades"):
        rows = J.read_strict(spark, f"{path}/{kind}", orders.schema)
        one = rows.agg(F.count(F.lit(1)).alias("records"), F.sum("quantity").alias("quantity")).withColumn("kind", F.lit(kind))
        back = one if back is None else back.unionByName(one)
    return present(back)


_ASKED = "upper(replace(p_name, ' ', '-')) || p_size % 5"
_RESOLVED = """
SELECT symbol, status, matches, rejected, CASE WHEN status = 'resolved' THEN one END AS id, CASE WHEN status = 'resolved' THEN trim(last_name) END AS name
FROM (SELECT *, CASE WHEN matches = 0 THEN 'unresolved' WHEN blank THEN 'incomplete' WHEN matches > 1 THEN 'ambiguous' ELSE 'resolved' END AS status
  FROM (SELECT symbol, count(DISTINCT id) FILTER (WHERE fits) AS matches, count(*) FILTER (WHERE NOT fits AND asked) AS rejected, min(id) FILTER (WHERE fits) AS one,
    coalesce(bool_or(trim(name) = '') FILTER (WHERE fits), false) AS blank, last(name ORDER BY p_partkey) FILTER (WHERE fits) AS last_name FROM v_answers GROUP BY 1))"""


def _answers(spark, sf):
    """Parts as a vendor's answers: several for each asked symbol, of which some fit."""
    asked = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), (F.col("p_size") % 5).cast("string"))
    name = F.when(F.col("p_partkey") % 37 == 5, " ").otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    return M.table(spark, sf, "part").withColumn("symbol", asked).withColumn("name", name)


def _roster(rows, spark):
    return rows.select("symbol").union(spark.range(1).select(F.lit(" unlisted-1 ")))


def _share_class(offset):
    k = (F.floor(F.col("p_partkey") / 2) + offset).cast("string")
    return F.concat(F.lit("BBG"), F.lpad(k, 9, "0"))


@q("mapped_instruments", with_views(_RESOLVED, v_answers=f"""
SELECT *, coalesce(p_partkey % 7 <> 3 AND p_partkey % 5 <> 1 AND p_type IN ('ECONOMY', 'PROMO') AND p_partkey % 11 <> 4 AND p_partkey % 13 <> 6, false) AS fits, true AS asked
FROM (SELECT p_partkey, p_type, {_ASKED} AS symbol, 'BBG' || lpad(CAST(p_partkey // 2 AS VARCHAR), 9, '0') AS id,
        CASE WHEN p_partkey % 37 = 5 THEN ' ' ELSE ' ' || p_brand END AS name FROM part)
UNION ALL SELECT NULL, NULL, 'UNLISTED-1', NULL, NULL, false, false"""))
def mapped_instruments(spark, sf):
    """Symbols against mapping rows: asked ticker, US, allowed types, well-formed identifiers; wrong ones planted in each."""
    k = F.col("p_partkey")
    rows = _answers(spark, sf).select(
        "symbol", "name", "p_partkey",
        F.when(k % 7 == 3, F.lower("symbol")).otherwise(F.replace("symbol", F.lit("-"), F.lit("/"))).alias("ticker"),
        F.when(k % 5 == 1, "LN").otherwise("US").alias("exchange_code"),
        F.when(F.col("p_type") == "ECONOMY", "Common Stock").when(F.col("p_type") == "PROMO", "REIT").otherwise("Warrant").alias("security_type_2"),
        F.when(k % 11 == 4, F.lower(_share_class(0))).otherwise(_share_class(0)).alias("share_class_id"),
        F.when(k % 13 == 6, F.concat(_share_class(7), F.lit("0"))).otherwise(_share_class(7)).alias("composite_id"),
    )
    found = IN.resolve_instruments(_roster(rows, spark), rows, IN.is_mapped_listing(), "share_class_id", ["name"], "p_partkey")
    return present(found.withColumnRenamed("share_class_id", "id"))


@q("searched_instruments", with_views(_RESOLVED, v_answers=f"""
SELECT *, coalesce(p_partkey % 7 <> 3 AND p_partkey % 5 <> 1 AND p_partkey % 3 <> 2 AND p_type IN ('ECONOMY', 'PROMO', 'SMALL'), false) AS fits, true AS asked
FROM (SELECT p_partkey, p_type, {_ASKED} AS symbol, p_partkey // 2 AS id, CASE WHEN p_partkey % 37 = 5 THEN ' ' ELSE ' ' || p_brand END AS name FROM part)
UNION ALL SELECT NULL, NULL, 'UNLISTED-1', NULL, NULL, false, false"""))
def searched_instruments(spark, sf):
    """Symbols against search hits: separators aside, US flag in any case, known exchanges, stocks and funds."""
    k = F.col("p_partkey")
    rows = _answers(spark, sf).select(
        "symbol", "name", "p_partkey", F.floor(k / 2).cast("bigint").alias("instrument_id"),
        F.when(k % 7 == 3, F.concat("symbol", F.lit("X"))).otherwise(F.lower(F.replace("symbol", F.lit("-"), F.lit(".")))).alias("quote_symbol"),
        F.when(k % 5 == 1, "UK").otherwise("usa").alias("flag"),
        F.when(k % 3 == 2, "LSE").when(k % 3 == 1, "nyse arca").otherwise("NASDAQ").alias("exchange"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "Stock - NYSE").when(F.col("p_type") == "SMALL", "ETF - NYSE").otherwise("Index").alias("quote_type"),
    )
    found = IN.resolve_instruments(_roster(rows, spark), rows, IN.is_searched_listing(), "instrument_id", ["name"], "p_partkey")
    return present(found.withColumnRenamed("instrument_id", "id"))
