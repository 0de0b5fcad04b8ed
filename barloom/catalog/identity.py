"""Canonical identities, text forms and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.functions import canonical as K, dates as D, names as N, numbers as U
from barloom.sources import market_views as M

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_DEC = "CASE WHEN x = 0 THEN '0' WHEN CAST(x AS VARCHAR) LIKE '%.%' THEN rtrim(rtrim(CAST(x AS VARCHAR), '0'), '.') ELSE CAST(x AS VARCHAR) END"


@q("canonical_decimals", with_views(f"""
SELECT c_custkey, {_DEC} AS text FROM (SELECT c_custkey, CAST(CAST(round(c_acctbal * 100) AS BIGINT) - CAST(round(c_acctbal * 100) AS BIGINT) % (1 + c_custkey % 3 * 99) AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS x FROM customer)"""))
def canonical_decimals(spark, sf):
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    value = (cents - cents % (1 + F.col("c_custkey") % 3 * 99)).cast("decimal(14,0)") * F.lit(0.01).cast("decimal(3,2)")
    rows = M.table(spark, sf, "customer").select("c_custkey", value.alias("x"))
    return present(rows.select("c_custkey", K.decimal_string(F.col("x")).alias("text")))


@q("canonical_identity", with_views("""
SELECT candidate_id, sha256('{"domain":"barloom/candidate/v1","payload":{"entry_session":"' || CAST(entry_session AS VARCHAR) || '","price":"' ||
  rtrim(rtrim(CAST(entry_price AS VARCHAR), '0'), '.') || '","reason":' || CASE WHEN reason = 'filled' THEN 'null' ELSE '"' || reason || '"' END ||
  ',"security_id":"' || security_id || '"}}') AS identity FROM v_cand"""))
def canonical_identity(spark, sf):
    rows = M.candidates(spark, sf)
    identity = K.identity(
        "barloom/candidate/v1",
        security_id=F.col("security_id"),
        entry_session=F.col("entry_session"),
        price=K.decimal_string(F.col("entry_price")),
        reason=F.when(F.col("reason") != "filled", F.col("reason")),
    )
    return present(rows.select("candidate_id", identity.alias("identity")))


_CODE = "printf('\\u%04x', {})"
_ASCII = rf"""list_transform(string_split({{}}, ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\'
  WHEN c = chr(8) THEN '\b' WHEN c = chr(9) THEN '\t' WHEN c = chr(10) THEN '\n' WHEN c = chr(12) THEN '\f' WHEN c = chr(13) THEN '\r'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN {_CODE.format("unicode(c)")}
  ELSE {_CODE.format("55296 + (unicode(c) - 65536) // 1024")} || {_CODE.format("56320 + (unicode(c) - 65536) % 1024")} END)"""
_MARKS = ("Caf\u00e9 \u6771\u4eac", "\U0001d11e \U0001f600", "\x07\x1b\x7f", "tab\t back\\u001F \"quoted\"", "plain")


@q("canonical_text_identity", f"""
SELECT doc_id, sha256('{{"domain":"barloom/document/v1","payload":{{"mark":"' || array_to_string({_ASCII.format("mark")}, '') || '","source":' ||
  coalesce('"' || array_to_string({_ASCII.format("source")}, '') || '"', 'null') || ',"text":' ||
  coalesce('"' || array_to_string({_ASCII.format("text")}, '') || '"', 'null') || '}}}}') AS identity
FROM (SELECT *, list_extract([{", ".join(" || ".join(f"chr({ord(c)})" for c in m) for m in _MARKS)}], CAST(doc_id % 5 AS INTEGER) + 1) AS mark FROM documents)""")
def canonical_text_identity(spark, sf):
    """Identities over whole texts, each with one of five marks of characters that canonical text must escape."""
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("doc_id") % 5).cast("int") + 1)
    identity = K.identity("barloom/document/v1", mark=mark, source=F.col("source"), text=F.col("text"))
    return present(M.table(spark, sf, "documents").select("doc_id", identity.alias("identity")))


@q("hash_and_id_checks", """
SELECT doc_id, sha256(text) AS content_sha256, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN upper(sha256(text)) ELSE sha256(text) END, '^[0-9a-f]{64}$') AS valid,
  substr(sha256(text), 1, 12) AS prefix FROM documents""")
def hash_and_id_checks(spark, sf):
    sha = F.sha2(F.col("text"), 256)
    claimed = F.when(F.col("doc_id") % 5 == 0, F.upper(sha)).otherwise(sha)
    return present(
        M.table(spark, sf, "documents").select(
            "doc_id", sha.alias("content_sha256"), K.is_sha256(claimed).alias("valid"), F.substring(sha, 1, 12).alias("prefix")
        )
    )


@q("ticker_forms", """
SELECT p_partkey, symbol, replace(symbol, '-', '/') AS slash_form, CASE WHEN symbol LIKE '%-%' THEN split_part(symbol, '-', 1) || lower(substr(symbol, strpos(symbol, '-') + 1)) ELSE symbol END AS search_form,
  upper(regexp_replace(symbol, '[-./]', '', 'g')) AS symbol_key FROM (
  SELECT p_partkey, CASE WHEN regexp_matches(upper(trim(raw)), '\\s') THEN NULL ELSE upper(trim(raw)) END AS symbol FROM (
    SELECT p_partkey, ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '-') || CASE WHEN p_partkey % 4 = 0 THEN '.x/y' ELSE '' END END || ' ' AS raw FROM part))""")
def ticker_forms(spark, sf):
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, ".x/y").otherwise("")
    raw = F.concat(
        F.lit(" "),
        F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), suffix)),
        F.lit(" "),
    )
    rows = M.table(spark, sf, "part").select("p_partkey", N.clean_symbol(raw).alias("symbol"))
    s = F.col("symbol")
    return present(
        rows.select(
            "p_partkey", "symbol", N.slash_class(s).alias("slash_form"), N.search_class(s).alias("search_form"),
            N.symbol_key(s).alias("symbol_key"),
        )
    )


@q("display_names", """
SELECT name, replace(replace(name, 'monthly-ema6-', 'M6-'), 'weekly-ema13-', 'W13-') AS short_name, n FROM (
  SELECT CASE WHEN p_size % 2 = 0 THEN 'monthly-ema6-above' ELSE 'weekly-ema13-below' END || '__' || lower(p_type) || '__size' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS name, count(*) AS n FROM part GROUP BY 1)""")
def display_names(spark, sf):
    context = F.when(F.col("p_size") % 2 == 0, "monthly-ema6-above").otherwise("weekly-ema13-below")
    name = N.slug(context, F.lower("p_type"), F.format_string("size%02d", "p_size"))
    rows = M.table(spark, sf, "part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return present(rows.withColumn("short_name", N.short_strategy_name(F.col("name"))))


@q("safe_ratios", """
SELECT o_orderkey, round(CAST(a AS DOUBLE) / nullif(b, 0), 8) AS ratio, round(coalesce(CAST(a AS DOUBLE) / nullif(b, 0), 0), 8) AS ratio_zero,
  CAST(round(CAST(a AS DOUBLE) / nullif(b, 0) * 10000) AS BIGINT) AS bp, CAST(try_cast(t AS DECIMAL(28,6)) AS DOUBLE) AS amount
FROM (SELECT o_orderkey, o_orderkey % 101 AS a, o_custkey % 7 AS b, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) || '.25' END AS t FROM orders)""")
def safe_ratios(spark, sf):
    rows = M.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 101).alias("a"), (F.col("o_custkey") % 7).alias("b"),
        F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".25"))).alias("t"),
    )
    ratio = U.ratio_or_null(F.col("a"), F.col("b"))
    return present(
        rows.select(
            "o_orderkey", ratio.alias("ratio"), U.ratio_or_zero(F.col("a"), F.col("b")).alias("ratio_zero"),
            U.basis_points(ratio).alias("bp"), U.lenient_decimal("t").alias("amount"),
        ),
        8, amount=6,
    )


@q("period_keys", with_views("""
SELECT CAST(session AS VARCHAR) AS session, CAST(week_end AS VARCHAR) AS week_end, CAST(month AS VARCHAR) AS month, strftime(session, '%Y-%m') AS month_key,
  year(session) AS year, CASE WHEN day(session) % 7 = 0 THEN NULL ELSE CAST(session AS VARCHAR) END AS parsed FROM v_calendar"""))
def period_keys(spark, sf):
    s = F.col("session")
    text = F.when(F.day("session") % 7 == 0, "2024-13-45").otherwise(s.cast("string"))
    return present(
        M.calendar(spark, sf).select(
            "session", D.week_end(s).alias("week_end"), D.month_start(s).alias("month"), D.month_key(s).alias("month_key"),
            F.year(s).alias("year"), D.lenient_date(text).alias("parsed"),
        )
    )


@q("numeric_projection", """
SELECT o_orderkey, try_cast(t AS DOUBLE) AS amount, s AS status FROM (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'x'
  ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS t FROM orders)""")
def numeric_projection(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 1, "x").when(k % 10 != 0, F.concat(k.cast("string"), F.lit(".5")))
    rows = M.table(spark, sf, "orders").select("o_orderkey", text.alias("amount"), F.col("o_orderstatus").alias("status"))
    return present(U.numeric_projection(rows, ["amount"]))
