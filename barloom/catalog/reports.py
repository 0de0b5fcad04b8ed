"""Read models, documents, stores and files."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from barloom.catalog import rankings as RK
from barloom.catalog.common import present
from barloom.catalog.views_sql import _roll, with_views
from barloom.operators import quality as Y, reports as P, signals as SG
from barloom.operators.feature_state import FeatureStore
from barloom.plans import study
from barloom.session import persist_table, work_dir
from barloom.sources import files as FI, json_lines as J, market_views as M, sinks

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_EX = """SELECT strategy_id, 'win' AS kind, w IS NULL AS fallback, coalesce(w, l) AS candidate_id FROM v_bw
UNION ALL SELECT strategy_id, 'loss', l IS NULL, coalesce(l, w) FROM v_bw"""
_BW = """SELECT strategy_id, first(candidate_id ORDER BY gross_pnl DESC, candidate_id DESC) FILTER (WHERE gross_pnl > 0) AS w,
 first(candidate_id ORDER BY gross_pnl, candidate_id) FILTER (WHERE gross_pnl < 0) AS l FROM v_some GROUP BY 1"""
_SOME = "SELECT * FROM v_trades WHERE NOT (strategy_id = 'Brand#2' AND gross_pnl > 0) AND NOT (strategy_id = 'Brand#4' AND gross_pnl < 0)"


def _some_trades(spark, sf):
    return M.trades(spark, sf).where(
        "NOT (strategy_id = 'Brand#2' AND gross_pnl > 0) AND NOT (strategy_id = 'Brand#4' AND gross_pnl < 0)"
    )


@q("trade_examples", with_views("""
SELECT e.strategy_id, e.kind, e.fallback, e.candidate_id, t.security_id, CAST(t.entry_session AS VARCHAR) AS entry_session, t.exit_reason, CAST(t.gross_pnl AS DOUBLE) AS gross_pnl
FROM v_ex e JOIN v_some t USING (candidate_id)""", v_ex=_EX, v_bw=_BW, v_some=_SOME))
def trade_examples(spark, sf):
    return present(
        P.trade_examples(_some_trades(spark, sf)).select(
            "strategy_id", "kind", "fallback", "candidate_id", "security_id", "entry_session", "exit_reason", "gross_pnl"
        )
    )


@q("trade_window_bars", with_views("""
SELECT e.strategy_id, e.kind, e.candidate_id, CAST(b.session AS VARCHAR) AS session, b.close, round(e5.y, 6) AS ema5
FROM v_ex e JOIN v_some t USING (candidate_id)
JOIN (SELECT security_id, max(rn) AS n FROM v_daily_rn GROUP BY 1) m ON m.security_id = t.security_id
JOIN v_daily_rn b ON b.security_id = t.security_id
 AND b.rn >= (SELECT count(*) FROM v_daily_rn x WHERE x.security_id = t.security_id AND x.session < t.entry_session) + 1 - 8
 AND b.rn <= (SELECT count(*) FROM v_daily_rn x WHERE x.security_id = t.security_id AND x.session <= t.exit_session) + 8
JOIN v_ema5 e5 ON e5.security_id = b.security_id AND e5.rn = b.rn
WHERE (SELECT count(*) FROM v_daily_rn x WHERE x.security_id = t.security_id AND x.session < t.entry_session) + 1 <= m.n""", recursive=True, v_ex=_EX, v_bw=_BW, v_some=_SOME))
def trade_window_bars(spark, sf):
    examples = P.trade_examples(_some_trades(spark, sf)).select(
        "strategy_id", "kind", "candidate_id", "security_id", "entry_session", "exit_session"
    )
    bars = P.indicator_overlay(M.bars(spark, sf)).select("security_id", "session", "close", "ema5")
    return present(
        P.trade_windows(examples, bars).select("strategy_id", "kind", "candidate_id", "session", "close", "ema5"), ema5=6
    )


@q("win_loss_counts", with_views("""
SELECT strategy_id, count(*) FILTER (WHERE gross_pnl > 0) AS wins, count(*) FILTER (WHERE gross_pnl < 0) AS losses, count(*) FILTER (WHERE gross_pnl = 0) AS flats FROM v_trades GROUP BY 1"""))
def win_loss_counts(spark, sf):
    return present(P.win_loss_counts(M.trades(spark, sf)))


@q("indicator_overlay", with_views(f"""
SELECT b.security_id, CAST(b.session AS VARCHAR) AS session, round(e.y, 6) AS ema5, round({_roll('avg', 'close', 10)}, 6) AS sma10, {_roll('min', 'low', 10)} AS low10,
 {_roll('min', 'low', 20)} AS low20, {_roll('max', 'high', 20)} AS high20
FROM v_daily_rn b JOIN v_ema5 e USING (security_id, rn, session)""", recursive=True))
def indicator_overlay(spark, sf):
    return present(
        P.indicator_overlay(M.bars(spark, sf)).select("security_id", "session", "ema5", "sma10", "low10", "low20", "high20"), 6
    )


@q("ranked_entries", with_views("""
SELECT kind, axis, place AS rank, identity, upper(strategy_id) AS name FROM v_axis WHERE place <= 7"""))
def ranked_entries(spark, sf):
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_rank").alias("place")) for a in ("profit", "drawdown", "ratio")])
    places = RK._ranked(spark, sf).select("kind", "identity", F.inline(axes))
    lists = places.groupBy("kind", "axis").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "identity"))), lambda r: r["identity"]).alias("entries")
    )
    names = M.strategies(spark, sf).select(F.sha2("strategy_id", 256).alias("identity"), F.upper("strategy_id").alias("name"))
    return present(P.ranked_entries(lists, "entries", names, "identity", 7))


_DOC = """'{"id":' || o_orderkey || ',"note":null,"tags":["a","' || o_orderstatus || '",' || o_orderkey % 7 || '],"deep":{"x":{"y":{"z":{"lost":1},"kept":"' || o_orderpriority || '"}}},"items":[{"p":' || o_custkey || '},{"p":' || (o_custkey + 1) || ',"q":true}]}'"""


@q("nested_scalars", """
SELECT o_orderkey, path, value FROM (SELECT o_orderkey, unnest(['id', 'tags', 'deep.x.y.kept', 'deep.x.y.z', 'items[0].p', 'items[1].p', 'items[1].q']) AS path,
 unnest([CAST(o_orderkey AS VARCHAR), 'a, ' || o_orderstatus || ', ' || o_orderkey % 7, o_orderpriority, '{"lost":1}', CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR), 'true']) AS value FROM orders)""")
def nested_scalars(spark, sf):
    doc = F.expr(_DOC.replace("o_orderkey % 7", "(o_orderkey % 7)"))
    docs = M.table(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))
    return present(P.scalar_rows(docs, "o_orderkey", "doc"))


@q("json_inline_rows", """
SELECT o_orderkey, unnest([1, 2]) AS part, unnest([o_custkey, o_custkey * 2]) AS amount FROM orders""")
def json_inline_rows(spark, sf):
    doc = F.expr("""concat('{"rows":[{"part":1,"amount":', o_custkey, '},{"part":2,"amount":', o_custkey * 2, '}]}')""")
    docs = M.table(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))
    return present(J.inline_rows(docs, "doc", "struct<part:bigint,amount:bigint>"))


@q("flattened_batches", """
SELECT o_orderkey, CAST(b AS BIGINT) AS batch, CAST(p AS BIGINT) AS position, v AS id FROM (
 SELECT o_orderkey, unnest([0, 0, 1]) AS b, unnest([0, 1, 0]) AS p, unnest([o_custkey, o_custkey + 1, o_custkey + 2]) AS v FROM orders)""")
def flattened_batches(spark, sf):
    doc = F.expr("""concat('[[{"id":', o_custkey, '},{"id":', o_custkey + 1, '}],[{"id":', o_custkey + 2, '}]]')""")
    docs = M.table(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))
    return present(J.flatten_batches(docs, "doc", "struct<id:bigint>"))


@q("tolerant_json_lines", """
SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 9 NOT IN (0, 1, 2)""")
def tolerant_json_lines(spark, sf):
    k = F.col("event_id") % 9
    line = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("x"), "props")).when(k == 2, F.concat(F.lit("["), "props", F.lit("]")))
    lines = M.table(spark, sf, "events").select("event_id", line.otherwise(F.col("props")).alias("line"))
    return present(J.parse_tolerant(lines, "line", T.StructType([T.StructField("k", T.LongType())])))


@q("bounds_coalesce", """
SELECT o_orderkey, CASE WHEN ms <> '' AND me <> '' THEN ms WHEN coalesce(nullif(ms, ''), nullif(ss, '')) IS NOT NULL THEN coalesce(nullif(ms, ''), nullif(ss, '')) ELSE nullif(ps, '') END AS evidence_start,
 CASE WHEN ms <> '' AND me <> '' THEN me WHEN coalesce(nullif(ms, ''), nullif(ss, '')) IS NOT NULL THEN coalesce(nullif(me, ''), nullif(se, '')) ELSE coalesce(nullif(me, ''), nullif(se, ''), nullif(pe, '')) END AS evidence_end,
 CASE WHEN ms <> '' AND me <> '' THEN nullif(mo, '') ELSE coalesce(nullif(mo, ''), nullif(so, '')) END AS outcome_end
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_custkey ELSE '' END AS ms, CASE WHEN o_orderkey % 3 = 0 THEN 'me' ELSE '' END AS me, CASE WHEN o_orderkey % 5 = 0 THEN 'mo' ELSE '' END AS mo,
  CASE WHEN o_orderkey % 7 < 3 THEN 'ss' END AS ss, CASE WHEN o_orderkey % 7 < 4 THEN 'se' END AS se, 'so' AS so, CASE WHEN o_orderkey % 11 < 6 THEN 'ps' ELSE '' END AS ps, 'pe' AS pe FROM orders)""")
def bounds_coalesce(spark, sf):
    k = F.col("o_orderkey")
    docs = M.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 2 == 0, F.concat(F.lit("m"), F.col("o_custkey").cast("string"))).otherwise("").alias("m_start"),
        F.when(k % 3 == 0, "me").otherwise("").alias("m_end"), F.when(k % 5 == 0, "mo").otherwise("").alias("m_outcome"),
        F.when(k % 7 < 3, "ss").alias("s_start"), F.when(k % 7 < 4, "se").alias("s_end"), F.lit("so").alias("s_outcome"),
        F.when(k % 11 < 6, "ps").otherwise("").alias("p_start"), F.lit("pe").alias("p_end"),
    )
    return present(P.window_bounds(docs).select("o_orderkey", "evidence_start", "evidence_end", "outcome_end"))


@q("bulky_fields_dropped", """
SELECT c_custkey, '{"profit":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',"rank":' || c_nationkey || '}' AS metrics FROM customer""")
def bulky_fields_dropped(spark, sf):
    metrics = F.struct(
        F.round(F.col("c_acctbal") * 100).cast("long").alias("profit"),
        F.col("c_nationkey").alias("rank"),
        F.array("c_name", "c_mktsegment").alias("signals"),
        F.array("c_custkey").alias("yearly"),
    )
    rows = M.table(spark, sf, "customer").select("c_custkey", metrics.alias("metrics"))
    return present(P.without_fields(rows, "metrics", ["signals", "yearly"]).withColumn("metrics", F.to_json("metrics")))


@q("name_index", """
SELECT s_suppkey AS identity, CASE WHEN s_suppkey % 3 = 0 THEN 'compact ' || s_suppkey ELSE s_name END AS name FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0""")
def name_index(spark, sf):
    s = M.table(spark, sf, "supplier").withColumn("identity", F.col("s_suppkey"))
    compact = s.where("s_suppkey % 3 = 0").select(
        "identity", F.concat(F.lit("compact "), F.col("s_suppkey").cast("string")).alias("name")
    )
    full = s.select("identity", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).otherwise("").alias("name"))
    return present(P.name_index(compact, full))


@q("name_arrays", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand], lambda x: x IS NOT NULL))), ',') AS facts,
 p_brand || ' ' || p_type AS description, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_brand || ',' || p_type END AS features FROM part""")
def name_arrays(spark, sf):
    even = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    facts = F.array_sort(F.array_distinct(F.array_compact(F.array("p_brand", even, "p_brand"))))
    features = F.array(
        F.struct(F.col("p_brand").alias("name")), F.struct(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("name"))
    )
    names = F.filter(F.transform(features, lambda f: f["name"]), lambda n: n != "")
    rules = F.array("p_brand", "p_type", "p_name")
    return present(
        M.table(spark, sf, "part").select(
            "p_partkey", F.array_join(facts, ",").alias("facts"), F.array_join(F.slice(rules, 1, 2), " ").alias("description"),
            F.array_join(names, ",").alias("features"),
        )
    )


@q("forward_signals", with_views("""
SELECT rule, security_id, CAST(entry_session AS VARCHAR) AS entry_session, round(daily_return20, 8) AS priority FROM v_signals WHERE signal_session = DATE '2001-06-29'""", recursive=True))
def forward_signals(spark, sf):
    """Signals of one completed session, computed from history through that session only."""
    day = F.to_date(F.lit("2001-06-29"))
    history = M.bars(spark, sf).where(F.col("session") <= day)
    signals = study.study_signals(history, M.calendar(spark, sf))
    one = SG.in_range(signals, day, F.date_add(day, 1))
    return present(one.select("rule", "security_id", "entry_session", F.col("daily_return20").alias("priority")), 8)


def _known_feat(frame, ema, n, period):
    """Completed periods with the session that shows them: their own last, or the next bar where the exchange went on."""
    return f"""
SELECT w.security_id, w.session AS {frame}_available, w.close AS {frame}_close, CASE WHEN w.rn >= {n} THEN e.y END AS {frame}_ema{n},
  CASE WHEN w.session >= k.last THEN w.session ELSE b.session END AS {frame}_known
FROM v_{frame}_rn w JOIN {ema} e ON e.security_id = w.security_id AND e.rn = w.rn JOIN v_calendar c ON c.session = w.session
JOIN (SELECT {period}, max(session) AS last FROM v_calendar GROUP BY 1) k ON k.{period} = c.{period}
ASOF LEFT JOIN v_bars b ON b.security_id = w.security_id AND w.session < b.session
QUALIFY row_number() OVER (PARTITION BY w.security_id, {frame}_known ORDER BY w.session DESC) = 1"""


_KNOWN_MATRIX = """
SELECT f.*, CASE WHEN f.rn >= 5 THEN e.y END AS daily_ema5, w.weekly_available, w.weekly_close, w.weekly_ema13,
       m.monthly_available, m.monthly_close, m.monthly_ema6
FROM v_feat f JOIN v_ema5 e ON e.security_id = f.security_id AND e.rn = f.rn
ASOF LEFT JOIN v_week_feat w ON w.security_id = f.security_id AND w.weekly_known <= f.session
ASOF LEFT JOIN v_month_feat m ON m.security_id = f.security_id AND m.monthly_known <= f.session"""


@q("signals_from_state", with_views("""
SELECT rule, security_id, CAST(signal_session AS VARCHAR) AS signal_session, CAST(entry_session AS VARCHAR) AS entry_session,
  CAST(weekly_available AS VARCHAR) AS weekly_available, CAST(monthly_available AS VARCHAR) AS monthly_available, round(adv20, 2) AS adv, round(daily_return20, 8) AS priority
FROM v_signals WHERE signal_session BETWEEN DATE '2001-05-29' AND DATE '2001-06-29'""", recursive=True, v_matrix=_KNOWN_MATRIX,
  v_week_feat=_known_feat("weekly", "v_wema13", 13, "week_end"), v_month_feat=_known_feat("monthly", "v_mema6", 6, "month")))
def signals_from_state(spark, sf):
    """Signals of each session of a month, each from the feature state the session before it left."""
    calendar = persist_table(M.calendar(spark, sf), "calendar")
    bars = persist_table(M.bars(spark, sf).where("session <= DATE '2001-06-29'"), "bars")
    store = FeatureStore(spark, work_dir(spark, "feature-state"), study.feature_state())
    days = [r.session for r in calendar.where("session BETWEEN DATE '2001-05-28' AND DATE '2001-06-29'").select("session").orderBy("session").collect()]
    store.take("2001-05-28", bars, calendar)
    # The sessions of the month read its bars only, not the whole history each.
    newer = persist_table(bars.where("session > DATE '2001-05-28'"), "bars")
    for day in days:
        if str(day) > "2001-05-28":
            store.take(day, newer, calendar)
    signals = study.session_signals(store.read_all().where("session > DATE '2001-05-28'"), calendar, F.col("session"))
    return present(
        signals.select(
            "rule", "security_id", "signal_session", "entry_session", "weekly_available", "monthly_available", "adv",
            F.col("daily_return20").alias("priority"),
        ),
        8, adv=2,
    )


@q("bar_store_roundtrip", with_views("""
SELECT security_id, count(*) AS n, CAST(max(session) AS VARCHAR) AS last_session, CAST(sum(volume) AS BIGINT) AS volume FROM v_bars WHERE session < DATE '2001-06-01'
 AND security_id NOT IN (SELECT security_id FROM (SELECT security_id, abs(close / lag(close) OVER (PARTITION BY security_id ORDER BY session) - 1) AS mv FROM v_bars) WHERE mv > 0.11) GROUP BY 1"""))
def bar_store_roundtrip(spark, sf):
    bars = M.bars(spark, sf)
    wild = Y.extreme_moves(bars, 0.11).select("security_id").distinct().withColumn("wild", F.lit(True))
    report = bars.select("security_id").distinct().join(wild, "security_id", "left").withColumn("ok", F.col("wild").isNull())
    path = work_dir(spark, "bars")
    sinks.write_bars(bars, report, F.to_date(F.lit("2001-08-31")), path)
    stored = sinks.read_bars(spark, path, F.to_date(F.lit("2001-06-01")))
    return present(
        stored.groupBy("security_id").agg(
            F.count(F.lit(1)).alias("n"), F.max("session").alias("last_session"), F.sum("volume").alias("volume")
        )
    )


_TREE_FILES = """
SELECT 'documents/' || coalesce(source, '') AS folder, coalesce(lang, '') || '/' || doc_id AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length,
  sha256(coalesce(text, '')) AS sha256 FROM documents
UNION ALL SELECT 'pages/' || regexp_extract(url, '^[a-z]+://([^/]*)', 1), CAST(page_id AS VARCHAR), CAST(strlen(coalesce(html, '')) AS BIGINT),
  sha256(coalesce(html, '')) FROM pages"""


def _tree_files(spark, sf):
    """Documents and pages as the files of a tree, by source and host."""
    docs, pages = M.table(spark, sf, "documents"), M.table(spark, sf, "pages")
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    return FI.row_files(docs, F.concat(F.lit("documents/"), F.coalesce("source", F.lit(""))), path, F.col("text")).unionByName(
        FI.row_files(pages, F.concat(F.lit("pages/"), host), F.col("page_id"), F.col("html"))
    )


@q("file_hashes", f"SELECT folder, path, length, sha256 FROM ({_TREE_FILES})")
def file_hashes(spark, sf):
    return present(_tree_files(spark, sf).select("folder", "path", "length", "sha256"))


_PLANTED = """
SELECT folder, path, CASE WHEN crc % 97 = 3 THEN reverse(sha256) ELSE sha256 END AS sha256
FROM (SELECT *, CAST(('0x' || substr(sha256(path), 1, 6)) AS BIGINT) AS crc FROM v_files)
WHERE folder NOT IN (SELECT max(folder) FROM v_files) AND NOT (folder <> (SELECT min(folder) FROM v_files) AND crc % 89 = 5)
UNION ALL SELECT folder, 'absent', sha256(folder) FROM (SELECT DISTINCT folder FROM v_files) WHERE folder LIKE '%1'"""
_STATES = """
SELECT folder, path, CASE WHEN h IS NULL THEN 'missing' WHEN w IS NULL AND NOT declared THEN 'unavailable' WHEN w IS NULL THEN 'extra'
  WHEN w = h THEN 'ok' ELSE 'changed' END AS state
FROM (SELECT coalesce(m.folder, f.folder) AS folder, coalesce(m.path, f.path) AS path, m.sha256 AS w, f.sha256 AS h,
             coalesce(m.folder, f.folder) IN (SELECT folder FROM v_planted) AS declared
      FROM v_planted m FULL JOIN v_files f ON m.folder = f.folder AND m.path = f.path)"""


def _planted_manifest(files):
    """The files as declared, with changed hashes, left out and absent files, and one folder left out whole."""
    number = F.conv(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 6), 16, 10).cast("bigint")
    lowest, highest = files.select(F.min("folder")).scalar(), files.select(F.max("folder")).scalar()
    kept = files.where((F.col("folder") != highest) & ~((F.col("folder") != lowest) & (number % 89 == 5)))
    declared = kept.select("folder", "path", F.when(number % 97 == 3, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    absent = files.select("folder").distinct().where("folder LIKE '%1'")
    return declared.unionByName(absent.select("folder", F.lit("absent").alias("path"), F.sha2("folder", 256).alias("sha256")))


@q("manifest_states", with_views("SELECT * FROM v_states", v_files=_TREE_FILES, v_planted=_PLANTED, v_states=_STATES))
def manifest_states(spark, sf):
    """Files against a manifest in which every state is planted."""
    files = _tree_files(spark, sf)
    return present(FI.reconcile(_planted_manifest(files), files))


@q("manifest_status", with_views("""
SELECT *, CASE WHEN n_unavailable > 0 THEN 'unavailable' WHEN n_changed + n_extra > 0 THEN 'degraded' WHEN n_missing > 0 THEN 'partial' ELSE 'ok' END AS status
FROM (SELECT folder, count(*) FILTER (WHERE state = 'ok') AS n_ok, count(*) FILTER (WHERE state = 'changed') AS n_changed,
  count(*) FILTER (WHERE state = 'missing') AS n_missing, count(*) FILTER (WHERE state = 'extra') AS n_extra, CAST(0 AS BIGINT) AS n_ambiguous,
  count(*) FILTER (WHERE state = 'unavailable') AS n_unavailable FROM v_states GROUP BY folder)""",
  v_files=_TREE_FILES, v_planted=_PLANTED, v_states=_STATES))
def manifest_status(spark, sf):
    files = _tree_files(spark, sf)
    return present(FI.manifest_status(_planted_manifest(files), files))


@q("manifest_verified", f"SELECT folder, path FROM ({_TREE_FILES})")
def manifest_verified(spark, sf):
    """Files under a manifest that holds; a job over one that does not would fail."""
    files = _tree_files(spark, sf)
    return present(FI.verified(files.select("folder", "path", "sha256"), files))


def _trie_sql(per_bucket: int, depth: int) -> str:
    digits = " + ".join(f"CASE WHEN n > {per_bucket * 16 ** (k - 1)} THEN 1 ELSE 0 END" for k in range(1, depth + 1))
    out = [
        f"""n_{depth} AS (SELECT folder, digits AS level, node, sha256(string_agg(line, chr(10) ORDER BY encode(line))) AS digest
        FROM (SELECT folder, {digits} AS digits, left(sha256(path), {digits}) AS node, path || ':' || sha256 AS line
              FROM v_files JOIN (SELECT folder, count(*) AS n FROM v_files GROUP BY folder) USING (folder)) GROUP BY ALL)"""
    ]
    for level in range(depth, 0, -1):
        out.append(
            f"""n_{level - 1} AS (SELECT * FROM n_{level} WHERE level < {level} UNION ALL SELECT folder, {level - 1}, left(node, {level - 1}),
            sha256(string_agg(digest, '' ORDER BY node)) FROM n_{level} WHERE level = {level} GROUP BY folder, left(node, {level - 1}))"""
        )
    return f"""WITH v_files AS ({_TREE_FILES}), {", ".join(out)}
SELECT folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, any_value(digest) AS fingerprint FROM v_files JOIN n_0 USING (folder) GROUP BY folder"""


@q("archive_fingerprints", _trie_sql(4, 5))
def archive_fingerprints(spark, sf):
    """Digest, count and bytes of every folder; buckets are small here so that several levels are built."""
    return present(FI.digest_tree(_tree_files(spark, sf), per_bucket=4, depth=5))
