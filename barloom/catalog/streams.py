"""Structured Streaming queries, each compared with its batch meaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from barloom.catalog import performance  # noqa: F401  (registers the views used below)
from barloom.catalog.common import present
from barloom.catalog.views_sql import with_views
from barloom.operators import equity as Q, gate as G, signals as SG
from barloom.operators.scaled import dealt_by
from barloom.operators.sessions import session_calendar, small
from barloom.plans import grid, study
from barloom.session import persist_table, work_dir
from barloom.sources import market_views as M
from barloom.streaming import books as BK, daily_bars as DB, forward as FW, pending as PD, positions as PS, runs

QUERIES, ORACLE = {}, {}


def q(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _stream(spark, table):
    """Read a written table back as a stream."""
    return spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])


@q("stream_daily_bars", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, user_id AS security_id, first(price ORDER BY event_id) AS open, max(price) AS high, min(price) AS low,
 last(price ORDER BY event_id) AS close, count(*) AS volume FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS price FROM events)
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_daily_bars(spark, sf):
    events = M.table(spark, sf, "events")
    raw = runs.table_stream(spark, sf, "events", events.schema)
    ticks = raw.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("security_id"), F.col("event_id").alias("seq"),
        F.round(F.col("value") * 100).cast("long").alias("price"), F.lit(1).cast("long").alias("size"),
    )
    return present(runs.run_available(DB.daily_bars(ticks, "1 hour"), "daily-bars"))


_DELAY_DAYS = 12
_EXITS = """
SELECT strategy_id || '|' || security_id || '|' || CAST(signal_session AS VARCHAR) AS candidate_id, security_id, CAST(session AS VARCHAR) AS exit_session,
  reason AS exit_reason, round(price, 6) AS exit_price, i + 1 AS sessions_held FROM v_exits"""


def _shuffled_batches(feed):
    """The feed in five batches: bars come up to ten days after others of their day, the first bar
    of each security comes once more at the end, and a row of no security closes the last day."""
    first, last = feed.agg(F.min("session"), F.max("session")).first()
    day = F.datediff("session", F.lit(first)) + F.pmod(F.xxhash64("security_id", "session"), F.lit(11))
    part = F.least(F.floor(day * 4 / F.lit((last - first).days + 1)), F.lit(3)).cast("int")
    again = feed.withColumn("k", F.row_number().over(Window.partitionBy("security_id").orderBy("session"))).where("k = 1").drop("k")
    closing = feed.sparkSession.createDataFrame(
        [("~", last + dt.timedelta(_DELAY_DAYS + 1), 0.0, 0.0, 0.0, 0.0)], "security_id string, session date, open double, high double, low double, close double"
    )
    for n in range(4):
        yield [feed.where(part == n)]
    yield [again.unionByName(closing, allowMissingColumns=True)]


@q("stream_position_exits", with_views(f"""
{_EXITS} UNION ALL
SELECT NULL, b.security_id, CAST(min(b.session) AS VARCHAR), 'late_bar', round(first(b.close ORDER BY b.session), 6), first(coalesce(e.n, 0) ORDER BY b.session)
FROM v_bars b LEFT JOIN (SELECT security_id, entry_session, count(*) AS n FROM v_levels WHERE geometry_reason IS NULL GROUP BY 1, 2) e
  ON e.security_id = b.security_id AND e.entry_session = b.session
  GROUP BY b.security_id""", recursive=True))
def stream_position_exits(spark, sf):
    """Every strategy's positions over batches that come out of order, with the bars that came too late to count."""
    runs.use_rocksdb(spark)
    bars = M.bars(spark, sf)
    entries = study.study_entries(bars, M.calendar(spark, sf)).where("geometry_reason IS NULL")
    opened = entries.select(
        "security_id",
        F.col("entry_session").alias("session"),
        F.struct(
            F.concat_ws("|", "strategy_id", "security_id", F.col("signal_session").cast("string")).alias("candidate_id"),
            "stop",
            "target",
        ).alias("entry"),
    )
    per_bar = opened.groupBy("security_id", "session").agg(F.collect_list("entry").alias("entries"))
    feed = persist_table(bars.drop("volume").join(per_bar, ["security_id", "session"], "left"), "position-feed")
    track = lambda stream: PS.track_positions(stream, delay=_DELAY_DAYS)
    return present(runs.run_arrivals(spark, _shuffled_batches(feed), track, "position-exits"), 6)


_BOOK_ROWS = """
SELECT r.strategy_id, r.session, CAST(r.equity * 100 AS BIGINT) AS equity_c, coalesce(x.closed, 0) AS closed, coalesce(e.n, 0) AS candidates,
  coalesce(e.tin, 0) + coalesce(x.tout, 0) AS turnover_c,
  sum(coalesce(e.opened, 0) - coalesce(x.closed, 0)) OVER (PARTITION BY r.strategy_id ORDER BY r.session) AS open_positions
FROM v_real r
LEFT JOIN (SELECT strategy_id, entry_session AS session, count(*) AS n, sum(CAST(entry_price * 100 AS BIGINT) * quantity) FILTER (WHERE status = 'filled') AS tin,
           count(*) FILTER (WHERE status = 'filled') AS opened FROM v_cand GROUP BY 1, 2) e USING (strategy_id, session)
LEFT JOIN (SELECT strategy_id, exit_session AS session, count(*) AS closed, sum(CAST(exit_price * 100 AS BIGINT) * quantity) AS tout FROM v_trades GROUP BY 1, 2) x USING (strategy_id, session)"""
_BOOKS = """
SELECT strategy_id, CAST(session AS VARCHAR) AS session, count(*) OVER w AS sessions, CAST(sum(CAST(open_positions > 0 AS INTEGER)) OVER w AS BIGINT) AS exposed_sessions,
 CAST(sum(closed) OVER w AS BIGINT) AS closed_trades, CAST(sum(candidates) OVER w AS BIGINT) AS candidates, CAST(sum(turnover_c) OVER w AS BIGINT) AS turnover_c,
 equity_c, peak_c, round(max(1 - CAST(equity_c AS DOUBLE) / peak_c) OVER w, 8) AS max_drawdown, max(peak_c - equity_c) OVER w AS max_drawdown_c
FROM (SELECT *, greatest(10000000, max(equity_c) OVER (PARTITION BY strategy_id ORDER BY session)) AS peak_c FROM v_rows)
WINDOW w AS (PARTITION BY strategy_id ORDER BY session)"""


def _session_rows(spark, sf):
    curve = Q.realized_equity(M.trades(spark, sf), M.calendar(spark, sf), M.CAPITAL, strategies=M.strategies(spark, sf))
    return BK.session_rows(M.candidates(spark, sf), curve)


@q("book_state_batch", with_views(_BOOKS, v_rows=_BOOK_ROWS))
def book_state_batch(spark, sf):
    return present(BK.books_batch(_session_rows(spark, sf), F.lit(M.CAPITAL * 100).cast("bigint")), max_drawdown=8)


@q("stream_book_state", with_views(_BOOKS, v_rows=_BOOK_ROWS))
def stream_book_state(spark, sf):
    runs.use_rocksdb(spark)
    feed = persist_table(_session_rows(spark, sf), "book-feed")
    return present(runs.run_available(BK.keep_books(_stream(spark, feed), M.CAPITAL), "books"), max_drawdown=8)


@q("stream_no_backfill", """
WITH d AS (SELECT CAST(ts AS DATE) AS session, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(session AS VARCHAR) AS session, decision, n AS records FROM (
 SELECT session, 'accepted' AS decision, n FROM d UNION ALL
 SELECT session, 'skipped_ahead', n FROM d WHERE session BETWEEN DATE '2024-01-07' AND DATE '2024-01-08' UNION ALL
 SELECT session, 'late', n FROM d WHERE session = DATE '2024-01-02' UNION ALL
 SELECT session, 'replayed', n FROM d WHERE session = DATE '2024-01-04')""")
def stream_no_backfill(spark, sf):
    """Arrivals in five runs: five days, two days too early, the rest, a changed old day, a replay."""
    events = M.table(spark, sf, "events").withColumn("session", F.to_date("ts"))
    ledger = FW.ForwardLedger(spark, work_dir(spark, "forward"), session_calendar(events))
    inbox, checkpoint = work_dir(spark, "inbox"), work_dir(spark, "forward-checkpoint")
    kinds = lambda batch: {
        "events": batch,
        "orders": batch.where("event_type = 'purchase'"),
    }
    day = lambda n: F.lit(dt.date(2024, 1, n))
    s = F.col("session")
    arrivals = (
        events.where(s <= day(5)),
        events.where(s.between(day(7), day(8))),
        events.where(s >= day(6)),
        events.where(s == day(2)).withColumn("value", F.col("value") + 1),
        events.where(s == day(4)),
    )
    for rows in arrivals:
        rows.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        runs.run_batches(stream, ledger.apply(kinds), checkpoint)
    return present(ledger.decisions())


class _CutOff(FW.ForwardLedger):
    """Stops once before its ``stop``-th write, as a lost driver would."""

    writes, stop = 0, None

    def _replace(self, rows, name, *by):
        self.writes += 1
        if self.writes == self.stop:
            raise InterruptedError(name)
        super()._replace(rows, name, *by)


def _five_kinds(batch):
    of = lambda kind: batch.where(F.col("event_type") == kind)
    equity = batch.groupBy("session").agg(F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100, 2).alias("equity"))
    return dict(zip(FW.KINDS, (of("view"), of("click"), of("purchase"), equity, batch), strict=True))


@q("forward_session_manifests", """
WITH e AS (SELECT CAST(ts AS DATE) AS session, event_type FROM events),
k AS (SELECT session, 'candidates' AS kind, count(*) FILTER (WHERE event_type = 'view') AS records FROM e GROUP BY 1 UNION ALL
      SELECT session, 'orders', count(*) FILTER (WHERE event_type = 'click') FROM e GROUP BY 1 UNION ALL
      SELECT session, 'trades', count(*) FILTER (WHERE event_type = 'purchase') FROM e GROUP BY 1 UNION ALL
      SELECT DISTINCT session, 'equity', 1 FROM e UNION ALL SELECT session, 'events', count(*) FROM e GROUP BY 1)
SELECT CAST(session AS VARCHAR) AS session, kind, records, records AS stored, true AS chained, CAST(1 AS BIGINT) AS manifests, CAST(1 AS BIGINT) AS accepted,
 CAST(0 AS BIGINT) AS violations FROM k""")
def forward_session_manifests(spark, sf):
    """Three batches; the second is cut off between two kinds, the third after its manifests, and both are offered again."""
    events = M.table(spark, sf, "events").withColumn("session", F.to_date("ts"))
    ledger = _CutOff(spark, work_dir(spark, "five-ledgers"), session_calendar(events))
    s, day = F.col("session"), lambda n: F.lit(dt.date(2024, 1, n))
    for name, rows, stop in (("a", s <= day(9), None), ("b", s.between(day(10), day(19)), 3), ("c", s > day(19), 7)):
        ledger.writes, ledger.stop = 0, stop
        if stop:
            try:
                ledger.offer(events.where(rows), _five_kinds, batch_id=name)
            except InterruptedError:
                ledger.stop = None
        ledger.offer(events.where(rows), _five_kinds, batch_id=name)
    schemas = {kind: part.schema for kind, part in _five_kinds(events).items()}
    stored = None
    for kind, schema in schemas.items():
        n = ledger.read(kind, schema).groupBy("session").agg(F.count(F.lit(1)).alias("stored")).withColumn("kind", F.lit(kind))
        stored = n if stored is None else stored.unionByName(n)
    before = F.lag("final_hash").over(Window.partitionBy("kind").orderBy("session"))
    rows = ledger.manifests().withColumns(
        {"chained": F.coalesce(before == F.col("prior_hash"), F.col("prior_hash") == F.sha2("kind", 256)),
         "manifests": F.count(F.lit(1)).over(Window.partitionBy("session", "kind"))}
    )
    taken = ledger.decisions().where("decision = 'accepted'").groupBy("session").agg(F.count(F.lit(1)).alias("accepted"))
    bad = ledger.violations(schemas).groupBy("session", "kind").agg(F.count(F.lit(1)).alias("violations"))
    found = rows.join(stored, ["session", "kind"], "left").join(taken, "session", "left").join(bad, ["session", "kind"], "left")
    return present(found.select(
        "session", "kind", "records", F.coalesce("stored", F.lit(0)).alias("stored"), "chained", "manifests", "accepted",
        F.coalesce("violations", F.lit(0)).alias("violations"),
    ))


_PENDING = """
SELECT rule, s.security_id, CAST(signal_session AS VARCHAR) AS signal_session, CAST(entry_session AS VARCHAR) AS entry_session,
  CASE WHEN b.session IS NOT NULL THEN 'entered' WHEN entry_session <= least((SELECT max(entry_session) FROM v_signals), (SELECT max(session) FROM v_bars)) - 1
       THEN 'expired' ELSE 'pending' END AS status, round(b.open, 6) AS entry_price
FROM v_signals s LEFT JOIN v_bars b ON b.security_id = s.security_id AND b.session = s.entry_session"""


def _signals(spark, sf):
    signals = study.study_signals(M.bars(spark, sf), M.calendar(spark, sf))
    return signals.select("rule", "security_id", "signal_session", "entry_session")


@q("pending_entries_batch", with_views(_PENDING, recursive=True))
def pending_entries_batch(spark, sf):
    return present(PD.pending_batch(_signals(spark, sf), M.bars(spark, sf)), 6)


def _numbered(signals, bars, rows):
    """Signals by entry session and bars by session with the number ``span`` of one of as many equal spans of days as
    keep about ``rows`` bars in one, and how many spans there are."""
    first, last, n = bars.agg(F.min("session"), F.max("session"), F.count(F.lit(1))).first()
    days = (last - first).days + 1 if n else 1
    step = -(-days // max(1, -(-n // rows)))
    spans, tables = -(-days // step), []
    for table, name in ((signals, "entry_session"), (bars, "session")):
        number = F.floor(F.datediff(name, F.lit(first)) / step) if n else F.lit(0)
        tables.append(table.where(F.col(name).isNotNull()).withColumn("span", F.greatest(F.lit(0), F.least(number, F.lit(spans - 1))).cast("int")))
    return tables, spans


def _spans(signals, bars, rows=1 << 22):
    """The rows of each span, picked from the whole tables."""
    tables, spans = _numbered(signals, bars, rows)
    for k in range(spans):
        yield [t.where(F.col("span") == k).drop("span") for t in tables]


def _span_folders(signals, bars, rows=1 << 22):
    """The same as folders: each table is dealt and written once for all spans, so no span reads what belongs to another."""
    spark = bars.sparkSession
    tables, spans = _numbered(signals, bars, rows)
    files, folders = spark.sparkContext.defaultParallelism, [work_dir(spark, f"{n}-spans") for n in ("signal", "bar")]
    for table, folder in zip(tables, folders, strict=True):
        dealt = table.repartition(spans * files, "span", F.pmod(F.xxhash64("security_id"), F.lit(files)))
        dealt.write.partitionBy("span").parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folders[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(spans):
        yield [f"{f}/span={k}" if fs.exists(path(f"{f}/span={k}")) else None for f in folders]


@q("stream_pending_entries", with_views(f"SELECT * FROM ({_PENDING}) WHERE status <> 'pending'", recursive=True))
def stream_pending_entries(spark, sf):
    """Signals of every rule wait for the bar of their entry session; those whose bar never comes expire.

    The rules of a signal wait together, and both feeds arrive by spans of sessions, more spans for more
    bars, so the state holds no more than a span however large the tables are.
    """
    cal, bars = M.calendar(spark, sf), persist_table(M.bars(spark, sf), "bar-feed")
    matrix = study.study_matrix(dealt_by(bars, ["security_id"], bars.count()), cal)
    fired = SG.with_entry_session(SG.rules_fired(matrix, grid.rules(), grid.PRIORITY, "adv"), cal)
    feeds = [fired.select("rules", "security_id", "signal_session", "entry_session"), bars.select("security_id", "session", "open")]
    entered = runs.run_folders(spark, _span_folders(*feeds), [f.schema for f in feeds], PD.enter_pending, "pending")
    return present(entered.select(F.explode("rules").alias("rule"), *[c for c in entered.columns if c != "rules"]), 6)


@q("forward_initial_books", with_views("""
SELECT strategy_id, '1995-01-02' AS first_session, CAST(100000 AS DOUBLE) AS starting_equity, CAST(100000 AS DOUBLE) AS current_equity,
  CAST(0 AS BIGINT) AS closed_trades, CAST(0 AS BIGINT) AS open_positions FROM v_strategies"""))
def forward_initial_books(spark, sf):
    strategies = M.cohort_members(spark, sf).where("cohort = 'ALL'")
    return present(FW.initial_books(strategies, M.CAPITAL, dt.date(1995, 1, 2)))


@q("forward_open_positions", with_views("""
SELECT strategy_id, candidate_id, security_id, CAST(entry_session AS VARCHAR) AS entry_session, quantity, CAST(entry_price AS DOUBLE) AS entry_price
FROM v_trades WHERE entry_session <= DATE '1998-06-30' AND exit_session > DATE '1998-06-30'"""))
def forward_open_positions(spark, sf):
    held = FW.open_positions(M.trades(spark, sf), dt.date(1998, 6, 30))
    return present(held.select("strategy_id", "candidate_id", "security_id", "entry_session", "quantity", "entry_price"))


@q("forward_known_schedule", with_views("""
SELECT security_id, event_id, CAST(event_session AS VARCHAR) AS event_session, CAST(known_session AS VARCHAR) AS known_session,
  CAST(superseded_session AS VARCHAR) AS superseded_session
FROM v_schedule WHERE known_session <= DATE '1998-06-30' AND DATE '1998-06-30' < coalesce(superseded_session, DATE '9999-12-31') AND event_session > DATE '1998-06-30'"""))
def forward_known_schedule(spark, sf):
    return present(FW.known_by(M.schedule(spark, sf), dt.date(1998, 6, 30)))


_FRAMES = """
SELECT m.as_of, b.security_id, b.session, b.volume FROM v_bars b JOIN v_months m ON m.month = date_trunc('month', b.session)
UNION ALL SELECT p.as_of, b.security_id, b.session, CASE WHEN day(b.session) < 20 THEN b.volume END
FROM v_bars b JOIN v_months p ON p.month = date_trunc('month', b.session) - INTERVAL 1 MONTH WHERE day(b.session) % 7 = 3 AND b.security_id LIKE '%1'
UNION ALL SELECT m.as_of, b.security_id, b.session, b.volume FROM v_bars b JOIN v_months m ON m.month = date_trunc('month', b.session)
WHERE day(b.session) % 9 = 4 AND b.security_id LIKE '%2'"""


@q("session_gate", with_views("""
SELECT CAST(as_of AS VARCHAR) AS as_of, problem, count(*) AS violations, min(security_id) AS first_security FROM (
 SELECT w.as_of, w.security_id, unnest(list_filter([
   CASE WHEN newest IS NULL THEN 'no_data' END, CASE WHEN newest IS NOT NULL AND last IS DISTINCT FROM w.as_of THEN 'last_bar' END,
   CASE WHEN newest > w.as_of THEN 'later_rows' END, CASE WHEN repeated THEN 'repeated_session' END, CASE WHEN broken THEN 'missing_value' END,
   CASE WHEN w.security_id LIKE '%4' AND w.as_of >= DATE '1996-06-01' THEN 'not_covered' END], lambda x: x IS NOT NULL)) AS problem
 FROM (SELECT as_of, 'S' || s_suppkey AS security_id FROM v_months, supplier) w
 LEFT JOIN (SELECT as_of, security_id, max(session) AS newest, max(session) FILTER (WHERE session <= as_of) AS last,
              count(*) > count(DISTINCT session) AS repeated, bool_or(volume IS NULL) AS broken FROM v_frames GROUP BY 1, 2) f USING (as_of, security_id)
 UNION ALL SELECT as_of, NULL, 'snapshot_date' FROM v_months WHERE month(as_of) = 6) GROUP BY 1, 2""",
    v_months="SELECT date_trunc('month', session) AS month, max(session) AS as_of FROM v_calendar GROUP BY 1", v_frames=_FRAMES))
def session_gate(spark, sf):
    """The month's bars of every security, delivered for its last session, with each kind of violation planted."""
    month = F.trunc("session", "month").alias("month")
    ends = M.calendar(spark, sf).groupBy(month).agg(F.max("session").alias("as_of"))
    bars = M.bars(spark, sf)
    day, placed = F.dayofmonth("session"), bars.withColumn("month", month).join(small(ends), "month")
    before = bars.withColumn("month", F.add_months(month, -1)).join(small(ends), "month")
    early = before.where((day % 7 == 3) & F.col("security_id").endswith("1")).withColumn("volume", F.when(day < 20, F.col("volume")))
    again = placed.where((day % 9 == 4) & F.col("security_id").endswith("2"))
    frames = placed.unionByName(early).unionByName(again)
    roster = M.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("security_id"))
    stops = F.when(F.col("security_id").endswith("4"), F.lit(dt.date(1996, 6, 1))).otherwise(F.lit(dt.date(9999, 1, 1)))
    coverage = roster.select("security_id", F.lit(dt.date(1900, 1, 1)).alias("start"), stops.alias("end"))
    june = F.month("as_of") == 6
    snapshots = ends.select("as_of", F.when(june, F.date_sub("as_of", 1)).otherwise(F.col("as_of")).alias("snapshot_session"))
    found = G.session_violations(frames, roster, coverage, snapshots)
    return present(found.groupBy("as_of", "problem").agg(F.count(F.lit(1)).alias("violations"), F.min("security_id").alias("first_security")))
