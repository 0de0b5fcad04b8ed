from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import exits as X, gate as G
from barloom.operators.sessions import session_calendar
from barloom.streaming import forward as FW, pending as PD, positions as PS, runs
from test_bars_and_sessions import business_days
from test_features_and_rules import noisy

D = dt.date


def test_position_tracker_carries_state_across_batches(spark, tmp_path):
    runs.use_rocksdb(spark)
    days = business_days("2024-01-02", "2024-03-15")
    bars = noisy(spark, days, 1, "A").unionByName(noisy(spark, days, 2, "B"))
    entries = bars.select(
        F.concat_ws("-", "security_id", F.col("session").cast("string")).alias("candidate_id"), "security_id",
        F.col("session").alias("entry_session"), (F.col("open") - 6).alias("stop"), (F.col("open") + 7).alias("target"),
    )
    per_bar = entries.groupBy("security_id", F.col("entry_session").alias("session")).agg(
        F.collect_list(F.struct("candidate_id", "stop", "target")).alias("entries")
    )
    feed = bars.drop("volume").join(per_bar, ["security_id", "session"]).persist()
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    cuts = [D(2024, 1, 1), D(2024, 1, 20), D(2024, 2, 10), D(2024, 3, 31)]
    for lo, hi in zip(cuts, cuts[1:]):
        feed.where((F.col("session") > F.lit(lo)) & (F.col("session") <= F.lit(hi))).write.mode("append").parquet(inbox)
        stream = PS.track_positions(spark.readStream.schema(feed.schema).parquet(inbox), hold=21)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).select("candidate_id", "exit_session", "exit_reason", F.round("exit_price", 6), "sessions_held")
    want = X.label_outcomes(entries, bars, 21).where("exit_reason IS NOT NULL")
    want = want.select("candidate_id", "exit_session", "exit_reason", F.round("exit_price", 6), "sessions_held")
    assert got.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_position_tracker_orders_bars_over_batches_and_reports_late_ones(spark, tmp_path):
    runs.use_rocksdb(spark)
    days = business_days("2024-01-02", "2024-03-15")
    bars = noisy(spark, days, 1, "A").unionByName(noisy(spark, days, 2, "B"))
    entries = bars.crossJoin(spark.range(3).select(F.col("id").alias("k"))).select(
        F.concat_ws("-", "security_id", F.col("session").cast("string"), "k").alias("candidate_id"), "security_id",
        F.col("session").alias("entry_session"), (F.col("open") - 3 - F.col("k")).alias("stop"), (F.col("open") + 4 + F.col("k")).alias("target"),
    )
    per_bar = entries.groupBy("security_id", F.col("entry_session").alias("session")).agg(
        F.collect_list(F.struct("candidate_id", "stop", "target")).alias("entries")
    )
    feed = bars.drop("volume").join(per_bar, ["security_id", "session"]).persist()
    # Sessions of seven days are dealt over batches in reverse order, far within the delay of ten days.
    number = F.floor((F.datediff("session", F.lit(days[0])) + F.pmod(-F.dayofyear("session"), F.lit(7))) / 14)
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))

    def batch(rows):
        rows.coalesce(1).write.mode("append").parquet(inbox)
        stream = PS.track_positions(spark.readStream.schema(feed.schema).parquet(inbox), hold=21, delay=10)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    numbers = sorted(r[0] for r in feed.select(number).distinct().collect())
    for n in numbers:
        batch(feed.where(number == n))
    closing = spark.createDataFrame([("~", D(2024, 4, 30), 0.0, 0.0, 0.0, 0.0)], "security_id string, session date, open double, high double, low double, close double")
    batch(feed.where(F.col("session") == days[3]).unionByName(closing, allowMissingColumns=True))
    batch(feed.where(F.col("session") == days[5]).where("security_id = 'A'"))
    batch(feed.where(F.col("session") > days[-1]).unionByName(closing.withColumn("session", F.lit(None).cast("date")), allowMissingColumns=True))
    tracked = spark.read.parquet(out)
    pick = ["candidate_id", "exit_session", "exit_reason", F.round("exit_price", 6), "sessions_held"]
    got, want = PS.exits(tracked).select(pick), X.label_outcomes(entries, bars, 21).where("exit_reason IS NOT NULL").select(pick)
    assert len(numbers) > 4 and got.count() > 100
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    late = sorted(tuple(r) for r in PS.late_bars(tracked).select("security_id", "session", "entries").collect())
    assert late == [("A", days[3], 3), ("A", days[5], 3), ("B", days[3], 3)]


def test_position_tracker_keeps_one_state_for_a_bucket_of_securities(spark, tmp_path):
    """Each security was a state and a call of its own, whose cost by far exceeded that of its bars."""
    runs.use_rocksdb(spark)
    days = business_days("2024-01-02", "2024-02-29")
    bars = None
    for k in range(12):
        one = noisy(spark, days, k, f"S{k}")
        bars = one if bars is None else bars.unionByName(one)
    entries = bars.select(
        F.concat_ws("-", "security_id", F.col("session").cast("string")).alias("candidate_id"), "security_id",
        F.col("session").alias("entry_session"), (F.col("open") - 6).alias("stop"), (F.col("open") + 7).alias("target"),
    )
    per_bar = entries.groupBy("security_id", F.col("entry_session").alias("session")).agg(
        F.collect_list(F.struct("candidate_id", "stop", "target")).alias("entries")
    )
    feed = bars.drop("volume").join(per_bar, ["security_id", "session"]).persist()
    # The first securities come later than the others, within the delay.
    late = F.when(F.substring("security_id", 2, 2).cast("int") < 3, 9).otherwise(0)
    number = F.floor((F.datediff("session", F.lit(days[0])) + late) / 20)
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    closing = spark.createDataFrame([("~", D(2024, 4, 30), 0.0, 0.0, 0.0, 0.0)], "security_id string, session date, open double, high double, low double, close double")
    calls = 0
    for rows in [feed.where(number == n) for n in range(4)] + [closing.withColumn("entries", F.lit(None).cast(feed.schema["entries"].dataType))]:
        rows.write.mode("append").parquet(inbox)
        stream = PS.track_positions(spark.readStream.schema(feed.schema).parquet(inbox), hold=21, delay=10, buckets=2)
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        calls = max([calls, *(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators)])
    pick = ["candidate_id", "exit_session", "exit_reason", F.round("exit_price", 6), "sessions_held"]
    tracked = spark.read.parquet(out)
    got, want = PS.exits(tracked).select(pick), X.label_outcomes(entries, bars, 21).where("exit_reason IS NOT NULL").select(pick)
    assert got.count() > 100 and PS.late_bars(tracked).isEmpty()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # A state and a timer with its index for each bucket.
    assert 0 < calls <= 8


def test_forward_ledger_decisions(spark, tmp_path):
    days = business_days("2024-01-02", "2024-01-09")
    rows = spark.createDataFrame([(d, s, float(i)) for i, d in enumerate(days) for s in ("A", "B")], "session date, security_id string, v double")
    roster = spark.createDataFrame([("A",), ("B",)], "security_id string")
    ledger = FW.ForwardLedger(spark, str(tmp_path / "run"), session_calendar(rows))
    kinds = lambda batch: {"events": batch}
    check = FW.missing_roster(roster)
    on = lambda *ds: rows.where(F.col("session").isin(list(ds)))
    decisions = lambda batch: [d[1] for d in ledger.offer(batch, kinds, check)]
    assert decisions(on(days[0], days[1])) == ["accepted", "accepted"]
    assert decisions(on(days[3])) == ["skipped_ahead"]
    assert decisions(on(days[1])) == ["replayed"]
    assert decisions(on(days[1]).withColumn("v", F.lit(9.0))) == ["late"]
    assert decisions(on(days[2]).where("security_id = 'A'")) == ["invalid"]
    assert decisions(on(days[2], days[3])) == ["accepted", "accepted"]
    assert ledger.control().count() == 4
    assert ledger.read("events", "session date, security_id string, v double").count() == 8


def test_pending_signals_over_several_batches(spark, tmp_path):
    days = business_days("2024-01-02", "2024-01-31")
    after = dict(zip(days, days[1:]))
    signals = [(f"r{k}", s, d, after[d]) for i, d in enumerate(days[:-1]) for s in ("A", "B", "C") for k in range(2) if (i + k) % 3]
    signals = spark.createDataFrame([*signals, ("r9", "A", days[-1], None)], "rule string, security_id string, signal_session date, entry_session date")
    bars = spark.createDataFrame(
        [(s, d, float(i)) for i, d in enumerate(days) for s in ("A", "B", "D") if not (s == "B" and i % 4 == 0)], "security_id string, session date, open double"
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n in range(0, len(days), 6):
        now = days[n : n + 6]
        signals.where(F.col("signal_session").isin(now)).write.mode("append").parquet(str(tmp_path / "signals"))
        bars.where(F.col("session").isin(now)).write.mode("append").parquet(str(tmp_path / "bars"))
        stream = PD.enter_pending(
            spark.readStream.schema(signals.schema).parquet(str(tmp_path / "signals")), spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
        )
        runs_once = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        runs_once.awaitTermination()
    got = sorted(map(str, spark.read.parquet(out).collect()))
    batch = PD.pending_batch(signals, bars)
    assert got == sorted(map(str, batch.where("status <> 'pending'").collect()))
    states = {r.status: r["count"] for r in batch.groupBy("status").count().collect()}
    assert states.keys() == {"entered", "expired", "pending"} and states["pending"] < 10
    assert PD.pending_batch(signals, bars.limit(0)).where("status <> 'pending'").isEmpty()


class CutOff(FW.ForwardLedger):
    left = None

    def _replace(self, rows, name, *by):
        if self.left is not None:
            if not self.left:
                self.left = None
                raise InterruptedError(name)
            self.left -= 1
        super()._replace(rows, name, *by)


def test_ledger_cut_off_before_any_write_ends_as_if_it_had_not(spark, tmp_path):
    days = business_days("2024-01-02", "2024-01-09")
    rows = spark.createDataFrame([(d, s, float(i)) for i, d in enumerate(days) for s in ("A", "B")], "session date, security_id string, v double")
    kinds = lambda b: {"orders": b.where("v > 0"), "events": b}
    batches = [("1", days[:2]), ("2", [days[0], days[4]]), ("3", days[2:])]
    ends = []
    for cut in (None, 0, 1, 2, 3, 4):
        ledger = CutOff(spark, str(tmp_path / f"run{cut}"), session_calendar(rows))
        for name, sessions in batches:
            batch = rows.where(F.col("session").isin(sessions))
            ledger.left = cut
            try:
                ledger.offer(batch, kinds, batch_id=name)
            except InterruptedError:
                ledger.left = None
                ledger.offer(batch, kinds, batch_id=name)
            ledger.left = None
        assert ledger.violations({"orders": rows.schema, "events": rows.schema}).isEmpty()
        ends.append((sorted(map(str, ledger.manifests().collect())), sorted(map(str, ledger.decisions().collect())), ledger.read("events", rows.schema).count()))
    assert all(end == ends[0] for end in ends)
    assert ends[0][2] == 12 and len(ends[0][0]) == 12


def test_ledger_shows_changed_rows(spark, tmp_path):
    days = business_days("2024-01-02", "2024-01-05")
    rows = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "session date, v double")
    ledger = FW.ForwardLedger(spark, str(tmp_path / "run"), session_calendar(rows))
    ledger.offer(rows, lambda b: {"events": b})
    assert set(ledger.heads()) == {"events"} and ledger.heads()["events"] != FW.genesis("events")
    changed = rows.where(F.col("session") == days[1]).withColumn("v", F.lit(7.0))
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(str(tmp_path / "run" / "events"))
    assert [tuple(r) for r in ledger.violations({"events": rows.schema}).collect()] == [(days[1], "events", "content")]


def test_session_gate_finds_each_violation_and_blocks_the_commit(spark, tmp_path):
    days = business_days("2024-01-02", "2024-01-04")
    ids = ["ok", "none", "stale", "later", "twice", "hole", "bare"]
    bars = [(d, s, d, 1.0, 2.0, 0.5, 1.5, 10) for d in days for s in ids]
    bad = days[1]
    bars = [b for b in bars if not (b[0] == bad and b[1] in ("none", "stale"))]
    bars += [(bad, "stale", days[0], 1.0, 2.0, 0.5, 1.5, 10), (bad, "later", days[2], 1.0, 2.0, 0.5, 1.5, 10)]
    bars += [(bad, "twice", bad, 1.0, 2.0, 0.5, 1.5, 10), (bad, "other", days[2], None, None, None, None, None)]
    bars = [(*b[:6], float("nan"), 10) if b[0] == bad and b[1] == "hole" else b for b in bars]
    frames = spark.createDataFrame(bars, "as_of date, security_id string, session date, open double, high double, low double, close double, volume long")
    roster = spark.createDataFrame([(s,) for s in ids], "security_id string")
    spans = [(s, days[0], D(2025, 1, 1)) for s in ids if s != "bare"] + [("bare", days[0], bad), ("bare", days[2], D(2025, 1, 1))]
    coverage = spark.createDataFrame(spans, "security_id string, start date, end date")
    snapshots = spark.createDataFrame([(days[0], days[0]), (bad, days[0]), (days[2], days[2])], "as_of date, snapshot_session date")
    found = G.session_violations(frames, roster, coverage, snapshots)
    assert {tuple(r) for r in found.collect()} == {
        (bad, "none", "no_data"), (bad, "stale", "last_bar"), (bad, "later", "later_rows"), (bad, "twice", "repeated_session"),
        (bad, "hole", "missing_value"), (bad, "bare", "not_covered"), (bad, None, "snapshot_date"),
    }
    rows = spark.createDataFrame([(d, 1.0) for d in days], "session date, v double")
    ledger = FW.ForwardLedger(spark, str(tmp_path / "run"), session_calendar(rows))
    decided = ledger.offer(rows, lambda b: {"events": b}, G.gated(found))
    assert [d[1] for d in decided] == ["accepted", "invalid", "skipped_ahead"] and ledger.control().count() == 1
    nothing = G.session_violations(frames.limit(0), roster, coverage, snapshots.limit(1))
    assert {r["problem"] for r in nothing.collect()} == {"no_data"}


def test_batches_arrive_whole_and_in_spans_that_grow_in_number_with_the_bars(spark):
    """Every batch was written by one task, and all bars and signals stood in the join state at once."""
    from barloom.catalog import streams as ST

    day = lambda n: dt.date(2024, 1, n)
    bars = spark.createDataFrame([(s, day(n), 100.0 + n) for s in "ab" for n in range(2, 30)], "security_id string, session date, open double")
    waiting = [(["r", "q"], s, day(n - 1), day(n)) for s in "abc" for n in range(2, 31)]
    signals = spark.createDataFrame(waiting, "rules array<string>, security_id string, signal_session date, entry_session date")
    spans = list(ST._spans(signals, bars.repartition(3), rows=10))
    assert len(spans) == 6 and sum(b.count() for _, b in spans) == 56 and sum(s.count() for s, _ in spans) == 87
    assert max(b.count() for _, b in spans) <= 10 and spans[2][1].rdd.getNumPartitions() == 3
    got = runs.run_arrivals(spark, iter(spans), PD.enter_pending, "spans")
    want = PD.pending_batch(signals, bars).where("status <> 'pending'")
    pick = lambda df: sorted(map(str, df.select("security_id", "entry_session", "status", "entry_price", "rules").collect()))
    assert pick(got) == pick(want)


def test_all_arrivals_go_through_one_query_with_few_state_partitions(spark, tmp_path, monkeypatch):
    """Each batch was a query of its own with as many state partitions as shuffles have, and picked its rows from the whole feeds."""
    from barloom.catalog import streams as ST

    made = iter(range(100))
    for module in (runs, ST):
        monkeypatch.setattr(module, "work_dir", lambda _, label: str(tmp_path / f"{label}-{next(made)}"))
    day = lambda n: dt.date(2024, 1, n)
    bars = spark.createDataFrame([(s, day(n), 100.0 + n) for s in "ab" for n in range(2, 30) if n < 9 or n > 20], "security_id string, session date, open double")
    waiting = [(["r", "q"], s, day(n - 1), day(n)) for s in "abc" for n in (*range(2, 7), *range(21, 31))] + [(["r"], "a", day(29), None)]
    signals = spark.createDataFrame(waiting, "rules array<string>, security_id string, signal_session date, entry_session date")
    most, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(most + 5))
    try:
        folders = list(ST._span_folders(signals, bars, rows=10))
        got = runs.run_folders(spark, folders, [signals.schema, bars.schema], PD.enter_pending, "few")
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(most + 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(folders) > 3 and any(s is None for s, _ in folders) and any(b is None for _, b in folders)
    assert len(list(tmp_path.glob("few-checkpoint-*/state/0/[0-9]*"))) == most
    want = PD.pending_batch(signals, bars).where("status <> 'pending'")
    pick = lambda df: sorted(map(str, df.select("security_id", "entry_session", "status", "entry_price", "rules").collect()))
    assert got.count() > 30 and pick(got) == pick(want)
