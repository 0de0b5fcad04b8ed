"""Bitemporal event schedules: what was known, when, and until when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.sessions import roll_table, small


def _floor_ord(df: DataFrame, calendar: DataFrame, day: Column, out: str) -> DataFrame:
    """Ordinal of the last session at or before ``day``; 0 before the calendar starts, one past its end after it."""
    hi = calendar.agg(F.max("session")).scalar()
    beyond = calendar.agg(F.max("ord") + 1).scalar()
    roll = roll_table(calendar).select(F.col("day").alias("_day"), F.col("floor_ord").alias(out))
    return (
        df.withColumn("_day", day)
        .join(small(roll), "_day", "left")
        .withColumn(out, F.when(F.col("_day") > hi, beyond).otherwise(F.coalesce(F.col(out), F.lit(0))))
        .drop("_day")
    )


def next_known_event(schedule: DataFrame, calendar: DataFrame) -> DataFrame:
    """Earliest event on or after the next session, as known at each signal session.

    A schedule row is valid for signals from ``known_session`` until
    ``superseded_session`` (open if null). Each row is unfolded over the signal
    sessions it is valid for and that precede its event, then reduced with
    ``min``: no security's signals are paired with its events, and partial
    aggregation shrinks repeated dates before the shuffle. An event past the
    calendar's end is still the next one, with an unknown (null) distance.
    """
    rows = _floor_ord(schedule, calendar, F.date_sub("known_session", 1), "_before_known")
    rows = _floor_ord(rows, calendar, F.col("event_session"), "_event_ord")
    rows = _floor_ord(rows, calendar, F.date_sub("superseded_session", 1), "_valid_ord")
    last = F.when(
        F.col("superseded_session").isNull(), F.col("_event_ord") - 1
    ).otherwise(F.least(F.col("_event_ord") - 1, F.col("_valid_ord")))
    first = F.col("_before_known") + 1
    unfolded = rows.where(first <= last).select(
        "security_id",
        "event_session",
        F.col("_event_ord").alias("event_ord"),
        F.explode(F.sequence(first, last)).alias("signal_ord"),
    )
    best = F.min(F.struct("event_session", "event_ord"))
    return unfolded.groupBy("security_id", "signal_ord").agg(best.alias("e")).select(
        "security_id",
        "signal_ord",
        F.col("e.event_session").alias("next_event"),
        F.when(F.col("e.event_ord") <= calendar.agg(F.max("ord")).scalar(), F.col("e.event_ord") - F.col("signal_ord") - 1).alias(
            "sessions_before"
        ),
    )


def best_provider_row(rows: DataFrame, keys: list[str], priority: list[Column], canonical: Column) -> DataFrame:
    """One row per group: highest priority, ties by canonical text."""
    kept = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*kept), F.struct(*priority, canonical)).alias("best"),
            F.count(F.lit(1)).alias("provider_row_count"),
        )
        .select(*keys, "best.*", "provider_row_count")
    )


def normalize_events(
    provider: DataFrame,
    calendar: DataFrame,
    snapshot: Column,
    coverage_start: Column,
    coverage_end: Column,
) -> DataFrame:
    """Provider rows to one causal event per (security, session).

    Dates roll to the same or next session; rows of a group compete by
    official type, fiscal quarter, completeness and canonical text. A past
    event with actual figures was known on its own session, anything else on
    the snapshot's session. ``violation`` marks an event known only after it
    happened.
    """
    roll = roll_table(calendar).select(F.col("day").alias("date"), F.col("next_session").alias("event_session"))
    dated = provider.join(small(roll), "date")
    figures = ("eps_actual", "eps_forecast", "revenue_actual", "revenue_forecast")
    filled = sum((F.col(c).isNotNull().cast("int") for c in figures), F.lit(0))
    text = F.to_json(F.struct(*sorted(provider.columns)), {"ignoreNullFields": "false"})
    best = best_provider_row(
        dated,
        ["security_id", "event_session"],
        [
            F.coalesce(F.col("date_type") == "OFFICIAL", F.lit(False)),
            F.col("fiscal_quarter").isNotNull(),
            filled,
        ],
        text,
    )
    known_snapshot = roll_table(calendar).where(F.col("day") == snapshot).select("prev_session").scalar()
    historical = (F.col("date") <= snapshot) & (F.col("eps_actual").isNotNull() | F.col("revenue_actual").isNotNull())
    return (
        best.where((F.col("event_session") >= coverage_start) & (F.col("event_session") < coverage_end))
        .withColumn("knowledge_kind", F.when(historical, "historical_result").otherwise("scheduled_snapshot"))
        .withColumn("known_session", F.when(historical, F.col("event_session")).otherwise(known_snapshot))
        .withColumn("violation", F.col("known_session") > F.col("event_session"))
    )


def snapshot_intervals(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Merge dated snapshots of scheduled events into validity intervals.

    ``snapshots(snapshot_session, snap)`` numbers the snapshots; ``events``
    lists (security, event, snap) presences with what each snapshot knew. A
    run of presences becomes one interval from its first snapshot. It is closed
    at the first later snapshot without the event, unless the event had passed
    by then, in which case it stays open.
    """
    key = Window.partitionBy("security_id", "event_session").orderBy("snap")
    present = events.select("security_id", "event_session", "snap").distinct()
    flagged = present.withColumn("prev", F.lag("snap").over(key)).withColumn("following", F.lead("snap").over(key))
    calendar = snapshots.select("snap", "snapshot_session")
    after = snapshots.select((F.col("snap") - 1).alias("snap"), F.col("snapshot_session").alias("missed_at"))
    gap = flagged.join(small(after), "snap", "left").withColumn(
        "closes",
        F.col("missed_at").isNotNull()
        & (F.col("following").isNull() | (F.col("following") > F.col("snap") + 1))
        & (F.col("event_session") >= F.col("missed_at")),
    )
    # A passed event never closes, so only a real close starts a new run.
    runs = gap.withColumn(
        "run", F.coalesce(F.sum(F.col("closes").cast("int")).over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    merged = runs.groupBy("security_id", "event_session", "run").agg(
        F.min("snap").alias("snap"), F.max(F.when(F.col("closes"), F.col("missed_at"))).alias("superseded_session")
    )
    return merged.join(small(calendar), "snap").select(
        "security_id",
        "event_session",
        F.col("snapshot_session").alias("known_session"),
        "superseded_session",
    )


def with_historical(intervals: DataFrame, historical: DataFrame) -> DataFrame:
    """Add past results as open intervals; the last snapshot's version of each wins."""
    latest = historical.groupBy("security_id", "event_session").agg(
        F.max_by("known_session", "snap").alias("known_session")
    )
    return intervals.unionByName(latest.withColumn("superseded_session", F.lit(None).cast("date")))


def merged_coverage(coverage: DataFrame) -> DataFrame:
    """Widest coverage per security over all snapshots."""
    return coverage.groupBy("security_id").agg(
        F.min("coverage_start").alias("coverage_start"), F.max("coverage_end").alias("coverage_end")
    )
