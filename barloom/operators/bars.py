"""Daily bars: normalization, hygiene, resampling, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.dates import month_start, week_end
from barloom.operators.sessions import small

OHLC = ("open", "high", "low", "close")


def bars_from_prints(prints: DataFrame, tick: Sequence[str]) -> DataFrame:
    """Merge intraday prints into daily bars.

    ``tick`` columns order the prints of one session totally. Everything is a
    decomposable aggregate, so a hot security is combined map-side and only
    one row per (security, session) and task crosses the network. A single
    numeric tick keeps the aggregation hash-based; several columns are compared
    as a struct, which Spark aggregates by sorting.
    """
    order = F.col(tick[0]) if len(tick) == 1 else F.struct(*tick)
    return prints.groupBy("security_id", "session").agg(
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
    )


def normalize_vendor_rows(rows: DataFrame, ingest: Sequence[str]) -> DataFrame:
    """Lower-case names, keep the bar columns, truncate to dates, keep the last duplicate.

    "Last" is by the ``ingest`` columns. ``max_by`` is used rather than a
    ranking window so that repeated copies of one bar are combined before the
    shuffle.
    """
    lowered = rows.toDF(*[c.lower() for c in rows.columns])
    dated = lowered.withColumn("session", F.to_date("session"))
    order = F.struct(*[F.col(c.lower()) for c in ingest])
    kept = F.max_by(F.struct(*OHLC, "volume"), order).alias("kept")
    return dated.groupBy("security_id", "session").agg(kept).select("security_id", "session", "kept.*")


def hygiene(bars: DataFrame, start: Column | None = None, cutoff: Column | None = None) -> DataFrame:
    """Drop bars with a null or non-positive price; clip to the date range."""
    keep = F.lit(True)
    for name in OHLC:
        keep = keep & (F.col(name) > 0)
    if start is not None:
        keep = keep & (F.col("session") >= start)
    if cutoff is not None:
        keep = keep & (F.col("session") <= cutoff)
    return bars.where(keep)


def bar_manifest(bars: DataFrame) -> DataFrame:
    """First and last session and bar count per security."""
    return bars.groupBy("security_id").agg(
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def minimum_history(bars: DataFrame, minimum: int = 300) -> DataFrame:
    """Securities with enough bars."""
    return bar_manifest(bars).where(F.col("n_bars") >= minimum)


def fresh(bars: DataFrame, required: Column) -> DataFrame:
    """Securities whose last bar reaches the required session."""
    return bar_manifest(bars).where(F.col("last_session") >= required)


def completed_only(bars: DataFrame, last_completed: Column) -> DataFrame:
    """Drop bars after the last completed session."""
    return bars.where(F.col("session") <= last_completed)


def frozen_roster(bars: DataFrame, roster: DataFrame, cutoff: Column) -> DataFrame:
    """Re-clip every series to the cutoff; a roster member left empty is flagged."""
    clipped = bar_manifest(hygiene(bars, cutoff=cutoff))
    return roster.join(clipped, "security_id", "left").withColumn(
        "status", F.when(F.col("n_bars").isNull(), "empty").otherwise("ok")
    )


def period_bars(bars: DataFrame, calendar: DataFrame, timeframe: str) -> DataFrame:
    """Completed weekly or monthly bars labelled by the last observed session.

    A security's trailing period is dropped while the calendar still has a
    session in it after the security's last bar.
    """
    if timeframe == "weekly":
        key, last = week_end(F.col("session")), "week_last"
    elif timeframe == "monthly":
        key, last = month_start(F.col("session")), "month_last"
    else:
        raise ValueError(f"unsupported timeframe {timeframe!r}")
    ends = calendar.select(
        (F.col("week_end") if timeframe == "weekly" else F.col("month")).alias("period"),
        F.col(last).alias("calendar_last"),
    ).distinct()
    grouped = (
        bars.withColumn("period", key)
        .groupBy("security_id", "period")
        .agg(
            F.min_by("open", "session").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "session").alias("close"),
            F.sum("volume").alias("volume"),
            F.max("session").alias("session"),
        )
    )
    trailing = F.max("period").over(Window.partitionBy("security_id")) == F.col("period")
    return (
        grouped.withColumn("_trailing", trailing)
        .join(small(ends), "period", "left")
        .where(~(F.col("_trailing") & (F.col("calendar_last") > F.col("session"))))
        .select("security_id", "session", *OHLC, "volume")
    )
