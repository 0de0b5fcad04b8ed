"""Pending signals: a signal of one session waits for the bar of the session it may enter on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _sides(signals: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    waiting = signals.where(F.col("entry_session").isNotNull()).withColumn("_entry_at", F.col("entry_session").cast("timestamp"))
    opened = bars.select(
        F.col("security_id").alias("_security"), F.col("session").cast("timestamp").alias("_bar_at"), F.col("open").alias("entry_price")
    )
    return waiting, opened


def _meets() -> Column:
    return (F.col("security_id") == F.col("_security")) & (F.col("_entry_at") == F.col("_bar_at"))


def _result(joined: DataFrame, columns: list[str], status: Column) -> DataFrame:
    return joined.select(*columns, status.alias("status"), "entry_price")


def enter_pending(signals: DataFrame, bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streams of signals and bars to entered and expired signals.

    A signal is kept as join state until the bar of its security and entry session arrives
    (``entered``, at that bar's open), or until both streams have passed the entry session by ``delay``
    (``expired``, without a price). The event time is part of the join key, so either side's state is
    dropped at that point and holds no more than the sessions still open. Later sessions never match:
    there is no backfill. Signals without an entry session are not pending and give no rows; what is
    still waiting when the input ends is put out by a later run of the same checkpoint.
    """
    waiting, opened = _sides(signals, bars)
    joined = waiting.withWatermark("_entry_at", delay).join(opened.withWatermark("_bar_at", delay), _meets(), "left_outer")
    status = F.when(F.col("_security").isNull(), "expired").otherwise("entered")
    return _result(joined, signals.columns, status)


def pending_batch(signals: DataFrame, bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same of two tables, with ``pending`` for signals that neither met a bar nor are passed yet."""
    waiting, opened = _sides(signals, bars)
    reach = waiting.agg(F.max("_entry_at").alias("at")).unionAll(opened.agg(F.max("_bar_at")))
    # The time that both sides have reached; an empty side has reached nothing.
    mark = reach.select(F.when(F.count("at") == 2, F.min("at") - F.expr(f"INTERVAL {delay}"))).scalar()
    joined = waiting.join(opened, _meets(), "left")
    status = F.when(F.col("_security").isNotNull(), "entered").when(F.col("_entry_at") <= mark, "expired").otherwise("pending")
    return _result(joined, signals.columns, status)
