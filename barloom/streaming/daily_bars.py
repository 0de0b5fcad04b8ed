"""Ticks to daily bars as an event-time stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_bars(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One bar per (security, day), emitted only once the day is complete.

    ``ticks`` has ts, security_id, seq, price, size. A day closes when the
    watermark passes its end, so append output never shows a partial bar.
    """
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "security_id")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(F.to_date("window.start").alias("session"), "security_id", "open", "high", "low", "close", "volume")
    )
