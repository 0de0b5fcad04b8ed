"""First touch of stop, target or time limit after an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_forward_path(bars: DataFrame, hold: int, start: int = 0, out: str = "path") -> DataFrame:
    """Each bar with the ``hold`` bars from offset ``start`` on, as an array.

    The array is bounded by ``hold``; it turns the range join between entries
    and their following bars into an equality join on the entry bar. ``pos``
    numbers the security's bars.
    """
    order = Window.partitionBy("security_id").orderBy("session")
    bar = F.struct("pos", "session", "open", "high", "low", "close")
    ahead = F.array_compact(F.array(*[F.lead(bar, k).over(order) for k in range(start, start + hold)]))
    return bars.withColumn("pos", F.row_number().over(order)).withColumn(out, ahead).drop("pos")


def with_first_touch(df: DataFrame, hold: int, out: str = "exit", entered: Column | None = None) -> DataFrame:
    """Exit of each position (stop, target) entered at the open of ``path[0]``.

    Order on each bar: gap through the stop at the open, gap through the
    target at the open (both only on carried days), low at or below the stop,
    high at or above the target, close of the last allowed bar. ``out`` is a
    struct (held, session, reason, price), null while still open and where
    ``entered`` is false. Bars are valid (low <= open <= high), so a gap shows
    in the low or high too and the first bar of interest is found by those; the
    rest is worked out once, on that bar.
    """
    stop, target = F.col("stop"), F.col("target")
    start = F.try_element_at("path", F.lit(1))["pos"]
    hits = F.filter("path", lambda b: (b["low"] <= stop) | (b["high"] >= target) | (b["pos"] == F.col("_last")))
    first = F.try_element_at(hits, F.lit(1))
    found = df.withColumn("_last", start + (hold - 1)).withColumn(
        "_bar", first if entered is None else F.when(entered, first)
    )
    bar = F.col("_bar")
    held = bar["pos"] - F.col("_last") + hold
    carried = held > 1
    reason = (
        F.when(carried & (bar["open"] <= stop), "gap_stop")
        .when(carried & (bar["open"] >= target), "gap_target")
        .when(bar["low"] <= stop, "stop")
        .when(bar["high"] >= target, "target")
        .otherwise("time")
    )
    price = (
        F.when(carried & ((bar["open"] <= stop) | (bar["open"] >= target)), bar["open"])
        .when(bar["low"] <= stop, stop)
        .when(bar["high"] >= target, target)
        .otherwise(bar["close"])
    )
    exit_ = F.struct(held.alias("held"), bar["session"].alias("session"), reason.alias("reason"), price.alias("price"))
    return found.withColumn(out, F.when(bar.isNotNull(), exit_)).drop("_bar", "_last")


def full_window(path: Column, hold: int, end_exclusive: Column) -> Column:
    """All ``hold`` bars exist and the last one is before the range end."""
    last = F.try_element_at(path, F.lit(hold))["session"]
    return F.coalesce(last < end_exclusive, F.lit(False))


def label_outcomes(entries: DataFrame, bars: DataFrame, hold: int = 21) -> DataFrame:
    """Entries (security, entry_session, stop, target) with their exit columns.

    The entries of a bar are joined to it as one list before the path is made, so
    paths, ``hold`` times as wide as a bar, never cross the network.
    """
    opened = entries.groupBy("security_id", F.col("entry_session").alias("session")).agg(
        F.collect_list(F.struct(*[c for c in entries.columns if c != "security_id"])).alias("_entries")
    )
    ahead = with_forward_path(bars.join(opened, ["security_id", "session"], "left"), hold)
    each = ahead.where("_entries IS NOT NULL").select("security_id", "path", F.inline("_entries"))
    touched = with_first_touch(each, hold)
    return touched.select(
        *entries.columns,
        F.col("exit.session").alias("exit_session"),
        F.col("exit.reason").alias("exit_reason"),
        F.col("exit.price").alias("exit_price"),
        F.col("exit.held").alias("sessions_held"),
    )
