"""Causal rolling features over bars.

All windows partition by security and order by session. Bars are unique on
(security, session), so one window partition is at most as long as the trading
calendar, however many prints stand behind it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.dates import month_start, week_end
from barloom.operators.sessions import small

# The vocabulary of features.
TIMEFRAMES = ("daily", "weekly", "monthly")
OPERATIONS = ("raw", "sma", "ema", "rolling_min", "rolling_max", "atr", "return")
SOURCES = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Feature:
    """One named feature: timeframe, operation, source column and lookback."""

    name: str
    timeframe: str
    operation: str
    source: str
    lookback: int

    def __post_init__(self):
        if (
            self.timeframe not in TIMEFRAMES
            or self.operation not in OPERATIONS
            or self.source not in SOURCES
            or self.lookback < 1
            or (self.operation == "raw" and self.lookback != 1)
        ):
            raise ValueError(f"unsupported feature {self}")


def rolling(how, value: Column, n: int, keys: Sequence, order: str, full_only: bool = True) -> Column:
    """``how`` over the last ``n`` rows; null until ``n`` values are there."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    result = how(value).over(frame)
    return F.when(F.count(value).over(frame) >= n, result) if full_only else result


def lag_return(value: Column, n: int, keys: Sequence, order: str) -> Column:
    return value / F.lag(value, n).over(Window.partitionBy(*keys).orderBy(order)) - 1


def true_range(high: Column, low: Column, close: Column, keys: Sequence, order: str) -> Column:
    """Largest of the bar range and both gaps to the previous close."""
    before = F.lag(close).over(Window.partitionBy(*keys).orderBy(order))
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


EMA_BLOCK = 256


def with_ema(
    df: DataFrame,
    value: Column,
    span: int,
    out: str,
    keys: Sequence[str],
    order: str,
    full_only: bool = True,
) -> DataFrame:
    """Exponential average ``y = a*x + (1-a)*y_prev`` started at the first value.

    One form for every span, over the whole history: values are numbered and
    cut into blocks of ``EMA_BLOCK``. Inside a block the average is a running sum
    of values weighted by r = 1-a to their distance; what earlier blocks
    contribute is folded from one sum per finished block. A null is no value: it
    repeats the last average and does not age it. ``full_only`` hides the first
    ``span - 1`` values.
    """
    alpha = 2.0 / (span + 1)
    r = 1.0 - alpha
    n, block, place, local, ends = (f"_{out}_{c}" for c in ("n", "block", "place", "local", "ends"))
    by_key = Window.partitionBy(*keys).orderBy(order)
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = value.cast("double")
    df = df.withColumn(n, F.count(x).over(upto))
    df = df.withColumn(block, F.floor((F.col(n) - 1) / EMA_BLOCK)).withColumn(place, F.pmod(F.col(n) - 1, F.lit(EMA_BLOCK)))
    if span == 1:
        y = F.last(x, ignorenulls=True).over(upto)
    else:
        weighted = F.when(F.col(n) == 1, x).otherwise(x * alpha) * F.pow(F.lit(1 / r), F.col(place))
        inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(local, F.sum(weighted).over(inside) * F.pow(F.lit(r), F.col(place)))
        end = F.when(x.isNotNull() & (F.col(place) == EMA_BLOCK - 1), F.col(local))
        df = df.withColumn(ends, F.collect_list(end).over(upto))
        finished = F.slice(ends, F.lit(1), F.col(block).cast("int"))
        carry = F.aggregate(finished, F.lit(0.0), lambda acc, s: acc * r**EMA_BLOCK + s)
        y = F.col(local) + F.when(F.col(block) > 0, carry * F.pow(F.lit(r), F.col(place) + 1)).otherwise(0.0)
    y = F.when(F.col(n) >= (span if full_only else 1), y)
    return df.withColumn(out, y).drop(n, block, place, local, ends)


def with_features(
    df: DataFrame,
    features: Iterable[Feature],
    columns: dict[str, str],
    keys: Sequence[str],
    order: str = "session",
) -> DataFrame:
    """Add the features of one timeframe; ``columns`` maps o/h/l/c/v to names in ``df``."""
    for f in features:
        x = F.col(columns[f.source])
        if f.operation == "raw":
            df = df.withColumn(f.name, x)
        elif f.operation == "sma":
            df = df.withColumn(f.name, rolling(F.avg, x, f.lookback, keys, order))
        elif f.operation == "rolling_min":
            df = df.withColumn(f.name, rolling(F.min, x, f.lookback, keys, order))
        elif f.operation == "rolling_max":
            df = df.withColumn(f.name, rolling(F.max, x, f.lookback, keys, order))
        elif f.operation == "return":
            df = df.withColumn(f.name, lag_return(x, f.lookback, keys, order))
        elif f.operation == "ema":
            df = with_ema(df, x, f.lookback, f.name, keys, order)
        else:
            tr = f"_{f.name}_tr"
            high, low, close = (F.col(columns[c]) for c in ("high", "low", "close"))
            df = df.withColumn(tr, true_range(high, low, close, keys, order))
            df = df.withColumn(f.name, rolling(F.avg, F.col(tr), f.lookback, keys, order)).drop(tr)
    return df


def average_dollar_volume(n: int, keys=("security_id",), order: str = "session") -> Column:
    return rolling(F.avg, F.col("close") * F.col("volume"), n, keys, order)


def feature_matrix(bars: DataFrame, calendar: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Daily rows with every feature and, per higher timeframe, its availability session.

    A completed week or month becomes visible on its own last observed
    session, and that session is itself a daily row. So higher-timeframe
    features are windows over the period-end rows among the daily rows, and
    alignment is ``last(..., ignorenulls)`` over the same security order: the
    whole matrix needs one exchange, by security.
    """
    bounds = calendar.select("session", "week_last", "month_last")
    by_security = Window.partitionBy("security_id").orderBy("session")
    df = bars.join(small(bounds), "session", "left")
    upto = by_security.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    daily = [f for f in features if f.timeframe == "daily"]
    identity = {c: c for c in SOURCES}
    for timeframe, period_of, last_col in (
        ("weekly", week_end, "week_last"),
        ("monthly", month_start, "month_last"),
    ):
        wanted = [f for f in features if f.timeframe == timeframe]
        if not wanted:
            continue
        key, ends = f"_{timeframe}", f"_{timeframe}_end"
        df = df.withColumn(key, period_of(F.col("session")))
        following = F.lead(key).over(by_security)
        df = df.withColumn(
            ends,
            F.when(following.isNull(), F.col("session") >= F.col(last_col)).otherwise(following != F.col(key)),
        )
        columns = dict(identity)
        needed = {f.source for f in wanted} | ({"high", "low"} if any(f.operation == "atr" for f in wanted) else set())
        inside = Window.partitionBy("security_id", key).orderBy("session").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        for source, how in (("open", F.first), ("high", F.max), ("low", F.min), ("volume", F.sum)):
            if source in needed:
                columns[source] = f"{key}_{source}"
                df = df.withColumn(columns[source], how(F.col(source)).over(inside))
        df = with_features(df, wanted, columns, ["security_id", ends])
        names = [f.name for f in wanted]
        packed = F.when(F.col(ends), F.struct(F.col("session").alias("available"), *names))
        seen = f"{key}_seen"
        df = df.withColumn(seen, F.last(packed, ignorenulls=True).over(upto)).drop(*names)
        for name in names:
            df = df.withColumn(name, F.col(f"{seen}.{name}"))
        df = df.withColumn(f"{timeframe}_available", F.col(f"{seen}.available"))
        df = df.drop(seen, key, ends, *[c for s, c in columns.items() if c != s])
    df = with_features(df, daily, identity, ["security_id"])
    return df.drop("week_last", "month_last")
