"""Equity curves and drawdowns from trade tables.

Curves have one row per (strategy, session); windows over them are bounded by
the number of sessions. Trades themselves are only ever aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.sessions import small

MONEY = "decimal(28,2)"


def _every_session(strategies: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Each strategy with each session, unfolded from the calendar's ordinal range."""
    last = calendar.agg(F.max("ord")).scalar()
    grid = strategies.select(key).distinct().withColumn("ord", F.explode(F.sequence(F.lit(1), last)))
    return grid.join(small(calendar.select("ord", "session")), "ord")


def realized_equity(
    trades: DataFrame, calendar: DataFrame, capital: float, key: str = "strategy_id", strategies: DataFrame | None = None
) -> DataFrame:
    """Capital plus profit of trades closed up to each session, for every one of ``strategies``.

    Without that list the strategies are those with a trade. One without trades stays at the capital.
    """
    daily = trades.groupBy(key, F.col("exit_ord").alias("ord")).agg(F.sum("gross_pnl").alias("pnl"))
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _every_session(trades if strategies is None else strategies, calendar, key)
        .join(daily, [key, "ord"], "left")
        .select(
            key,
            "ord",
            "session",
            (F.lit(capital).cast(MONEY) + F.coalesce(F.sum("pnl").over(order), F.lit(0))).cast(MONEY).alias("equity"),
        )
    )


def dense_closes(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Latest known close of each security on every session from its first bar on."""
    last = calendar.agg(F.max("ord")).scalar()
    placed = bars.join(small(calendar.select("session", "ord")), "session")
    following = F.lead("ord").over(Window.partitionBy("security_id").orderBy("ord"))
    until = F.coalesce(following - 1, last)
    return placed.withColumn("until", until).select(
        "security_id",
        F.col("close").cast("decimal(12,2)").alias("close"),
        F.explode(F.sequence(F.col("ord"), F.col("until"))).alias("ord"),
    )


def equity_curve(
    trades: DataFrame, bars: DataFrame, calendar: DataFrame, capital: float, strategies: DataFrame | None = None
) -> DataFrame:
    """Cash, marked position value, equity and deployed fraction per session.

    A trade is open from its entry through the session before its exit. Trades
    with equal (strategy, security, entry, exit) are summed before they are
    unfolded over the sessions they are open, so a hot security contributes at
    most (strategies x sessions x holding length) rows.
    """
    notional = F.col("quantity").cast("decimal(10,0)")
    flows = trades.select(
        "strategy_id",
        F.explode(
            F.array(
                F.struct(F.col("entry_ord").alias("ord"), (-notional * F.col("entry_price")).cast(MONEY).alias("amount")),
                F.struct(F.col("exit_ord").alias("ord"), (notional * F.col("exit_price")).cast(MONEY).alias("amount")),
            )
        ).alias("f"),
    ).groupBy("strategy_id", F.col("f.ord").alias("ord")).agg(F.sum("f.amount").alias("flow"))
    held = (
        trades.where(F.col("exit_ord") > F.col("entry_ord"))
        .groupBy("strategy_id", "security_id", "entry_ord", "exit_ord")
        .agg(F.sum("quantity").alias("qty"))
        .select(
            "strategy_id", "security_id", "qty",
            F.explode(F.sequence(F.col("entry_ord"), F.col("exit_ord") - 1)).alias("ord"),
        )
        .groupBy("strategy_id", "security_id", "ord")
        .agg(F.sum("qty").alias("qty"))
    )
    value = (
        held.join(dense_closes(bars, calendar), ["security_id", "ord"])
        .groupBy("strategy_id", "ord")
        .agg(F.sum(F.col("qty").cast("decimal(12,0)") * F.col("close")).alias("value"))
    )
    order = Window.partitionBy("strategy_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast(MONEY)
    curve = (
        _every_session(trades if strategies is None else strategies, calendar, "strategy_id")
        .join(flows, ["strategy_id", "ord"], "left")
        .join(value, ["strategy_id", "ord"], "left")
        .withColumn("cash", (F.lit(capital).cast(MONEY) + F.coalesce(F.sum("flow").over(order), zero)).cast(MONEY))
        .withColumn("position_value", F.coalesce(F.col("value"), zero).cast(MONEY))
        .withColumn("equity", (F.col("cash") + F.col("position_value")).cast(MONEY))
    )
    return curve.select(
        "strategy_id", "ord", "session", "cash", "position_value", "equity",
        safe_ratio(F.col("position_value"), F.col("equity")).alias("deployed_fraction"),
    )


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Double quotient; zero where the divisor is zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_drawdown(
    curve: DataFrame, keys: Sequence[str], order: str, value: str = "equity", start: Column | None = None
) -> DataFrame:
    """Running peak, drawdown fraction and drawdown in money.

    ``start`` puts a starting capital before the first row; without it the
    peak begins at the first value.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.max(value).over(frame)
    if start is not None:
        peak = F.greatest(peak, start)
    v = F.col(value)
    return (
        curve.withColumn("peak", peak)
        .withColumn("drawdown", F.when(F.col("peak") > 0, 1 - v.cast("double") / F.col("peak").cast("double")))
        .withColumn("drawdown_money", F.col("peak") - v)
    )


def curve_summary(curve: DataFrame, keys: Sequence[str], capital: Column, start: Column | None = None) -> DataFrame:
    """Ending equity, profit, return, worst drawdowns and profit/drawdown per key."""
    deep = with_drawdown(curve, keys, "session", start=start)
    out = deep.groupBy(*keys).agg(
        F.max_by("equity", "session").alias("ending_equity"),
        F.max("drawdown").alias("maximum_drawdown"),
        F.max("drawdown_money").alias("maximum_drawdown_money"),
        F.max(capital).alias("starting_capital"),
    )
    profit = F.col("ending_equity") - F.col("starting_capital")
    gain = profit.cast("double") / F.col("starting_capital").cast("double")
    return (
        out.withColumn("gross_profit", profit)
        .withColumn("gross_return", gain)
        .withColumn(
            "profit_drawdown",
            F.when(F.col("maximum_drawdown") != 0, F.col("gross_return") / F.col("maximum_drawdown")),
        )
    )
