"""Performance metrics of strategies from candidates, trades and curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.dates import month_key
from barloom.operators.equity import curve_summary, with_drawdown
from barloom.operators.scaled import exact_median


def result_status(df: DataFrame) -> DataFrame:
    """Three-state profit/drawdown status next to the ratio."""
    flat = F.col("maximum_drawdown") == 0
    return df.withColumn(
        "profit_drawdown_status",
        F.when(flat & (F.col("gross_return") > 0), "positive_return_no_drawdown")
        .when(flat, "undefined")
        .otherwise("defined"),
    )


def core_result(curve: DataFrame, capital: Column, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Ending equity, profit, return and drawdown; the path starts at the capital."""
    return result_status(curve_summary(curve, keys, capital, start=capital))


def turnover(orders: DataFrame, curve: DataFrame, capital: Column) -> DataFrame:
    """Dollars turned over, turnover, profit per dollar and break-even cost.

    Entry notional comes from filled orders, exit notional from their trades.
    """
    q = F.col("quantity").cast("decimal(10,0)")
    filled = F.col("status") == "filled"
    dollars = orders.where(filled).groupBy("strategy_id").agg(
        F.sum((q * F.col("entry_price")).cast("decimal(28,2)")).alias("entry_notional"),
        F.sum((q * F.col("exit_price")).cast("decimal(28,2)")).alias("exit_notional"),
    )
    book = curve.groupBy("strategy_id").agg(
        F.sum("equity").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max_by("equity", "session").alias("_end")
    )
    joined = book.join(dollars, "strategy_id", "left").withColumn(
        "turned_over",
        (F.coalesce("entry_notional", F.lit(0)) + F.coalesce("exit_notional", F.lit(0))).cast("decimal(28,2)"),
    )
    total = F.col("turned_over").cast("double")
    mean = F.col("_sum").cast("double") / F.col("_n")
    profit = (F.col("_end") - capital).cast("double")
    per_dollar = F.try_divide(profit, total)
    return joined.select(
        "strategy_id",
        "turned_over",
        F.try_divide(total, 2 * mean).alias("turnover"),
        per_dollar.alias("profit_per_dollar"),
        F.when(total == 0, "undefined_no_turnover")
        .when(profit > 0, "defined")
        .otherwise("not_applicable_nonpositive_profit")
        .alias("break_even_status"),
        F.when(profit > 0, per_dollar).alias("break_even_cost"),
    )


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, total, mean, exact median, minimum and maximum of one value."""
    v = F.col(value)
    basic = df.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.coalesce(F.sum(v), F.lit(0)).alias("total"),
        (F.sum(v).cast("double") / F.count(v)).alias("mean"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
    )
    return basic.join(exact_median(df, keys, value), list(keys), "left")


def trade_distributions(trades: DataFrame) -> DataFrame:
    """Winners, losers and holding sessions of each strategy, stacked."""
    pnl = F.col("gross_pnl")
    held = (F.col("exit_ord") - F.col("entry_ord") + 1).cast("decimal(18,2)")
    stacked = trades.select(
        "strategy_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(pnl > 0, F.struct(F.lit("winners").alias("kind"), pnl.alias("value"))),
                    F.when(pnl < 0, F.struct(F.lit("losers").alias("kind"), pnl.alias("value"))),
                    F.struct(F.lit("holding_sessions").alias("kind"), held.alias("value")),
                )
            )
        ).alias("d"),
    ).select("strategy_id", "d.kind", "d.value")
    return distribution(stacked, ["strategy_id", "kind"], "value")


def concentration(trades: DataFrame) -> DataFrame:
    """Profit by entry session, entry month, exit session, security and symbol in one pass."""
    rows = trades.select(
        "strategy_id",
        "gross_pnl",
        F.col("entry_session").cast("string").alias("entry_session"),
        month_key(F.col("entry_session")).alias("entry_month"),
        F.col("exit_session").cast("string").alias("exit_session"),
        "security_id",
        "symbol",
    )
    names = ["entry_session", "entry_month", "exit_session", "security_id", "symbol"]
    sets = [["strategy_id", n] for n in names]
    grouped = rows.groupingSets(sets, "strategy_id", *names).agg(
        F.sum("gross_pnl").alias("gross_pnl"), *[F.grouping(n).alias(f"_{n}") for n in names]
    )
    kind = value = None
    for n in names:
        used = F.col(f"_{n}") == 0
        kind = F.when(used, n) if kind is None else kind.when(used, n)
        value = F.when(used, F.col(n)) if value is None else value.when(used, F.col(n))
    return grouped.select("strategy_id", kind.alias("kind"), value.alias("key"), "gross_pnl")


def order_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("status") == "filled").alias("filled"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def rejections(orders: DataFrame) -> DataFrame:
    return orders.where("status = 'rejected'").groupBy("strategy_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def signal_sets(candidates: DataFrame) -> DataFrame:
    """Distinct (strategy, security, signal session) with a filled mark."""
    return candidates.groupBy("strategy_id", "security_id", "signal_session").agg(
        F.bool_or(F.col("status") == "filled").alias("filled")
    )


def exposure(curve: DataFrame) -> DataFrame:
    return curve.groupBy("strategy_id").agg(
        F.avg("deployed_fraction").alias("mean"), F.max("deployed_fraction").alias("maximum")
    )


def yearly(trades: DataFrame, curve: DataFrame, capital: Column) -> DataFrame:
    """Marked and realized result per calendar year; each year's path includes its start."""
    keys = ["strategy_id", "year"]
    eq = curve.withColumn("year", F.year("session"))
    ends = eq.groupBy(*keys).agg(F.max_by("equity", "session").alias("last_equity"))
    closed = trades.groupBy("strategy_id", F.year("exit_session").alias("year")).agg(
        F.sum("gross_pnl").alias("realized"), F.count(F.lit(1)).alias("trade_count")
    )
    years = ends.join(closed, keys, "full_outer")
    before = Window.partitionBy("strategy_id").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.withColumn(
        "starting_equity", F.coalesce(F.last("last_equity", ignorenulls=True).over(before), capital)
    ).withColumn("ending_equity", F.coalesce("last_equity", "starting_equity"))
    deep = with_drawdown(
        eq.join(years.select(*keys, "starting_equity"), keys), keys, "session", start=F.col("starting_equity")
    )
    worst = deep.groupBy(*keys).agg(F.max("drawdown").alias("maximum_drawdown"))
    profit = F.col("ending_equity") - F.col("starting_equity")
    return years.join(worst, keys, "left").select(
        *keys,
        "starting_equity",
        "ending_equity",
        profit.alias("gross_profit"),
        (profit.cast("double") / F.col("starting_equity").cast("double")).alias("gross_return"),
        F.coalesce("realized", F.lit(0)).alias("realized"),
        F.coalesce("maximum_drawdown", F.lit(0.0)).alias("maximum_drawdown"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
    )


def reconciliation(orders: DataFrame, trades: DataFrame, curve: DataFrame, capital: Column) -> DataFrame:
    """Does the book add up? One row of booleans per strategy; without trades or orders their sums are zero."""
    sums = trades.groupBy("strategy_id").agg(
        F.sum("gross_pnl").alias("pnl"), F.count(F.lit(1)).alias("trades")
    )
    ending = curve.groupBy("strategy_id").agg(F.max_by("equity", "session").alias("ending"))
    counts = order_counts(orders)

    def or_zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return (
        ending.join(sums, "strategy_id", "left")
        .join(counts, "strategy_id", "left")
        .select(
            "strategy_id",
            (F.col("ending") == capital + or_zero("pnl")).alias("ending_matches"),
            (or_zero("filled") == or_zero("trades")).alias("fills_match"),
            (or_zero("orders") == or_zero("filled") + or_zero("rejected")).alias("orders_covered"),
        )
    )


def invariants(orders: DataFrame, trades: DataFrame, curve: DataFrame, capital: Column) -> DataFrame:
    """Metric constraints as rows: (strategy, rule, holds); without orders or trades their counts are zero."""
    core = core_result(curve, capital)
    counts = order_counts(orders)
    pnl = F.col("gross_pnl")
    mix = trades.groupBy("strategy_id").agg(
        F.count_if(pnl > 0).alias("w"), F.count_if(pnl < 0).alias("l"), F.count_if(pnl == 0).alias("f"),
        F.count(F.lit(1)).alias("t"), F.sum(pnl).alias("total"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0)).alias("gains"), F.sum(F.when(pnl < 0, pnl).otherwise(0)).alias("losses"),
    )
    joined = core.join(counts, "strategy_id", "left").join(mix, "strategy_id", "left")
    joined = joined.fillna(0, ["orders", "filled", "rejected", "w", "l", "f", "t", "total", "gains", "losses"])
    checks = {
        "drawdown_not_negative": F.col("maximum_drawdown") >= 0,
        "profit_reconciles": F.col("gross_profit") == F.col("ending_equity") - F.col("starting_capital"),
        "counts_cover": F.col("orders") == F.col("filled") + F.col("rejected"),
        "trades_are_fills": F.col("filled") == F.col("t"),
        "outcomes_cover": F.col("t") == F.col("w") + F.col("l") + F.col("f"),
        "gains_and_losses_sum": F.col("total") == F.col("gains") + F.col("losses"),
        "ratio_matches_status": (F.col("profit_drawdown_status") == "defined") == F.col("profit_drawdown").isNotNull(),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("holds")) for k, v in checks.items()])
    return joined.select("strategy_id", F.explode(pairs).alias("c")).select("strategy_id", "c.rule", "c.holds")
