"""Independent leaderboards, selections and rank comparisons.

These tables have one row per strategy (and window): their size is that of the
strategy grid, so ranking windows over them are small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.equity import curve_summary
from barloom.operators.metrics import result_status
from barloom.operators.sessions import small

AXES = ("profit", "drawdown", "ratio")
AXIS_LABELS = {"profit": "Gross profit", "drawdown": "Lowest maximum drawdown", "ratio": "Profit/drawdown"}


def window_results(trades: DataFrame, split: DataFrame, capital: Column, strategies: DataFrame) -> DataFrame:
    """Result per (window, strategy) of trades entered inside the window.

    The field is ``strategies`` in every window: each opens it at the capital, so one without trades
    has no profit, no drawdown and a rank like any other. Trades of strategies outside the list don't count.
    """
    kinds = split.select(F.col("session").alias("entry_session"), "kind")
    keys = ["kind", "strategy_id"]
    field = strategies.select("strategy_id").distinct()
    windows = split.groupBy("kind").agg(F.min("session").alias("session"))
    windows = windows.agg(F.collect_list(F.struct("kind", "session")).alias("w")).select("w").scalar()
    opening = field.select("strategy_id", F.inline(windows)).select(*keys, "session", F.lit(0).alias("gross_pnl"), F.lit(0).alias("n"))
    closing = trades.join(small(kinds), "entry_session").join(field, "strategy_id", "left_semi")
    closing = closing.select(*keys, F.col("exit_session").alias("session"), "gross_pnl", F.lit(1).alias("n"))
    daily = (
        closing.unionByName(opening)
        .groupBy(*keys, "session")
        .agg(F.sum("gross_pnl").alias("pnl"), F.sum("n").alias("closed"))
    )
    order = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = daily.withColumn("equity", (capital + F.sum("pnl").over(order)).cast("decimal(28,2)"))
    summary = result_status(curve_summary(curve, keys, capital, start=capital))
    counts = daily.groupBy(*keys).agg(F.sum("closed").alias("trades"))
    return summary.join(counts, keys).withColumn("identity", F.sha2("strategy_id", 256))


def leaderboards(metrics: DataFrame, keys: Sequence[str] = ("kind",), tie: str = "identity") -> DataFrame:
    """Unique ranks on each axis; ties are broken by identity, never shared."""
    status = (
        F.when(F.col("profit_drawdown_status") == "positive_return_no_drawdown", 0)
        .when(F.col("profit_drawdown_status") == "defined", 1)
        .otherwise(2)
    )
    by = Window.partitionBy(*keys)
    orders = {
        "profit": [F.col("gross_profit").desc(), tie],
        "drawdown": [F.col("maximum_drawdown").asc(), tie],
        "ratio": [status.asc(), F.coalesce("profit_drawdown", F.lit(0.0)).desc(), tie],
    }
    return metrics.select(
        "*", *[F.row_number().over(by.orderBy(*o)).alias(f"{axis}_rank") for axis, o in orders.items()]
    )


def top_of_axis(ranked: DataFrame, axis: str, n: int = 5) -> DataFrame:
    return ranked.where(F.col(f"{axis}_rank") <= n)


def top_union(ranked: DataFrame, n: int = 5) -> DataFrame:
    """Every strategy in the top ``n`` of any axis, with its full-field ranks."""
    return ranked.where(reduce(lambda a, b: a | b, [F.col(f"{a}_rank") <= n for a in AXES]))


def compare_windows(ranked: DataFrame, left: str, right: str) -> DataFrame:
    """One row per strategy with both windows side by side; a missing side is flagged."""

    def side(kind, prefix):
        rows = ranked.where(F.col("kind") == kind)
        return rows.select(
            "strategy_id", "identity", *[F.col(f"{a}_rank").alias(f"{prefix}_{a}_rank") for a in AXES],
            F.col("trades").alias(f"{prefix}_trades"), F.col("gross_profit").alias(f"{prefix}_profit"),
        )

    both = side(left, "development").join(side(right, "validation"), ["strategy_id", "identity"], "full_outer")
    return both.withColumn(
        "aligned", F.col("development_profit_rank").isNotNull() & F.col("validation_profit_rank").isNotNull()
    )


def _shared(axis: str, n: int) -> Column:
    return F.coalesce(
        (F.col(f"development_{axis}_rank") <= n) & (F.col(f"validation_{axis}_rank") <= n), F.lit(False)
    )


def selection_options(wide: DataFrame, top: int = 5, shared_top: int = 20) -> DataFrame:
    """A: any validation rank in the top; B: two of three; C: same axis in both windows' wider top."""
    hits = [(F.col(f"validation_{a}_rank") <= top).cast("int") for a in AXES]
    count = reduce(lambda a, b: a + b, hits)
    either = reduce(lambda a, b: a | b, [_shared(a, shared_top) for a in AXES])
    tags = F.array_compact(
        F.array(F.when(count >= 1, "A"), F.when(count >= 2, "B"), F.when(either, "C"))
    )
    return wide.withColumn("option", F.explode(tags)).select("option", "strategy_id", "identity")


def rank_scatter(wide: DataFrame, shared_top: int = 20) -> DataFrame:
    """One row per (strategy, axis) with both ranks and the shared mark."""
    rows = F.array(
        *[
            F.struct(
                F.lit(AXIS_LABELS[a]).alias("metric"),
                F.col(f"development_{a}_rank").alias("development_rank"),
                F.col(f"validation_{a}_rank").alias("validation_rank"),
                F.when(_shared(a, shared_top), "Yes").otherwise("No").alias("shared"),
            )
            for a in AXES
        ]
    )
    return wide.select(
        "strategy_id",
        F.substring("identity", 1, 12).alias("identity_prefix"),
        "development_trades",
        "validation_trades",
        F.explode(rows).alias("r"),
    ).select("strategy_id", "identity_prefix", "development_trades", "validation_trades", "r.*")


def continuity(wide: DataFrame, shared_top: int = 20) -> DataFrame:
    """Per axis: how many of the top stay in the top in the other window."""
    counts = wide.agg(*[F.count_if(_shared(a, shared_top)).alias(a) for a in AXES])
    rows = []
    for a in AXES:
        for label, value in (("Shared top", F.col(a)), ("Not shared", F.lit(shared_top) - F.col(a))):
            rows.append(
                F.struct(F.lit(AXIS_LABELS[a]).alias("metric"), F.lit(label).alias("continuity"), value.alias("revisions"))
            )
    return counts.select(F.inline(F.array(*rows)))


def shared_sets(wide: DataFrame, n: int = 20) -> DataFrame:
    """Strategies shared on any axis, with the axes they share."""
    axes = F.array_compact(F.array(*[F.when(_shared(a, n), a) for a in AXES]))
    return wide.select("strategy_id", axes.alias("axes")).where(F.size("axes") > 0)


def spearman(wide: DataFrame) -> DataFrame:
    """Rank correlation between the windows, one row per axis."""
    corr = [F.corr(f"development_{a}_rank", f"validation_{a}_rank").alias(a) for a in AXES]
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("rho")) for a in AXES])
    return wide.where("aligned").agg(*corr).select(F.inline(pairs))


def sign_agreement(wide: DataFrame) -> DataFrame:
    """How often profit has the same sign in both windows."""

    def sign(col):
        return F.when(F.col(col) > 0, "positive").otherwise("not_positive")

    return (
        wide.where("aligned")
        .groupBy(sign("development_profit").alias("development"), sign("validation_profit").alias("validation"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
