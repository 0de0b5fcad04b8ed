"""Running book state per strategy."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = (
    "sessions", "exposed_sessions", "closed_trades", "candidates", "turnover_c", "equity_c", "peak_c",
    "max_drawdown", "max_drawdown_c",
)
OUTPUT = (
    "strategy_id string, session date, sessions bigint, exposed_sessions bigint, closed_trades bigint, candidates bigint, "
    "turnover_c bigint, equity_c bigint, peak_c bigint, max_drawdown double, max_drawdown_c bigint"
)
STATE = (
    "sessions bigint, exposed_sessions bigint, closed_trades bigint, candidates bigint, turnover_c bigint, equity_c bigint, "
    "peak_c bigint, max_drawdown double, max_drawdown_c bigint"
)


class BookKeeper(StatefulProcessor):
    """Updates a strategy's book with each session row (money in cents)."""

    def __init__(self, capital_c: int):
        self.capital_c = capital_c

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = pd.concat(list(rows)).sort_values("session", kind="stable")
        if self.book.exists():
            book = dict(zip(FIELDS, self.book.get()))
        else:
            book = dict.fromkeys(FIELDS, 0) | {"equity_c": self.capital_c, "peak_c": self.capital_c, "max_drawdown": 0.0}
        peak = day["equity_c"].cummax().clip(lower=book["peak_c"])
        drop = peak - day["equity_c"]
        fraction = (1 - day["equity_c"].astype(float) / peak.astype(float)).where(peak != 0, 0.0)
        sessions = range(book["sessions"] + 1, book["sessions"] + 1 + len(day))
        out = pd.DataFrame(
            {
                "strategy_id": key[0],
                "session": day["session"].to_numpy(),
                "sessions": list(sessions),
                "exposed_sessions": book["exposed_sessions"] + (day["open_positions"] > 0).cumsum().to_numpy(),
                "closed_trades": book["closed_trades"] + day["closed"].cumsum().to_numpy(),
                "candidates": book["candidates"] + day["candidates"].cumsum().to_numpy(),
                "turnover_c": book["turnover_c"] + day["turnover_c"].cumsum().to_numpy(),
                "equity_c": day["equity_c"].to_numpy(),
                "peak_c": peak.to_numpy(),
                "max_drawdown": fraction.cummax().clip(lower=book["max_drawdown"]).to_numpy(),
                "max_drawdown_c": drop.cummax().clip(lower=book["max_drawdown_c"]).to_numpy(),
            }
        )
        last = out.iloc[-1]
        self.book.update(
            tuple(float(last[f]) if f == "max_drawdown" else int(last[f]) for f in FIELDS)
        )
        yield out

    def close(self) -> None:
        pass


def keep_books(sessions: DataFrame, capital: Decimal | int) -> DataFrame:
    """Stream of books from a stream of per-session strategy rows."""
    return sessions.groupBy("strategy_id").transformWithStateInPandas(
        BookKeeper(int(capital * 100)), outputStructType=OUTPUT, outputMode="append", timeMode="none"
    )


def books_batch(sessions: DataFrame, capital: Column) -> DataFrame:
    """The same books as window aggregates over the whole ledger; ``capital`` in cents."""
    w = Window.partitionBy("strategy_id").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.greatest(F.max("equity_c").over(w), capital)
    deep = sessions.withColumn("peak_c", peak).withColumn(
        "_f", F.coalesce(1 - F.try_divide(F.col("equity_c").cast("double"), F.col("peak_c").cast("double")), F.lit(0.0))
    )
    return deep.select(
        "strategy_id",
        "session",
        F.count(F.lit(1)).over(w).alias("sessions"),
        F.sum((F.col("open_positions") > 0).cast("long")).over(w).alias("exposed_sessions"),
        F.sum("closed").over(w).alias("closed_trades"),
        F.sum("candidates").over(w).alias("candidates"),
        F.sum("turnover_c").over(w).alias("turnover_c"),
        "equity_c",
        "peak_c",
        F.greatest(F.max("_f").over(w), F.lit(0.0)).alias("max_drawdown"),
        F.max(F.col("peak_c") - F.col("equity_c")).over(w).alias("max_drawdown_c"),
    )


def session_rows(orders: DataFrame, curve: DataFrame) -> DataFrame:
    """Per (strategy, session) ledger rows from orders and an equity curve."""
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    filled = F.col("status") == "filled"
    q = F.col("quantity")
    entered = orders.groupBy("strategy_id", F.col("entry_session").alias("session")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum(F.when(filled, q * cents("entry_price"))).alias("_in"),
        F.count_if(filled).alias("_opened"),
    )
    left = orders.where(filled).groupBy("strategy_id", F.col("exit_session").alias("session")).agg(
        F.count(F.lit(1)).alias("closed"), F.sum(q * cents("exit_price")).alias("_out")
    )
    keys = ["strategy_id", "session"]
    w = Window.partitionBy("strategy_id").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    joined = curve.join(entered, keys, "left").join(left, keys, "left")
    return joined.select(
        *keys,
        cents("equity").alias("equity_c"),
        F.coalesce("closed", zero).alias("closed"),
        F.coalesce("candidates", zero).alias("candidates"),
        (F.coalesce("_in", zero) + F.coalesce("_out", zero)).alias("turnover_c"),
        F.sum(F.coalesce("_opened", zero) - F.coalesce("closed", zero)).over(w).alias("open_positions"),
    )
