"""Instruments behind symbols: exactly one eligible identifier for each, or a row that says why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.canonical import GLOBAL_ID
from barloom.functions.names import slash_class, symbol_key

# What counts as a listing in the United States.
SECURITY_TYPES = ("Common Stock", "Depositary Receipt", "Mutual Fund", "REIT")
EXCHANGES = ("NASDAQ", "NASDAQ OTC", "NYSE", "NYSE AMEX", "NYSE ARCA")
QUOTE_TYPES = ("Stock", "ETF")


def requested(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def is_mapped_listing(symbol: str = "symbol") -> Column:
    """A mapping row of the asked ticker: listed in the US, of an allowed type, both identifiers well formed."""
    return (
        (F.col("ticker") == slash_class(requested(F.col(symbol))))
        & (F.col("exchange_code") == "US")
        & F.col("security_type_2").isin(*SECURITY_TYPES)
        & F.col("share_class_id").rlike(GLOBAL_ID)
        & F.col("composite_id").rlike(GLOBAL_ID)
    )


def is_searched_listing(symbol: str = "symbol") -> Column:
    """A search hit of the asked symbol, separators aside: US flag, a known exchange, a stock or a fund."""
    kind = F.col("quote_type")
    return (
        (symbol_key(F.col("quote_symbol")) == symbol_key(requested(F.col(symbol))))
        & (F.upper("flag") == "USA")
        & F.upper("exchange").isin(*EXCHANGES)
        & (F.startswith(kind, F.lit(QUOTE_TYPES[0])) | F.startswith(kind, F.lit(QUOTE_TYPES[1])))
    )


def resolve_instruments(
    roster: DataFrame, rows: DataFrame, eligible: Column, identifier: str, details: Sequence[str], position: str
) -> DataFrame:
    """One row per symbol of the roster: status, matches, rejected rows, and the instrument where it is resolved.

    ``rows`` are the vendor's answers with the asked ``symbol``. A symbol is ``resolved`` if its eligible rows hold exactly
    one distinct identifier, ``ambiguous`` with more, ``unresolved`` with none, ``incomplete`` if an eligible row has a blank
    among the text columns ``details``. Of rows that repeat an identifier the last by ``position`` gives the details,
    ties by their values. Rows are counted by (symbol, identifier) before they meet, so a symbol with very many answers
    is no large group. Null conditions are not met; a null symbol is not asked.
    """
    chosen = F.when(F.coalesce(eligible, F.lit(False)), F.col(identifier))
    blank = F.lit(False)
    for name in details:
        blank = blank | F.coalesce(F.trim(name) == "", F.lit(True))
    tidy = [F.trim(name).alias(name) for name in details]
    answers = rows.select(
        requested(F.col("symbol")).alias("symbol"), chosen.alias(identifier), blank.alias("_blank"),
        F.struct(F.col(position).alias("_at"), *tidy).alias("_row"),
    )
    by_id = answers.groupBy("symbol", identifier).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_row").alias("_row"), F.bool_or("_blank").alias("_blank")
    )
    known = F.col(identifier).isNotNull()
    by_symbol = by_id.groupBy("symbol").agg(
        F.count(identifier).alias("matches"),
        F.sum(F.when(~known, F.col("_n")).otherwise(0)).alias("rejected"),
        F.bool_or(known & F.col("_blank")).alias("_blank"),
        F.min(F.when(known, F.struct(F.col(identifier), F.col("_row")))).alias("_one"),
    )
    asked = roster.select(requested(F.col("symbol")).alias("symbol")).where("symbol IS NOT NULL").distinct()
    matches = F.coalesce("matches", F.lit(0).cast("bigint"))
    status = (
        F.when(matches == 0, "unresolved").when(F.col("_blank"), "incomplete").when(matches > 1, "ambiguous").otherwise("resolved")
    )
    found = asked.join(by_symbol, "symbol", "left").withColumn("status", status)
    single = F.col("status") == "resolved"
    return found.select(
        "symbol", "status", matches.alias("matches"), F.coalesce("rejected", F.lit(0).cast("bigint")).alias("rejected"),
        F.when(single, F.col(f"_one.{identifier}")).alias(identifier),
        *[F.when(single, F.col(f"_one._row.{name}")).alias(name) for name in details],
    )


def unresolved_violations(resolved: DataFrame) -> DataFrame:
    """(symbol, status, matches) of all that must stop a build: what is not exactly one instrument."""
    return resolved.where("status <> 'resolved'").select("symbol", "status", "matches")
