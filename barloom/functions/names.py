"""Text forms of symbols and strategy names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_symbol(text: Column) -> Column:
    """Trimmed upper-case symbol; null when blank or broken by white space."""
    tidy = F.upper(F.trim(text))
    return F.when((tidy != "") & ~tidy.rlike(r"\s"), tidy)


def slash_class(symbol: Column) -> Column:
    """Share class with a slash: BF-B becomes BF/B."""
    return F.replace(symbol, F.lit("-"), F.lit("/"))


def search_class(symbol: Column) -> Column:
    """Share class as a lower-case suffix: BF-B becomes BFb."""
    base, share = F.regexp_extract(symbol, r"^([^-]*)-(.*)$", 1), F.regexp_extract(symbol, r"^([^-]*)-(.*)$", 2)
    return F.when(F.contains(symbol, F.lit("-")), F.concat(base, F.lower(share))).otherwise(symbol)


def symbol_key(symbol: Column) -> Column:
    """Comparison key without separators."""
    return F.upper(F.regexp_replace(symbol, r"[-./]", ""))


def short_strategy_name(name: Column) -> Column:
    """Strategy name with its context abbreviated."""
    short = F.replace(name, F.lit("monthly-ema6-"), F.lit("M6-"))
    return F.replace(short, F.lit("weekly-ema13-"), F.lit("W13-"))


def slug(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)
