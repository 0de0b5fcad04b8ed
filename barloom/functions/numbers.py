"""Number coercion and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lenient_decimal(text: str) -> Column:
    """Decimal or null: what a read model uses for one bad value."""
    return F.expr(f"try_cast({text} AS decimal(28,6))")


def basis_points(ratio: Column) -> Column:
    return F.round(ratio * 10000).cast("int")


def ratio_or_null(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio_or_null(top, bottom), F.lit(0.0))


def numeric_projection(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listed text columns as doubles, everything else untouched, null kept."""
    wanted = set(columns)
    return df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in wanted else F.col(c) for c in df.columns])
