"""Small presentation helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def present(df: DataFrame, digits: int | None = None, **rounding: int) -> DataFrame:
    """Stable output types: dates as text, counts as bigint, decimals as double.

    ``digits`` rounds every double; ``rounding`` overrides it per column.
    """
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType,)):
            col = col.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
            places = rounding.get(field.name, digits)
            if places is not None:
                col = F.round(col, places)
        out.append(col.alias(field.name))
    return df.select(*out)
