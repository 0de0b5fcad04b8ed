"""Backward as-of join: latest right row at or before each left row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    slice_of=None,
) -> DataFrame:
    """Attach ``values`` and ``right_on`` of the latest matching right row.

    Both sides are stacked and read in order; a right row sorts before left
    rows of the same moment, so exact matches count. ``slice_of`` (a function
    of the time column, for example a month) splits hot keys: rows are then
    windowed per (key, slice), and what earlier slices leave behind is joined
    back from one row per slice.
    """
    packed = F.struct(F.col(right_on), *[F.col(v) for v in values])
    moment, tag, hit, part = "_moment", "_tag", "_hit", "_slice"
    lefts = left.withColumn(moment, F.col(left_on)).withColumn(tag, F.lit(1))
    rights = right.select(*by, F.col(right_on).alias(moment), packed.alias(hit)).withColumn(tag, F.lit(0))
    rows = lefts.unionByName(rights, allowMissingColumns=True)
    keys = list(by)
    if slice_of is not None:
        rows = rows.withColumn(part, slice_of(F.col(moment)))
        keys.append(part)
    order = Window.partitionBy(*keys).orderBy(moment, tag).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn(hit, F.last(hit, ignorenulls=True).over(order)).where(F.col(tag) == 1)
    if slice_of is not None:
        last_of_slice = (
            right.withColumn(part, slice_of(F.col(right_on)))
            .groupBy(*by, part)
            .agg(F.max_by(packed, right_on).alias("_end"))
        )
        slices = rows.select(*keys).distinct().join(last_of_slice, keys, "left")
        before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(*keys, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        found = found.join(carried, keys, "left").withColumn(hit, F.coalesce(F.col(hit), F.col("_carry")))
        found = found.drop("_carry", part)
    picked = [F.col(f"{hit}.{c}").alias(c) for c in (right_on, *values)]
    return found.select(*left.columns, *picked)
