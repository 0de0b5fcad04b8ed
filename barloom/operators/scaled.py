"""Order-dependent operators that stay distributed when one key is hot.

A plain window over a hot key would put the whole key into one task. These
forms cut each key into buckets along the order, work inside the buckets, and
add what earlier buckets contribute from one summary row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows of one task of a job by key; a window job over bars takes about 2 KB of memory a row.
ROWS_PER_TASK = 1 << 17


def dealt_by(df: DataFrame, keys: Sequence[str], rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt by key into as many tasks as ``rows``, a bound of their number, needs.

    Adaptive execution joins small shuffle partitions by their compressed bytes, however much memory the
    windows behind them take a row. A number that is named stays, so a task's memory does not grow with the input.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))
    return df.repartition(tasks, *keys)


def bucketed_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Running sums (inclusive) per key in ``order``; ``bucket`` must be monotone in it.

    ``sums`` maps output names to the summed columns; ``lit(1)`` gives a rank.
    """
    b = "_bucket"
    rows = df.withColumn(b, bucket)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
    local = named.select("*", *[F.sum(f"_s_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    # Bucket totals come from the same rows: both sides of the join read one exchange.
    totals = local.groupBy(*keys, b).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, b)],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    condition = reduce(lambda a, k: a & k, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, b)])
    return local.join(offsets, condition).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def value_buckets(counts: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Distinct values ``_v`` with a bucket ``_b`` in their order that holds about as many of them as any other.

    The cuts are quantiles of the distinct values from a mergeable sketch, so neither a long tail nor values
    crowded in one place fill a bucket. A cut that is somewhat off changes sizes only, never the order.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, 10 * buckets).alias("_cuts"), F.sum("_n").alias("_total")
    )
    number = F.size(F.filter("_cuts", lambda cut: cut < F.col("_v")))
    return counts.join(cuts, list(keys)).withColumn("_b", number).drop("_cuts")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", buckets: int = 128) -> DataFrame:
    """Exact median per key without gathering a key's values in one task.

    Equal values are counted first. The counts are then split into buckets of about equally many values;
    only the one or two buckets that hold the middle positions are ordered.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    spread = value_buckets(counts, keys, buckets)
    per_bucket = spread.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        *[F.col(k) for k in keys], "_b", "_bn", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_start")
    )
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    held = spread.join(starts, [*keys, "_b"]).where(
        (F.col("_start") < high) & (F.col("_start") + F.col("_bn") >= low)
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.withColumn("_end", F.col("_start") + F.sum("_n").over(inside)).withColumn(
        "_begin", F.col("_end") - F.col("_n")
    )

    def at(position):
        return F.max(F.when((F.col("_begin") < position) & (F.col("_end") >= position), F.col("_v")))

    return placed.groupBy(*keys).agg(((at(low).cast("double") + at(high).cast("double")) / 2).alias(out))
