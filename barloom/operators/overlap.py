"""Overlap of signal sets between strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pair_intersections(memberships: DataFrame, keys: Sequence[str], member: str, by: Sequence[str] = ()) -> DataFrame:
    """How many keys each pair of members shares, without joining the facts to themselves.

    Keys with the same set of members are counted together first, so pairs are
    unfolded once per distinct member set and never per key. A set is at most
    as long as the list of strategies.
    """
    sets = (
        memberships.select(*by, *keys, member)
        .groupBy(*by, *keys)
        .agg(F.array_sort(F.collect_set(member)).alias("_set"))
        .groupBy(*by, "_set")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.size("_set") > 1)
    )
    left = sets.select(*by, "_set", "_n", F.posexplode("_set").alias("_i", "left_member"))
    pairs = left.select(
        *by, "left_member", "_n", F.explode(F.slice("_set", F.col("_i") + 2, F.size("_set"))).alias("right_member")
    )
    return pairs.groupBy(*by, "left_member", "right_member").agg(F.sum("_n").alias("intersection"))


def set_sizes(memberships: DataFrame, keys: Sequence[str], member: str, by: Sequence[str] = ()) -> DataFrame:
    distinct = memberships.select(*by, *keys, member).distinct()
    return distinct.groupBy(*by, member).agg(F.count(F.lit(1)).alias("size"))


def unordered_pairs(members: DataFrame, member: str, by: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of members, optionally inside groups such as a selection option.

    Member lists are strategies (grid-sized), gathered into one array per group.
    """
    lists = members.groupBy(*by).agg(F.array_sort(F.collect_set(member)).alias("_all"))
    left = lists.select(*by, "_all", F.posexplode("_all").alias("_i", "left_member"))
    return left.select(
        *by, "left_member", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("right_member")
    )


def jaccard(
    pairs: DataFrame,
    memberships: DataFrame,
    keys: Sequence[str],
    member: str,
    by: Sequence[str] = (),
    empty: Column | None = None,
) -> DataFrame:
    """Intersection, union and Jaccard ratio of every given pair.

    ``empty`` is the ratio of two empty sets: null unless given.
    """
    wanted = pairs.select(F.explode(F.array("left_member", "right_member")).alias(member)).distinct()
    rows = memberships.join(wanted, member, "left_semi")
    inter = pair_intersections(rows, keys, member, by)
    sizes = set_sizes(rows, keys, member, by)
    left = sizes.withColumnRenamed(member, "left_member").withColumnRenamed("size", "_l")
    right = sizes.withColumnRenamed(member, "right_member").withColumnRenamed("size", "_r")
    out = (
        pairs.join(inter, [*by, "left_member", "right_member"], "left")
        .join(left, [*by, "left_member"], "left")
        .join(right, [*by, "right_member"], "left")
        .fillna(0, ["intersection", "_l", "_r"])
        .withColumn("union", F.col("_l") + F.col("_r") - F.col("intersection"))
    )
    ratio = F.try_divide(F.col("intersection").cast("double"), F.col("union").cast("double"))
    if empty is not None:
        ratio = F.coalesce(ratio, empty)
    return out.withColumn("jaccard", ratio).drop("_l", "_r")


def overlap_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and maximum overlap in basis points; pairs without signals are skipped."""
    bp = lambda x: F.round(x * 10000).cast("int")
    return pairs.groupBy(*keys).agg(
        bp(F.avg("jaccard")).alias("mean_overlap_bp"),
        bp(F.max("jaccard")).alias("maximum_overlap_bp"),
        F.count(F.lit(1)).alias("pair_count"),
    )
