"""Append-only ledgers: replay, tails, segmentation, allotment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.asof import asof_backward
from barloom.operators.scaled import bucketed_running


def latest_state(rows: DataFrame, key: str, seq: str, position: str) -> DataFrame:
    """Row with the highest sequence per key; the first in file order wins ties.

    Rows without a key are skipped and an unreadable sequence counts as zero.
    ``max_by`` combines map-side, so a key with very many rows is no hot task.
    """
    number = F.coalesce(F.expr(f"try_cast({seq} AS bigint)"), F.lit(0))
    best = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(number, -F.col(position)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("s")).select(key, "s.*")


def stat_tiles(state: DataFrame) -> DataFrame:
    """Realized profit, open count, money deployed and win rate of the latest states."""
    closed = F.col("status") == "closed"
    opened = F.col("status") == "open"
    return state.agg(
        F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0)).alias("realized_pnl"),
        F.count_if(opened).alias("open_count"),
        F.coalesce(F.sum(F.when(opened, F.col("deployed"))), F.lit(0)).alias("deployed"),
        F.try_divide(
            F.count_if(closed & (F.col("pnl") > 0)).cast("double"), F.count_if(closed).cast("double")
        ).alias("win_rate"),
    )


def tail_rows(rows: DataFrame, order: str, n: int, newest_last: bool = True) -> DataFrame:
    """The newest ``n`` rows, newest last or first."""
    newest = rows.orderBy(F.col(order).desc()).limit(n)
    return newest.orderBy(F.col(order).asc() if newest_last else F.col(order).desc())


def restart_segments(rows: DataFrame, position: str, session: str, chunk: int = 1 << 20) -> DataFrame:
    """Number the runs of a file: a new run starts where the session does not advance."""
    part = F.floor(F.col(position) / chunk)
    inside = Window.partitionBy("_part").orderBy(position)
    stepped = rows.withColumn("_part", part).withColumn("_before", F.lag(session).over(inside))
    ends = stepped.groupBy("_part").agg(F.max_by(session, position).alias("_tail"))
    previous = ends.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_part"), F.col("_tail").alias("_carried")
    ).where(F.col("_part").isNotNull())
    linked = stepped.join(previous, "_part", "left")
    restart = F.col(session) <= F.coalesce("_before", "_carried")
    flagged = linked.withColumn("_restart", F.coalesce(restart, F.lit(False)).cast("long")).drop("_part", "_before", "_carried")
    return bucketed_running(flagged, [], [F.col(position)], part, {"segment": F.col("_restart")}).drop("_restart")


def ordered_allotment(owners: DataFrame, rows: DataFrame, owner: str, count: str, index: str, chunk: int = 1 << 20) -> DataFrame:
    """Give unlabelled rows to owners in order: the first ``count`` rows to the first owner and so on.

    An owner's range start is a running sum; rows find their range by a
    backward as-of lookup on the row index.
    """
    summed = bucketed_running(owners, [], [F.col(owner)], F.floor(F.col(owner) / chunk), {"_end": F.col(count)})
    starts = summed.where(F.col(count) > 0).select((F.col("_end") - F.col(count)).alias("_from"), owner)
    return asof_backward(
        rows, starts, [], index, "_from", [owner], slice_of=lambda moment: F.floor(moment / chunk)
    ).drop("_from")


def membership(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return rows.join(members.select(key), key, "left_semi")


def session_list(manifests: DataFrame, kinds: Column, limit: int) -> DataFrame:
    """Newest sessions first with their counts and whether every kind was written."""
    per = manifests.groupBy("session").agg(
        F.sum("records").alias("records"), (F.count_distinct("kind") == kinds).alias("complete")
    )
    return per.orderBy(F.col("session").desc()).limit(limit)
