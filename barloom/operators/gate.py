"""Gate before a session is recorded: what its inputs lack, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

PRICES = ("open", "high", "low", "close", "volume")


def session_violations(frames: DataFrame, roster: DataFrame, coverage: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(as_of, security_id, problem) for each delivered session ``as_of`` of ``snapshots``.

    ``frames`` holds bars with the ``as_of`` they were delivered for, ``coverage`` the intervals
    [``start``, ``end``) a security's schedule covers, ``snapshots`` one row per ``as_of`` with the
    ``snapshot_session`` of the schedule. Each security of the roster must have a bar on ``as_of``, none
    after it, none twice, none with a missing value, and be covered; the snapshot must be of that day
    (``snapshot_date``, without a security). Bars of securities outside the roster do not matter.

    Bars are counted by session before the keys are joined. A batch has few sessions: the roster is
    unfolded over those, so the work is securities x sessions delivered.
    """
    broken = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in PRICES])
    per_session = frames.groupBy("as_of", "security_id", "session").agg(
        F.count(F.lit(1)).alias("n"), F.max(broken).alias("broken")
    )
    at = F.col("session")
    seen = per_session.groupBy("as_of", "security_id").agg(
        F.max(at).alias("newest"), F.max(F.when(at <= F.col("as_of"), at)).alias("last"),
        F.max(F.col("n") > 1).alias("repeated"), F.max("broken").alias("broken"), F.max(at.isNull()).alias("undated"),
    )
    sessions = snapshots.groupBy("as_of").agg(F.max("snapshot_session").alias("snapshot_session"))
    days = sessions.agg(F.collect_list("as_of").alias("d")).select("d").scalar()
    wanted = roster.select("security_id").distinct().withColumn("as_of", F.explode(days))
    spans = coverage.join(roster.select("security_id").distinct(), "security_id", "left_semi")
    covered = (
        spans.withColumn("as_of", F.explode(days))
        .where((F.col("start") <= F.col("as_of")) & (F.col("as_of") < F.col("end")))
        .select("as_of", "security_id")
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    keys = ["as_of", "security_id"]
    rows = wanted.join(seen, keys, "left").join(covered, keys, "left")
    empty = F.col("newest").isNull() & F.col("undated").isNull()
    problems = _named(
        no_data=empty,
        last_bar=~empty & ~F.col("last").eqNullSafe(F.col("as_of")),
        later_rows=F.col("newest") > F.col("as_of"),
        repeated_session=F.col("repeated"),
        missing_value=F.col("broken") | F.col("undated"),
        not_covered=F.col("covered").isNull(),
    )
    other = sessions.where(~F.col("snapshot_session").eqNullSafe(F.col("as_of")))
    dated = other.select("as_of", F.lit(None).cast("string").alias("security_id"), F.lit("snapshot_date").alias("problem"))
    return rows.select(*keys, F.explode(problems).alias("problem")).unionByName(dated)


def _named(**checks: Column) -> Column:
    return F.array_compact(F.array(*[F.when(failed, name) for name, failed in checks.items()]))


def gated(violations: DataFrame):
    """A check for ``ForwardLedger.offer``: sessions with a violation are refused."""

    def check(batch: DataFrame) -> DataFrame:
        return violations.select(F.col("as_of").alias("session")).distinct()

    return check
