"""Rosters, security masters and symbol histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.integrity import resolve_unique


def roster_violations(roster: DataFrame, column: str, declared: Column) -> DataFrame:
    """Symbols that are not unique upper-case text, and a count that does not match."""
    s = F.col(column)
    per = roster.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    bad = per.select(
        s.alias("symbol"),
        F.when(F.col("n") > 1, "duplicate").when((s != F.upper(F.trim(s))) | (s == ""), "not_canonical").alias("problem"),
    ).where("problem IS NOT NULL")
    total = roster.agg(F.count(F.lit(1)).alias("n"), declared.alias("want"))
    count = total.where(F.col("n") != F.col("want")).select(
        F.lit(None).cast("string").alias("symbol"), F.lit("count_mismatch").alias("problem")
    )
    return bad.unionByName(count)


def first_positions(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Order-preserving dedupe: each value at its first position."""
    return rows.groupBy(value).agg(F.min(position).alias(position))


def fill_plan(pool: DataFrame, taken: DataFrame, value: str, position: str, need: int) -> DataFrame:
    """The first ``need`` pool values in listed order that are not taken yet."""
    left = first_positions(pool, value, position).join(taken.select(value).distinct(), value, "left_anti")
    return left.orderBy(position, value).limit(need)


def security_master(responses: DataFrame, manifest: DataFrame, end_exclusive: Column) -> DataFrame:
    """Permanent id and half-open symbol interval per manifest symbol, with its problem if any.

    ``responses`` lists matching identifiers per symbol; exactly one must match,
    and an identifier may serve one symbol only. Uses of one identifier are
    counted by aggregation and joined back.
    """
    resolved = resolve_unique(responses, "symbol", "permanent_id")
    uses = resolved.where(F.col("permanent_id").isNotNull()).groupBy("permanent_id").agg(F.count(F.lit(1)).alias("uses"))
    joined = (
        manifest.join(resolved, "symbol", "left")
        .join(uses, "permanent_id", "left")
        .withColumn("end_exclusive", end_exclusive)
    )
    problem = (
        F.when(F.col("status").isNull(), "unresolved")
        .when(F.col("status") != "resolved", F.col("status"))
        .when(F.col("uses") > 1, "shared_id")
        .when(F.col("permanent_id") == F.col("symbol"), "id_is_ticker")
        .when(F.col("first_session") >= F.col("end_exclusive"), "empty_interval")
    )
    return joined.select(
        "symbol", "permanent_id", F.col("first_session").alias("start"), "end_exclusive", problem.alias("problem")
    )


def constant_coverage(securities: DataFrame, start: Column, end: Column) -> DataFrame:
    """One coverage interval per security."""
    return securities.select("security_id").distinct().select(
        "security_id", start.alias("coverage_start"), end.alias("coverage_end")
    )


def trade_payload(trades: DataFrame, candidates: DataFrame, geometry: DataFrame) -> DataFrame:
    """Trade with its candidate's facts (name to value text) and its planned levels."""
    facts = F.transform_values("signal_facts", lambda name, fact: fact["value"].cast("string"))
    told = candidates.select("candidate_id", "signal_session", facts.alias("facts"))
    return trades.join(told, "candidate_id", "left").join(
        geometry.select("candidate_id", "stop", "target"), "candidate_id", "left"
    )
