"""Cohorts: named sets of strategies whose books are added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.equity import MONEY, with_drawdown


def cohort_equity(members: DataFrame, curve: DataFrame, capital: float) -> DataFrame:
    """Sum of member equity per session with the number of members recorded."""
    return (
        members.join(curve, "strategy_id")
        .groupBy("cohort", "session")
        .agg(
            F.sum("equity").cast(MONEY).alias("equity"),
            F.count_distinct("strategy_id").alias("recorded"),
        )
        .join(cohort_sizes(members, capital), "cohort")
    )


def cohort_sizes(members: DataFrame, capital: float) -> DataFrame:
    sizes = members.groupBy("cohort").agg(F.count_distinct("strategy_id").alias("member_count"))
    return sizes.withColumn(
        "starting_capital", (F.col("member_count") * F.lit(capital).cast("decimal(18,2)")).cast(MONEY)
    )


def _curve_columns(deep: DataFrame) -> DataFrame:
    start = F.col("starting_capital").cast("double")
    return (
        deep.withColumn("normalized_index", F.coalesce(F.try_divide(F.col("equity").cast("double"), start), F.lit(0.0)) * 100)
        .withColumn("gross_return", F.try_divide(F.col("equity").cast("double"), start) - 1)
        .withColumn("drawdown", F.coalesce("drawdown", F.lit(0.0)))
    )


def cohort_curve(members: DataFrame, curve: DataFrame, capital: float) -> DataFrame:
    """Cohort curve whose peak starts at the first value."""
    deep = with_drawdown(cohort_equity(members, curve, capital), ["cohort"], "session")
    return _curve_columns(deep).drop("recorded", "drawdown_money")


def forward_cohort_curve(members: DataFrame, curve: DataFrame, capital: float) -> DataFrame:
    """Cohort curve from complete sessions only, peak starting at the declared capital."""
    complete = cohort_equity(members, curve, capital).where(F.col("recorded") == F.col("member_count"))
    deep = with_drawdown(complete, ["cohort"], "session", start=F.col("starting_capital"))
    return _curve_columns(deep).drop("recorded", "drawdown_money")


def leave_one_out(members: DataFrame, curve: DataFrame, capital: float) -> DataFrame:
    """Curve of each cohort without each of its members.

    The retained members' sum is the cohort's sum minus the omitted member, so
    the expansion is linear in members, not quadratic.
    """
    whole = cohort_equity(members, curve, capital).where(F.col("member_count") > 1)
    own = members.join(curve.select("strategy_id", "session", F.col("equity").alias("own")), "strategy_id")
    return (
        own.join(whole, ["cohort", "session"])
        .select(
            "cohort",
            F.col("strategy_id").alias("omitted"),
            "session",
            (F.col("equity") - F.col("own")).cast(MONEY).alias("equity"),
            (F.col("starting_capital") - F.lit(capital).cast("decimal(18,2)")).cast(MONEY).alias("starting_capital"),
        )
    )


def breadth(members: DataFrame, results: DataFrame) -> DataFrame:
    """Breadth and concentration of member profits.

    ``results`` has strategy_id, gross_profit, gross_return and trades. Groups
    are member lists, so the ranking window is grid-sized.
    """
    joined = members.join(results, "strategy_id")
    place = F.row_number().over(
        Window.partitionBy("cohort").orderBy(F.col("gross_profit").desc(), "strategy_id")
    )
    p = F.col("gross_profit")
    gains = F.sum(F.when(p > 0, p).otherwise(F.lit(0).cast(MONEY)))
    grouped = joined.withColumn("_place", place).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_if(p > 0).alias("positive"),
        F.count_if(p < 0).alias("negative"),
        F.count_if(p == 0).alias("flat"),
        F.median("gross_return").alias("median_return"),
        gains.alias("gains"),
        F.sum(F.when(p < 0, -p).otherwise(F.lit(0).cast(MONEY))).alias("losses"),
        F.max(F.when(p > 0, p)).alias("_largest"),
        F.sum(F.when((p > 0) & (F.col("_place") <= 3), p)).alias("_top3"),
        F.sum("trades").alias("closed_trades"),
    )

    def share(col):
        return F.try_divide(F.col(col).cast("double"), F.col("gains").cast("double"))

    return (
        grouped.withColumn("losses_share_of_gains", share("losses"))
        .withColumn("largest_share", share("_largest"))
        .withColumn("top_three_share", share("_top3"))
        .drop("_largest", "_top3")
    )


def books_as_of(trades: DataFrame, as_of: Column, capital: float) -> DataFrame:
    """Running book of each strategy: closed and open counts, start and current equity."""
    closed = F.col("exit_session") <= as_of
    opened = F.col("entry_session") <= as_of
    return trades.groupBy("strategy_id").agg(
        F.count_if(closed).alias("closed_trades"),
        F.count_if(opened & ~closed).alias("open_positions"),
        F.lit(capital).cast(MONEY).alias("starting_equity"),
        (F.lit(capital).cast(MONEY) + F.coalesce(F.sum(F.when(closed, F.col("gross_pnl"))), F.lit(0)))
        .cast(MONEY)
        .alias("current_equity"),
    )


def evidence_tier(minimum_closed: Column, decision: int = 30, interim: tuple[int, ...] = (10, 20)) -> Column:
    """Tier of the weakest member: ready, descriptive at an interim count, or too early."""
    tier = F.when(minimum_closed >= decision, "decision_ready")
    for count in sorted(interim, reverse=True):
        tier = tier.when(minimum_closed >= count, f"descriptive_{count}")
    return tier.otherwise(f"pre_{min(interim)}")


def cohort_summary(members: DataFrame, books: DataFrame) -> DataFrame:
    """Totals per cohort; money totals are null until every member has a book."""
    joined = members.join(books, "strategy_id", "left")
    known = F.col("current_equity").isNotNull()
    whole = F.bool_and(known)
    return (
        joined.groupBy("cohort")
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.count_if(known).alias("members_resolved"),
            F.coalesce(F.sum("closed_trades"), F.lit(0)).alias("closed_trades"),
            F.coalesce(F.min("closed_trades"), F.lit(0)).alias("minimum_closed"),
            F.coalesce(F.sum("open_positions"), F.lit(0)).alias("open_positions"),
            F.when(whole, F.sum("starting_equity")).alias("starting_capital"),
            F.when(whole, F.sum("current_equity")).alias("current_equity"),
        )
        .withColumn("evidence_tier", evidence_tier(F.col("minimum_closed")))
    )


def charter_status(summary: DataFrame, diagnostic: str) -> DataFrame:
    """Charter label per cohort; one diagnostic cohort carries a prefix. Ready means all are."""
    label = F.when(F.col("minimum_closed") >= 30, F.when(F.col("cohort") == diagnostic, "30").otherwise("decision_ready"))
    label = label.when(F.col("minimum_closed") >= 20, "descriptive_20").when(
        F.col("minimum_closed") >= 10, "descriptive_10"
    )
    label = label.otherwise("pre_10")
    weakest = F.min("minimum_closed").over(Window.partitionBy())
    return summary.select(
        "cohort",
        "minimum_closed",
        F.when(F.col("cohort") == diagnostic, F.concat(F.lit("diagnostic_"), label)).otherwise(label).alias("status"),
        F.when(weakest >= 30, "ready").otherwise("not_ready").alias("readiness"),
    )


def run_overview(books: DataFrame) -> DataFrame:
    return books.agg(
        F.count(F.lit(1)).alias("books"),
        F.sum("closed_trades").alias("closed_trades"),
        F.min("closed_trades").alias("minimum_closed"),
        F.sum("open_positions").alias("open_positions"),
        F.sum("starting_equity").alias("starting_equity"),
        F.sum("current_equity").alias("current_equity"),
        F.count_if(F.col("current_equity") > F.col("starting_equity")).alias("books_up"),
    )


def cohort_algebra(members: DataFrame, whole: str, left: str, right: str) -> DataFrame:
    """Violations of whole = left + right with left and right disjoint."""
    flags = members.groupBy("strategy_id").agg(
        *[F.bool_or(F.col("cohort") == c).alias(f"in_{n}") for n, c in (("whole", whole), ("left", left), ("right", right))]
    )
    w, a, b = F.col("in_whole"), F.col("in_left"), F.col("in_right")
    problem = (
        F.when(w & ~a & ~b, "not_in_any_part")
        .when(~w & (a | b), "not_in_whole")
        .when(a & b, "in_both_parts")
    )
    return flags.select("strategy_id", problem.alias("problem")).where("problem IS NOT NULL")


def cohort_report(members: DataFrame, results: DataFrame) -> DataFrame:
    """One row per cohort with its members listed by profit; lists are grid-sized."""
    joined = members.join(results, "strategy_id")
    row = F.struct((-F.col("gross_profit")).alias("order"), F.col("strategy_id"))
    return joined.groupBy("cohort").agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda r: r["strategy_id"]).alias("members"),
        F.count_if(F.col("gross_profit") > 0).alias("positive"),
        F.count(F.lit(1)).alias("member_count"),
    )


