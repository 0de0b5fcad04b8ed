"""The historical study as one job: features, signals, levels, outcomes, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators import eligibility as E, exits as X, features as FT, signals as SG
from barloom.operators.feature_state import FeatureState
from barloom.plans import grid


def study_matrix(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Feature matrix of the whole grid plus average dollar volume."""
    matrix = FT.feature_matrix(bars, calendar, grid.FEATURES)
    return matrix.withColumn("adv", FT.average_dollar_volume(grid.ADV_LOOKBACK))


def study_signals(bars: DataFrame, calendar: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """One row per (rule, security, signal session); stops and targets share it."""
    matrix = study_matrix(bars, calendar) if matrix is None else matrix
    return SG.with_entry_session(SG.rule_hits(matrix, grid.rules(), grid.PRIORITY, "adv"), calendar)


def feature_state() -> FeatureState:
    """State that carries the features of the grid from session to session."""
    return FeatureState(grid.FEATURES, grid.ADV_LOOKBACK)


def session_signals(states: DataFrame, calendar: DataFrame, session: Column) -> DataFrame:
    """``study_signals`` of one session from the state after it: no bar before the session is read."""
    matrix = feature_state().matrix(states, session)
    hits = SG.rule_hits(matrix, grid.rules(), grid.PRIORITY, "adv", previous=lambda name: F.col(f"before.{name}"))
    return SG.with_entry_session(hits.drop("before"), calendar)


GEOMETRY_FACTS = ("daily_atr14", "daily_rolling_low10", "daily_rolling_low20", "daily_rolling_high20")


def fact_column(name: Column) -> Column:
    case = None
    for fact in GEOMETRY_FACTS:
        case = F.when(name == fact, F.col(fact)) if case is None else case.when(name == fact, F.col(fact))
    return case


def study_levels(bars: DataFrame, calendar: DataFrame, limits: E.Limits = E.Limits(), path: bool = False) -> DataFrame:
    """Every (security, signal, stop, target) with levels at the next session's open and the rules that fired.

    Levels do not depend on the rule, so they are worked out once for all rules of a signal. With ``path``
    the next ``hold`` bars travel with each row, so neither the entry bar nor the exit needs a join:
    the only exchange is by security.
    """
    matrix = study_matrix(bars, calendar)
    following = F.lead(F.struct("session", "open")).over(Window.partitionBy("security_id").orderBy("session"))
    matrix = matrix.withColumn("_first", following)
    if path:
        matrix = X.with_forward_path(matrix, limits.hold_sessions, start=1)
    fired = SG.with_entry_session(SG.rules_fired(matrix, grid.rules(), grid.PRIORITY, "adv"), calendar)
    opened = F.when(F.col("_first.session") == F.col("entry_session"), F.col("_first.open"))
    entries = fired.withColumn("entry_price", opened).drop("_first").crossJoin(F.broadcast(grid.level_table(bars.sparkSession)))
    return E.with_geometry(entries, fact_column).withColumn("geometry_reason", E.geometry_reason(limits))


def by_strategy(levels: DataFrame) -> DataFrame:
    """Rows of ``study_levels`` unfolded by the rules that fired, each named as its strategy."""
    names = grid.grid_table(levels.sparkSession).select("rule", "stop_slug", "target_slug", "strategy_id")
    each = levels.withColumn("rule", F.explode("rules")).drop("rules")
    return each.join(F.broadcast(names), ["rule", "stop_slug", "target_slug"])


def study_entries(bars: DataFrame, calendar: DataFrame, limits: E.Limits = E.Limits()) -> DataFrame:
    """Every (strategy, security, signal) with levels at the next session's open."""
    return by_strategy(study_levels(bars, calendar, limits))


def study_outcomes(bars: DataFrame, calendar: DataFrame, limits: E.Limits = E.Limits()) -> DataFrame:
    """Entries with their first-touch exit; rejected entries keep a reason and no exit."""
    levels = study_levels(bars, calendar, limits, path=True)
    ok = F.col("geometry_reason").isNull()
    return by_strategy(X.with_first_touch(levels, limits.hold_sessions, "exit", ok).drop("path"))


def evaluate(bars: DataFrame, calendar: DataFrame, limits: E.Limits = E.Limits()) -> DataFrame:
    """Per strategy: candidates, rejections, exits by reason and mean return."""
    out = study_outcomes(bars, calendar, limits)
    gain = F.col("exit.price") / F.col("entry_price") - 1
    closed = F.col("exit").isNotNull()
    return out.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("geometry_reason") == "missing_geometry").alias("missing_geometry"),
        F.count_if(F.col("geometry_reason") == "invalid_geometry").alias("invalid_geometry"),
        F.count_if(closed).alias("closed"),
        *[
            F.count_if(F.col("exit.reason") == r).alias(r)
            for r in ("gap_stop", "gap_target", "stop", "target", "time")
        ],
        F.avg(gain).alias("mean_return"),
        F.avg("exit.held").alias("mean_held"),
        F.count_if(gain > 0).alias("winners"),
    )
