"""The strategy grid: contexts x triggers x stops x targets."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.features import Feature
from barloom.operators.rules import Condition, check_grammar

# Fixed values of the grid: (timeframe, method, lookback, relation, word).
CONTEXTS = (
    ("weekly", "ema", 13, "gt", "above"),
    ("weekly", "ema", 13, "lt", "below"),
    ("monthly", "ema", 6, "gt", "above"),
    ("monthly", "ema", 6, "lt", "below"),
)
# (slug, operation, lookback)
# Fixed values of the grid: (slug, operation, lookback).
TRIGGERS = (
    ("close-cross-ema5", "ema", 5),
    ("close-cross-sma10", "sma", 10),
    ("return5-cross-zero", "return", 5),
)
# (slug, formula, fact, multiple)
# Fixed values of the grid: stops by slug.
STOPS = (
    ("atr14x1", "entry_minus_fact_multiple", "daily_atr14", 1.0),
    ("atr14x1p5", "entry_minus_fact_multiple", "daily_atr14", 1.5),
    ("rolling-low10", "fact_value", "daily_rolling_low10", 1.0),
    ("rolling-low20", "fact_value", "daily_rolling_low20", 1.0),
)
# Fixed values of the grid: targets by slug.
TARGETS = (
    ("risk1p75", "entry_plus_risk_multiple", None, 1.75),
    ("risk2p5", "entry_plus_risk_multiple", None, 2.5),
    ("rolling-high20", "fact_value", "daily_rolling_high20", 1.0),
)
PRIORITY = "daily_return20"
ADV_LOOKBACK = 20

# Fixed values of the grid: the features that rules and levels read.
FEATURES = (
    Feature("weekly_close", "weekly", "raw", "close", 1),
    Feature("weekly_ema13", "weekly", "ema", "close", 13),
    Feature("monthly_close", "monthly", "raw", "close", 1),
    Feature("monthly_ema6", "monthly", "ema", "close", 6),
    Feature("daily_close", "daily", "raw", "close", 1),
    Feature("daily_sma10", "daily", "sma", "close", 10),
    Feature("daily_ema5", "daily", "ema", "close", 5),
    Feature("daily_return5", "daily", "return", "close", 5),
    Feature("daily_return20", "daily", "return", "close", 20),
    Feature("daily_atr14", "daily", "atr", "close", 14),
    Feature("daily_rolling_low10", "daily", "rolling_min", "low", 10),
    Feature("daily_rolling_low20", "daily", "rolling_min", "low", 20),
    Feature("daily_rolling_high20", "daily", "rolling_max", "high", 20),
)


@dataclass(frozen=True)
class Rule:
    """One context and trigger; every stop and target shares its signals."""

    name: str
    where: Condition
    when: Condition
    facts: tuple[str, ...]


def rules() -> list[Rule]:
    out = []
    for (frame, method, n, relation, word), (slug, operation, lookback) in product(CONTEXTS, TRIGGERS):
        where = Condition(f"{frame}_close", relation, feature=f"{frame}_{method}{n}")
        if operation == "return":
            when = Condition("daily_return5", "crosses_above", threshold=0.0)
        else:
            when = Condition("daily_close", "crosses_above", feature=f"daily_{operation}{lookback}")
        check_grammar(FEATURES, [where], [when])
        facts = {where.left, where.feature, when.left, when.feature, PRIORITY} - {None}
        out.append(Rule(f"{frame}-{method}{n}-{word}__{slug}", where, when, tuple(sorted(facts))))
    return out


def grid_rows() -> list[tuple]:
    """(name, rule, stop slug, target slug, stop kind/fact/multiple, target kind/fact/multiple)."""
    return [
        (f"{rule.name}__{stop[0]}__target-{target[0]}", rule.name, stop[0], target[0], *stop[1:], *target[1:])
        for rule, stop, target in product(rules(), STOPS, TARGETS)
    ]


GRID_SCHEMA = (
    "strategy_id string, rule string, stop_slug string, target_slug string, "
    "stop_kind string, stop_fact string, stop_multiple double, "
    "target_kind string, target_fact string, target_multiple double"
)


def grid_table(spark: SparkSession) -> DataFrame:
    """The grid as a table; its size is set by the constants above (144 rows)."""
    return spark.createDataFrame(grid_rows(), GRID_SCHEMA)


def level_table(spark: SparkSession) -> DataFrame:
    """The stops and targets of the grid (12 pairs), which do not depend on the rule."""
    return grid_table(spark).drop("strategy_id", "rule").distinct()
