"""Ordered eligibility checks, geometry and sizing as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Limits:
    """Study limits; the defaults are the study's fixed values."""

    minimum_price: float = 5.0
    minimum_adv: float = 20_000_000.0
    blackout_sessions: int = 2
    maximum_stop_fraction: float = 0.12
    minimum_reward_risk: float = 1.5
    hold_sessions: int = 21
    risk_fraction: float = 0.0075
    notional_fraction: float = 0.15
    deployed_fraction: float = 0.80
    maximum_positions: int = 8


def first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check whose condition holds, else null."""
    case = None
    for reason, failed in checks:
        case = F.when(failed, reason) if case is None else case.when(failed, reason)
    return case


def rejection_reason(limits: Limits, range_start: Column, range_end: Column, data_cutoff: Column) -> Column:
    """First failing rule for a candidate, in fixed order."""
    c = F.col
    return first_reason(
        ("strategy_binding", ~c("strategy_bound")),
        ("input_manifest_binding", ~c("inputs_bound")),
        (
            "outside_evaluation_range",
            ~((c("signal_session") >= range_start) & (c("signal_session") < range_end))
            | (c("entry_session") >= range_end),
        ),
        ("source_fact_after_cutoff", c("latest_fact") > data_cutoff),
        ("minimum_signal_price", c("signal_close") < limits.minimum_price),
        ("minimum_average_dollar_volume", c("adv") < limits.minimum_adv),
        ("earnings_blackout", c("sessions_before") <= limits.blackout_sessions),
    )


def price_formula(kind: Column, primary: Column, secondary: Column, multiple: Column, entry: Column, risk: Column) -> Column:
    """The six stop and target price formulas."""
    return (
        F.when(kind == "entry_minus_fact_multiple", entry - primary * multiple)
        .when(kind == "fact_minus_fact_multiple", primary - secondary * multiple)
        .when(kind == "entry_plus_fact_multiple", entry + primary * multiple)
        .when(kind == "fact_plus_fact_multiple", primary + secondary * multiple)
        .when(kind == "fact_value", primary)
        .when(kind == "entry_plus_risk_multiple", entry + risk * multiple)
    )


def with_geometry(df: DataFrame, fact) -> DataFrame:
    """Stop first, then risk, then target. ``fact`` maps a name column to its value."""
    c = F.col
    none = F.lit(None).cast("double")

    def secondary(side):
        return fact(c(f"{side}_fact2")) if f"{side}_fact2" in df.columns else none

    out = df.withColumn(
        "stop",
        price_formula(c("stop_kind"), fact(c("stop_fact")), secondary("stop"), c("stop_multiple"), c("entry_price"), none),
    ).withColumn("risk", c("entry_price") - c("stop"))
    return (
        out.withColumn(
            "target",
            price_formula(
                c("target_kind"), fact(c("target_fact")), secondary("target"), c("target_multiple"), c("entry_price"), c("risk")
            ),
        )
        .withColumn("reward", c("target") - c("entry_price"))
        .withColumn("reward_risk", F.try_divide(c("reward"), c("risk")))
        .withColumn("stop_fraction", F.try_divide(c("risk"), c("entry_price")))
    )


def geometry_reason(limits: Limits) -> Column:
    """Null when stop < entry < target and the planned ratios are inside the limits."""
    c = F.col
    return first_reason(
        ("missing_geometry", c("entry_price").isNull() | c("stop").isNull() | c("target").isNull()),
        (
            "invalid_geometry",
            ~(
                (c("stop") > 0)
                & (c("stop") < c("entry_price"))
                & (c("target") > c("entry_price"))
                & (c("stop_fraction") <= limits.maximum_stop_fraction)
                & (c("reward_risk") > limits.minimum_reward_risk)
            ),
        ),
    )


def opening_reason(limits: Limits, opened: Column) -> Column:
    """Re-check of resolved levels against the price actually opened at."""
    c = F.col
    risk, reward = opened - c("stop"), c("target") - opened
    invalid = (
        (c("entry_price") != opened)
        | (risk <= 0)
        | (reward <= 0)
        | (F.try_divide(risk, opened) > limits.maximum_stop_fraction)
        | (F.try_divide(reward, risk) <= limits.minimum_reward_risk)
    )
    return first_reason(("minimum_price", opened < limits.minimum_price), ("opening_geometry_invalid", invalid))


def share_quantity(limits: Limits, entry: Column, stop: Column, equity: Column, deployed: Column, cash: Column) -> Column:
    """Whole shares allowed by risk, notional, deployment and cash, whichever is least."""
    room = F.greatest(F.lit(0.0), equity * limits.deployed_fraction - deployed)
    return F.least(
        F.floor(F.try_divide(equity * limits.risk_fraction, entry - stop)),
        F.floor(equity * limits.notional_fraction / entry),
        F.floor(room / entry),
        F.floor(cash / entry),
    )
