"""Readable rules compiled to boolean columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, Window, functions as F

from barloom.operators.features import Feature

COMPARATORS = ("gt", "gte", "lt", "lte", "crosses_above", "crosses_below")


@dataclass(frozen=True)
class Condition:
    """``left`` compared with exactly one feature or one threshold."""

    left: str
    comparator: str
    feature: str | None = None
    threshold: float | None = None

    def __post_init__(self):
        if self.comparator not in COMPARATORS:
            raise ValueError(f"unsupported comparator {self.comparator!r}")
        if (self.feature is None) == (self.threshold is None):
            raise ValueError("condition requires exactly one feature or threshold")


def condition_column(
    c: Condition, keys=("security_id",), order: str = "session", previous: Callable[[str], Column] | None = None
) -> Column:
    """Boolean column; a null operand is false. Crosses look one daily row back.

    A threshold is a constant and is not lagged. ``previous`` gives a feature's
    value one row back where the rows before are not at hand.
    """
    row = Window.partitionBy(*keys).orderBy(order)
    before = previous or (lambda name: F.lag(F.col(name)).over(row))
    left = F.col(c.left)
    right = F.col(c.feature) if c.feature is not None else F.lit(c.threshold)
    before_left = before(c.left)
    before_right = before(c.feature) if c.feature is not None else right
    mask = {
        "gt": lambda: left > right,
        "gte": lambda: left >= right,
        "lt": lambda: left < right,
        "lte": lambda: left <= right,
        "crosses_above": lambda: (left > right) & (before_left <= before_right),
        "crosses_below": lambda: (left < right) & (before_left >= before_right),
    }[c.comparator]()
    return F.coalesce(mask, F.lit(False))


def all_of(conditions: Sequence[Condition], **window) -> Column:
    return reduce(lambda a, b: a & b, [condition_column(c, **window) for c in conditions])


def check_grammar(features: Sequence[Feature], where: Sequence[Condition], when: Sequence[Condition]) -> None:
    """*where* needs a weekly or monthly feature; *when* may only use daily ones."""
    frames = {f.name: f.timeframe for f in features}

    def used(conditions):
        names = {c.left for c in conditions} | {c.feature for c in conditions if c.feature is not None}
        unknown = names - set(frames)
        if unknown:
            raise ValueError(f"unknown features {sorted(unknown)}")
        return {frames[n] for n in names}

    if not where or not when:
        raise ValueError("both where and when conditions are required")
    if not used(where) & {"weekly", "monthly"}:
        raise ValueError("where must use a weekly or monthly feature")
    if used(when) != {"daily"}:
        raise ValueError("when conditions must use daily features only")
