"""Signals: where the rules of a grid fire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.rules import all_of
from barloom.operators.scaled import bucketed_running, dealt_by
from barloom.operators.sessions import small
from barloom.session import persist_table


def rules_fired(matrix: DataFrame, rules: Sequence, priority: str, adv: str, **how) -> DataFrame:
    """Rows on which a rule fires, with the names of all that do as the array ``rules``.

    Every rule is a boolean column over one shared feature matrix. Rows without
    a priority value or dollar volume drop. ``how`` goes to the conditions.
    """
    flags = [F.when(all_of([r.where, r.when], **how), F.lit(r.name)) for r in rules]
    fired = matrix.withColumn("rules", F.array_compact(F.array(*flags)))
    return fired.where((F.size("rules") > 0) & F.col(priority).isNotNull() & F.col(adv).isNotNull())


def rule_hits(matrix: DataFrame, rules: Sequence, priority: str, adv: str, **how) -> DataFrame:
    """One row per (rule, security, session) that fires: ``rules_fired`` unfolded."""
    return rules_fired(matrix, rules, priority, adv, **how).withColumn("rule", F.explode("rules")).drop("rules")


def in_range(signals: DataFrame, start: Column, end: Column, entry_end: Column | None = None) -> DataFrame:
    """Half-open range on the signal session, optionally also on the entry session."""
    keep = (F.col("signal_session") >= start) & (F.col("signal_session") < end)
    if entry_end is not None:
        keep = keep & (F.col("entry_session") < entry_end)
    return signals.where(keep)


def with_entry_session(signals: DataFrame, calendar: DataFrame, session: str = "session") -> DataFrame:
    """Signal session and ordinal, and the session it would be entered on."""
    picked = calendar.select(
        F.col("session").alias(session), F.col("ord").alias("signal_ord"), F.col("next_session").alias("entry_session")
    )
    return signals.join(small(picked), session).withColumnRenamed(session, "signal_session")


def facts_map(names: Sequence[str], available: dict[str, str], default_available: str) -> Column:
    """Map of fact name to (value, available session), in name order."""
    entries = [
        F.struct(
            F.lit(n).alias("key"),
            F.struct(
                F.col(n).alias("value"), F.col(available.get(n, default_available)).alias("available_session")
            ).alias("value"),
        )
        for n in sorted(names)
    ]
    return F.map_from_entries(F.array(*entries))


def priority_order(
    signals: DataFrame, keys: Sequence[str], priority: str, tie: str, descending: bool = True, width: float = 0.01
) -> DataFrame:
    """Rank within each key by priority, ties by the locked hash.

    Priorities are bucketed by ``width`` so that a session on which very many
    securities fire is ranked by several tasks.
    """
    sign = -1 if descending else 1
    value = F.col(priority) * sign
    return bucketed_running(
        signals, keys, [value, F.col(tie)], F.floor(value / width), {"priority_rank": F.lit(1).cast("long")}
    )


def rules_in_order(fired: DataFrame, priority: str, tie: Column, width: float = 0.01) -> DataFrame:
    """Rank of each signal within its rule and session, from one row per security and session with the ``rules`` that fired.

    As ``priority_order``, but a signal is written once for all its rules and crosses the network once: what ``tie``
    works out of a signal and its ``rule`` is made where it is ranked. ``fired`` keeps ``security_id``, ``signal_session``,
    ``rules`` and ``priority``.
    """
    place, order = ["signal_session", "_bucket"], -F.col(priority)
    rows = persist_table(fired.select("rules", "security_id", "signal_session", priority, F.floor(order / width).alias("_bucket")), "fired")
    counts = rows.select(*place, F.explode("rules").alias("rule")).groupBy(*place, "rule").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("signal_session", "rule").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    size = rows.count()
    # Both sides are dealt alike, by what the ranks are counted in, rules aside: neither the join nor the window deals again.
    offsets = dealt_by(offsets, place, size).groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("_before"))
    dealt = dealt_by(rows, place, size).join(offsets, place)
    each = dealt.withColumn("rule", F.explode("rules")).withColumn("tie", tie)
    inside = Window.partitionBy(*place, "rule").orderBy(order, "tie")
    rank = F.row_number().over(inside) + F.element_at("_before", F.col("rule"))
    return each.select("rule", "security_id", "signal_session", "tie", rank.cast("long").alias("priority_rank"))


def admit(
    ranked: DataFrame, keys: Sequence[str], rank: str, notional: Column, slots: int, cap: float, chunk: int = 4096
) -> DataFrame:
    """Admit in rank order while slots last and the running notional stays under the cap."""
    running = bucketed_running(
        ranked, keys, [F.col(rank)], F.floor(F.col(rank) / chunk), {"running_notional": notional}
    )
    return running.withColumn("admitted", (F.col(rank) <= slots) & (F.col("running_notional") <= cap))
