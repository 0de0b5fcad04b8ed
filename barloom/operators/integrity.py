"""Cross-table checks that return violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.asof import asof_backward


def missing_references(child: DataFrame, parent: DataFrame, key: str, check: str) -> DataFrame:
    """Child keys without a parent row."""
    return child.join(parent.select(key), key, "left_anti").select(F.lit(check).alias("check"), F.col(key))


def cover_differences(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Keys present on one side only; an exact cover gives no rows."""
    only_left = missing_references(left.select(key).distinct(), right, key, f"only_in_{left_name}")
    only_right = missing_references(right.select(key).distinct(), left, key, f"only_in_{right_name}")
    return only_left.unionByName(only_right)


def reconcile_inventory(roster: DataFrame, manifest: DataFrame, observed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Roster, declared manifest and observed facts side by side, one row per failed check."""
    key = "security_id"
    declared = manifest.select(key, F.struct(*fields).alias("declared"))
    seen = observed.select(key, F.struct(*fields).alias("observed"))
    joined = (
        roster.select(key, F.lit(True).alias("listed"))
        .join(declared, key, "full_outer")
        .join(seen, key, "full_outer")
    )
    d, o = F.col("declared"), F.col("observed")
    both = d.isNotNull() & o.isNotNull()
    checks = [
        F.when(F.col("listed").isNull(), F.struct(F.lit("not_in_roster").alias("problem"), F.lit(None).cast("string").alias("detail"))),
        F.when(d.isNull(), F.struct(F.lit("absent_from_manifest").alias("problem"), F.lit(None).cast("string").alias("detail"))),
        F.when(o.isNull(), F.struct(F.lit("no_bars").alias("problem"), F.lit(None).cast("string").alias("detail"))),
    ]
    for f in fields:
        detail = F.concat_ws(" vs ", F.col(f"declared.{f}").cast("string"), F.col(f"observed.{f}").cast("string"))
        checks.append(
            F.when(
                both & ~F.col(f"declared.{f}").eqNullSafe(F.col(f"observed.{f}")),
                F.struct(F.lit(f"{f}_mismatch").alias("problem"), detail.alias("detail")),
            )
        )
    return joined.select(key, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(key, "v.*")


def compare_fields(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field-by-field differences of two tables keyed alike; null equals null."""
    e = expected.select(key, *[F.col(f).cast("string").alias(f"_e_{f}") for f in fields], F.lit(True).alias("_he"))
    a = actual.select(key, *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields], F.lit(True).alias("_ha"))
    joined = e.join(a, key, "full_outer")
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.col(f"_e_{f}").alias("expected"), F.col(f"_a_{f}").alias("actual")
        )
        for f in fields
    ]
    return (
        joined.select(key, F.explode(F.array(*rows)).alias("d"))
        .select(key, "d.*")
        .where(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def uncovered_facts(facts: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """Facts outside every half-open interval of their key.

    A fact is covered when the farthest end among intervals that started by
    then lies beyond it, so one backward as-of lookup replaces the range join.
    Keys are cut by month, so a key with very many facts is spread over tasks.
    """
    order = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = intervals.groupBy(key, "start").agg(F.max("end").alias("end"))
    reach = merged.select(key, "start", F.max("end").over(order).alias("reach"))
    by_month = lambda moment: F.trunc(moment, "MM")
    found = asof_backward(facts, reach, [key], at, "start", ["reach"], slice_of=by_month)
    return found.where(F.col("reach").isNull() | (F.col("reach") <= F.col(at))).drop("start", "reach")


def uncovered_ranges(ranges: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Keys for which no single interval covers the whole required range."""
    joined = ranges.join(intervals, key, "left")
    covers = F.coalesce((F.col("start") <= F.col("need_start")) & (F.col("end") > F.col("need_end")), F.lit(False))
    return joined.groupBy(key).agg(F.bool_or(covers).alias("covered")).where("NOT covered").select(key)


def calendar_differences(left: DataFrame, right: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sessions listed on one side only, inside a range."""
    def clip(df):
        return df.select("session").where(F.col("session").between(start, end))

    a, b = clip(left), clip(right)
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right_only"))
    )


def resolve_unique(matches: DataFrame, key: str, identifier: str) -> DataFrame:
    """Exactly one distinct identifier per key, else an error row."""
    stats = matches.groupBy(key).agg(
        F.min(identifier).alias("_lo"), F.max(identifier).alias("_hi"), F.count(identifier).alias("matches")
    )
    status = (
        F.when(F.col("matches") == 0, "unresolved").when(F.col("_lo") == F.col("_hi"), "resolved").otherwise("ambiguous")
    )
    return stats.select(
        key, "matches", status.alias("status"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(identifier)
    )


def chain_violations(events: DataFrame, key: str, own_hash: Column) -> DataFrame:
    """Broken links of a hash chain per key.

    Each event is joined to its predecessor by sequence number, so a chain of
    any length is checked in parallel. A number used more than once is a problem
    of its own and does not multiply rows.
    """
    numbers = events.groupBy(key, "sequence").agg(F.count(F.lit(1)).alias("_n"), F.collect_set("event_hash").alias("_hashes"))
    before = numbers.select(key, (F.col("sequence") + 1).alias("sequence"), F.col("_hashes").alias("_before"))
    linked = events.join(before, [key, "sequence"], "left").join(numbers.select(key, "sequence", "_n"), [key, "sequence"])
    first = F.col("sequence") == 1
    problems = F.array_compact(
        F.array(
            F.when(~first & F.col("_before").isNull(), "gap_before"),
            F.when(first & F.col("previous_hash").isNotNull(), "first_has_previous"),
            F.when(
                F.col("_before").isNotNull() & ~F.coalesce(F.array_contains("_before", F.col("previous_hash")), F.lit(False)),
                "previous_mismatch",
            ),
            F.when(F.col("event_hash") != own_hash, "hash_mismatch"),
            F.when(F.col("_n") > 1, "duplicate_sequence"),
        )
    )
    return linked.select(key, "sequence", F.explode(problems).alias("problem"))


def record_counts(**tables: DataFrame) -> DataFrame:
    """Number of records per kind."""
    out = None
    for kind, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("records")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def snapshot_complete(roster: DataFrame, snapshot: DataFrame, session: Column) -> DataFrame:
    """Is a daily snapshot exactly the roster, each security ending on the session?"""
    joined = roster.select("security_id", F.lit(True).alias("listed")).join(
        snapshot.select("security_id", "last_session"), "security_id", "full_outer"
    )
    return joined.agg(
        F.count_if(F.col("last_session").isNull()).alias("missing"),
        F.count_if(F.col("listed").isNull()).alias("extra"),
        F.count_if(F.col("last_session") != session).alias("stale"),
    ).withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("stale") == 0))
