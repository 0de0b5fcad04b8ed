"""Bar quality as counts and messages per security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.bars import OHLC
from barloom.operators.sessions import small

EXTREME_MOVE = 0.50
TOLERANCE = 1e-9


def extreme_moves(bars: DataFrame, limit: float = EXTREME_MOVE) -> DataFrame:
    """Bars whose close moved more than ``limit`` from the previous bar."""
    before = F.lag("close").over(Window.partitionBy("security_id").orderBy("session"))
    move = F.abs(F.try_divide(F.col("close"), before) - 1)
    return bars.withColumn("move", move).where(F.col("move") > limit).select("security_id", "session", "close", "move")


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar sessions between a security's first and last bar that have no bar.

    Gaps are found between neighbouring bars and only the gaps are unfolded.
    """
    placed = bars.join(small(calendar.select("session", "ord")), "session").select("security_id", "ord").distinct()
    following = F.lead("ord").over(Window.partitionBy("security_id").orderBy("ord"))
    gaps = placed.withColumn("following", following).where(F.col("following") > F.col("ord") + 1)
    holes = gaps.select("security_id", F.explode(F.sequence(F.col("ord") + 1, F.col("following") - 1)).alias("ord"))
    return holes.join(small(calendar.select("ord", "session")), "ord").select("security_id", "session")


def order_problems(rows: DataFrame, position: str, chunk: int = 4096) -> DataFrame:
    """Per security: is the file order ascending, and are there repeated sessions?

    Rows are compared inside chunks of the file order; neighbouring chunks are
    compared through one summary row each, so a long file is not one task.
    """
    part = F.floor(F.col(position) / chunk)
    inside = Window.partitionBy("security_id", "_part").orderBy(position)
    stepped = rows.select("security_id", "session", F.col(position).alias(position), part.alias("_part")).withColumn(
        "_back", F.col("session") < F.lag("session").over(inside)
    )
    chunks = stepped.groupBy("security_id", "_part").agg(
        F.count_if("_back").alias("_n"),
        F.min_by("session", position).alias("_first"),
        F.max_by("session", position).alias("_last"),
    )
    across = Window.partitionBy("security_id").orderBy("_part")
    joined = chunks.withColumn("_step", F.col("_first") < F.lag("_last").over(across))
    ordered = joined.groupBy("security_id").agg(((F.sum("_n") > 0) | (F.count_if("_step") > 0)).alias("unsorted"))
    repeated = (
        rows.groupBy("security_id", "session")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("security_id")
        .agg((F.max("n") > 1).alias("duplicated"))
    )
    return ordered.join(repeated, "security_id")


def valid_range() -> Column:
    """Low at or below every price of the bar and high at or above, within tolerance."""
    top, bottom = F.greatest(*OHLC), F.least(*OHLC)
    bad = (F.col("high") < F.col("low")) | (F.col("high") < top - TOLERANCE) | (F.col("low") > bottom + TOLERANCE)
    return ~F.coalesce(bad, F.lit(False))


def quality_report(rows: DataFrame, calendar: DataFrame, position: str) -> DataFrame:
    """Errors and warnings per security; ``ok`` when there are no errors.

    A file that is unsorted or repeats a session is not checked for holes or
    moves: neither is meaningful there.
    """
    any_null = F.lit(False)
    any_low = F.lit(False)
    for c in OHLC:
        any_null = any_null | F.col(c).isNull()
        any_low = any_low | F.coalesce(F.col(c) <= 0, F.lit(False))
    any_null = any_null | F.col("volume").isNull()
    counts = rows.groupBy("security_id").agg(
        F.count_if(any_null).alias("nulls"),
        F.count_if(any_low).alias("nonpositive"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(~valid_range()).alias("bad_range"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
    )
    order = order_problems(rows, position)
    clean = rows.join(order.where(~(F.col("unsorted") | F.col("duplicated"))), "security_id", "left_semi")
    holes = missing_sessions(clean, calendar).groupBy("security_id").agg(
        F.count(F.lit(1)).alias("missing"), F.min("session").alias("first_missing")
    )
    jumps = extreme_moves(clean).groupBy("security_id").agg(
        F.count(F.lit(1)).alias("extreme"),
        F.min("session").alias("first_extreme"),
        F.min_by("move", "session").alias("first_move"),
    )
    whole = counts.join(order, "security_id").join(holes, "security_id", "left").join(jumps, "security_id", "left")

    def text(*parts):
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    c = F.col
    # The texts of errors and warnings.
    errors = F.array_compact(
        F.array(
            F.when(c("nulls") > 0, text("NaN values on ", c("nulls"), " bar(s)")),
            F.when(c("nonpositive") > 0, "non-positive price(s)"),
            F.when(c("negative_volume") > 0, "negative volume"),
            F.when(c("bad_range") > 0, text("inconsistent OHLC range on ", c("bad_range"), " bar(s)")),
            F.when(c("unsorted"), "index not sorted"),
            F.when(c("duplicated"), "duplicate dates"),
            F.when(c("missing") > 0, text(c("missing"), " missing session(s), e.g. ", c("first_missing"))),
        )
    )
    checked = ~(c("unsorted") | c("duplicated"))
    percent = F.format_string("%.0f", c("first_move") * 100)
    warnings = F.array_compact(
        F.array(
            F.when(
                c("extreme") > 0,
                text(c("extreme"), " extreme move(s) >50%, e.g. ", c("first_extreme"), " (", percent, "%)"),
            ),
            F.when(checked & (c("zero_volume") > 0), text(c("zero_volume"), " zero-volume bar(s)")),
        )
    )
    return whole.select("security_id", errors.alias("errors"), warnings.alias("warnings")).withColumn(
        "ok", F.size("errors") == 0
    )


def quarantine(bars: DataFrame, report: DataFrame) -> DataFrame:
    """Bars of securities whose report has no errors."""
    return bars.join(report.where("ok"), "security_id", "left_semi")
