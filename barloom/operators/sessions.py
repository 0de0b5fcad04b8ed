"""The trading calendar as a table, and operators keyed by session ordinal.

A calendar holds at most one row per civil date, whatever the volume of the
fact tables, so joining it by broadcast is bounded by the length of history
(100 years of sessions is about 25,000 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.dates import month_start, week_end


def session_calendar(days: DataFrame, column: str = "session") -> DataFrame:
    """Distinct sessions with ordinal, neighbours and period bounds."""
    distinct = days.select(F.col(column).alias("session")).distinct()
    order = Window.orderBy("session")
    return (
        distinct.withColumn("ord", F.row_number().over(order))
        .withColumn("next_session", F.lead("session").over(order))
        .withColumn("prev_session", F.lag("session").over(order))
        .withColumn("week_end", week_end(F.col("session")))
        .withColumn("month", month_start(F.col("session")))
        .withColumn("week_last", F.max("session").over(Window.partitionBy("week_end")))
        .withColumn("month_last", F.max("session").over(Window.partitionBy("month")))
    )


def _easter(day: Column) -> Column:
    """Easter Sunday of the year of ``day``, 1900 to 2099."""
    y = F.year(day)
    a = y % 19
    d = (19 * a + 24) % 30
    e = (2 * (y % 4) + 4 * (y % 7) + 6 * d + 5) % 7
    late = ((d == 29) & (e == 6)) | ((d == 28) & (e == 6) & (a > 10))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(22)), (d + e - F.when(late, 7).otherwise(0)).cast("int"))


def is_session(day: Column) -> Column:
    """Does a United States stock exchange open on this date? By the standing rules, 1900 to 2099.

    Closed on weekends, New Year, Martin Luther King day (from 1998), Presidents'
    day, Good Friday, Memorial day, Juneteenth (from 2022), Independence day,
    Labor day, Thanksgiving and Christmas. A fixed holiday on a Sunday moves to
    Monday, one on a Saturday to Friday (New Year does not). Closings by decree are not rules.
    """
    month, at, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)

    def fixed(m: int, d: int, on_friday: bool = True) -> Column:
        out = (month == m) & (at == d)
        out = out | ((weekday == 0) & (F.month(F.date_sub(day, 1)) == m) & (F.dayofmonth(F.date_sub(day, 1)) == d))
        if on_friday:
            out = out | ((weekday == 4) & (F.month(F.date_add(day, 1)) == m) & (F.dayofmonth(F.date_add(day, 1)) == d))
        return out

    def nth(m: int, which: int, n: int) -> Column:
        return (month == m) & (weekday == which) & at.between(7 * n - 6, 7 * n)

    closed = (
        (weekday > 4)
        | fixed(1, 1, on_friday=False)
        | (nth(1, 0, 3) & (F.year(day) >= 1998))
        | nth(2, 0, 3)
        | ((weekday == 4) & month.between(3, 4) & (day == F.date_sub(_easter(day), 2)))
        | ((month == 5) & (weekday == 0) & (at >= 25))
        | (fixed(6, 19) & (F.year(day) >= 2022))
        | fixed(7, 4)
        | nth(9, 0, 1)
        | nth(11, 3, 4)
        | fixed(12, 25)
    )
    return ~closed


def rolled_days(spark: SparkSession) -> DataFrame:
    """Every civil date for which the rules hold, with the first session on or after it (73,049 rows, whatever the facts)."""
    days = spark.range(1).select(F.explode(F.expr("sequence(DATE'1900-01-01', DATE'2099-12-31')")).alias("day"))
    marked = days.withColumn("open", F.when(is_session(F.col("day")), F.col("day")))
    ahead = Window.orderBy("day").rowsBetween(Window.currentRow, 4)
    return marked.select("day", F.first("open", ignorenulls=True).over(ahead).alias("next_session"))


def closes_early(day: Column) -> Column:
    """Half days: the day after Thanksgiving, and the session on 3 July or 24 December."""
    month, at, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    after = (month == 11) & (weekday == 4) & at.between(23, 29)
    return is_session(day) & (after | ((month == 7) & (at == 3)) | ((month == 12) & (at == 24)))


def close_instant(day: Column) -> Column:
    """Closing time of a session as an instant: 16:00 New York, 13:00 on half days."""
    clock = F.when(closes_early(day), F.lit(" 13:00:00")).otherwise(F.lit(" 16:00:00"))
    return F.to_utc_timestamp(F.to_timestamp_ntz(F.concat(day.cast("string"), clock)).cast("timestamp"), "America/New_York")


def exchange_calendar(bounds: DataFrame) -> DataFrame:
    """Sessions by rule from the one row (first, last) of ``bounds``: dates do not depend on what was traded."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("session"))
    return session_calendar(days.where(is_session(F.col("session"))))


def small(calendar: DataFrame) -> DataFrame:
    """Broadcast mark for a calendar; see the bound in the module text."""
    return F.broadcast(calendar)


def with_session_columns(df: DataFrame, calendar: DataFrame, on: str, **columns: str) -> DataFrame:
    """Attach calendar columns: ``with_session_columns(t, cal, "session", entry="next_session")``."""
    picked = calendar.select(
        F.col("session").alias(on), *[F.col(src).alias(dst) for dst, src in columns.items()]
    )
    return df.join(small(picked), on, "left")


def roll_table(calendar: DataFrame) -> DataFrame:
    """Every civil date in range with its same-or-next and same-or-previous session."""
    bounds = calendar.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    dates = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    marked = dates.join(
        small(calendar.select(F.col("session").alias("day"), F.col("session").alias("hit"), "ord")),
        "day",
        "left",
    )
    up = Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    down = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.select(
        "day",
        F.col("hit").isNotNull().alias("is_session"),
        F.first("hit", ignorenulls=True).over(up).alias("next_session"),
        F.last("hit", ignorenulls=True).over(down).alias("prev_session"),
        F.last("ord", ignorenulls=True).over(down).alias("floor_ord"),
    )


def sessions_in_range(calendar: DataFrame, start: Column, end: Column) -> DataFrame:
    return calendar.where(F.col("session").between(start, end))


def last_completed(instants: DataFrame, closes: DataFrame, instant: str = "ts") -> DataFrame:
    """Latest session whose close has passed at each instant.

    ``closes`` has ``session`` and ``close_ts``. Only the two sessions around
    an instant's date can matter, so the join is an equality on the date of the
    instant, not a range scan of the calendar.
    """
    order = Window.orderBy("session")
    spans = closes.withColumn("before", F.lag("session").over(order))
    rolled = roll_table(closes.withColumn("ord", F.row_number().over(order))).select(
        F.col("day").alias("_day"), F.col("prev_session").alias("session")
    )
    per_day = rolled.join(small(spans), "session")
    newest = spans.agg(F.max("session").alias("_newest"))
    keyed = instants.withColumn("_date", F.to_date(F.col(instant))).crossJoin(small(newest))
    keyed = keyed.withColumn("_day", F.least("_date", "_newest"))
    return (
        keyed.join(small(per_day), "_day", "left")
        .withColumn(
            "completed_session",
            F.when(F.col("close_ts") <= F.col(instant), F.col("session")).otherwise(F.col("before")),
        )
        .drop("_day", "_date", "_newest", "session", "before", "close_ts")
    )


def session_distance(df: DataFrame, calendar: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Sessions strictly after ``start`` through ``end``; either may be a non-session."""
    roll = roll_table(calendar).select("day", "floor_ord")
    left = roll.select(F.col("day").alias(start), F.col("floor_ord").alias("_a"))
    right = roll.select(F.col("day").alias(end), F.col("floor_ord").alias("_b"))
    return (
        df.join(small(left), start, "left")
        .join(small(right), end, "left")
        .withColumn(out, F.col("_b") - F.col("_a"))
        .drop("_a", "_b")
    )


def chronological_split(calendar: DataFrame, purge: int = 21) -> DataFrame:
    """Label each session with its evidence window.

    Boundaries sit at floor(3n/5) and floor(4n/5); the last ``purge`` sessions
    before each boundary belong to neither side.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    labelled = calendar.select("session", "ord", n.alias("n"))
    dev = F.floor(F.col("n") * 3 / F.lit(5))
    oos = F.floor(F.col("n") * 4 / F.lit(5))
    kind = (
        F.when(F.col("ord") <= dev - purge, "development")
        .when(F.col("ord") <= dev, "development_validation_purge")
        .when(F.col("ord") <= oos - purge, "validation")
        .when(F.col("ord") <= oos, "validation_oos_purge")
        .otherwise("oos")
    )
    return labelled.select("session", "ord", kind.alias("kind"))


def split_windows(calendar: DataFrame, purge: int = 21) -> DataFrame:
    """One row per window: start, exclusive end, session count."""
    order = Window.orderBy("start_session")
    grouped = (
        chronological_split(calendar, purge)
        .groupBy("kind")
        .agg(
            F.min("session").alias("start_session"),
            F.max("session").alias("last_session"),
            F.count(F.lit(1)).alias("session_count"),
        )
    )
    return grouped.withColumn(
        "end_exclusive",
        F.coalesce(F.lead("start_session").over(order), F.date_add("last_session", 1)),
    ).drop("last_session")


def study_range(manifest: DataFrame, calendar: DataFrame, cutoff: Column, buffer: int = 21) -> DataFrame:
    """Evaluation start, exclusive end and coverage end from a bar manifest.

    Start is the latest first session; the end leaves ``buffer`` outcome
    sessions before the cutoff. ``late_members`` counts securities that do not
    end on the cutoff, which makes the range unusable.
    """
    ranked = calendar.where(F.col("session") <= cutoff).withColumn(
        "_back", F.row_number().over(Window.orderBy(F.col("session").desc()))
    )
    end = ranked.where(F.col("_back") == buffer).select("session").scalar()
    facts = manifest.agg(
        F.max("first_session").alias("evaluation_start"),
        F.count_if(F.col("last_session") != cutoff).alias("late_members"),
    )
    return facts.select(
        "evaluation_start",
        end.alias("evaluation_end_exclusive"),
        F.date_add(cutoff, 1).alias("coverage_end_exclusive"),
        "late_members",
    )
