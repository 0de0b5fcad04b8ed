"""Market-shaped views derived from the given order tables.

One order line is read as an intraday print of the security named by its
supplier. All prices are whole cents derived with integer arithmetic, so both
Spark and an oracle engine see exactly the same numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.operators.bars import bars_from_prints
from barloom.operators.scaled import dealt_by
from barloom.operators.sessions import exchange_calendar, rolled_days, small

CAPITAL = 100_000
TICK = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


#: Declared and never traded, so that the field holds a strategy without trades at every size.
IDLE_STRATEGY = "Brand#99"


def tick_number() -> Column:
    """The tick columns packed into one number with the same order.

    Twelve digits each for order and part, two for the line, nine for cents.
    """

    def place(value: Column, digits: int, shift: int) -> Column:
        return value.cast(f"decimal({digits},0)") * F.lit(Decimal(10**shift)).cast(f"decimal({shift + 1},0)")

    cents = F.round(F.col("l_extendedprice") * 100)
    packed = (
        place(F.col("l_orderkey"), 12, 23)
        + place(F.col("l_linenumber"), 2, 21)
        + place(F.col("l_partkey"), 12, 9)
        + cents.cast("decimal(9,0)")
    )
    return packed.cast("decimal(38,0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines with integer price parts; what ships while the exchange is closed counts for the next session."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return (
        lines.join(small(rolled_days(spark)), "day")
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
            "l_returnflag",
            "l_linestatus",
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("security_id"),
            F.col("next_session").alias("session"),
            (10000 + F.floor(F.round(F.col("l_extendedprice") * 100) / 10000)).cast("long").alias("price_c"),
            F.round(F.col("l_discount") * 100).cast("long").alias("disc_c"),
            F.round(F.col("l_tax") * 100).cast("long").alias("tax_c"),
            F.col("l_quantity").cast("long").alias("qty"),
        )
    )


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dollars(cents):
        return cents.cast("double") / 100

    p, d, t = F.col("price_c"), F.col("disc_c"), F.col("tax_c")
    return order_lines(spark, sf_dir).select(
        *TICK,
        tick_number().alias("tick"),
        "security_id",
        "session",
        dollars(p).alias("open"),
        dollars(p + t * 10).alias("high"),
        dollars(p - d * 10).alias("low"),
        dollars(p + (t - d) * 10).alias("close"),
        (F.col("qty") * 1000).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, dealt by security: there are no more than order lines, whose number stands in the file footers."""
    lines = table(spark, sf_dir, "lineitem").count()
    return dealt_by(bars_from_prints(prints(spark, sf_dir), ["tick"]), ["security_id"], lines)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange sessions by rule from a week before the first print to 60 days after the newest.

    The two dates are read once here, so the plan holds them as literals and
    no use of the calendar scans the facts again.
    """
    day = F.to_date("l_shipdate")
    lo, hi = table(spark, sf_dir, "lineitem").agg(F.date_sub(F.min(day), 7), F.date_add(F.max(day), 60)).first()
    bounds = spark.range(1).select(F.lit(lo).cast("date").alias("first"), F.lit(hi).cast("date").alias("last"))
    return exchange_calendar(bounds)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as one signal of the strategy named by the part's brand.

    Signal on the ship session, entry on the next one, planned exit up to 20
    sessions later. The calendar reaches past every planned exit.
    """
    cal = calendar(spark, sf_dir).select("session", "ord")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    lines = order_lines(spark, sf_dir).withColumnRenamed("session", "signal_session")
    signal = cal.select(F.col("session").alias("signal_session"), F.col("ord").alias("signal_ord"))
    entry = cal.select(F.col("session").alias("entry_session"), F.col("ord").alias("entry_ord"))
    leave = cal.select(F.col("session").alias("exit_session"), F.col("ord").alias("exit_ord"))
    cents = F.lit(0.01).cast("decimal(3,2)")

    def money(col):
        return (col.cast("decimal(12,0)") * cents).cast("decimal(18,2)")

    reason = (
        F.when(F.col("l_linenumber") % 4 == 0, "earnings_blackout")
        .when(F.col("l_linenumber") % 4 == 1, "minimum_signal_price")
        .when(F.col("l_linenumber") % 4 == 2, "missing_entry_bar")
        .otherwise("portfolio_cap")
    )
    filled = F.col("l_linestatus") == "F"
    out = F.col("price_c") + (F.col("disc_c") - 5) * 10
    return (
        lines.join(small(signal), "signal_session")
        .withColumn("entry_ord", F.col("signal_ord") + 1)
        .withColumn("exit_ord", (F.col("entry_ord") + F.col("l_orderkey") % 21).cast("int"))
        .join(small(entry), "entry_ord")
        .join(small(leave), "exit_ord")
        .join(part, "l_partkey")
        .select(
            F.col("p_brand").alias("strategy_id"),
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
            ).alias("candidate_id"),
            "security_id",
            F.col("p_type").alias("symbol"),
            "signal_session",
            "entry_session",
            "exit_session",
            "entry_ord",
            "exit_ord",
            F.when(filled, "filled").otherwise("rejected").alias("status"),
            F.when(filled, "filled").otherwise(reason).alias("reason"),
            F.col("qty").alias("quantity"),
            money(F.col("price_c")).alias("entry_price"),
            money(out).alias("exit_price"),
            (money(out - F.col("price_c")) * F.col("qty").cast("decimal(10,0)")).cast("decimal(18,2)").alias("gross_pnl"),
            F.when(F.col("l_returnflag") == "A", "stop")
            .when(F.col("l_returnflag") == "N", "target")
            .otherwise("time")
            .alias("exit_reason"),
        )
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where(F.col("status") == "filled").drop("status", "reason")


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared strategy: the brands, and one that never trades."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("strategy_id"))
    return brands.union(spark.createDataFrame([(IDLE_STRATEGY,)], "strategy_id string")).where("strategy_id IS NOT NULL").distinct()


def cohort_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALL = CORE + FRINGE, split by brand number."""
    brands = strategies(spark, sf_dir)
    number = F.regexp_extract("strategy_id", r"(\d+)$", 1).cast("int")
    names = F.array(F.lit("ALL"), F.when(number <= 13, "CORE").otherwise("FRINGE"))
    return brands.select(F.explode(names).alias("cohort"), "strategy_id")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal events from orders: known up to 30 days ahead, some superseded."""
    key = F.col("o_orderkey")
    event = F.to_date("o_orderdate")
    known = F.date_sub(event, (key % 30).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("security_id"),
        key.alias("event_id"),
        event.alias("event_session"),
        known.alias("known_session"),
        F.when(key % 3 == 0, F.date_add(known, (1 + key % 7).cast("int"))).alias("superseded_session"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only position ledger from the event stream."""
    status = (
        F.when(F.col("event_type").isin("purchase", "signup"), "closed")
        .when(F.col("event_type") == "error", "cancelled")
        .otherwise("open")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entry_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.col("event_type").alias("family"),
        status.alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("amount_c"),
        "props",
    )
