"""Read models: trade examples, chart windows, flattened documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators import features as FT
from barloom.operators.asof import asof_backward


def trade_examples(trades: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Best win and worst loss per strategy; one stands in for the other when a kind is missing."""
    row = F.struct(*[c for c in trades.columns if c != key])
    pnl = F.col("gross_pnl")
    best = F.max_by(F.when(pnl > 0, row), F.when(pnl > 0, F.struct(pnl, F.col("candidate_id"))))
    worst = F.min_by(F.when(pnl < 0, row), F.when(pnl < 0, F.struct(pnl, F.col("candidate_id"))))
    both = trades.groupBy(key).agg(best.alias("best"), worst.alias("worst"))

    def example(kind, main, other):
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.col(main).isNull()).alias("fallback"),
            F.coalesce(main, other).alias("trade"),
        )

    rows = F.array(example("win", "best", "worst"), example("loss", "worst", "best"))
    return (
        both.select(key, F.explode(rows).alias("e"))
        .where(F.col("e.trade").isNotNull())
        .select(key, "e.kind", "e.fallback", "e.trade.*")
    )


def win_loss_counts(trades: DataFrame, key: str = "strategy_id") -> DataFrame:
    pnl = F.col("gross_pnl")
    return trades.groupBy(key).agg(
        F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), F.count_if(pnl == 0).alias("flats")
    )


def indicator_overlay(bars: DataFrame) -> DataFrame:
    """Chart indicators; here the average is plotted from the first bar on."""
    keys, order = ["security_id"], "session"
    df = FT.with_ema(bars, F.col("close"), 5, "ema5", keys, order, full_only=False)
    return (
        df.withColumn("sma10", FT.rolling(F.avg, F.col("close"), 10, keys, order))
        .withColumn("low10", FT.rolling(F.min, F.col("low"), 10, keys, order))
        .withColumn("low20", FT.rolling(F.min, F.col("low"), 20, keys, order))
        .withColumn("high20", FT.rolling(F.max, F.col("high"), 20, keys, order))
    )


def trade_windows(trades: DataFrame, bars: DataFrame, pad: int = 8) -> DataFrame:
    """Bars from ``pad`` before the entry bar to ``pad`` after the exit bar of each trade.

    Positions are looked up once per trade, unfolded over the window and
    joined by equality on (security, position).
    """
    order = Window.partitionBy("security_id").orderBy("session")
    placed = bars.withColumn("pos", F.row_number().over(order))
    where = placed.select("security_id", F.col("session").alias("at"), F.col("pos").alias("found"))
    by = ["security_id"]
    before_entry = trades.withColumn("_eve", F.date_sub("entry_session", 1))
    by_month = lambda moment: F.trunc(moment, "MM")
    entered = asof_backward(before_entry, where, by, "_eve", "at", ["found"], slice_of=by_month)
    entered = entered.withColumn("_entry", F.coalesce("found", F.lit(0)) + 1).drop("_eve", "at", "found")
    left = asof_backward(entered, where, by, "exit_session", "at", ["found"], slice_of=by_month)
    spans = left.where(F.col("found").isNotNull()).withColumn("_exit", F.col("found")).drop("at", "found")
    ends = placed.groupBy("security_id").agg(F.max("pos").alias("_last"))
    known = spans.join(ends, "security_id").where(F.col("_entry") <= F.col("_last"))
    steps = known.withColumn(
        "pos",
        F.explode(
            F.sequence(F.greatest(F.lit(1), F.col("_entry") - pad), F.least(F.col("_last"), F.col("_exit") + pad))
        ),
    ).drop("_entry", "_exit", "_last")
    return steps.join(placed, ["security_id", "pos"])


def ranked_entries(ranking: DataFrame, entries: str, names: DataFrame, key: str, top: int) -> DataFrame:
    """Display rows of an ordered list of entries with looked-up names."""
    rows = ranking.select(
        *[c for c in ranking.columns if c != entries], F.posexplode(F.slice(entries, 1, top)).alias("_p", key)
    )
    return rows.withColumn("rank", F.col("_p") + 1).drop("_p").join(names, key, "left")


def scalar_rows(docs: DataFrame, key: str, doc: str, depth: int = 4) -> DataFrame:
    """Flatten JSON text to (path, value) rows.

    Nulls are skipped, lists of scalars are joined, lists of objects are
    numbered. What is nested below ``depth`` stays one row with its JSON text.
    """
    none = F.lit(None).cast("variant")

    def row(path, value=None, inner=None):
        return F.struct(
            path.alias("path"),
            (F.lit(None).cast("string") if value is None else value).alias("value"),
            (none if inner is None else inner).alias("v"),
        )

    def is_nested(x):
        return F.is_variant_null(x) | F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")

    rows = docs.select(
        F.col(key), F.lit("").alias("path"), F.lit(None).cast("string").alias("value"), F.try_parse_json(doc).alias("v")
    )
    path, value = F.col("path"), F.col("value")
    for step in range(depth + 1):
        kind = F.schema_of_variant("v")
        typed = rows.withColumn(
            "_items", F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
        ).withColumn("_object", kind.startswith("OBJECT"))
        nested = F.exists("_items", is_nested)
        fields = F.transform(
            F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')")),
            lambda e: row(F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])), inner=e["value"]),
        )
        numbered = F.transform(
            F.col("_items"),
            lambda x, i: row(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), inner=x),
        )
        joined = F.array_join(F.expr("try_variant_get(v, '$', 'array<string>')"), ", ")
        text = F.when(F.col("_items").isNotNull(), joined).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
        deeper = F.array(row(path, F.to_json("v"))) if step == depth else None
        children = (
            F.when(value.isNotNull(), F.array(row(path, value)))
            .when(F.col("v").isNull() | F.is_variant_null("v"), None)
            .when(F.col("_object"), fields if deeper is None else deeper)
            .when(nested, numbered if deeper is None else deeper)
            .otherwise(F.array(row(path, text)))
        )
        rows = typed.select(key, F.inline(children))
    return rows.select(key, "path", "value")


def window_bounds(docs: DataFrame) -> DataFrame:
    """Evidence bounds from three documents, first complete source first.

    Columns ``m_*`` (manifest), ``s_*`` (selection) and ``p_*`` (protocol) hold
    start, end and outcome; empty text counts as missing.
    """

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    whole = text("m_start").isNotNull() & text("m_end").isNotNull()

    def pick(field: str, late: bool) -> Column:
        first = text(f"m_{field}")
        second = F.coalesce(first, text(f"s_{field}"))
        settled = F.coalesce(text("m_start"), text("s_start")).isNotNull()
        third = F.coalesce(second, text(f"p_{field}")) if late else second
        return F.when(whole, first).when(settled, second).otherwise(third)

    return docs.withColumns(
        {
            "evidence_start": pick("start", True),
            "evidence_end": pick("end", True),
            "outcome_end": pick("outcome", False),
        }
    )


def name_index(compact: DataFrame, full: DataFrame, key: str = "identity") -> DataFrame:
    """Names from the compact index, falling back to the full records."""
    short = compact.select(key, F.col("name").alias("_c"))
    long = full.select(key, F.col("name").alias("_f"))
    return long.join(short, key, "full_outer").select(key, F.coalesce("_c", "_f").alias("name")).where(
        F.coalesce(F.col("name"), F.lit("")) != ""
    )


def without_fields(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """Drop bulky nested fields; they are then pruned from the scan as well."""
    return df.withColumn(column, F.col(column).dropFields(*fields))
