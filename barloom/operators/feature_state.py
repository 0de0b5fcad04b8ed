"""Features of new bars from kept state instead of from history.

One state row per security holds what the features of its next bar need: the
newest bars up to the longest lookback, the last value of every exponential
average, the open week and month, and the completed ones. A batch of bars is
folded into the state in session order, so the work of a session grows with the
number of securities and not with the length of their history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.dates import month_start, week_end
from barloom.operators.features import Feature
from barloom.operators.sessions import small
from barloom.sources.sinks import _exists

BAR = "struct<session:date,open:double,high:double,low:double,close:double,volume:double>"
PERIODS = {"weekly": (week_end, "week_last"), "monthly": (month_start, "month_last")}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last(ring: Column) -> Column:
    return F.get(ring, F.size(ring) - 1)


def _push(ring: Column, bar: Column, most: int) -> Column:
    """The ring with one bar more, cut to its ``most`` newest."""
    return _let(F.concat(ring, F.array(bar)), lambda r: F.slice(r, F.greatest(F.size(r) - most + 1, F.lit(1)), F.lit(most)))


def _tail(values: Column, n: int) -> Column:
    """The last ``n`` values if all of them are there, else null."""
    return _let(
        F.filter(F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n)), lambda v: v.isNotNull()),
        lambda full: F.when(F.size(full) >= n, full),
    )


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(_tail(values, n), F.lit(0.0), lambda total, v: total + v) / n


def _true_ranges(ring: Column) -> Column:
    def reach(bar, i):
        before = F.get(ring, i - 1)["close"]
        return F.greatest(bar["high"] - bar["low"], F.abs(bar["high"] - before), F.abs(bar["low"] - before))

    return F.transform(ring, reach)


class FeatureState:
    """How a feature set is kept and moved on by one bar.

    ``adv_lookback`` is the length of the average dollar volume that goes with the features.
    """

    def __init__(self, features: Sequence[Feature], adv_lookback: int):
        self.features, self.adv_lookback = tuple(features), adv_lookback
        self.averages = [f for f in self.features if f.operation == "ema"]
        values = ",".join(f"{f.name}:double" for f in self.features)
        frames = ",".join(
            f"{frame}_ring:array<{BAR}>,{frame}_open:struct<key:date,bar:{BAR}>" for frame in PERIODS
        )
        averages = "".join(f",ema_{f.name}:struct<y:double,n:bigint>" for f in self.averages)
        self.schema = (
            f"struct<session:date,row:struct<{values},weekly_available:date,monthly_available:date,adv:double>,"
            f"before:struct<{values}>,daily_ring:array<{BAR}>,{frames}{averages}>"
        )

    def _of(self, frame: str) -> list[Feature]:
        return [f for f in self.features if f.timeframe == frame]

    def _depth(self, frame: str) -> int:
        lookbacks = [f.lookback + 1 for f in self._of(frame) if f.operation != "ema"]
        return max([1, *lookbacks, *([self.adv_lookback] if frame == "daily" else [])])

    def _taken(self, frame: str, kept: Column, bar: Column) -> Column:
        """Ring and averages of a frame after one more bar of it."""
        fields = [_push(kept["ring"], bar, self._depth(frame)).alias("ring")]
        for f in self.averages:
            if f.timeframe == frame:
                alpha, x, old = 2.0 / (f.lookback + 1), bar[f.source], kept[f"ema_{f.name}"]
                y = F.when(F.coalesce(old["n"], F.lit(0)) == 0, x).otherwise(alpha * x + (1 - alpha) * old["y"])
                new = F.struct(y.alias("y"), (F.coalesce(old["n"], F.lit(0)) + 1).cast("bigint").alias("n"))
                fields.append(F.when(x.isNull(), old).otherwise(new).alias(f"ema_{f.name}"))
        return F.struct(*fields)

    def _value(self, f: Feature, kept: Column) -> Column:
        ring = kept["ring"]
        if f.operation == "ema":
            average = kept[f"ema_{f.name}"]
            return F.when(average["n"] >= f.lookback, average["y"])
        values = F.transform(ring, lambda bar: bar[f.source])
        if f.operation == "raw":
            return _last(values)
        if f.operation == "sma":
            return _mean(values, f.lookback)
        if f.operation == "rolling_min":
            return F.array_min(_tail(values, f.lookback))
        if f.operation == "rolling_max":
            return F.array_max(_tail(values, f.lookback))
        if f.operation == "return":
            return _let(values, lambda v: _last(v) / F.get(v, F.size(v) - 1 - f.lookback) - 1)
        return _mean(_true_ranges(ring), f.lookback)

    def _values(self, frame: str, kept: Column) -> list[Column]:
        return [self._value(f, kept).alias(f.name) for f in self._of(frame)]

    def _kept(self, frame: str, state: Column) -> Column:
        """A frame's part of the state; empty before the first bar."""
        ring = F.coalesce(state[f"{frame}_ring"], F.array().cast(f"array<{BAR}>"))
        own = [state[f"ema_{f.name}"].alias(f"ema_{f.name}") for f in self.averages if f.timeframe == frame]
        return F.struct(ring.alias("ring"), *own)

    def _period(self, frame: str, state: Column, bar: Column) -> Column:
        """(known, kept, open): the frame as the new bar shows the past, after the bar, and the period left open.

        A bar of a later period completes the open one; the exchange's last session of a period completes its own.
        """
        period_of, last = PERIODS[frame]
        price = F.struct(*[bar[c].alias(c) for c in ("session", "open", "high", "low", "close", "volume")])

        def opened(s):
            key, old = period_of(bar["session"]), s["open"]["bar"]
            grown = F.struct(
                bar["session"].alias("session"), old["open"].alias("open"), F.greatest(old["high"], bar["high"]).alias("high"),
                F.least(old["low"], bar["low"]).alias("low"), bar["close"].alias("close"),
                F.coalesce(old["volume"] + bar["volume"], old["volume"], bar["volume"]).alias("volume"),
            )
            same = F.coalesce(s["open"]["key"] == key, F.lit(False))
            known = F.when(s["open"].isNotNull() & ~same, self._taken(frame, s["kept"], old)).otherwise(s["kept"])
            return F.struct(known.alias("known"), F.when(same, grown).otherwise(price).alias("bar"), key.alias("key"))

        def closed(s):
            done = F.coalesce(bar["session"] >= bar[last], F.lit(False))
            return F.struct(
                s["known"].alias("known"),
                F.when(done, self._taken(frame, s["known"], s["bar"])).otherwise(s["known"]).alias("kept"),
                F.when(~done, F.struct(s["key"].alias("key"), s["bar"].alias("bar"))).alias("open"),
            )

        start = F.struct(self._kept(frame, state).alias("kept"), state[f"{frame}_open"].alias("open"))
        return _let(_let(start, opened), closed)

    def after(self, state: Column, bar: Column, values: bool = True) -> Column:
        """The state moved on by a bar; a bar at or before the state's session changes nothing.

        Without ``values`` the feature rows stay those of the state before: two more bars with values replace both.
        """
        price = F.struct(*[bar[c].alias(c) for c in ("session", "open", "high", "low", "close", "volume")])
        parts = F.struct(
            self._taken("daily", self._kept("daily", state), price).alias("daily"),
            *[self._period(frame, state, bar).alias(frame) for frame in PERIODS],
        )

        def whole(p):
            frames = {"daily": p["daily"], **{frame: p[frame]["kept"] for frame in PERIODS}}
            rings = []
            for frame in PERIODS:
                rings += [p[frame]["kept"]["ring"].alias(f"{frame}_ring"), p[frame]["open"].alias(f"{frame}_open")]
            kept = [
                p["daily"]["ring"].alias("daily_ring"), *rings,
                *[frames[f.timeframe][f"ema_{f.name}"].alias(f"ema_{f.name}") for f in self.averages],
            ]
            if not values:
                return F.struct(bar["session"].alias("session"), state["row"].alias("row"), state["before"].alias("before"), *kept).cast(self.schema)
            now = {f.name: self._value(f, frames[f.timeframe]) for f in self.features}
            before = {
                f.name: state["row"][f.name] if f.timeframe == "daily" else self._value(f, p[f.timeframe]["known"])
                for f in self.features
            }
            dollars = F.transform(p["daily"]["ring"], lambda b: b["close"] * b["volume"])
            seen = [_last(p[frame]["kept"]["ring"])["session"].alias(f"{frame}_available") for frame in PERIODS]
            return F.struct(
                bar["session"].alias("session"),
                F.struct(*[c.alias(n) for n, c in now.items()], *seen, _mean(dollars, self.adv_lookback).alias("adv")).alias("row"),
                F.struct(*[c.alias(n) for n, c in before.items()]).alias("before"), *kept,
            ).cast(self.schema)

        late = F.coalesce(bar["session"] <= state["session"], F.lit(False))
        return F.when(late, state).otherwise(_let(parts, whole))

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], f"security_id string, state {self.schema}")

    def advance(self, kept: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
        """States after a batch of bars, of one session or of many.

        Bars are unique on (security, session), so a security's bars of a batch are at most one
        per session of the calendar. Securities without new bars keep their state.
        """
        bounds = calendar.select("session", "week_last", "month_last")
        prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
        new = (
            bars.where("session IS NOT NULL").join(small(bounds), "session", "left").groupBy("security_id")
            .agg(F.array_sort(F.collect_list(F.struct("session", *prices, "week_last", "month_last"))).alias("_bars"))
        )
        joined = kept.join(new, "security_id", "full_outer")
        return joined.select("security_id", self._moved.alias("state"))

    @cached_property
    def _moved(self) -> Column:
        """``state`` after ``_bars``; long to build, hence once for all sessions.

        A row holds the features of the newest bar and of the one before, so only the last two bars get values.
        """
        first = F.slice("_bars", F.lit(1), F.greatest(F.size("_bars") - 2, F.lit(0)))
        newest = F.slice("_bars", F.greatest(F.size("_bars") - 1, F.lit(1)), F.lit(2))
        begun = F.aggregate(first, F.col("state"), lambda state, bar: self.after(state, bar, values=False))
        return F.when(F.col("_bars").isNull(), F.col("state")).otherwise(F.aggregate(newest, begun, lambda state, bar: self.after(state, bar)))

    def matrix(self, states: DataFrame, session: Column) -> DataFrame:
        """Feature rows of the securities that have a bar on ``session``, as ``feature_matrix`` gives them.

        ``before`` holds the features a row earlier. ``session`` may be a column of ``states``, so
        that several versions are read at once.
        """
        return states.where(F.col("state.session") == session).select(
            "security_id", F.col("state.session").alias("session"),
            F.element_at("state.daily_ring", -1)["close"].alias("close"), "state.row.*", F.col("state.before").alias("before"),
        )


class FeatureStore:
    """Versions of the state under ``root``, one folder per session.

    A version is written from the newest complete one before its session and replaces what a crash left in its place,
    so a session taken again gives the same version. Readers take only folders that Spark marked as complete.
    """

    def __init__(self, spark: SparkSession, root: str, kind: FeatureState):
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind

    def versions(self) -> list[str]:
        """Sessions with a complete version, oldest first."""
        if not _exists(self.spark, self.root):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/session=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().getParent().getName().removeprefix("session=") for f in found or ())

    def read(self, version: str | None) -> DataFrame:
        if version is None:
            return self.kind.empty(self.spark)
        return self.spark.read.schema(f"security_id string, state {self.kind.schema}").parquet(f"{self.root}/session={version}")

    def read_all(self) -> DataFrame:
        """All complete versions, each with its session."""
        versions = [F.lit(v).cast("date") for v in self.versions()]
        schema = f"security_id string, state {self.kind.schema}, session date"
        return self.spark.read.schema(schema).parquet(self.root).where(F.col("session").isin(versions))

    def take(self, session, bars: DataFrame, calendar: DataFrame) -> DataFrame:
        """Write the version of a session from the one before it and the bars up to the session; returns it."""
        before = max((v for v in self.versions() if v < str(session)), default=None)
        day = F.lit(session).cast("date")
        fresh = F.col("session") <= day
        if before is not None:
            fresh = fresh & (F.col("session") > F.lit(before).cast("date"))
        moved = self.kind.advance(self.read(before), bars.where(fresh), calendar)
        moved.write.mode("overwrite").parquet(f"{self.root}/session={session}")
        return self.read(str(session))
