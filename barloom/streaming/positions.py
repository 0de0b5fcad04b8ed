"""Open-position tracker: the bars of each security taken in order of their session over all batches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the tracker puts out; ``exit_day`` counts days from 1970-01-01.
TRACKED = (
    "candidate_id string, security_id string, exit_day int, exit_reason string, exit_price double, sessions_held int"
)
#: One row for each bucket of securities: their names and the last session taken of each, the open positions and the bars
#: that wait, with the entries on them. Numbers are kept as the bytes of their arrays and texts as JSON lists.
STATE = (
    "names string, last binary, "
    "open_of binary, open_ids string, open_stops binary, open_targets binary, open_held binary, "
    "bars_of binary, days binary, prices binary, counts binary, ids string, stops binary, targets binary"
)
#: Days as numbers from 0 to 2^23, below the number of the security.
_DAY_BITS, _DAY_ZERO = 23, 1 << 21
#: Positions whose paths are laid out at once.
POSITIONS = 1 << 14
BUCKETS = 1024
#: A bar this old is dropped by Spark itself; younger ones reach the tracker, which reports them when they are late.
HORIZON_DAYS = 36525
DAY_MS = 86_400_000


def touched(bar, stops: np.ndarray, targets: np.ndarray, held: np.ndarray, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit reason (empty: none) and price of positions, each on its bar.

    A position in its first session was opened on this bar, so its open can't gap over a level.
    """
    opened, high, low, close = bar
    carried = held > 1
    cases = [carried & (opened <= stops), carried & (opened >= targets), low <= stops, high >= targets, held == hold]
    reason = np.select(cases, ["gap_stop", "gap_target", "stop", "target", "time"], "")
    price = np.select(cases, [opened, opened, stops, targets, close], np.nan)
    return reason, price


class Bars(NamedTuple):
    """Bars, each of the security with the number ``of``, and the entries opened on them, bar after bar: ``counts`` of them on each."""

    of: np.ndarray
    days: np.ndarray
    prices: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    stops: np.ndarray
    targets: np.ndarray

    def at(self, places: np.ndarray) -> Bars:
        """The bars at these places, in this order."""
        ends = np.cumsum(self.counts)
        starts, counts = (ends - self.counts)[places], self.counts[places]
        entries = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        bars = (x[places] for x in self[:3])
        return Bars(*bars, counts, *(x[entries] for x in self[4:]))


class Positions(NamedTuple):
    """Open positions, each of the security with the number ``of``, with the sessions they were held."""

    of: np.ndarray
    ids: np.ndarray
    stops: np.ndarray
    targets: np.ndarray
    held: np.ndarray


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _together(parts: list):
    return type(parts[0])(*(np.concatenate(columns) for columns in zip(*parts, strict=True)))


_INT, _NONE = np.zeros(0, np.int64), _objects([])
NO_BARS = Bars(_INT, _INT, np.zeros((0, 4)), _INT, _NONE, np.zeros(0), np.zeros(0))
NO_POSITIONS = Positions(_INT, _NONE, np.zeros(0), np.zeros(0), _INT)


def _flat(arrays: pd.Series, kind) -> np.ndarray:
    held = [np.asarray(x, kind) for x in arrays if x is not None and len(x)]
    return np.concatenate(held) if held else np.zeros(0, kind)


def _bars_of(part: pd.DataFrame, numbers: dict[str, int]) -> Bars:
    """The bars of a frame; securities not met before get the next numbers."""
    of = np.array([numbers.setdefault(name, len(numbers)) for name in part["security_id"]], np.int64)
    counts = np.array([0 if x is None else len(x) for x in part["ids"]], np.int64)
    prices = np.stack([part[c].to_numpy(float, na_value=np.nan) for c in ("open", "high", "low", "close")], axis=1)
    entries = _flat(part["ids"], object), _flat(part["stops"], float), _flat(part["targets"], float)
    return Bars(of, part["day"].to_numpy(np.int64), prices, counts, *entries)


class PositionTracker(StatefulProcessor):
    """Carries open positions and bars that are not yet due across batches.

    Input rows are bars of the securities of one bucket, each with the entries opened on it. A bar waits in the
    state until the watermark has passed its session by ``delay`` days, then the waiting bars of its security are
    taken in order. A bar at or before the last session taken is late: it changes nothing and comes out as a row
    with the reason ``late_bar``. A security has at most one bar per session (of several in waiting the
    first that came counts, the others are late) and every position ends within ``hold`` bars, so the
    state is bounded by securities of the bucket x (strategies x hold and the bars of ``delay`` days and of one batch).
    """

    def __init__(self, hold: int, delay: int = 0):
        self.hold, self.delay = hold, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self.advance(rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.advance([], timerValues.getCurrentWatermarkInMs())

    def advance(self, rows: Iterable[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        """Take all bars that are due and leave the others waiting; exits and late bars as rows."""
        names, last, positions, waiting = self._load()
        numbers = {name: k for k, name in enumerate(names)}
        arrived = [_bars_of(part, numbers) for part in rows]
        bars, names = _together([waiting, *arrived]), _objects(list(numbers))
        last = np.concatenate((last, np.full(len(names) - len(last), np.iinfo(np.int64).min)))
        young = np.flatnonzero(bars.days > last[bars.of])
        _, first = np.unique((bars.of[young] << _DAY_BITS) + bars.days[young] + _DAY_ZERO, return_index=True)
        first = young[first]
        late = np.ones(len(bars.days), bool)
        late[first] = False
        ready = bars.days[first] <= watermark // DAY_MS - self.delay
        if ready.any():
            due = bars.at(first[ready])
            positions, closed = self._take(due, positions, len(names))
            np.maximum.at(last, due.of, due.days)
        else:
            closed = []
        queue = bars.at(np.sort(first[~ready]))
        if ready.any() or arrived:
            self._store(names, last, positions, queue)
        if len(queue.days):
            # One millisecond early: a timer fires when the watermark is past it.
            self.handle.registerTimer((int(queue.days.min()) + self.delay) * DAY_MS - 1)
        if late.any():
            reason = np.full(late.sum(), "late_bar")
            closed.append((_objects([None] * len(reason)), bars.of[late], bars.days[late], reason, bars.prices[late, 3], bars.counts[late]))
        for ids, of, days, reasons, prices, held in closed:
            yield pd.DataFrame(
                {"candidate_id": ids, "security_id": names[of], "exit_day": days.astype(np.int32), "exit_reason": reasons, "exit_price": prices, "sessions_held": held.astype(np.int32)}
            )

    def _take(self, bars: Bars, positions: Positions, securities: int) -> tuple[Positions, list[tuple]]:
        """The positions that stay open after these bars, which come by security and in order, and the exits on them as arrays.

        The path of each position is laid out as a row of at most ``hold`` bars, on which its first exit is looked up.
        """
        ends = np.cumsum(np.bincount(bars.of, minlength=securities))
        begins = np.concatenate(([0], ends[:-1]))
        opened_on = np.repeat(np.arange(len(bars.days)), bars.counts)
        entered = Positions(bars.of[opened_on], bars.ids, bars.stops, bars.targets, np.zeros(len(opened_on), np.int64))
        starts = np.concatenate((begins[positions.of], opened_on))
        of, ids, stops, targets, before = held = _together([positions, entered])
        opened, high, low, close = bars.prices.T
        closed, gone, step = [], np.zeros(len(ids), bool), np.arange(self.hold)
        for begin in range(0, len(ids), POSITIONS):
            some = slice(begin, begin + POSITIONS)
            stop, target, left = stops[some, None], targets[some, None], self.hold - before[some, None]
            place = starts[some, None] + step
            there = (place < ends[of[some], None]) & (step < left)
            place = np.minimum(place, len(bars.days) - 1)
            # A gap over a level that the low or high does not reach is told by the open.
            gap = (before[some, None] + step > 0) & ((opened[place] <= stop) | (opened[place] >= target))
            met = there & (gap | (low[place] <= stop) | (high[place] >= target) | (step == left - 1))
            out = np.flatnonzero(met.any(axis=1))
            k = met[out].argmax(axis=1)
            bar, at = place[out, k], out + begin
            reason, price = touched((opened[bar], high[bar], low[bar], close[bar]), stops[at], targets[at], before[at] + k + 1, self.hold)
            gone[at] = True
            if len(at):
                closed.append((ids[at], of[at], bars.days[bar], reason, price, before[at] + k + 1))
        stay = np.flatnonzero(~gone)
        held = Positions(*(x[stay] for x in held))
        return held._replace(held=held.held + ends[held.of] - starts[stay]), closed

    def _load(self) -> tuple[list[str], np.ndarray, Positions, Bars]:
        kept = self.state.get()
        if kept is None:
            return [], _INT, NO_POSITIONS, NO_BARS
        names, last, *kept = kept
        whole, texts = (lambda x: np.frombuffer(x, np.int64)), (lambda x: _objects(json.loads(x)))
        of, ids, stops, targets, held = kept[:5]
        positions = Positions(whole(of), texts(ids), np.frombuffer(stops), np.frombuffer(targets), whole(held))
        of, days, prices, counts, ids, stops, targets = kept[5:]
        prices = np.frombuffer(prices).reshape(-1, 4)
        return json.loads(names), whole(last), positions, Bars(whole(of), whole(days), prices, whole(counts), texts(ids), np.frombuffer(stops), np.frombuffer(targets))

    def _store(self, names: np.ndarray, last: np.ndarray, positions: Positions, queue: Bars) -> None:
        columns = (names, last, *positions, *queue)
        self.state.update(tuple(json.dumps(x.tolist()) if x.dtype == object else x.tobytes() for x in columns))

    def close(self) -> None:
        pass


def track_positions(bars: DataFrame, hold: int = 21, delay: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Stream of exits, and of bars that came too late, from a stream of bars with their entries.

    Batches may bring sessions in any order within ``delay`` days of the newest session seen by any
    security; so a row without entries of a security of its own serves as the close of a day. Rows
    without a security or a session are left out. Securities are kept in ``buckets``, whose number stays for the
    life of a checkpoint: each call costs a few milliseconds, however many bars it brings.
    """
    clock = F.timestamp_seconds((F.unix_date("session").cast("bigint") + HORIZON_DAYS) * 86400)
    entries = [F.col(f"entries.{name}").alias(alias) for name, alias in (("candidate_id", "ids"), ("stop", "stops"), ("target", "targets"))]
    timed = bars.where("security_id IS NOT NULL AND session IS NOT NULL").select(
        F.pmod(F.xxhash64("security_id"), F.lit(buckets)).alias("bucket"), "security_id", F.unix_date("session").alias("day"), "open", "high", "low", "close", *entries, clock.alias("_clock")
    )
    tracked = (
        timed.withWatermark("_clock", f"{HORIZON_DAYS} days")
        .groupBy("bucket")
        .transformWithStateInPandas(PositionTracker(hold, delay), outputStructType=TRACKED, outputMode="append", timeMode="EventTime")
    )
    return tracked.withColumn("exit_day", F.date_from_unix_date("exit_day")).withColumnRenamed("exit_day", "exit_session")


def exits(tracked: DataFrame) -> DataFrame:
    return tracked.where("exit_reason <> 'late_bar'")


def late_bars(tracked: DataFrame) -> DataFrame:
    """Bars that came after a later session of their security had been taken; ``entries`` on them were not opened."""
    late = tracked.where("exit_reason = 'late_bar'")
    return late.select("security_id", F.col("exit_session").alias("session"), F.col("exit_price").alias("close"), F.col("sessions_held").alias("entries"))
