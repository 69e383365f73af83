"""Swings of price series as a stream whose view equals the batch after every trigger.

Points wait in state until the watermark passes them, then they are folded in order of date; what the
fold closes is settled and never changes. After every trigger a series also gives its open view: the moves
that the waiting points would close, and the move that is still going on.
"""

from __future__ import annotations

import datetime as dt
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOVES = "ticker string, kind string, start date, start_px double, end date, end_px double, ongoing boolean, settled boolean, version long"
_EPOCH = dt.date(1970, 1, 1)
Point = tuple[dt.date, float]


class Zigzag:
    """Direction, running extremes and origin of the open move of one series."""

    KIND = "n long, dir int, lo_dt date, lo double, hi_dt date, hi double, from_dt date, from_px double, last_dt date, last_px double"

    def __init__(self, threshold: float, held: tuple | None = None):
        self.up, self.down, self.threshold = 1 + threshold, 1 - threshold, threshold
        self.n, self.dir, self.lo, self.hi, self.origin, self.last = 0, 0, None, None, None, None
        if held is not None:
            self.n, self.dir, *rest = held
            self.lo, self.hi, self.origin, self.last = (tuple(rest[k : k + 2]) for k in range(0, 8, 2))

    def held(self) -> tuple:
        return (self.n, self.dir, *self.lo, *self.hi, *self.origin, *self.last)

    def add(self, point: Point) -> tuple | None:
        """The move that the point closes, if any."""
        px, done = point[1], None
        self.n, self.last = self.n + 1, point
        if self.n == 1:
            self.lo = self.hi = self.origin = point
        elif self.dir == 0:
            if px >= self.lo[1] * self.up:
                self.dir, self.origin, self.hi = 1, self.lo, point
            elif px <= self.hi[1] * self.down:
                self.dir, self.origin, self.lo = -1, self.hi, point
            else:
                self.lo = point if px < self.lo[1] else self.lo
                self.hi = point if px > self.hi[1] else self.hi
        elif self.dir == 1:
            if px >= self.hi[1]:
                self.hi = point
            elif px <= self.hi[1] * self.down:
                done = ("rally", *self.origin, *self.hi)
                self.dir, self.origin, self.lo = -1, self.hi, point
        elif px <= self.lo[1]:
            self.lo = point
        elif px >= self.lo[1] * self.up:
            done = ("decline", *self.origin, *self.lo)
            self.dir, self.origin, self.hi = 1, self.lo, point
        return done

    def ongoing(self) -> tuple | None:
        """The open move, if it makes half the threshold."""
        if self.dir and self.last[0] > self.origin[0] and abs(self.last[1] / self.origin[1] - 1) >= self.threshold / 2:
            return ("rally" if self.dir == 1 else "decline", *self.origin, *self.last)
        return None


class SwingProcessor(StatefulProcessor):
    """State of the series of one key: of each the fold up to the watermark, and the points that wait for it.

    All of it is one value, read and written once a trigger. Rows without a ticker are of the series that the key names.
    """

    def __init__(self, threshold: float = 0.25, min_points: int = 8, view: bool = True):
        self.threshold, self.min_points, self.view = threshold, min_points, view

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", "held binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: dict[str, list[Point]] = {}
        for pdf in rows:
            names = pdf["ticker"] if "ticker" in pdf else [key[0]] * len(pdf)
            for name, day, px in zip(names, pdf["dt"], pdf["close_px"], strict=True):
                new.setdefault(name, []).append((day, float(px)))
        yield self._advance(new, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._advance({}, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, new: dict[str, list[Point]], times: Any) -> pd.DataFrame:
        """Bring on the series that have new points or some that the watermark has passed."""
        mark = _EPOCH + dt.timedelta(days=times.getCurrentWatermarkInMs() // 86_400_000)  # days are whole
        found = self.state.get()
        held, timer = pickle.loads(found[0]) if found is not None else ({}, None)
        out: list[tuple] = []
        first = None
        for name in held.keys() | new.keys():
            fold, waiting, version = held.get(name, (None, [], 0))
            due = waiting and waiting[0][0] <= mark and len(waiting) + (fold[0] if fold else 0) >= self.min_points
            if name in new or due:
                rows, fold, waiting = self._series(fold, sorted([*waiting, *new.get(name, [])]), mark)
                version += 1
                held[name] = (fold, waiting, version)
                out += [(name, *r, version) for r in rows]
            late = bisect_right(waiting, mark, key=lambda p: p[0])
            if late < len(waiting) and (first is None or waiting[late][0] < first):
                first = waiting[late][0]
        at = None if first is None else _millis(first)
        if at != timer:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(at)
        self.state.update((pickle.dumps((held, at)),))
        columns = ["ticker", "kind", "start", "start_px", "end", "end_px", "ongoing", "settled", "version"]
        made = pd.DataFrame(out, columns=columns)
        return made.astype({"start_px": "float64", "end_px": "float64", "ongoing": "object", "settled": "bool", "version": "int64"})

    def _series(self, fold: tuple | None, points: list[Point], mark: dt.date) -> tuple[list[tuple], tuple | None, list[Point]]:
        """Fold what the watermark has passed, keep the rest, and give the settled moves and the open view."""
        zigzag = Zigzag(self.threshold, fold)
        out: list[tuple] = []
        ready = bisect_right(points, mark, key=lambda p: p[0])
        if zigzag.n + ready >= self.min_points and ready:  # a shorter series has no moves yet: all of it waits
            out += [(*m, False, True) for p in points[:ready] if (m := zigzag.add(p))]
            points, fold = points[ready:], zigzag.held()
        if self.view:
            view = []
            if zigzag.n + len(points) >= self.min_points:
                view = [(*m, False, False) for p in points if (m := zigzag.add(p))]
                view += [(*m, True, False)] if (m := zigzag.ongoing()) else []
            out += view or [(None, None, None, None, None, None, False)]  # says that nothing is open now
        return out, fold, points


def _millis(day: dt.date) -> int:
    return (day - _EPOCH).days * 86_400_000


def swing_stream(prices: DataFrame, threshold: float = 0.25, min_points: int = 8, delay: str = "60 days", view: bool = True, n_buckets: int = 128) -> DataFrame:
    """Moves of a stream of (ticker, dt, close_px), as MOVES; write it in update mode, or without view in append mode.

    Points may arrive in any order; one that comes after the watermark (the largest date less `delay`) has
    passed its date is dropped, as Spark does with late rows. Rows with a null are left out. Settled rows
    are final. The others are a series' open view as of its `version`, and the next version replaces them; a
    row of nulls says that nothing is open. A series of fewer than min_points points gives no move. Series are held in
    n_buckets by a hash of their ticker, a bucket's state as one value; the number stays for as long as the checkpoint does.
    """
    points = prices.where("ticker is not null and dt is not null and close_px is not null")
    timed = points.select("ticker", "dt", "close_px", F.timestamp_millis(F.unix_date("dt").cast("long") * 86_400_000).alias("at")).withWatermark("at", delay)
    return timed.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(n_buckets))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SwingProcessor(threshold, min_points, view), outputStructType=MOVES, outputMode="Update" if view else "Append", timeMode="EventTime"
    )


def current_swings(moves: DataFrame) -> DataFrame:
    """All moves as of now, from all rows that a swing stream has given: settled ones and each series' last view."""
    last = moves.groupBy("ticker").agg(F.max("version").alias("last"))
    held = moves.join(last, "ticker").where("(settled or version = last) and kind is not null")
    return held.select("ticker", "kind", "start", "start_px", "end", "end_px", "ongoing").distinct()
