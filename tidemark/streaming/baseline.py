"""State of the alert stream: the sums of the last days per scope, and timers for days without any request.

Days arrive summed (one row per scope and closed day), so the state of a scope is at most `days` small rows, whatever the traffic.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = timedelta(days=1)
OUTPUT = "scope string, window_start timestamp, n bigint, articles double, seconds double, n_base bigint, articles_base double, seconds_base double"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class DailyBaseline(StatefulProcessor):
    """Each closed day with its sums and those of the `days` days up to it; days without requests come too, with nothing in them.

    A silent day is told when the next active one arrives, or when the watermark passes its end, whichever is first; never twice. Late days (before one
    that was told) are left out, as the watermark promises that there are none. What lies further back than `days` days is dropped from the state, and so
    is the scope itself after `days` silent days.
    """

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "day int", "n bigint, articles double, seconds double")
        self.told = handle.getValueState("told", "day int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                arrived[_number(r.window_start)] = (int(r.n), float(r.articles), float(r.seconds))
        out = []
        for day in sorted(arrived):
            last = self._last()
            if last is not None and day <= last:
                continue
            if last is not None:
                out += [self._row(key, d) for d in range(max(last + 1, day - self.days), day)]
            self.sums.updateValue((day,), arrived[day])
            out.append(self._row(key, day))
            self.told.update((day,))
        self._wait()
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self._last()
        out = []
        if last is not None:
            closed = int(timerValues.getCurrentWatermarkInMs()) // 86_400_000 - 1  # the last day that has ended
            for day in range(last + 1, min(closed, last + self.days) + 1):
                out.append(self._row(key, day))
                self.told.update((day,))
            if list(self.sums.keys()):
                self._wait()
            else:
                self.told.clear()
        yield _frame(out)

    def close(self) -> None:
        pass

    def _last(self) -> int | None:
        return self.told.get()[0] if self.told.exists() else None

    def _wait(self) -> None:
        """One timer, for the end of the day after the last one told."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((self._last() + 2) * 86_400_000)

    def _row(self, key: Any, day: int) -> tuple:
        held = {k[0]: v for k, v in self.sums.iterator()}
        for old in [d for d in held if d <= day - self.days]:
            self.sums.removeKey((old,))
            del held[old]
        base = [sum(v[i] for d, v in held.items() if d <= day) for i in range(3)]
        own = held.get(day, (0, 0.0, 0.0))
        return (key[0], _EPOCH.replace(tzinfo=None) + day * DAY, own[0], own[1], own[2], int(base[0]), float(base[1]), float(base[2]))


def _number(stamp: Any) -> int:
    """The day's number since 1970, of a zoned or session-time stamp in UTC."""
    stamp = pd.Timestamp(stamp)
    stamp = stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")
    return (stamp - pd.Timestamp(_EPOCH)).days


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"window_start": "datetime64[us]", "n": "int64", "n_base": "int64", **dict.fromkeys(["articles", "seconds", "articles_base", "seconds_base"], "float64")})
