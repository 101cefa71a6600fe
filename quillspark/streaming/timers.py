"""Notices and cooldowns with state and timers, for records that come as a stream.

``notice_stream`` gives the notices that ``lifecycle.notices`` gives a daily run, and
those that no new record would bring: when a known issue date lies ahead, a timer
stands for the day, and the issue's notice goes out when the watermark passes it.
The rule for records that came with a backfill holds: an issue that was out then,
by the version of the record that was stored before, is not noticed any more.

``cooldown_stream`` holds the last attempt of each record and says when it is due
again; the state goes when the timer fires or the work is done, so what is kept is
what was tried within the cooldown.

Both run on event time, so a replay after a break gives the same rows: state, timers
and offsets are of one checkpoint.  They need the RocksDB state store
(``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Hours after which a look-up and a download are tried again.
LOOKUP_HOURS, DOWNLOAD_HOURS = 7 * 24, 24

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _day(ms: int) -> date:
    return datetime.fromtimestamp(ms / 1000, UTC).date()


def _ms(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp() * 1000)


def _text(value: object) -> str:
    return "" if value is None or value != value else str(value)


class NoticeProcessor(StatefulProcessor):
    """Input (id, ts, backfill, dated, volume, issueEnd): a version of a record as
    it is seen at ts; issueEnd is the last day of its issue date (ISO) or null."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # the stored version, the day of a backfill notice, whether an issue was noticed
        self._state = handle.getValueState("record", "volume string, issueEnd string, backfillDay string, issued boolean")

    @staticmethod
    def _ready(volume: str, end: str, today: date) -> bool:
        return volume != "" and end != "" and date.fromisoformat(end) <= today

    def _plan(self, end: str, now: int, wanted: bool) -> None:
        """One timer, on the day of the issue, as long as it is awaited."""
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        if wanted and end and _ms(end) > now:
            self._handle.registerTimer(_ms(end))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        known = self._state.get() if self._state.exists() else None
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            now = int(row.ts.timestamp() * 1000) if row.ts.tzinfo else int(row.ts.tz_localize("UTC").timestamp() * 1000)
            today, volume, end = _day(now), _text(row.volume), _text(row.issueEnd)
            ready = self._ready(volume, end, today)
            if known is None:
                kind = "backfill" if row.backfill or not row.dated else "issue" if ready else "online"
                out.append((key[0], kind, today.isoformat()))
                known = (volume, end, today.isoformat() if kind == "backfill" else "", kind == "issue")
            else:
                before, before_end, backfill_day, issued = known
                was_out = backfill_day != "" and self._ready(before, before_end, date.fromisoformat(backfill_day))
                if ready and not issued and not was_out:
                    out.append((key[0], "issue", today.isoformat()))
                    issued = True
                known = (volume, end, backfill_day, issued)
            self._state.update(known)
            self._plan(end, now, volume != "" and not known[3])
        yield pd.DataFrame(out, columns=["id", "kind", "day"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = _day(expiredTimerInfo.getExpiryTimeInMs())
        out = []
        if self._state.exists():
            volume, end, backfill_day, issued = self._state.get()
            was_out = backfill_day != "" and self._ready(volume, end, date.fromisoformat(backfill_day))
            if self._ready(volume, end, day) and not issued and not was_out:
                out.append((key[0], "issue", day.isoformat()))
                self._state.update((volume, end, backfill_day, True))
        yield pd.DataFrame(out, columns=["id", "kind", "day"])

    def close(self) -> None:
        pass


class CooldownProcessor(StatefulProcessor):
    """Input (id, ts, done): an attempt at ts, or that nothing is left to do."""

    def __init__(self, hours: int):
        self._hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long")

    def _clear(self) -> None:
        self._last.clear()
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            at = int(row.ts.timestamp() * 1000) if row.ts.tzinfo else int(row.ts.tz_localize("UTC").timestamp() * 1000)
            if self._last.exists() and self._last.get()[0] > at:
                continue  # a late report of an earlier attempt
            self._clear()
            if not row.done:
                self._last.update((at,))
                self._handle.registerTimer(at + self._hours * 3_600_000)
        yield pd.DataFrame([], columns=["id", "attempted", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self._last.exists():
            at = self._last.get()[0]
            out.append((key[0], at, at + self._hours * 3_600_000))
            self._last.clear()
        yield pd.DataFrame(out, columns=["id", "attempted", "due"])

    def close(self) -> None:
        pass


def notice_stream(versions: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(id, kind, day) of a stream of record versions; ``delay`` is how late a
    version may come."""
    use_state_store(versions.sparkSession)
    keyed = versions.withWatermark("ts", delay).groupBy("id")
    return keyed.transformWithStateInPandas(NoticeProcessor(), "id string, kind string, day string", "append", "EventTime")


def cooldown_stream(attempts: DataFrame, hours: int = LOOKUP_HOURS, delay: str = "0 seconds") -> DataFrame:
    """(id, attempted, due), in milliseconds, of records whose cooldown is over."""
    use_state_store(attempts.sparkSession)
    keyed = attempts.withWatermark("ts", delay).groupBy("id")
    return keyed.transformWithStateInPandas(CooldownProcessor(hours), "id string, attempted long, due long", "append", "EventTime")
