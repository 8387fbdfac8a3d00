"""Visitor state on streams: repair of new visitors, daily unique visits, bounces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EMPTY = ("", None)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def repair_new_visitors(pages: DataFrame) -> DataFrame:
    """The first day a device claims to be new is kept as state and never moves."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        for rows in [pd.concat(list(frames))]:
            rows = rows.sort_values("ts", kind="stable")
            days, flags = rows["ts"].dt.strftime("%Y%m%d").tolist(), rows["is_new"].tolist()
            for i, (day, flag) in enumerate(zip(days, flags, strict=True)):
                if flag == "1":
                    first = first or day
                    flags[i] = "1" if day == first else "0"
            rows["is_new"] = flags
            if first:
                state.update((first,))
            yield rows

    return pages.groupBy("mid").applyInPandasWithState(run, _schema(pages), "first string", "append", GroupStateTimeout.NoTimeout)


def unique_visits(pages: DataFrame) -> DataFrame:
    """The first page without a predecessor of each device and day; state is the last day seen.

    State leaves a day after the watermark has passed its last page; pages need a watermark on ts.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        kept = []
        for day, before in zip(rows["ts"].dt.strftime("%Y%m%d"), rows["last_page_id"], strict=True):
            fresh = before in EMPTY and (last is None or day > last)
            kept.append(fresh)
            last = day if fresh else last
        if last:
            state.update((last,))
            ends = int(rows["ts"].max().timestamp() * 1000) + 86_400_000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows[kept]

    return pages.groupBy("mid").applyInPandasWithState(run, _schema(pages), "last string", "append", GroupStateTimeout.EventTimeTimeout)


class Bounces(StatefulProcessor):
    """First pages that nothing follows within a time limit, by event-time timers.

    Pages wait until the watermark passes them, so that each device's pages are judged in order.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ms long, page_id string, first boolean")
        self.open = handle.getValueState("open", "ts_ms long, page_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for ts, page, before in zip(frame["ts"], frame["page_id"], frame["last_page_id"], strict=True):
                ms = int(ts.timestamp() * 1000)
                self.waiting.appendValue((ms, page, before in EMPTY or pd.isna(before)))
                self.handle.registerTimer(ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        pages = sorted(tuple(x) for x in self.waiting.get())
        due, later = [p for p in pages if p[0] < now], [p for p in pages if p[0] >= now]
        out, held = [], tuple(self.open.get()) if self.open.exists() else None
        for ms, page, first in due:
            if held is not None and ms - held[0] >= self.limit_ms:
                out.append(held)
            held = (ms, page) if first else None
        if held is not None and now >= held[0] + self.limit_ms and (not later or later[0][0] - held[0] >= self.limit_ms):
            out.append(held)
            held = None
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if held is None:
            self.open.clear()
        else:
            self.open.update(held)
            self.handle.registerTimer(held[0] + self.limit_ms)
        if out:
            yield pd.DataFrame({"mid": [key[0]] * len(out), "page_id": [x[1] for x in out], "ts_ms": [x[0] for x in out]})


def bounces(pages: DataFrame, limit_ms: int = 10_000) -> DataFrame:
    """mid, page_id, ts_ms of bounced first pages; ``pages`` needs a watermark on ts.

    Needs the RocksDB state store provider.
    """
    return pages.groupBy("mid").transformWithStateInPandas(
        statefulProcessor=Bounces(limit_ms),
        outputStructType="mid string, page_id string, ts_ms long",
        outputMode="append",
        timeMode="eventTime",
    )
