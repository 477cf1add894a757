"""Sessions over a stream whose rows come out of order, with the rows that came too late counted and not lost.

Time is cut into slots as wide as the gap, so rows of one slot always belong together. Rows are combined per (key, slot) where they are
read; state holds one entry per open slot, all of a key in one value. Slots that have ended before the watermark can't change any more,
so neighbours among them become one entry: a key has as many entries as slots fit into the delay, and a few more, however long its
session lasts.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

PART = T.StructType([T.StructField(c, T.LongType()) for c in ("lo", "hi", "n")])
ENTRY = ("slot", *PART.fieldNames())
#: A key's open slots, column by column, and the time of its timer in milliseconds.
OPEN = T.StructType([T.StructField("wake", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ENTRY)])


def _combined(keys: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A combiner in front of the shuffle: one entry per key and slot of what a task reads at a time, one row per key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            slots = frame.groupby([*keys, "slot"], dropna=False, as_index=False, sort=False).agg(lo=("t", "min"), hi=("t", "max"), n=("t", "size"))
            of = slots.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            lists = {c: np.split(slots[c].to_numpy()[order], first[1:]) for c in ENTRY}
            yield slots.iloc[order[first]][list(keys)].assign(**{c: pd.Series(v, dtype=object).to_numpy() for c, v in lists.items()})

    return run


class _Sessions(StatefulProcessor):
    """One key. All times are in microseconds. The open slots and the time of the timer are one value, read and written once a batch:
    every call to the state is a round trip to the JVM."""

    def __init__(self, keys: Sequence[str], gap: int):
        self._keys, self._gap = list(keys), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", OPEN)

    def _row(self, key: Any, part: str, entry: tuple[int, int, int]) -> Row:
        return Row(**dict(zip(self._keys, key, strict=True)), part=part, lo=entry[0], hi=entry[1], n=entry[2])

    def _held(self) -> tuple[dict[int, tuple[int, int, int]], int | None]:
        """The open slots, and when the timer goes off."""
        held = self._open.get()
        if held is None:
            return {}, None
        wake, slot, *parts = held
        return dict(zip(slot, zip(*parts, strict=True), strict=True)), wake

    def _settled(self, key: Any, slots: dict[int, tuple[int, int, int]], first_open: int, old_wake: int | None) -> Iterator[Row]:
        """Puts out the sessions that nothing can join any more, joins ended slots of one session, and sets the timer for the next."""
        runs: list[list[tuple[int, tuple[int, int, int]]]] = []
        for slot, entry in sorted(slots.items()):
            if runs and entry[0] - runs[-1][-1][1][1] <= self._gap:
                runs[-1].append((slot, entry))
            else:
                runs.append([(slot, entry)])
        wake, left = None, []
        for run in runs:
            last = run[-1][1][1]
            closing = (last + self._gap) // self._gap + 1  # the first slot of which no row can come within the gap
            if closing <= first_open:
                yield self._row(key, "session", (run[0][1][0], last, sum(e[2] for _, e in run)))
                continue
            wake = closing if wake is None else min(wake, closing)
            ended = [(slot, e) for slot, e in run if slot < first_open]
            if len(ended) > 1:
                ended = [(ended[-1][0], (ended[0][1][0], ended[-1][1][1], sum(e[2] for _, e in ended)))]
            left += ended + [(slot, e) for slot, e in run if slot >= first_open]
        if wake is None:
            self._open.clear()
        else:
            wake = wake * self._gap // 1000
            self._open.update((wake, [slot for slot, _ in left], *([e[i] for _, e in left] for i in range(3))))
        if wake != old_wake:
            if old_wake is not None:
                self._handle.deleteTimer(old_wake)
            if wake is not None:
                self._handle.registerTimer(wake)

    def _first_open(self, times: TimerValues) -> int:
        return max(times.getCurrentWatermarkInMs(), 0) * 1000 // self._gap

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        first_open, late = self._first_open(timerValues), {}
        slots, wake = self._held()
        for row in rows:
            for slot, *entry in zip(*(row[c] for c in ENTRY), strict=True):
                into = late if slot < first_open else slots
                old = into.get(slot)
                into[slot] = tuple(entry) if old is None else (min(old[0], entry[0]), max(old[1], entry[1]), old[2] + entry[2])
        yield from (self._row(key, "late", late[slot]) for slot in sorted(late))
        yield from self._settled(key, slots, first_open, wake)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        slots, wake = self._held()
        # Spark itself takes away the timer that went off
        yield from self._settled(key, slots, self._first_open(timerValues), None if wake == expiredTimerInfo.getExpiryTimeInMs() else wake)

    def close(self) -> None:
        pass


def sessions_with_late(events: DataFrame, keys: Sequence[str], at: str, gap_seconds: int, delay: str) -> DataFrame:
    """Runs of a stream's rows with at most `gap_seconds` between neighbours, per key: part ('session'), session_start, last_event,
    events. A session comes out once the watermark (`delay` behind the newest row of earlier batches) says that nothing can join it.

    A row whose slot has ended before the watermark is late. Late rows come out too, one row of part 'late' per key, slot and batch with
    first and last time and their number. So every row with a time counts once: in a session, as late, or in state. Sessions are those
    of `alerts.alert_sessions` over the rows that weren't late. Rows without a time are left out, a null key is a key. The session must
    keep its state in RocksDB (`memory.state_session`).
    """
    gap = gap_seconds * 1_000_000
    timed = events.filter(F.col(at).isNotNull()).select(*keys, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", delay)
    micros = F.unix_micros("_at")
    slotted = timed.select(*keys, micros.alias("t"), F.floor(micros / gap).cast("long").alias("slot"))
    own = [slotted.schema[k] for k in keys]
    partial = T.StructType([*own, *OPEN.fields[1:]])
    # the combiner's rows carry no event time, so none is dropped in front of the state
    parts = slotted.mapInPandas(_combined(keys), partial)
    out = T.StructType([*own, T.StructField("part", T.StringType()), *PART.fields])
    rows = parts.groupBy(*keys).transformWithState(_Sessions(keys, gap), out, "append", "eventTime")
    return rows.select(*keys, "part", F.timestamp_micros("lo").alias("session_start"), F.timestamp_micros("hi").alias("last_event"), F.col("n").alias("events"))
