"""Findings that are new since earlier scans, with state that outlives a query.

Each identifier has one value in the state store: when it was last alerted. It is alerted again once its time has passed, and its
state goes by a timer when the watermark says so, so the store holds only identifiers of the last while. Keys are hashes.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from leakscope.operators.links import with_cluster_id

KEY = "identity_cluster_id"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB: on local disk, with changes uploaded to the checkpoint."""
    session = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


def last_alerts(records: DataFrame, at: str = "detected_at") -> DataFrame:
    """The state that stored leak records stand for: when each identifier was last found."""
    return records.filter(F.col(at).isNotNull()).groupBy(KEY).agg(F.max(F.unix_millis(F.col(at).cast("timestamp"))).alias("last_ms"))


class _Alerted(StatefulProcessor):
    """One identifier. Rows of a batch come in any order, so they are looked at by time."""

    def __init__(self, at: str, again_after_ms: int, resolution_ms: int):
        self._at, self._again, self._resolution = at, again_after_ms, resolution_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def _remember(self, ms: int, before: int | None) -> None:
        """Every call to the state is a round trip to the JVM; the timer is known by the time it stands for."""
        self._last.update((ms,))
        if before is not None:
            self._handle.deleteTimer(before + self._again)
        self._handle.registerTimer(ms + self._again)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self._last.get()
        last = held[0] if held is not None else None
        before, first = last, {}
        for row in rows:  # one row for each step of the clock, whatever a frequent identifier brings
            step = row["_ms"] // self._resolution
            if step not in first or (row["_ms"], row["_tie"]) < (first[step]["_ms"], first[step]["_tie"]):
                first[step] = row
        for step in sorted(first):
            if last is None or step * self._resolution >= last + self._again:
                last = step * self._resolution
                yield Row(**{c: first[step][c] for c in first[step].__fields__ if c not in ("_ms", "_tie")})
        if last != before:
            self._remember(last, before)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802, N803
        self._remember(initialState["last_ms"] // self._resolution * self._resolution, None)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self._last.get()
        # a timer of a run with another `again_after` may go off after a newer alert
        if held is not None and held[0] + self._again <= expiredTimerInfo.getExpiryTimeInMs():
            self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _first_of_each(resolution_ms: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A combiner in front of the shuffle: of a batch's rows one per identifier and step of the clock, the one that the state would take."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ordered = frame.assign(_step=frame["_ms"] // resolution_ms).sort_values([KEY, "_step", "_ms", "_tie"])
            yield ordered.drop_duplicates([KEY, "_step"]).drop(columns="_step")

    return keep


def milliseconds(duration: str) -> int:
    """'6 hours' -> 21600000, as pandas reads it."""
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def first_of_each(findings: DataFrame, resolution_ms: int, at: str = "detected_at") -> DataFrame:
    """Findings with their identifier, time in milliseconds and a hash that breaks ties, thinned out where they are read."""
    kept = with_cluster_id(findings.filter(F.col(at).isNotNull()))
    plain = [f.name for f in kept.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    timed = kept.withColumns({"_ms": F.unix_millis(F.col(at).cast("timestamp")), "_tie": F.xxhash64(*plain)})
    return timed.mapInPandas(_first_of_each(resolution_ms), timed.schema)


def new_since_last(findings: DataFrame, again_after: str = "7 days", stored: DataFrame | None = None, horizon: str = "1 day",
                   resolution: str = "1 second", at: str = "detected_at") -> DataFrame:
    """The findings of a stream that alert: the first of each identifier (type and normalised value, as in stored records), and again
    the first that comes `again_after` or more after the last alert. Adds identity_cluster_id.

    Runs on one checkpoint go on from each other, so a value of an earlier run isn't alerted in the next one. `stored` are leak
    records of scans before the first run: what they hold counts as alerted when it was last found. Times count in steps of
    `resolution`. Rows later than `horizon` behind the newest row of earlier batches are dropped, as the watermark says; rows without a
    time never alert. The session must keep its state in RocksDB (`state_session`).
    """
    again, step = milliseconds(again_after), milliseconds(resolution)
    combined = first_of_each(findings, step, at)
    schema = combined.drop("_ms", "_tie").schema
    keyed = combined.withWatermark(at, horizon).groupBy(KEY)
    state = None if stored is None else last_alerts(stored, at).groupBy(KEY)
    return keyed.transformWithState(_Alerted(at, again, step), schema, "append", "eventTime", initialState=state)
