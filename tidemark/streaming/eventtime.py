"""Keyed operators that work in event-time order, on ``transformWithStateInPandas``.

A key's rows wait in a typed list state, one entry of column arrays per batch that came in, until the watermark has passed them.  An event-time timer then hands the rows that
are due, sorted by time, to ``advance`` together with what the key carried over.  So results depend neither on the cut
into micro-batches nor on the order of arrival inside the allowed delay.  Rows older than the watermark are dropped by
Spark and counted (``replay.late_rows``).  State is bounded by the delay (rows that wait) plus what ``advance`` carries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import micros

Carry = list[tuple]
Advance = Callable[[Carry, pd.DataFrame], tuple[Carry, pd.DataFrame | None]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(stream: DataFrame, ts: str = "ts", delay: str | None = "0 seconds") -> DataFrame:
    """The stream with an event-time watermark on ``ts``; ``delay`` None says that it has one already."""
    if delay is None:
        return stream
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def after_watermark(timed: DataFrame, condition: Column, ts: str = "ts") -> DataFrame:
    """Rows that meet the condition, filtered where the watermark has seen all rows.

    The optimiser moves a plain filter below the watermark, and then rows that only tell the time no longer move it.  A
    predicate that reads the event time stays where it is.
    """
    return timed.where(F.least(F.coalesce(condition, F.lit(False)).cast("int"), F.col(ts).isNotNull().cast("int")) == 1)


def _plain(value):
    return value.tolist() if isinstance(value, np.ndarray) else value


class EventOrder(StatefulProcessor):
    """Holds rows back until they are due and lets a key expire when it has been silent for ``idle_ms``."""

    def __init__(self, key: str, columns: list[str], row_schema: str, carry_schema: str, advance: Advance, order: list[str],
                 outputs: list[str], idle_ms: int | None):
        self.key, self.columns, self.row_schema, self.carry_schema = key, columns, row_schema, carry_schema
        self.advance, self.order, self.outputs, self.idle_ms = advance, order, outputs, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.carried = handle.getListState("carried", self.carry_schema)
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for batch in rows:
            first = int(batch["us"].min())
            oldest = first if oldest is None else min(oldest, first)
            self.waiting.appendValue(tuple([_plain(v) for v in batch[c].tolist()] for c in self.columns))
        if oldest is not None:
            self._wake(oldest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = list(self.waiting.get())
        rows = {c: list(chain.from_iterable(chunk[i] for chunk in chunks)) for i, c in enumerate(self.columns)}
        frame = pd.DataFrame(rows, columns=self.columns)
        due = frame["us"].to_numpy(dtype=np.int64) <= passed
        later = None
        if due.any():
            out = self._advance(frame[due])
            if due.all():
                self.waiting.clear()
            else:
                keep = np.flatnonzero(~due).tolist()
                self.waiting.put([tuple([rows[c][i] for i in keep] for c in self.columns)])
            if out is not None and len(out):
                out.insert(0, self.key, [key[0]] * len(out))
                yield out[self.outputs]
        if not due.all():
            later = int(frame["us"][~due].min())
        if later is not None:
            self._wake(later)
        elif self.idle_ms is not None and self.newest.exists():
            ends = self.newest.get()[0] + self.idle_ms * 1000
            if ends <= passed:
                self.carried.clear()
                self.newest.clear()
            else:
                self._wake(ends)

    def close(self) -> None:
        pass

    def _advance(self, due: pd.DataFrame) -> pd.DataFrame | None:
        frame = due.sort_values(self.order, kind="stable", ignore_index=True)
        carry, out = self.advance(list(self.carried.get()), frame)
        if carry:
            self.carried.put(carry)
        else:
            self.carried.clear()
        self.newest.update((int(frame["us"].iloc[-1]),))
        return out

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))


def in_event_time(stream: DataFrame, columns: list[str], advance: Advance, carry_schema: str, out_schema: str, key: str = "symbol",
                  delay: str | None = "0 seconds", idle_ms: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``advance(carried, due rows) -> (carried, output or None)`` to each key of a stream with a ``ts`` column.

    ``columns`` of the stream reach ``advance``, with ``us`` (microseconds of ``ts``) in front.  Rows with a NULL key only move
    the watermark.  ``idle_ms`` forgets a key that has been silent that long in event time; None keeps what it carries for
    good.  The state store is RocksDB, the one Spark offers for typed state, so this sets it for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = after_watermark(watermarked(stream, "ts", delay), F.col(key).isNotNull())
    rows = timed.select(key, "ts", micros("ts").alias("us"), *columns)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["us", *columns]
    outputs = [f.split()[0] for f in out_schema.split(", ")]
    processor = EventOrder(key, names, ", ".join(f"{n} array<{types[n]}>" for n in names), carry_schema, advance, ["us", *order], outputs, idle_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, out_schema, "append", "EventTime")
