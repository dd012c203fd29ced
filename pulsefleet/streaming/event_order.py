"""Keyed streams in the order of event time, whatever the order of delivery.

Rows of a key wait in list state until the watermark has passed them; a timer then releases them in order, once, to
the key's kernel. So windows and scores do not depend on files, batches or their order, as long as no row comes
later than ``lateness`` behind the newest one. A row behind the watermark cannot be put in order any more: it comes out
marked ``late`` for a quarantine table and changes no state. A timer after ``idle_ms`` of silence calls the kernel's
``close`` (for a last row, such as the end of an episode) and clears the key's state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from pulsefleet.operators.sequential import Kernel, output_names
from pulsefleet.operators.windows import SERIES
from pulsefleet.streaming.stream import store_rows, window_kernel

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AT = "__at"


@contextmanager
def list_state(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _plain(value):
    """A cell as the list state stores it."""
    if isinstance(value, (np.ndarray, list)):
        return [_plain(v) for v in value]
    return None if value is None or value != value else value


def _cells(rows: pd.DataFrame) -> list[tuple]:
    return [tuple(map(_plain, row)) for row in rows.astype(object).itertuples(index=False, name=None)]


#: Called with a key's state when the key is silent: output columns of a closing row, or None for no row.
Close = Callable[[object], dict | None]


class InOrder(StatefulProcessor):
    """Buffers rows, and folds the kernel over those that the watermark has passed."""

    def __init__(
        self, keys: list[str], order: list[str], names: list[str], rest: StructType, kernel: Kernel, idle_ms: int | None, close: Close | None
    ) -> None:
        self.keys, self.order, self.names, self.rest = keys, order, names, rest
        self.kernel, self.idle_ms, self.close_key = kernel, idle_ms, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rest)
        self.folded = handle.getValueState("folded", StructType().add("state", StringType()))

    def _marks(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(self.order, kind="stable", ignore_index=True)

    def _wake(self, at: int) -> None:
        """One timer per key: at ``at`` milliseconds."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _ms(self, micros: int) -> int:
        # The watermark is whole milliseconds; a row has passed once the whole millisecond has.
        return int(micros) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if any(v is None or v != v for v in key):
            return
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for pdf in rows:
            # A row without a time can never be put in order either.
            late = ~(pdf[self.order[0]] >= mark * 1000)
            if late.any():
                yield pdf.loc[late, [*self.keys, *self.order]].assign(late=True, **{n: None for n in self.names})
            fresh = pdf.loc[~late, self.rest.names]
            if len(fresh):
                self.waiting.appendList(_cells(fresh))
                low = int(fresh[self.order[0]].min())
                first = low if first is None else min(first, low)
        if first is not None:
            due = [int(t) for t in self.handle.listTimers()]
            if not due or self._ms(first) < min(due):
                self._wake(self._ms(first))

    def _runs(self, rows: pd.DataFrame, last: list | None) -> Iterator[tuple[bool, pd.DataFrame]]:
        """The rows cut where a key was silent for longer than ``idle_ms``: whether a silence came before, the rows."""
        if not len(rows):
            return
        times = rows[self.order[0]]
        before = times.shift(fill_value=last[0] if last else times.iloc[0])
        gap = times - before > self.idle_ms * 1000 if self.idle_ms is not None else times != times
        for _, run in rows.groupby(gap.cumsum(), sort=True):
            yield bool(gap.loc[run.index[0]]), run.reset_index(drop=True)

    def _closing(self, key: tuple, inner: object, last: list) -> Iterator[pd.DataFrame]:
        row = self.close_key(inner) if self.close_key is not None else None
        if row is not None:
            yield pd.DataFrame([{**dict(zip(self.keys, key)), **dict(zip(self.order, last)), "late": False, **row}])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.folded.get() if self.folded.exists() else None
        inner, last = json.loads(kept[0]) if kept else (None, None)
        mark = timerValues.getCurrentWatermarkInMs()
        rows = self._marks(pd.DataFrame(list(self.waiting.get()), columns=self.rest.names))
        passed = rows[self.order[0]].map(self._ms) <= mark
        stay = rows[~passed]
        for silent, run in self._runs(rows[passed].reset_index(drop=True), last):
            if silent:
                yield from self._closing(key, inner, last)
                inner = None
            columns, inner = self.kernel({c: run[c].tolist() for c in run.columns}, inner)
            last = [int(v) for v in run[self.order].iloc[-1]]
            yield run[self.order].assign(**dict(zip(self.keys, key)), late=False, **columns)[[*self.keys, *self.order, "late", *self.names]]
        due = [self._ms(stay[self.order[0]].iloc[0])] if len(stay) else []
        if self.idle_ms is not None and last is not None:
            silent_at = self._ms(last[0]) + self.idle_ms
            if silent_at <= mark:
                # All rows up to the watermark are out, so none came in time.
                yield from self._closing(key, inner, last)
                inner = last = None
            else:
                due.append(silent_at)
        if len(stay):
            self.waiting.put(_cells(stay))
        else:
            self.waiting.clear()
        if last is not None:
            self.folded.update((json.dumps([inner, last]),))
        else:
            self.folded.clear()
        if due:
            self._wake(min(due))

    def close(self) -> None:
        pass


def in_event_order(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Kernel, outputs: str, lateness: str,
    idle_ms: int | None = None, close: Close | None = None,
) -> DataFrame:
    """Streaming twin of ``sequential.fold`` for rows that come in any order.

    order     whole-number columns; the first is the event time in microseconds
    lateness  how far the watermark stays behind the newest row of the stream
    idle_ms   event time of silence after which a key's state is dropped; ``close`` may then give a last row

    Returns the keys, the order columns, ``late`` and the outputs. Rows with a null key only move the watermark:
    such a row, after the last one, lets a finite stream release everything. State grows with the rows of
    ``lateness``; start the query inside ``list_state``.
    """
    keys, order = list(keys), list(order)
    columns = [c for c in stream.columns if c not in keys]
    rest = StructType([stream.schema[c] for c in columns])
    kinds = {c: stream.schema[c].dataType.simpleString() for c in [*keys, *order]}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", late boolean, " + outputs
    # Late rows must reach the processor, so the watermarked column itself is not among its input.
    marked = stream.withColumn(_AT, F.timestamp_micros(order[0])).withWatermark(_AT, lateness).select(*stream.columns)
    processor = InOrder(keys, order, output_names(outputs), rest, kernel, idle_ms, close)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventtime")


def windowed(stream: DataFrame, keys: Sequence[str], order: Sequence[str], lateness: str, series: Sequence[str] = SERIES) -> DataFrame:
    """Each row that ends a full window, with ``values`` (per series the window, oldest first), and the late rows."""
    outputs = ", ".join(f"{c}_window array<double>" for c in series)
    rows = in_event_order(stream, keys, order, window_kernel(series), outputs, lateness)
    values = F.when(~F.col("late"), F.struct(*[F.col(f"{c}_window").alias(c) for c in series]))
    return rows.where(F.col("late") | F.col(f"{series[0]}_window").isNotNull()).select(*keys, *order, "late", values.alias("values"))


def store_in_order(rows: DataFrame, folder: str, checkpoint: str, seconds: float | None = None):
    """Store the rows of ``in_event_order``; late ones are told apart by ``late`` when read (``quarantined``)."""
    with list_state(rows.sparkSession):
        return store_rows(rows, folder, checkpoint, seconds)


def quarantined(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The late rows of a stored result: keys and order columns."""
    names = rows.columns[: rows.columns.index("late")]
    return rows.where("late").select(*names)
