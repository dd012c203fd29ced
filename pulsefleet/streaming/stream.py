"""Structured Streaming: batched writes, keyed state per device, late rows, sessions, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pulsefleet.operators import training
from pulsefleet.operators.sequential import Kernel, Rows, output_names
from pulsefleet.operators.windows import WINDOW
from pulsefleet.sources.sinks import SNAPSHOT_KEYS, flatten_snapshots, write_batch


#: Files of a micro-batch at most, so that a first batch is never a whole history.
FILES_PER_BATCH = 100


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _start(writer, seconds: float | None) -> StreamingQuery:
    """Every ``seconds``, or once over everything available when seconds is None."""
    timed = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return timed.start()


def store_snapshots(stream: DataFrame, folder: str, checkpoint: str, order: Sequence[str], seconds: float | None = 2.0) -> StreamingQuery:
    """Append nested snapshots as three keyed tables, one idempotent write per batch.

    Of the rows of a key the last by ``order`` counts, within a batch and, through ``sinks.read_keyed``,
    across batches: any cut into batches gives the same tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(flatten_snapshots(batch, order), folder, batch_id, order, SNAPSHOT_KEYS)

    return _start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), seconds)


def store_rows(stream: DataFrame, folder: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    return _start(
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint), seconds
    )


def stateful_fold(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kernel: Kernel,
    outputs: str,
    watermark: str | None = None,
    idle_ms: int | None = None,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Streaming twin of ``sequential.fold``: the same kernel, its state kept per key.

    Rows of a batch are put in order. A row that is not after the last accepted one of its key is
    late: it keeps ``late`` = true, null outputs, and does not touch the state. With a watermark
    column and ``idle_ms``, the state of a key that stays silent is dropped; ``lateness`` is how far behind
    the newest row the watermark stays. A task holds a key's rows of one micro-batch, which
    ``file_stream`` bounds by its number of files.
    """
    keys, order = list(keys), list(order)
    kept = keys + order
    kinds = {c: stream.schema[c].dataType.simpleString() for c in kept}
    names = output_names(outputs)
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", late boolean, " + outputs
    expires = watermark is not None and idle_ms is not None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        inner, last = json.loads(state.get[0]) if state.exists else (None, None)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        marks = list(pdf[order].itertuples(index=False, name=None))
        late = [False] * len(marks)
        high = tuple(last) if last is not None else None
        for i, mark in enumerate(marks):
            late[i] = high is not None and mark <= high
            high = high if late[i] else mark
        fresh = pdf[[not x for x in late]].reset_index(drop=True)
        if len(fresh):
            columns, inner = kernel({c: fresh[c].tolist() for c in fresh.columns}, inner)
            yield fresh[kept].assign(late=False, **columns)
            state.update((json.dumps([inner, [int(v) for v in high]]),))
            if expires:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        if any(late):
            yield pdf.loc[late, kept].assign(late=True, **{n: None for n in names})

    source = stream.withWatermark(watermark, lateness) if expires else stream
    timeout = GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout
    return source.groupBy(*keys).applyInPandasWithState(step, schema, "state string", "append", timeout)


# -- kernels that batch code expresses with frames ------------------------------------------


def rolling_mean_kernel(columns: Sequence[str], size: int = 30) -> Kernel:
    """Mean of the last rows of each column; the state is a bounded list per column."""

    def kernel(rows: Rows, state):
        state = state or [[] for _ in columns]
        out = {}
        for i, c in enumerate(columns):
            joined = [*state[i], *rows[c]]
            known = len(state[i])
            spans = [joined[max(0, k - size + 1) : k + 1] for k in range(known, len(joined))]
            out[f"{c}_mean"] = [sum(span) / len(span) for span in spans]
            state[i] = joined[-(size - 1) :]
        return out, state

    return kernel


def alert_kernel(critical: str, calm: str, raise_after: int = 2, clear_after: int = 2) -> Kernel:
    def kernel(rows: Rows, state):
        alert, high, low = state or (False, 0, 0)
        out = []
        for c, ok in zip(rows[critical], rows[calm]):
            high, low = (high + 1, 0) if c else (0, low + 1) if ok else (0, 0)
            alert = True if high >= raise_after else False if low >= clear_after else alert
            out.append(bool(alert))
        return {"alert": out}, [bool(alert), high, low]

    return kernel


def boundary_kernel(clock: str, session: str, phase: str, foreground: Sequence[str], max_gap: int) -> Kernel:
    """Episode index and boundary reason of each frame."""

    def kernel(rows: Rows, state):
        before, index = (None, -1) if state is None else state
        indexes, reasons = [], []
        for row in zip(*(rows[c] for c in (clock, session, phase, *foreground))):
            reason = None
            if before is None:
                reason = "first_frame"
            elif row[0] - before[0] > max_gap:
                reason = "telemetry_gap"
            elif row[1] != before[1]:
                reason = "session_changed"
            elif row[2] != before[2]:
                reason = "workload_phase_changed"
            elif list(row[3:]) != list(before[3:]):
                reason = "foreground_behavior_changed"
            index += reason is not None
            indexes.append(index)
            reasons.append(reason)
            before = [int(row[0]), *row[1:]]
        return {"episode_index": indexes, "boundary_reason": reasons}, [before, index]

    return kernel


def sessions(stream: DataFrame, keys: Sequence[str], event_time: str, gap: str, lateness: str) -> DataFrame:
    """Sessions by the gap rule alone, from a watermarked session window."""
    return (
        stream.withWatermark(event_time, lateness)
        .groupBy(*keys, F.session_window(event_time, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("frames"))
        .select(*keys, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "frames")
    )


def window_kernel(columns: Sequence[str], size: int = WINDOW) -> Kernel:
    """Per row the last ``size`` values of each column, once there are so many; the state is the rest of them."""

    def kernel(rows: Rows, state):
        state = state or [[] for _ in columns]
        out = {}
        for i, c in enumerate(columns):
            joined = [*state[i], *(float(v) for v in rows[c])]
            known = len(state[i])
            out[f"{c}_window"] = [joined[k - size + 1 : k + 1] if k >= size - 1 else None for k in range(known, len(joined))]
            state[i] = joined[-(size - 1) :]
        return out, state

    return kernel


# -- scoring --------------------------------------------------------------------------------


def score_stream(
    stream: DataFrame,
    model_path: str,
    features: Callable[[DataFrame, dict], DataFrame],
    folder: str,
    checkpoint: str,
    seconds: float | None = 1.0,
) -> StreamingQuery:
    """Score windows batch by batch; the model and its metadata are read anew when they were written anew.

    Every row of ``stream`` is a whole window (a packet of ``files.window_rows``, or a row of ``event_order.windowed``),
    so no score depends on other rows of the batch. ``features`` turns a batch and the metadata (baseline,
    thresholds) into feature columns.
    """

    kept: dict[str, tuple] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        version = training.model_version(model_path, batch.sparkSession)
        if version not in kept:
            kept.clear()
            kept[version] = training.load_model(model_path, batch.sparkSession)
        model, meta = kept[version]
        scored = training.score(features(batch, meta), model)
        scored.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return _start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), seconds)
