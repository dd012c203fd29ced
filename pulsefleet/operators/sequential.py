"""Operators whose state depends on their own earlier decisions, folded over each key in order.

These recurrences cannot be written as frames or running aggregates: a cooldown depends on what was
accepted, and a baseline's learning rate on the deviation it just computed. ``fold`` hashes rows by
key, sorts inside the partitions, and streams each partition through one small kernel, so memory is
an Arrow batch and a state, never a group. A key above the row budget would still be one long task;
it is cut in consecutive segments that are folded one after the other with the state carried
between them, and the segments of all heavy keys advance together. A cooldown alone needs no fold there: what
follows an accepted time depends on that time only, so pointers between times settle it in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from pulsefleet.operators.ordered import HEAVY, SEG, Ordered
from pulsefleet.session import checkpointed, shared_folder

# (column -> values of consecutive rows of one key, state or None) -> (output columns, new state).
# A state is JSON-compatible.
Rows = dict[str, list]
Kernel = Callable[[Rows, object], tuple[Rows, object]]

STATE = "__state"


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kernel: Kernel,
    outputs: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows (keys, order, keep) with the kernel's output columns, given as a DDL string."""
    keys, order = list(keys), list(order)
    seq = Ordered(df, keys, order)
    if not seq.split:
        return fold_ordinary(df, keys, order, kernel, outputs, keep)
    kept, schema = _returned(df, keys, order, outputs, keep)
    light = _streamed(seq.df.where(~F.col(HEAVY)).select(*df.columns), keys, order, kept, kernel, schema, outputs)
    return light.unionByName(_fold_heavy(seq, df, keys, order, kept, kernel, schema, outputs))


def fold_ordinary(df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Kernel, outputs: str, keep: Sequence[str] = ()) -> DataFrame:
    """``fold`` of keys that are known to be within the row budget."""
    kept, schema = _returned(df, keys, order, outputs, keep)
    return _streamed(df, keys, order, kept, kernel, schema, outputs)


def _returned(df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: str, keep: Sequence[str]) -> tuple[list[str], str]:
    """Columns of df that a fold returns, and the schema of its result."""
    kept = [*keys, *order, *[c for c in keep if c not in [*keys, *order]]]
    return kept, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + ", " + outputs


def output_names(ddl: str) -> list[str]:
    return [part.strip().split()[0] for part in ddl.split(", ")]


def _streamed(rows: DataFrame, keys, order, kept, kernel: Kernel, schema: str, outputs: str, carry: bool = False) -> DataFrame:
    """Stream sorted partitions through the kernel: memory is an Arrow batch and a state.

    With ``carry``, rows have a column STATE: a key may begin with a row that holds its state, and ends
    with an extra row that holds its last state, so rows and state commit together.
    """
    names = output_names(outputs)

    def state_rows(ended: list[tuple[tuple, object]]) -> pd.DataFrame:
        empty = dict.fromkeys([*kept, *names])
        return pd.DataFrame([{**empty, **dict(zip(keys, key)), STATE: json.dumps(state)} for key, state in ended], dtype=object)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = {c: pdf[c].tolist() for c in pdf.columns}
            marks = list(zip(*(rows[k] for k in keys)))
            given = rows.pop(STATE, None)
            made: Rows = {n: [] for n in names}
            ended, plain = [], [True] * len(marks)
            start = 0
            while start < len(marks):
                if marks[start] != current:
                    if current is not None:
                        ended.append((current, state))
                    current, state = marks[start], None
                    if given is not None and given[start] is not None:
                        state, plain[start] = json.loads(given[start]), False
                        start += 1
                        continue
                end = start + 1
                while end < len(marks) and marks[end] == current:
                    end += 1
                out, state = kernel({c: v[start:end] for c, v in rows.items()}, state)
                for n in names:
                    made[n].extend(out[n])
                start = end
            done = pdf[kept][plain].assign(**made)
            yield done.assign(**{STATE: None}) if carry else done
            if carry and ended:
                yield state_rows(ended)
        if carry and current is not None:
            yield state_rows([(current, state)])

    first = [F.col(STATE).desc_nulls_last()] if carry else []
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *first, *order)
    return placed.mapInPandas(scan, schema + f", {STATE} string" * carry)


def _blank(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Values for the other columns of a state row: zeros, as nulls would turn whole numbers into floats."""
    number = (NumericType, BooleanType)
    return [
        F.lit(0 if isinstance(f.dataType, number) else None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in keys
    ]


def _fold_heavy(seq: Ordered, df: DataFrame, keys, order, kept, kernel: Kernel, schema: str, outputs: str) -> DataFrame:
    """Fold the segments of the heavy keys in turn; results and states go to written tables."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    heavy = seq.df.where(F.col(HEAVY)).select(*df.columns, SEG)
    heavy.write.partitionBy(SEG).parquet(f"{folder}/rows")
    stored = spark.read.schema(heavy.schema).parquet(f"{folder}/rows")
    last = stored.agg(F.max(SEG)).first()[0]
    states, paths = None, []
    for segment in range(last + 1):
        rows = stored.where(F.col(SEG) == segment).select(*df.columns, F.lit(None).cast("string").alias(STATE))
        if states is not None:
            # A key that has ended needs no state any more.
            open_ = states.join(rows.select(*keys).distinct(), list(keys), "left_semi")
            rows = rows.unionByName(open_.select(*keys, *_blank(df, keys), STATE))
        done = _streamed(rows, keys, order, kept, kernel, schema, outputs, carry=True)
        paths.append(f"{folder}/out/part={segment}")
        done.write.parquet(paths[-1])
        results = spark.read.schema(done.schema).parquet(paths[-1])
        states = results.where(F.col(STATE).isNotNull()).select(*keys, STATE)
    return spark.read.schema(done.schema).parquet(*paths).where(F.col(STATE).isNull()).drop(STATE)


# -- adaptive baseline ----------------------------------------------------------------------

# Metrics with weight, smallest spread, and whether a low value is the risk.
BASELINE_METRICS = (
    ("cpu", 0.18, 4.0, False),
    ("memory", 0.20, 3.0, False),
    ("disk", 0.16, 2.0, True),
    ("network", 0.12, 64.0, False),
    ("process_count", 0.12, 6.0, False),
    ("top_process_cpu", 0.12, 5.0, False),
    ("top_process_memory", 0.10, 64.0, False),
)
BASELINE_OUTPUTS = (
    "sample_count long, ready boolean, confidence double, anomaly_score double, risk_adjustment double, "
    "dominant_metric string, status string, means array<double>, deviations array<double>"
)


def baseline_kernel(columns: Sequence[str], min_samples: int = 30, sensitivity: float = 1.6) -> Kernel:
    """Exponential mean and variance of seven metrics; a strong deviation slows the learning down."""
    names = [m[0] for m in BASELINE_METRICS]
    metrics = [(i, m[1], m[2], m[2] * m[2], -1.0 if m[3] else 1.0) for i, m in enumerate(BASELINE_METRICS)]
    scale = max(0.75, min(3.0, max(0.6, sensitivity)))
    ready_at = max(5, min_samples)

    def kernel(rows: Rows, state):
        n, mean, var = (0, [0.0] * len(names), [0.0] * len(names)) if state is None else (state[0], list(state[1]), list(state[2]))
        out: Rows = {c: [] for c in output_names(BASELINE_OUTPUTS)}
        columns_out = list(out.values())
        for values in zip(*(rows[c] for c in columns)):
            slow = 0.08 if n < 30 else 0.025
            deviations, score = [], 0.0
            for i, weight, floor, floor2, sign in metrics:
                v = values[i]
                if n == 0:
                    mean[i], var[i] = v, floor2
                    deviations.append(0.0)
                    continue
                gap = v - mean[i]
                spread = max(1.0, floor, var[i] ** 0.5)
                deviation = min(100.0, max(0.0, sign * gap / spread / scale * 35.0))
                alpha = 0.006 if deviation >= 70.0 else 0.012 if deviation >= 45.0 else slow
                mean[i] += alpha * gap
                var[i] = max((1.0 - alpha) * var[i] + alpha * gap * gap, floor2)
                deviations.append(deviation)
                score += deviation * weight
            n += 1
            ready = n >= ready_at
            score = min(100.0, score)
            if ready:
                confidence = min(100.0, max(45.0, n / max(1, min_samples * 3) * 100.0))
                adjustment = min(10.0, max(-4.0, (score - 40.0) * 0.18))
                status = "ANOMALOUS" if score >= 75.0 else "SHIFTING" if score >= 45.0 else "STABLE"
            else:
                score = min(35.0, score * 0.35)
                confidence, adjustment, status = min(45.0, n / max(1, min_samples) * 45.0), 0.0, "WARMING_UP"
            top = names[deviations.index(max(deviations))]
            row = (n, ready, confidence, score, adjustment, top, status, list(mean), deviations)
            for column, value in zip(columns_out, row):
                column.append(value)
        return out, [n, mean, var]

    return kernel


def adaptive_baseline(df: DataFrame, keys, order, columns: Sequence[str], min_samples=30, sensitivity=1.6) -> DataFrame:
    """Baseline evaluation of every sample. columns: the seven metrics in the fixed order."""
    return fold(df, keys, order, baseline_kernel(columns, min_samples, sensitivity), BASELINE_OUTPUTS)


# -- cooldown and action budget -------------------------------------------------------------


def cooldown_kernel(clock: str, seconds: float, units: float) -> Kernel:
    """A row is accepted when the last accepted one is at least the cooldown ago."""

    def kernel(rows: Rows, last):
        accepted, remaining = [], []
        for now in rows[clock]:
            elapsed = None if last is None else max(0.0, (now - last) / units)
            wait = 0.0 if elapsed is None or elapsed >= seconds else seconds - elapsed
            accepted.append(wait == 0.0)
            remaining.append(wait)
            if wait == 0.0:
                last = now
        return {"accepted": accepted, "remaining_seconds": remaining}, last

    return kernel


def cooldown(df: DataFrame, keys, order, seconds: float = 300.0, units: float = 1e6) -> DataFrame:
    """Cooldown per key, normally (device, action, target): rows (keys, order) with ``accepted`` and ``remaining_seconds``.

    Ordinary keys are folded. Keys above the row budget are settled by pointers, all their rows in parallel.
    """
    outputs = "accepted boolean, remaining_seconds double"
    keys, order = list(keys), list(order)
    seq = Ordered(df.select(*keys, *order), keys, order)
    light = seq.df.where(~F.col(HEAVY)).select(*keys, *order) if seq.split else seq.df
    folded = fold_ordinary(light, keys, order, cooldown_kernel(order[0], seconds, units), outputs)
    if not seq.split:
        return folded
    return folded.unionByName(_cooldown_by_pointers(seq.df.where(HEAVY).select(*keys, *order), keys, order, seconds, units))


def _cooldown_by_pointers(rows: DataFrame, keys: list[str], order: list[str], seconds: float, units: float) -> DataFrame:
    """Cooldown of keys that no single task should hold.

    The time accepted after t is the first one at t plus the cooldown or later, whatever came before: a pointer per
    distinct time. From the first time of a key, the accepted ones are its chain of pointers. Each round
    follows pointers of doubled reach from all accepted times, so the rounds grow with the logarithm of their number.
    """
    clock, wait = order[0], seconds * units
    if wait <= 0:
        return rows.select(*keys, *order, F.lit(True).alias("accepted"), F.lit(0.0).alias("remaining_seconds"))
    wait = int(wait) if wait == int(wait) else wait
    times = checkpointed(rows.select(*keys, F.col(clock).alias("__t")).distinct())
    none = F.lit(None).cast(times.schema["__t"].dataType)
    # Backwards in time, a question for t + cooldown comes after the times it may find; the last one met is the answer.
    found = times.select(*keys, (-F.col("__t")).alias("__at"), F.lit(0).alias("__asks"), F.col("__t").alias("__met"), none.alias("__t"))
    asked = times.select(*keys, (-(F.col("__t") + F.lit(wait))).alias("__at"), F.lit(1).alias("__asks"), none.alias("__met"), "__t")
    backwards = Ordered(found.unionByName(asked), keys, ["__at", "__asks"]).cumulate({"__next": ("last", F.col("__met"))})
    reach = checkpointed(backwards.df.where("__asks = 1 AND __next IS NOT NULL").select(*keys, "__t", "__next"))
    accepted = checkpointed(times.groupBy(*keys).agg(F.min("__t").alias("__t")))
    new = accepted
    while True:
        new = checkpointed(accepted.join(reach, [*keys, "__t"]).select(*keys, F.col("__next").alias("__t")))
        if new.isEmpty():
            break
        accepted = accepted.unionByName(new)
        beyond = reach.select(*keys, F.col("__t").alias("__next"), F.col("__next").alias("__beyond"))
        reach = checkpointed(reach.join(beyond, [*keys, "__next"]).select(*keys, "__t", F.col("__beyond").alias("__next")))
    marked = rows.join(accepted.select(*keys, F.col("__t").alias(clock), F.lit(True).alias("__marked")), [*keys, clock], "left")
    seq = Ordered(marked, keys, order, before=1)
    earlier = F.lag(clock).over(seq.window)
    seq.with_columns({"__first": earlier.isNull() | (earlier != F.col(clock))})
    seq.cumulate({"__last": ("last", F.when(F.col("__marked"), F.col(clock)))})
    # Of the rows at an accepted time, the first is the accepted one.
    taken = F.coalesce("__marked", F.lit(False)) & F.col("__first")
    left = F.lit(float(seconds)) - (F.col(clock) - F.col("__last")) / F.lit(float(units))
    return seq.result().select(*keys, *order, taken.alias("accepted"), F.when(taken, 0.0).otherwise(left).alias("remaining_seconds"))


def budget_kernel(clock: str, target: Sequence[str], per_hour: int, cooldown_seconds: float, units: float) -> Kernel:
    """At most ``per_hour`` accepted rows in a trailing hour and a cooldown per target.

    The state holds the accepted times of the last hour (at most ``per_hour``) and the targets that
    are still cooling down; both expire.
    """

    def kernel(rows: Rows, state):
        recent, until = ([], {}) if state is None else (state[0], dict(state[1]))
        verdicts = []
        for now, *parts in zip(rows[clock], *(rows[c] for c in target)):
            recent = [t for t in recent if now - t < 3600 * units]
            until = {k: t for k, t in until.items() if t > now}
            key = "\x1f".join(str(p) for p in parts)
            if len(recent) >= per_hour:
                verdicts.append("budget_exhausted")
            elif key in until:
                verdicts.append("cooldown_active")
            else:
                verdicts.append("accepted")
                recent.append(int(now))
                until[key] = int(now + cooldown_seconds * units)
        return {"verdict": verdicts}, [recent, sorted(until.items())]

    return kernel


def action_budget(df: DataFrame, keys, order, target, per_hour=3, cooldown_seconds=600.0, units=1e6) -> DataFrame:
    return fold(df, keys, order, budget_kernel(order[0], target, per_hour, cooldown_seconds, units), "verdict string", keep=target)


# -- adaptive sampling ----------------------------------------------------------------------


def sampling_kernel(
    clock: str,
    units_per_ms: float = 1.0,
    stable_ms: int = 5000,
    elevated_ms: int = 1000,
    immediate_ms: int = 500,
    burst_ms: int = 30000,
    backoff: int = 2,
) -> Kernel:
    """Which ticks to capture. Flags: elevated, severe, foreground_changed, invalid, safety,
    within_budget (of a capture taken now) and collector_failed."""

    def kernel(rows: Rows, state):
        last, burst, slow, blocked = state or (None, None, False, 0.0)
        capture, reasons = [], []
        flags = ("elevated", "severe", "foreground_changed", "invalid", "safety", "within_budget", "collector_failed")
        for t, elevated, severe, moved, invalid, safety, cheap, failed in zip(rows[clock], *(rows[f] for f in flags)):
            now = t / units_per_ms
            forced = moved or invalid or safety or severe
            interval = elevated_ms if (forced or elevated) else stable_ms
            if slow and not safety and not severe:
                interval *= backoff
            gap = None if last is None else max(0.0, now - last)
            take = False
            if last is None:
                take, why = True, "initial_sample"
            elif now < blocked and not safety:
                why = "collector_failure_backoff"
            elif forced and gap >= immediate_ms:
                take, why = True, "foreground_changed" if moved else "forced_escalation"
            elif forced or elevated:
                burst = now if burst is None else burst
                if now - burst >= burst_ms and not severe and not safety:
                    take, why = gap >= stable_ms * (backoff if slow else 1), "focused_burst_capped"
                else:
                    take, why = gap >= interval, "elevated_risk"
            else:
                burst = None
                take, why = gap >= interval, "overhead_backoff" if slow else "stable_interval"
            if take:
                last, slow = now, not cheap
                if failed:
                    blocked = now + stable_ms * backoff
            capture.append(bool(take))
            reasons.append(why)
        return {"capture": capture, "reason": reasons}, [last, burst, bool(slow), blocked]

    return kernel


def adaptive_sampling(df: DataFrame, keys, order, units_per_ms: float = 1.0, **settings) -> DataFrame:
    kernel = sampling_kernel(order[0], units_per_ms, **settings)
    return fold(df, keys, order, kernel, "capture boolean, reason string")


# -- recently active applications -----------------------------------------------------------


def recent_apps_kernel(clock: str, app: str, window: float, limit: int) -> Kernel:
    """Recently seen apps, the most recently added first; at most ``limit`` are remembered."""

    def kernel(rows: Rows, apps):
        apps = [list(a) for a in apps or []]
        listed = []
        for now, name in zip(rows[clock], rows[app]):
            known = next((a for a in apps if a[0] == name), None)
            if known:
                known[1] = int(now)
            else:
                apps = [[name, int(now)], *apps][:limit]
            apps = [a for a in apps if now - a[1] <= window]
            listed.append([str(a[0]) for a in apps])
        return {"recent_apps": listed}, apps

    return kernel


def recent_apps(df: DataFrame, keys, order, app: str, window: float = 300e6, limit: int = 8) -> DataFrame:
    return fold(df, keys, order, recent_apps_kernel(order[0], app, window, limit), "recent_apps array<string>")
