"""Window operators over device history: features, labels, rates, rolling statistics, streaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators.ordered import Ordered

WINDOW = 8
HORIZON = 5
SERIES = ("cpu", "mem", "disk", "net", "process", "top_cpu", "top_mem")
STATS = ("last", "mean", "std", "min", "max", "delta", "slope", "range")
DEFAULT_BASELINE = {"cpu": 35.0, "mem": 55.0, "disk": 50.0, "net": 0.0, "process": 120.0}


def series_stats(name: str, v: Sequence[Column]) -> dict[str, Column]:
    """Eight statistics of one series from its values, oldest first.

    The values are separate columns, so everything stays in generated code with no array or
    sliding aggregate.
    """
    n = len(v)
    total = sum(v[1:], v[0])
    mean = total / n
    variance = sum(((x - mean) * (x - mean) for x in v[1:]), (v[0] - mean) * (v[0] - mean)) / n
    low, high = F.least(*v), F.greatest(*v)
    middle = (n - 1) / 2.0
    spread = sum((i - middle) ** 2 for i in range(n))
    trend = sum((x * ((i - middle) / spread) for i, x in enumerate(v[1:], 1)), v[0] * (-middle / spread))
    # A series that stays within the comparison tolerance of its first value has slope 0.
    tolerance = F.lit(1e-8) + F.abs(v[0]) * 1e-5
    flat = (high - v[0] <= tolerance) & (v[0] - low <= tolerance)
    return {
        f"{name}_last": v[-1],
        f"{name}_mean": mean,
        f"{name}_std": F.sqrt(variance),
        f"{name}_min": low,
        f"{name}_max": high,
        f"{name}_delta": v[-1] - v[0],
        f"{name}_slope": F.when(flat, F.lit(0.0)).otherwise(trend),
        f"{name}_range": high - low,
    }


def derived_features(
    first: Mapping[str, Column], f: Mapping[str, Column], net_median: Column, t: S.Thresholds, baseline
) -> dict[str, Column]:
    last = {name: f[f"{name}_last"] for name in SERIES}
    cpu_p, mem_p, _ = S.pressure_parts(last["cpu"], last["mem"], last["disk"], t)
    disk_p = F.when(
        last["disk"] < t.disk, F.greatest(F.lit(0.0), (t.disk - last["disk"]) / max(1, t.disk) * 100.0)
    ).otherwise(F.lit(0.0))
    fall = lambda name: F.greatest(F.lit(0.0), first[name] - last[name])
    out = {
        "cpu_mem_gap": last["cpu"] - last["mem"],
        "mem_disk_gap": last["mem"] - last["disk"],
        "cpu_disk_gap": last["cpu"] - last["disk"],
        "disk_pressure": disk_p,
        "memory_pressure": mem_p,
        "cpu_pressure": cpu_p,
        "net_spike": F.greatest(F.lit(0.0), last["net"] - net_median),
        "process_growth": last["process"] - first["process"],
        "top_cpu_pressure": last["top_cpu"],
        "top_mem_pressure": S.clamp(last["top_mem"] / 10.0),
        "resource_pressure": cpu_p * 0.42 + mem_p * 0.42 + disk_p * 0.16,
        "recovery_signal": fall("cpu") * 0.4 + fall("mem") * 0.4,
    }
    for name in ("cpu", "mem", "disk", "net", "process"):
        out[f"{name}_baseline_delta"] = last[name] - baseline[name]
    return out


def median_of(v: Sequence[Column]) -> Column:
    ordered = F.sort_array(F.array(*v))
    n = len(v)
    if n % 2:
        return F.element_at(ordered, n // 2 + 1)
    return (F.element_at(ordered, n // 2) + F.element_at(ordered, n // 2 + 1)) / 2.0


FEATURES = [f"{s}_{stat}" for s in SERIES for stat in STATS] + [
    "cpu_mem_gap", "mem_disk_gap", "cpu_disk_gap", "disk_pressure", "memory_pressure", "cpu_pressure",
    "net_spike", "process_growth", "top_cpu_pressure", "top_mem_pressure", "resource_pressure",
    "recovery_signal", "cpu_baseline_delta", "mem_baseline_delta", "disk_baseline_delta",
    "net_baseline_delta", "process_baseline_delta",
]


def feature_columns(
    values: Mapping[str, Sequence[Column]], t: S.Thresholds = S.Thresholds(), baseline=None
) -> dict[str, Column]:
    """The 73 features of one window. values: series name -> its values, oldest first."""
    base = {name: (F.lit(v) if not isinstance(v, Column) else v) for name, v in (baseline or DEFAULT_BASELINE).items()}
    out: dict[str, Column] = {}
    for name in SERIES:
        out |= series_stats(name, values[name])
    first = {name: values[name][0] for name in SERIES}
    out |= derived_features(first, out, median_of(values["net"]), t, base)
    return out


def _past(seq: Ordered, names: Sequence[str]) -> dict[str, list[Column]]:
    """Add the earlier values of the window as columns and return all values, oldest first.

    Offset functions only move a pointer, so they are much cheaper than sliding aggregates.
    """
    back = range(WINDOW - 1, 0, -1)
    seq.with_columns({f"__p{i}_{n}": F.lag(n, i).over(seq.window) for n in names for i in back})
    # The first samples of a key lack earlier rows, not just values: a counter tells them apart.
    seq.with_columns({"__p_rows": F.count(F.lit(1)).over(seq.rows(-(WINDOW - 1), 0))})
    return {n: [F.col(f"__p{i}_{n}") for i in back] + [F.col(n)] for n in names}


def _drop_past(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__p") or c.startswith("__f")])


def window_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    thresholds: S.Thresholds = S.Thresholds(),
    baseline=None,
) -> DataFrame:
    """Features over the last eight samples; rows with fewer than eight samples are left out."""
    seq = Ordered(df, keys, order, before=WINDOW - 1)
    values = _past(seq, SERIES)
    full = seq.result().where(F.col("__p_rows") == WINDOW)
    return _drop_past(full.select("*", *[c.alias(n) for n, c in feature_columns(values, thresholds, baseline).items()]))


def future_label_columns(
    cpu: Sequence[Column], mem: Sequence[Column], disk: Sequence[Column], press: Sequence[Column], t: S.Thresholds
) -> Column:
    """Label of a horizon: CRITICAL, then RECOVERY, then WARNING, else NORMAL.

    The recovery test compares the last future sample with the first future one.
    """
    peak, low = F.greatest(*press), F.least(*disk)
    cpu_peak, mem_peak = F.greatest(*cpu), F.greatest(*mem)
    return S.first_match(
        [
            (
                (low <= max(3.0, t.disk * 0.35)) | (cpu_peak >= 96.0) | (mem_peak >= 96.0) | (peak >= 82.0),
                "CRITICAL",
            ),
            ((peak >= 55.0) & (press[-1] + 8.0 < press[0]), "RECOVERY"),
            ((cpu_peak >= t.cpu) | (mem_peak >= t.mem) | (low <= t.disk) | (peak >= 58.0), "WARNING"),
        ],
        "NORMAL",
    )


def _future(seq: Ordered, t: S.Thresholds) -> Column:
    seq.with_columns({"__f0": F.struct("cpu", "mem", "disk", S.pressure("cpu", "mem", "disk", t).alias("press"))})
    seq.with_columns({f"__f{i}": F.lead("__f0", i).over(seq.window) for i in range(1, HORIZON + 1)})
    ahead = [F.col(f"__f{i}") for i in range(1, HORIZON + 1)]
    return future_label_columns(*[[a[n] for a in ahead] for n in ("cpu", "mem", "disk", "press")], t)


def future_labels(
    df: DataFrame, keys, order, thresholds: S.Thresholds = S.Thresholds()
) -> DataFrame:
    """Heuristic label from the next five samples; rows with a shorter future are left out."""
    seq = Ordered(df, keys, order, after=HORIZON)
    label = _future(seq, thresholds)
    return _drop_past(seq.result().where(F.col(f"__f{HORIZON}").isNotNull()).withColumn("label", label))


def training_set(
    df: DataFrame,
    keys,
    order,
    thresholds: S.Thresholds = S.Thresholds(),
    manual: str | None = None,
    baseline=None,
) -> DataFrame:
    """Features and label in one pass; a manual label wins over the heuristic one."""
    seq = Ordered(df, keys, order, before=WINDOW - 1, after=HORIZON)
    values = _past(seq, SERIES)
    label = _future(seq, thresholds)
    full = seq.result().where((F.col("__p_rows") == WINDOW) & F.col(f"__f{HORIZON}").isNotNull())
    given = F.upper(F.trim(F.col(manual))) if manual else F.lit(None).cast("string")
    chosen = F.when(given.isin(*S.LABELS), given).otherwise(label)
    source = F.when(given.isin(*S.LABELS), "manual").otherwise("heuristic")
    out = full.select(
        "*",
        *[c.alias(n) for n, c in feature_columns(values, thresholds, baseline).items()],
        chosen.alias("label"),
        source.alias("label_source"),
    )
    return _drop_past(out)


def rolling_means(df: DataFrame, keys, order, columns: Sequence[str], rows: int = 30) -> DataFrame:
    seq = Ordered(df, keys, order, before=rows - 1)
    frame = seq.rows(-(rows - 1), 0)
    return seq.with_columns({f"{c}_mean": F.avg(c).over(frame) for c in columns}).result()


def deviation_scores(
    df: DataFrame, keys, order, columns: Sequence[str], rows: int = 30
) -> DataFrame:
    """Deviation of each value from the up to ``rows - 1`` samples before it."""
    seq = Ordered(df, keys, order, before=rows - 1)
    frame = seq.rows(-(rows - 1), -1)
    seq.with_columns({"__dn": F.count(F.lit(1)).over(frame)})
    seq.with_columns(
        {f"__dm_{c}": F.avg(c).over(frame) for c in columns} | {f"__ds_{c}": F.stddev_pop(c).over(frame) for c in columns}
    )
    out = seq.result().withColumns(
        {f"{c}_deviation": S.deviation_score(c, "__dn", f"__dm_{c}", f"__ds_{c}") for c in columns}
    )
    return out.drop("__dn", *[f"__d{k}_{c}" for k in "ms" for c in columns])


def robust_z(
    df: DataFrame, keys, order, columns: Sequence[str], rows: int = 120
) -> DataFrame:
    """Median, MAD and robust z of each value within its last ``rows`` samples (itself included)."""
    seq = Ordered(df, keys, order, before=rows - 1)
    frame = seq.rows(-(rows - 1), 0)
    seq.with_columns({f"__v_{c}": F.sort_array(F.collect_list(c).over(frame)) for c in columns})
    out = seq.result()
    out = out.withColumns({f"{c}_median": array_median(F.col(f"__v_{c}")) for c in columns})
    out = out.withColumns({f"__g_{c}": array_gaps(F.col(f"__v_{c}"), F.col(f"{c}_median")) for c in columns})
    out = out.withColumns({f"{c}_mad": array_median(F.col(f"__g_{c}")) for c in columns})
    out = out.withColumns(
        {
            f"{c}_z": (F.col(c) - F.col(f"{c}_median")) / F.greatest(F.lit(0.01), F.col(f"{c}_mad") * 1.4826)
            for c in columns
        }
        | {"sample_count": F.size(f"__v_{columns[0]}")}
    )
    return out.drop(*[f"__{k}_{c}" for k in "vg" for c in columns])


def array_median(ordered: Column) -> Column:
    """Median of an already sorted array."""
    n = F.size(ordered)
    half = F.floor(n / 2).cast("int")
    upper = F.get(ordered, half)
    return F.when(n % 2 == 1, upper).otherwise((F.get(ordered, half - 1) + upper) / 2.0)


def array_gaps(values: Column, center: Column) -> Column:
    """Sorted distances of an array from its center."""
    return F.sort_array(F.transform(values, lambda x: F.abs(x - center)))


def array_at(ordered: Column, index: Column) -> Column:
    return F.get(ordered, index.cast("int"))


def counter_rates(
    df: DataFrame,
    keys,
    order,
    counters: Sequence[str],
    units_per_second: float = 1e6,
) -> DataFrame:
    """Per-second rate of cumulative counters; a first sample, a reset or a stuck clock gives 0."""
    clock = order[0]
    seq = Ordered(df, keys, order, before=1)
    seq.with_columns({"__before": F.lag(F.struct(clock, *counters)).over(seq.window)})
    before = F.col("__before")
    step = F.col(clock) - before[clock]
    rate = lambda c: F.when(
        before.isNull() | (step <= 0) | (F.col(c) < before[c]), F.lit(0.0)
    ).otherwise((F.col(c) - before[c]) * units_per_second / step)
    return seq.result().withColumns({f"{c}_rate": rate(c) for c in counters}).drop("__before")


def cpu_percent(rate_ms_per_second, processors) -> Column:
    """CPU share from consumed CPU milliseconds per second over all processors."""
    return S.clamp(S.col(rate_ms_per_second) / 10.0 / F.greatest(F.lit(1), S.col(processors)))


def rolling_p95(df: DataFrame, keys, order, value: str, rows: int = 60) -> DataFrame:
    """95th percentile (upper index rule) of the last ``rows`` valid values."""
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0))
    seq = Ordered(usable, keys, order, before=rows - 1)
    frame = seq.rows(-(rows - 1), 0)
    seq.with_columns({"__v": F.sort_array(F.collect_list(value).over(frame))})
    at = F.ceil(F.size("__v") * 0.95) - 1
    return seq.result().withColumn(f"{value}_p95", array_at(F.col("__v"), at)).drop("__v")


def collector_cost(
    df: DataFrame, keys, order, duration: str, succeeded: str, rows: int = 64
) -> DataFrame:
    """Per collector: last duration, p50 and p95 of its last ``rows`` samples, and health.

    Only the newest rows of a collector matter, so the top-n filter prunes before the shuffle.
    """
    from pulsefleet.operators.tables import newest_rows

    recent = newest_rows(df, keys, order, rows)
    packed = recent.groupBy(*keys).agg(
        F.sort_array(F.collect_list(duration)).alias("__v"),
        F.max_by(F.struct(duration, succeeded), F.struct(*order)).alias("__last"),
    )
    at = lambda q: array_at(F.col("__v"), F.ceil((F.size("__v") - 1) * q))
    return packed.select(
        *keys,
        F.col("__last")[duration].alias("last_duration"),
        at(0.50).alias("p50_duration"),
        at(0.95).alias("p95_duration"),
        F.col("__last")[succeeded].alias("healthy"),
    )


def ewma_last(df: DataFrame, keys, order, value: str, alpha: float) -> DataFrame:
    """Final exponential average per key, seeded by the first value.

    The recurrence is a weighted sum: with r rows after it, a value weighs alpha (1-alpha)^r and the
    first value keeps (1-alpha)^r. So one running count and one aggregate replace the fold.
    """
    seq = Ordered(df.where(F.col(value).isNotNull()), keys, order)
    seq.cumulate({"__i": ("sum", F.lit(1))})
    numbered = seq.result()
    total = numbered.groupBy(*keys).agg(F.max("__i").alias("__n"))
    left = F.col("__n") - F.col("__i")
    weight = F.pow(F.lit(1.0 - alpha), left) * F.when(F.col("__i") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    return (
        numbered.join(total, list(keys))
        .groupBy(*keys)
        .agg(F.sum(weight * F.col(value)).alias("ewma"), F.max("__n").alias("samples"))
    )


def focus_durations(df: DataFrame, keys, order, identity: Sequence[str]) -> DataFrame:
    """Time since the foreground identity last changed, in units of the order clock."""
    clock = order[0]
    seq = Ordered(df, keys, order, before=1)
    now = F.struct(*identity)
    seq.with_columns({"__id": now})
    before = F.lag("__id").over(seq.window)
    seq.with_columns({"__started": F.when(before.isNull() | ~before.eqNullSafe(F.col("__id")), F.col(clock))})
    seq.cumulate({"__since": ("last", F.col("__started"))})
    return seq.result().withColumn("focus_duration", F.col(clock) - F.col("__since")).drop("__id", "__started", "__since")


def alert_states(
    df: DataFrame,
    keys,
    order,
    critical: Column,
    calm: Column,
    raise_after: int = 2,
    clear_after: int = 2,
) -> DataFrame:
    """Alert with hysteresis: raised by a critical streak, cleared by a calm streak.

    A streak of k rows only needs the last k rows, and the state is the latest raise or clear.
    """
    reach = max(raise_after, clear_after)
    seq = Ordered(df, keys, order, before=reach)
    seq.with_columns({"__crit": critical.cast("int"), "__calm": (calm & ~critical).cast("int")})
    run = lambda flag, k: (F.sum(flag).over(seq.rows(-(k - 1), 0)) == k)
    seq.with_columns(
        {"__event": F.when(run("__crit", raise_after), F.lit(True)).when(run("__calm", clear_after), F.lit(False))}
    )
    seq.with_columns({"__event_before": F.lag("__event").over(seq.window)})
    seq.cumulate({"__state": ("last", F.col("__event")), "__was": ("last", F.col("__event_before"))})
    state, was = F.coalesce("__state", F.lit(False)), F.coalesce("__was", F.lit(False))
    return (
        seq.result()
        .withColumns(
            {
                "alert": state,
                "alert_edge": F.when(state & ~was, "RAISED").when(~state & was, "CLEARED"),
            }
        )
        .drop("__crit", "__calm", "__event", "__event_before", "__state", "__was")
    )


# Observer budgets in the order their breach is named.
OBSERVER_BUDGETS = (
    ("collector_p95_ms", 15.0, "collector_budget"),
    ("inference_p95_ms", 20.0, "inference_budget"),
    ("process_cpu_percent", 1.0, "cpu_budget"),
    ("working_set_mb", 100.0, "memory_budget"),
    ("process_io_bytes_per_second", 1_048_576.0, "io_budget"),
    ("wakeups_per_second", 2.0, "wakeup_budget"),
    ("pending_writes", 64.0, "storage_queue_budget"),
)


def budget_governor(
    df: DataFrame,
    keys,
    order,
    budgets: Sequence[tuple[str, float, str]] = OBSERVER_BUDGETS,
    watchdog: str | None = None,
    recovery_rows: int = 3,
) -> DataFrame:
    """Degraded from a budget breach until ``recovery_rows`` healthy rows in a row."""
    breach = S.first_match([(F.col(c) > limit, reason) for c, limit, reason in budgets], F.lit(None).cast("string"))
    healthy_watchdog = F.col(watchdog) if watchdog else F.lit(True)
    seq = Ordered(df, keys, order, before=recovery_rows)
    seq.with_columns({"__breach": breach})
    calm = F.sum(F.col("__breach").isNull().cast("int")).over(seq.rows(-(recovery_rows - 1), 0)) == recovery_rows
    seq.with_columns({"__event": F.when(F.col("__breach").isNotNull(), F.lit(True)).when(calm, F.lit(False))})
    seq.with_columns({"__event_before": F.lag("__event").over(seq.window)})
    named = F.when(~healthy_watchdog, F.lit("rollback_watchdog_unhealthy")).otherwise(F.col("__breach"))
    seq.cumulate(
        {
            "__state": ("last", F.col("__event")),
            "__was": ("last", F.col("__event_before")),
            "__named": ("last", named),
        }
    )
    state, was = F.coalesce("__state", F.lit(False)), F.coalesce("__was", F.lit(False))
    reason = S.first_match(
        [
            (~healthy_watchdog, "rollback_watchdog_unhealthy"),
            (state, F.col("__named")),
            (was, "recovered_within_budget"),
        ],
        "within_budget",
    )
    return (
        seq.result()
        .withColumns({"over_budget": state, "maximum_optional_tier": F.when(state, 1).otherwise(3), "reason": reason})
        .drop("__breach", "__event", "__event_before", "__state", "__was", "__named")
    )


def change_or_every(df: DataFrame, keys, order, status: Sequence[str], every: int = 10) -> DataFrame:
    """Rows where the status changed, and every n-th row of the key."""
    seq = Ordered(df, keys, order, before=1)
    seq.with_columns({"__id": F.struct(*status)})
    before = F.lag("__id").over(seq.window)
    seq.with_columns({"__changed": before.isNull() | ~before.eqNullSafe(F.col("__id"))})
    seq.cumulate({"__i": ("sum", F.lit(1))})
    return (
        seq.result()
        .where(F.col("__changed") | (F.col("__i") % every == 0))
        .withColumnRenamed("__i", "tick")
        .drop("__id", "__changed")
    )


def accepted_in_order(df: DataFrame, keys, order, sequence: str, usable: Column | None = None) -> DataFrame:
    """Verdict per message: its sequence must exceed every earlier usable one of the session.

    A message with a lower sequence never raises the maximum, so the running maximum over usable
    messages is the maximum over accepted ones.
    """
    usable = F.lit(True) if usable is None else usable
    seq = Ordered(df, keys, order, before=1)
    seq.with_columns({"__usable": usable})
    seq.with_columns({"__v": F.when(F.col("__usable"), F.col(sequence))})
    seq.with_columns({"__before": F.lag("__v").over(seq.window)})
    seq.cumulate({"__top": ("max", F.col("__before"))})
    verdict = (
        F.when(~F.col("__usable"), "stale_or_future_request")
        .when(F.col(sequence) <= F.coalesce("__top", F.lit(0)), "replayed_or_out_of_order_request")
        .otherwise("accepted")
    )
    return seq.result().withColumn("verdict", verdict).drop("__usable", "__v", "__before", "__top")


def asof_last(
    df: DataFrame,
    keys,
    order,
    value: str,
    max_age: int | None = None,
    age_in: str = "rows",
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, with its age in rows or clock units.

    A value older than ``max_age`` is not reused.
    """
    clock = order[0]
    seq = Ordered(df, keys, order)
    specs = {"__v": ("last", F.col(value)), "__at": ("last", F.when(F.col(value).isNotNull(), F.col(clock)))}
    if age_in == "rows":
        seq.cumulate({"__i": ("sum", F.lit(1))})
        specs["__at"] = ("last", F.when(F.col(value).isNotNull(), F.col("__i")))
    seq.cumulate(specs)
    here = F.col("__i") if age_in == "rows" else F.col(clock)
    age = here - F.col("__at")
    fresh = F.col("__v").isNotNull() if max_age is None else F.col("__v").isNotNull() & (age <= max_age)
    return (
        seq.result()
        .withColumns({f"{value}_asof": F.when(fresh, F.col("__v")), f"{value}_age": F.when(fresh, age)})
        .drop("__v", "__at", "__i")
    )


def asof_join(
    left: DataFrame, right: DataFrame, keys, order, value: str, max_age: int | None = None
) -> DataFrame:
    """Left rows with the latest right value at or before them (clock tolerance ``max_age``).

    Both sides share the order columns. They are unioned and swept once, so there is no range join.
    """
    tagged = left.withColumn("__left", F.lit(1)).unionByName(
        right.select(*keys, *order, value).withColumn("__left", F.lit(0)), allowMissingColumns=True
    )
    merged_order = [order[0], "__left", *order[1:]]
    swept = asof_last(tagged, keys, merged_order, value, max_age, age_in="clock")
    return swept.where(F.col("__left") == 1).drop("__left", value)
