"""Paired benchmark statistics: summaries, bootstrap intervals, quality gates and the report.

Samples are rows (one per measured value), runs are rows (one per run). A run holds any number of
samples, so nothing here collects a run's samples into an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators.quality import BASELINE_VARIANT, RUN_TYPES, SCENARIOS, SUBJECT_VARIANT, VARIANTS
from pulsefleet.operators.ranking import exact_quantiles
from pulsefleet.session import RowBudget, checkpointed

GROUP = ["device_id", "scenario", "run_type", "metric"]
QUANTILES = {"median": 0.50, "p95": 0.95, "p99": 0.99}
ENVIRONMENT = ("os_build", "power_mode", "thermal_state")
REPLICATES = 2000
#: Runs of a plan that one task makes.
TASK_RUNS = 250_000


def explode_metrics(runs: DataFrame) -> DataFrame:
    """One row per run and metric, with the run's own fields repeated."""
    rest = [c for c in runs.columns if c != "metrics"]
    return runs.select(*rest, F.explode("metrics").alias("metric", "m")).select(
        *rest, "metric", "m.unit", "m.direction", "m.samples"
    )


def sample_rows(metric_rows: DataFrame) -> DataFrame:
    """One row per measured value."""
    rest = [c for c in metric_rows.columns if c != "samples"]
    return metric_rows.select(*rest, F.explode("samples").alias("sample"))


def summarize(samples: DataFrame, groups: Sequence[str], value: str = "sample") -> DataFrame:
    """Count, median, p95, p99 (linear interpolation) and mean per group."""
    return exact_quantiles(samples, groups, value, QUANTILES, {"mean": F.avg(value)})


def run_p95(samples: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """95th percentile of each run; of several runs of one pair key the last id counts."""
    per_run = exact_quantiles(samples, [*groups, "variant", "iteration", "run_id"], "sample", {"p95": 0.95})
    return per_run.groupBy(*groups, "variant", "iteration").agg(F.max_by("p95", "run_id").alias("p95"))


def pair_runs(p95: DataFrame, groups: Sequence[str] = GROUP, baseline: str = BASELINE_VARIANT) -> DataFrame:
    """Baseline and candidate p95 of the same group and iteration, for every other variant."""
    base = p95.where(F.col("variant") == baseline).select(*groups, "iteration", F.col("p95").alias("baseline_p95"))
    other = p95.where(F.col("variant") != baseline).select(
        *groups, "iteration", "variant", F.col("p95").alias("candidate_p95")
    )
    return other.join(base, [*groups, "iteration"])


def resample_counts(lengths: DataFrame, seed: int, replicates: int = REPLICATES) -> DataFrame:
    """How often each replicate draws each number, per pair count: __n, rep, __i, __times. lengths has one column, __n."""
    slots = lengths.select("__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__slot"))
    draws = slots.repartition("__n", "__slot").select(
        "__n", "__slot", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    )
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep"), F.col("__slot"))
    picked = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("__n")
    return draws.groupBy("__n", "rep", picked.cast("int").alias("__i")).agg(F.count(F.lit(1)).alias("__times"))


def bootstrap_interval(
    pairs: DataFrame,
    groups: Sequence[str],
    direction: Column,
    seed: int,
    replicates: int = REPLICATES,
) -> DataFrame:
    """95 % interval of the relative improvement over resampled pair keys.

    Draw (replicate, slot) takes the pair whose number is a hash of seed, replicate and slot modulo
    the pair count, so any engine reproduces it. Groups of one pair count draw the same numbers: how
    often a replicate takes a number is counted once per distinct count and joined to the pairs as a
    weight. Up to the row budget these counts are sent to the pairs, which are dealt by group once and
    averaged in place; larger ones meet the pairs by shuffle, with map-side combining.
    """
    groups = list(groups)
    w = Window.partitionBy(*groups)
    numbered = checkpointed(
        pairs.withColumns({"__i": F.row_number().over(w.orderBy("iteration")) - 1, "__n": F.count(F.lit(1)).over(w)})
        .withColumn("__lower", F.coalesce(direction == "lower", F.lit(False)))
        .select(*groups, "__n", "__i", "__lower", "baseline_p95", "candidate_p95")
    )
    weights = resample_counts(numbered.select("__n").distinct(), seed, replicates)
    slots = numbered.select("__n").distinct().agg(F.sum("__n")).first()[0] or 0
    if slots * replicates <= RowBudget.of(pairs.sparkSession).broadcast_rows:
        weights, numbered = F.broadcast(weights), numbered.repartition(*groups)
    weighted = lambda c: (F.sum(F.col("__times") * F.col(c)) / F.first("__n")).alias(c[0])
    means = (
        numbered.join(weights, ["__n", "__i"])
        .groupBy(*groups, "rep")
        .agg(weighted("baseline_p95"), weighted("candidate_p95"), F.first("__lower").alias("__lower"))
    )
    gain = S.relative_improvement("b", "c", F.when(F.col("__lower"), "lower").otherwise("higher"))
    # Exactly `replicates` values per group, so the built-in percentile is bounded.
    return means.groupBy(*groups).agg(F.percentile(gain, F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).select(
        *groups, F.get("ci", 0).alias("ci_low"), F.get("ci", 1).alias("ci_high")
    )


def quality_gates(
    runs: DataFrame,
    groups: Sequence[str] = ("device_id", "scenario", "run_type", "metric"),
    minimum_runs: int = 10,
    baseline: str = BASELINE_VARIANT,
) -> DataFrame:
    """Checks of each comparison (group, candidate variant).

    runs has one row per run and metric: groups, variant, run_id, iteration, order_index, notes,
    crashes, app_reloads, user_apps_touched, rollback_failures, the environment columns, and the
    sums and counts of the overhead samples (``cpu_sum``, ``cpu_n``, ``memory_sum``, ``memory_n``).
    """
    groups = list(groups)
    per_variant = runs.groupBy(*groups, "variant").agg(
        F.count_distinct("run_id", "iteration").alias("runs"),
        F.max("crashes").alias("crashes"),
        F.max("app_reloads").alias("app_reloads"),
        F.max("user_apps_touched").alias("user_apps_touched"),
        F.max("rollback_failures").alias("rollback_failures"),
        F.count_distinct("order_index").alias("positions"),
        (F.sum("cpu_sum") / F.sum("cpu_n")).alias("mean_cpu_percent"),
        (F.sum("memory_sum") / F.sum("memory_n")).alias("mean_memory_mb"),
        F.bool_or(F.lower("notes").contains("synthetic")).alias("synthetic"),
        *[F.min(F.coalesce(F.col(e), F.lit("UNKNOWN"))).alias(f"min_{e}") for e in ENVIRONMENT],
        *[F.max(F.coalesce(F.col(e), F.lit("UNKNOWN"))).alias(f"max_{e}") for e in ENVIRONMENT],
    )
    base = per_variant.where(F.col("variant") == baseline).drop("variant")
    base = base.select(*groups, *[F.col(c).alias(f"b_{c}") for c in base.columns if c not in groups])
    compared = per_variant.where(F.col("variant") != baseline).join(base, groups)

    # Order of the two variants inside each pair key; the last run of a key counts.
    order = runs.groupBy(*groups, "variant", "iteration").agg(F.max_by("order_index", "run_id").alias("position"))
    b = order.where(F.col("variant") == baseline).select(*groups, "iteration", F.col("position").alias("b_position"))
    c = order.where(F.col("variant") != baseline)
    # A baseline key without a candidate run fails the order check, so keep it: count both sides.
    matched = c.join(b, [*groups, "iteration"]).groupBy(*groups, "variant").agg(
        F.count(F.lit(1)).alias("paired_runs"), F.count_if(F.col("position") != F.col("b_position")).alias("distinct_pairs")
    )
    keys = b.groupBy(*groups).agg(F.count(F.lit(1)).alias("baseline_keys"))
    rows = compared.join(matched, [*groups, "variant"], "left").join(keys, groups)
    paired = F.coalesce("paired_runs", F.lit(0))
    same_environment = [
        F.least(f"min_{e}", f"b_min_{e}") == F.greatest(f"max_{e}", f"b_max_{e}") for e in ENVIRONMENT
    ]
    checks = {
        "minimum_runs": (F.col("runs") >= minimum_runs) & (F.col("b_runs") >= minimum_runs),
        "paired_randomized_runs": paired >= minimum_runs,
        "order_randomized": (F.coalesce("distinct_pairs", F.lit(0)) == F.col("baseline_keys")) & (F.col("positions") >= 2),
        "environment_consistent": same_environment[0] & same_environment[1] & same_environment[2],
        "non_synthetic_data": ~F.coalesce("synthetic", F.lit(False)) & ~F.coalesce("b_synthetic", F.lit(False)),
        "zero_safety_regressions": (F.col("crashes") == 0)
        & (F.col("app_reloads") == 0)
        & (F.col("user_apps_touched") == 0)
        & (F.col("rollback_failures") == 0),
        "cpu_overhead_within_1_percent": F.coalesce(F.col("mean_cpu_percent") <= 1.0, F.lit(False)),
        "memory_overhead_within_60_mb": F.coalesce(F.col("mean_memory_mb") <= 60.0, F.lit(False)),
    }
    passed = None
    for check in checks.values():
        passed = check if passed is None else passed & check
    return rows.select(
        *groups,
        "variant",
        paired.alias("paired_runs"),
        *[check.alias(name) for name, check in checks.items()],
        passed.alias("passed"),
        "mean_cpu_percent",
        "mean_memory_mb",
        "crashes",
        "app_reloads",
        "user_apps_touched",
        "rollback_failures",
    )


def contract_conflicts(metric_rows: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """Groups whose runs disagree on unit or direction; a report must not be built from them."""
    seen = metric_rows.groupBy(*groups).agg(F.count_distinct("unit", "direction").alias("contracts"))
    return seen.where(F.col("contracts") > 1)


def comparison_report(
    samples: DataFrame,
    runs: DataFrame,
    minimum_runs: int = 10,
    seed: int = 20260711,
    replicates: int = REPLICATES,
    baseline: str = BASELINE_VARIANT,
) -> DataFrame:
    """One row per comparison with both summaries, interval, checks and claim. No row is dropped.

    samples: GROUP, variant, iteration, run_id, unit, direction, sample.
    """
    spread = summarize(samples, [*GROUP, "variant"])
    directions = samples.groupBy(*GROUP).agg(F.first("direction").alias("direction"), F.first("unit").alias("unit"))
    b = spread.where(F.col("variant") == baseline).select(
        *GROUP, *[F.col(c).alias(f"baseline_{c}") for c in ("count", "median", "p95", "p99", "mean")]
    )
    c = spread.where(F.col("variant") != baseline).select(
        *GROUP, "variant", *[F.col(x).alias(f"candidate_{x}") for x in ("count", "median", "p95", "p99", "mean")]
    )
    pairs = pair_runs(run_p95(samples), baseline=baseline).join(directions.select(*GROUP, "direction"), GROUP)
    interval = bootstrap_interval(pairs, [*GROUP, "variant"], F.col("direction"), seed, replicates)
    gates = quality_gates(runs, GROUP, minimum_runs, baseline)
    rows = (
        c.join(b, GROUP)
        .join(directions, GROUP)
        .join(interval, [*GROUP, "variant"], "left")
        .join(gates, [*GROUP, "variant"])
    )
    improvement = S.relative_improvement("baseline_p95", "candidate_p95", "direction")
    qualified = F.coalesce(F.col("passed") & (F.col("ci_low") > 0), F.lit(False))
    return rows.withColumns({"p95_improvement": improvement, "__ok": qualified}).withColumn(
        "claim_status",
        F.when(~F.col("__ok"), "NO_CLAIM")
        .when(F.col("p95_improvement") >= 0.50, "QUALIFIED_2X_RESPONSIVENESS")
        .otherwise("QUALIFIED_IMPROVEMENT"),
    ).drop("__ok")


def negative_results(report: DataFrame) -> DataFrame:
    return report.where(F.col("claim_status") == "NO_CLAIM").select(*GROUP, "variant", "claim_status")


def run_plan(
    devices: DataFrame,
    scenarios: Sequence[str] = SCENARIOS,
    variants: Sequence[str] = (BASELINE_VARIANT, SUBJECT_VARIANT),
    repetitions: int = 10,
    seed: int = 20260711,
    known: Sequence[str] = VARIANTS,
    subject: str = SUBJECT_VARIANT,
) -> DataFrame:
    """Balanced plan: each device runs every scenario, run type, iteration and variant.

    The order of the variants in an iteration is the order of a seeded hash. devices has one column,
    device_id; the other dimensions are short fixed lists, so they are exploded, not joined.
    """
    if repetitions < 2:
        raise ValueError("repetitions must be at least 2")
    if BASELINE_VARIANT not in variants or subject not in variants:
        raise ValueError("a plan needs the baseline and the subject variant")
    if set(variants) - set(known) or set(scenarios) - set(SCENARIOS):
        raise ValueError("unknown variant or scenario")
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    # A device becomes many runs, so a short list of devices in a file or two is dealt to the tasks that its runs need.
    runs = devices.count() * len(scenarios) * len(RUN_TYPES) * repetitions * len(variants)
    tasks = max(1, -(-runs // TASK_RUNS))
    cells = (
        devices.select("device_id").repartition(tasks).select("device_id", each(scenarios).alias("scenario"))
        .select("*", each(RUN_TYPES).alias("run_type"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("iteration"))
    )
    cell = F.concat_ws("|", F.lit(str(seed)), F.col("device_id").cast("string"), "scenario", "run_type", F.col("iteration").cast("string"))
    drawn = F.sort_array(
        F.array(*[F.struct(F.md5(F.concat_ws("|", cell, F.lit(v))).alias("h"), F.lit(v).alias("variant")) for v in variants])
    )
    rows = cells.select("*", F.posexplode(drawn).alias("__pos", "__v"))
    return rows.select(
        F.lit(1).alias("plan_version"),
        F.concat_ws(
            "-", F.col("device_id").cast("string"), "scenario", "run_type", F.lpad(F.col("iteration").cast("string"), 3, "0"), "__v.variant"
        ).alias("run_id"),
        F.lit(seed).alias("seed"),
        "device_id",
        "scenario",
        F.col("__v.variant").alias("variant"),
        "run_type",
        "iteration",
        (F.col("__pos") + 1).alias("order_index"),
        F.lit("PLANNED").alias("status"),
    )
