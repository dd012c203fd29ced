"""Roll-ups of audit, health and sample tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S


def counts_by(df: DataFrame, groups: Sequence[str | Column], averages: Mapping[str, str] | None = None, digits: int = 1) -> DataFrame:
    """Rows per group, with rounded averages."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.round(F.avg(c), digits).alias(name) for name, c in (averages or {}).items()]
    return df.groupBy(*groups).agg(*aggs)


def top_groups(counted: DataFrame, limit: int, ties: Sequence[str]) -> DataFrame:
    """Largest groups first; ties in a fixed order so the report is reproducible."""
    return counted.orderBy(F.col("n").desc(), *ties).limit(limit)


def label_coverage(df: DataFrame, label: str) -> DataFrame:
    """Rows per training label, zero-filled over the known labels and AUTO."""
    from pulsefleet.operators.quality import class_counts

    return class_counts(df, F.upper(F.coalesce(F.col(label), F.lit("AUTO"))), [*S.LABELS, "AUTO"])


def since_newest(df: DataFrame, clock: str, span: int) -> DataFrame:
    """Rows within ``span`` of the newest clock value of the table."""
    newest = df.agg(F.max(clock).alias("m")).first()["m"]
    return df.where(F.col(clock) >= F.lit(newest - span)) if newest is not None else df


def at_newest(df: DataFrame, clock: str) -> DataFrame:
    """Rows of the newest clock value; the value is read first so that it reaches the scan as a filter."""
    newest = df.agg(F.max(clock).alias("m")).first()["m"]
    return df.where(F.col(clock) == F.lit(newest))


def recent_groups(df: DataFrame, groups: Sequence[str], clock: str, aggs: Sequence[Column], limit: int) -> DataFrame:
    """Groups ordered by when they were last seen."""
    rows = df.groupBy(*groups).agg(F.max(clock).alias("last_seen"), *aggs)
    return rows.orderBy(F.col("last_seen").desc(), *groups).limit(limit)


def normal_rows(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    thresholds: S.Thresholds = S.Thresholds(),
    minimum: int = 30,
) -> DataFrame:
    """Rows that stand for normal operation of each key, with the ``tier`` that supplied them.

    Labelled rows if there are enough, else low-pressure rows, else all rows of the key.
    """
    t = thresholds
    is_normal = F.coalesce(F.upper(F.col(label)) == "NORMAL", F.lit(False))
    is_low = (F.col("cpu") < t.cpu * 0.65) & (F.col("mem") < t.mem * 0.80) & (F.col("disk") > t.disk * 2.0)
    flagged = df.withColumns({"__normal": is_normal, "__low": is_low})
    tiers = flagged.groupBy(*keys).agg(
        F.when(F.count_if("__normal") >= minimum, "labelled").when(F.count_if("__low") > 0, "low_pressure").otherwise("all").alias("tier")
    )
    kept = F.when(F.col("tier") == "labelled", F.col("__normal")).when(F.col("tier") == "low_pressure", F.col("__low")).otherwise(F.lit(True))
    return flagged.join(tiers, list(keys)).where(kept).drop("__normal", "__low")


def runtime_health(cycles: DataFrame, writes: DataFrame, keys: Sequence[str], latency: DataFrame | None = None) -> DataFrame:
    """Health of each key (device, or device and day) from its prediction cycles and storage writes.

    cycles: keys, has_window, ran_model, source, path, model_success. writes: keys, ok.
    latency: keys and ``ewma`` (see ``windows.ewma_last``). A key without writes has no storage.
    """
    warm = ~F.col("has_window") | (F.col("path") == "warmup")
    cached = ~warm & (F.col("path") == "cache")
    fallback = ~warm & ~cached & ((F.col("source") == "FALLBACK") | (F.col("path") == "fallback"))
    ran, won = F.col("ran_model"), F.col("ran_model") & F.col("model_success")
    c = cycles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cycles"),
        F.count_if(warm).alias("warmup"),
        F.count_if(cached).alias("cached"),
        F.count_if(fallback).alias("fallback"),
        F.count_if(ran).alias("model_attempts"),
        F.count_if(won).alias("model_successes"),
        F.count_if(won & (F.col("path") == "service")).alias("service_successes"),
        F.count_if(won & (F.col("path") == "process")).alias("process_successes"),
    )
    w = writes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("storage_writes"), F.count_if(~F.col("ok")).alias("storage_failures")
    )
    rows = c.join(w, list(keys), "left").fillna(0, ["storage_writes", "storage_failures"])
    if latency is not None:
        rows = rows.join(latency.select(*keys, F.col("ewma").alias("avg_latency_ms")), list(keys), "left")
    else:
        rows = rows.withColumn("avg_latency_ms", F.lit(0.0))
    percent = lambda a, b, empty: F.when(b <= 0, F.lit(empty)).otherwise(a * 100.0 / b)
    rows = rows.withColumns(
        {
            "model_success_rate": percent(F.col("model_successes"), F.col("model_attempts"), 100.0),
            "fallback_rate": percent(
                F.col("fallback"), F.greatest(F.lit(1), F.col("total_cycles") - F.col("warmup")), 0.0
            ),
            "storage_success_rate": percent(
                F.col("storage_writes") - F.col("storage_failures"), F.col("storage_writes"), 0.0
            ),
        }
    )
    lost = 100.0 - F.col("model_success_rate")
    unsaved = 100.0 - F.col("storage_success_rate")
    score = S.clamp(100.0 - F.col("fallback_rate") * 0.45 - lost * 0.35 - unsaved * 0.20)
    status = S.first_match(
        [
            ((F.col("storage_writes") == 0) | (F.col("storage_success_rate") < 80.0) | (lost >= 70.0), "CRITICAL"),
            (F.col("total_cycles") < 10, "STARTING"),
            (
                (F.col("storage_success_rate") < 95.0)
                | (F.col("fallback_rate") > 35.0)
                | (F.coalesce("avg_latency_ms", F.lit(0.0)) > 3500.0)
                | (lost > 35.0),
                "DEGRADED",
            ),
        ],
        "HEALTHY",
    )
    return rows.withColumns({"availability_score": score, "status": status})


def budget_report(components: DataFrame, bundles: Sequence[str], global_budget: float = 0.01) -> DataFrame:
    """Reliability budget of each bundle: requested sum, violations and verdict.

    components: bundles, component, measured, error_upper_bound, requested.
    """
    valid, violation = _budget_rule()
    asked = F.col("requested")
    rows = components.groupBy(*bundles).agg(
        F.coalesce(F.sum(F.when(valid, asked)), F.lit(0.0)).alias("total_allocated"),
        F.count(violation).alias("component_violations"),
    )
    over = F.col("total_allocated") > global_budget + 1e-12
    accepted = (F.col("component_violations") == 0) & ~over & F.lit(0.0 < global_budget < float("inf"))
    return rows.withColumns(
        {
            "over_global_budget": over,
            "accepted": accepted,
            "reason": F.when(accepted, "measured_component_bounds_fit_global_budget").otherwise("reliability_budget_rejected"),
        }
    )


def _budget_rule() -> tuple[Column, Column]:
    """Whether a component's numbers are valid, and what it violates (null: nothing)."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    bound, asked = F.col("error_upper_bound"), F.col("requested")
    named = F.coalesce(F.col("component"), F.lit("")) != ""
    valid = named & F.coalesce(F.col("measured"), F.lit(False)) & good(bound) & good(asked) & (bound >= 0.0) & (asked > 0.0)
    violation = (
        F.when(~named, F.lit("unnamed_component"))
        .when(~valid, F.concat("component", F.lit(":unmeasured_or_invalid")))
        .when(bound > asked, F.concat("component", F.lit(":upper_bound_exceeds_budget")))
    )
    return valid, violation


def budget_violations(components: DataFrame, bundles: Sequence[str]) -> DataFrame:
    """The violating components as rows, so a bundle with many of them stays spread out."""
    _, violation = _budget_rule()
    return components.select(*bundles, violation.alias("violation")).where(F.col("violation").isNotNull())
