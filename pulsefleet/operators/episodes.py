"""Workload episodes: cutting frame streams into episodes, their baselines and data quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions.scoring import first_match
from pulsefleet.operators.ordered import Ordered
from pulsefleet.operators.windows import array_at, array_gaps, array_median

BAD_COLLECTOR = ("UNAVAILABLE", "FAILED", "INVALID")


@dataclass(frozen=True)
class EpisodeRules:
    max_gap: int = 15_000
    min_frames: int = 3
    baseline_frames: int = 5
    outcome_interval: int = 5_000


def cut_episodes(
    frames: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    session: str,
    phase: str,
    foreground: Sequence[str],
    rules: EpisodeRules = EpisodeRules(),
) -> DataFrame:
    """Frames with ``episode_index`` (per key), ``boundary_reason`` on first frames, and two flags.

    A boundary is a gap above the limit, else a change of session, phase or foreground, in that
    order. ``early`` marks the first frames of an episode that feed its baseline, ``next_reason`` is
    the boundary reason of the next frame, and ``out_of_order`` marks a clock that did not advance.
    """
    clock = order[0]
    seq = Ordered(frames, keys, order, before=max(2, rules.baseline_frames), after=1)
    here = F.struct(
        F.col(clock).alias("t"),
        F.col(session).alias("session"),
        F.coalesce(F.col(phase), F.lit("UNKNOWN")).alias("phase"),
        F.struct(*[F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in foreground]).alias("foreground"),
    )
    seq.with_columns({"__here": here})
    seq.with_columns({"__before": F.lag("__here").over(seq.window)})
    now, before = F.col("__here"), F.col("__before")
    changed = lambda field: ~now[field].eqNullSafe(before[field])
    reason = first_match(
        [
            (before.isNull(), "first_frame"),
            (now["t"] - before["t"] > rules.max_gap, "telemetry_gap"),
            (changed("session"), "session_changed"),
            (changed("phase"), "workload_phase_changed"),
            (changed("foreground"), "foreground_behavior_changed"),
        ],
        F.lit(None).cast("string"),
    )
    seq.with_columns(
        {
            "boundary_reason": reason,
            "out_of_order": F.coalesce(now["t"] <= before["t"], F.lit(False)),
        }
    )
    seq.with_columns({"__edge": F.col("boundary_reason").isNotNull().cast("int")})
    seq.with_columns(
        {
            "early": F.max("__edge").over(seq.rows(-(rules.baseline_frames - 1), 0)) == 1,
            "next_reason": F.lead("boundary_reason").over(seq.window),
        }
    )
    seq.cumulate({"episode_index": ("sum", F.col("__edge"))})
    return seq.result().withColumn("episode_index", F.col("episode_index") - 1).drop("__here", "__before", "__edge")


def out_of_order_frames(cut: DataFrame) -> DataFrame:
    """Frames whose clock did not advance; they are an input error and go to quarantine."""
    return cut.where("out_of_order")


def baseline_columns(name: str, packed: Column) -> dict[str, Column]:
    """Median, p05 and p95 (nearest index, half to even) of a short sorted array."""
    at = lambda q: array_at(packed, F.bround((F.size(packed) - 1) * F.lit(q)))
    return {
        f"{name}_median": array_median(packed),
        f"{name}_p05": at(0.05),
        f"{name}_p95": at(0.95),
    }


def episodes(
    cut: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    resources: Sequence[str],
    first_columns: Sequence[str] = (),
    last_columns: Sequence[str] = (),
    collectors: str | None = None,
    rules: EpisodeRules = EpisodeRules(),
) -> DataFrame:
    """One row per episode of ``cut_episodes`` output.

    Everything is a combinable aggregate, and the collected arrays hold at most the baseline frames,
    so an episode of any length is fine. Frame membership stays in the frames table
    (keys, episode_index) and is not collected.
    """
    keys = list(keys)
    clock = order[0]
    position = F.struct(*order)
    ids = keys + ["episode_index"]
    aggs = [
        F.min(clock).alias("start_t"),
        F.max(clock).alias("end_t"),
        F.count(F.lit(1)).alias("frame_count"),
        F.max("boundary_reason").alias("start_reason"),
        # Only the last frame of an episode is followed by a boundary, or by nothing.
        F.coalesce(F.max("next_reason"), F.lit("input_exhausted")).alias("end_reason"),
        *[F.min_by(c, position).alias(c) for c in first_columns],
        *[F.max_by(c, position).alias(c) for c in last_columns],
        *[F.sort_array(F.collect_list(F.when(F.col("early"), F.col(c)))).alias(f"__{c}") for c in resources],
    ]
    rows = cut.groupBy(*ids).agg(*aggs)
    if collectors:
        failing = failed_collectors(cut, ids, collectors)
        rows = rows.join(failing, ids, "left").withColumn(
            "failed_collectors", F.coalesce("failed_collectors", F.array().cast("array<string>"))
        )
    else:
        rows = rows.withColumn("failed_collectors", F.array().cast("array<string>"))
    merged = lambda maps: {k: v for m in maps for k, v in m.items()}
    rows = rows.withColumns(merged(baseline_columns(c, F.col(f"__{c}")) for c in resources))
    rows = rows.withColumns({f"__g_{c}": array_gaps(F.col(f"__{c}"), F.col(f"{c}_median")) for c in resources})
    rows = rows.withColumns({f"{c}_mad": array_median(F.col(f"__g_{c}")) for c in resources})
    return rows.withColumns(
        {
            "observation_interval": F.col("end_t") - F.col("start_t"),
            "outcome_interval": F.lit(rules.outcome_interval),
            "valid": (F.col("frame_count") >= rules.min_frames) & (F.size("failed_collectors") == 0),
            "positive_interval": F.col("end_t") > F.col("start_t"),
        }
    ).drop(*[f"__{k}{c}" for k in ("", "g_") for c in resources])


def failed_collectors(frames: DataFrame, ids: Sequence[str], health: str) -> DataFrame:
    """Sorted distinct collectors that failed in an episode, from a map of collector to status."""
    pairs = frames.select(*ids, F.explode(health).alias("collector", "status"))
    bad = pairs.where(F.upper("status").isin(*BAD_COLLECTOR)).select(*ids, "collector").distinct()
    return bad.groupBy(*ids).agg(F.array_sort(F.collect_set("collector")).alias("failed_collectors"))


def context_episodes(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    phase: str,
    behaviour: str,
    captured: Column,
) -> tuple[DataFrame, DataFrame]:
    """Episodes that change with phase or behaviour (no gap rule), and the captured samples.

    Returns (episodes, summaries). An episode closes at the first sample of the next one; the last
    stays OPEN. The second frame has one row per captured sample, with its episode.
    """
    clock = order[0]
    seq = Ordered(samples, keys, order, before=1, after=1)
    seq.with_columns({"__ctx": F.struct(phase, behaviour)})
    before, after = F.lag("__ctx").over(seq.window), F.lead("__ctx").over(seq.window)
    # The last sample of an episode sees the start of the next one.
    ends = F.when(after.isNotNull() & ~after.eqNullSafe(F.col("__ctx")), F.lead(clock).over(seq.window))
    seq.with_columns({"__edge": (before.isNull() | ~before.eqNullSafe(F.col("__ctx"))).cast("int"), "__closed": ends})
    seq.cumulate({"episode_index": ("sum", F.col("__edge"))})
    placed = seq.result().drop("__ctx", "__edge")
    rows = placed.groupBy(*keys, "episode_index").agg(
        F.min(clock).alias("started_at"),
        F.coalesce(F.max("__closed"), F.min(clock)).alias("ended_at"),
        F.when(F.max("__closed").isNull(), "OPEN").otherwise("WORKLOAD_OR_FOREGROUND_CHANGE").alias("end_reason"),
        F.min_by(phase, F.struct(*order)).alias(phase),
        F.min_by(behaviour, F.struct(*order)).alias(behaviour),
        F.count(F.lit(1)).alias("samples"),
        F.sum(captured.cast("int")).alias("captures"),
    )
    closed = rows.withColumn("start_reason", F.when(F.col("episode_index") == 1, "INITIAL").otherwise("CHANGED_CONTEXT"))
    return closed, placed.where(captured).drop("__closed")


def collector_status(ready: Column, within_budget: Column, captured: Column) -> Column:
    return (
        F.when(~ready, "UNAVAILABLE")
        .when(~within_budget, "OVER_BUDGET")
        .when(captured, "HEALTHY")
        .otherwise("SCHEDULED_REUSE")
    )


def missingness_mask(available: dict[str, Column]) -> Column:
    """``name=0;name=1`` text, 1 where a measurement was missing."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.when(c, "0").otherwise("1")) for n, c in available.items()])
