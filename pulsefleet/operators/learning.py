"""Action learning: linear reward models, shadow selection, off-policy evaluation, private updates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators.sequential import Kernel, fold

RIDGE = 1.0
EXPLORATION = 1.0
REWARD_LIMIT = 2.0


def reward_statistics(samples: DataFrame, action: str = "action", vector: str = "x", reward: str = "reward") -> DataFrame:
    """Per action: sum of x xᵀ (upper triangle, row by row), sum of reward x, and count, without ridge.

    Each task adds up its own rows with one matrix product per batch and action, so a hot action
    moves one small record per batch. Statistics of different periods merge by addition.
    """
    rows = samples.select(
        F.col(action).alias("action"),
        F.col(vector).cast("array<double>").alias("x"),
        S.clamp(F.col(reward).cast("double"), -REWARD_LIMIT, REWARD_LIMIT).alias("r"),
    ).where(F.col("x").isNotNull() & F.col("r").isNotNull() & ~F.isnan("r"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("action", sort=False):
                x = np.vstack(part["x"].to_numpy())
                upper = np.triu_indices(x.shape[1])
                yield pd.DataFrame(
                    {
                        "action": [name],
                        "cells": [np.concatenate([(x.T @ x)[upper], x.T @ part["r"].to_numpy()])],
                        "n": [len(part)],
                    }
                )

    kind = samples.schema[action].dataType.simpleString()
    partial = rows.mapInPandas(add_up, f"action {kind}, cells array<double>, n long")
    return merge_statistics(partial)


def merge_statistics(partial: DataFrame) -> DataFrame:
    """Add up statistics records of the same action cell by cell."""
    cells = partial.select("action", F.posexplode("cells").alias("i", "v"))
    summed = cells.groupBy("action", "i").agg(F.sum("v").alias("v"))
    # One record holds d(d+1)/2 + d numbers for d features, whatever the number of samples.
    packed = summed.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    counts = partial.groupBy("action").agg(F.sum("n").alias("n"))
    return packed.join(counts, "action").select("action", F.transform("c", lambda e: e["v"]).alias("cells"), "n")


def _dimension(cells: int) -> int:
    # d(d+1)/2 + d = cells
    return int(round((-3 + (9 + 8 * cells) ** 0.5) / 2))


def solve_models(statistics: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """Per action: weights and the inverse of (ridge I + sum x xᵀ), flattened by row."""

    @F.pandas_udf("weights array<double>, inverse array<double>")
    def solve(cells: pd.Series) -> pd.DataFrame:
        weights, inverses = [], []
        for flat in cells:
            d = _dimension(len(flat))
            a = np.zeros((d, d))
            upper = np.triu_indices(d)
            a[upper] = flat[: len(upper[0])]
            a = a + a.T - np.diag(np.diag(a)) + ridge * np.eye(d)
            inverse = np.linalg.inv(a)
            inverses.append(inverse.ravel())
            weights.append(inverse @ np.asarray(flat[len(upper[0]) :]))
        return pd.DataFrame({"weights": weights, "inverse": inverses})

    return statistics.withColumn("m", solve("cells")).select("action", "n", "m.weights", "m.inverse")


def predict(contexts: DataFrame, models: DataFrame, action: str, vector: str, ridge: float = RIDGE, exploration: float = EXPLORATION) -> DataFrame:
    """Expected reward, uncertainty, lower bound and whether the action is well known.

    Models are joined by action, so any number of actions will do; Spark broadcasts them while they are
    small. An action without a model is scored by the ridge prior.
    """

    @F.pandas_udf("expected double, uncertainty double")
    def score(vectors: pd.Series, weights: pd.Series, inverses: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(vectors), 2))
        # Rows of one action share a model: the product of a batch is taken once per model.
        models = weights.map(lambda w: None if w is None else w.tobytes())
        for _, at in vectors.groupby(models.fillna(b"").to_numpy(), sort=False).indices.items():
            x = np.vstack(vectors.iloc[at].to_numpy())
            d = x.shape[1]
            w, inverse = weights.iloc[at[0]], inverses.iloc[at[0]]
            w = np.zeros(d) if w is None else w
            inverse = np.eye(d) / ridge if inverse is None else inverse.reshape(d, d)
            out[at, 0] = x @ w
            out[at, 1] = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", x, inverse, x)))
        return pd.DataFrame(out, columns=["expected", "uncertainty"])

    known = models.select(
        F.col("action").alias("__action"), F.col("n").alias("__n"), F.col("weights").alias("__w"), F.col("inverse").alias("__i")
    )
    joined = contexts.join(known, contexts[action].eqNullSafe(known["__action"]), "left")
    scored = joined.withColumn("__p", score(F.col(vector).cast("array<double>"), "__w", "__i"))
    observations = F.coalesce("__n", F.lit(0))
    return scored.withColumns(
        {
            "expected_reward": F.col("__p.expected"),
            "uncertainty": F.col("__p.uncertainty"),
            "lower_bound": F.col("__p.expected") - exploration * F.col("__p.uncertainty"),
            "observations": observations,
            "sufficiently_known": (observations >= 20) & (F.col("__p.uncertainty") <= 0.75),
        }
    ).drop("__p", "__action", "__n", "__w", "__i")


ONLINE_OUTPUTS = "expected_reward double, uncertainty double, lower_bound double, observations long, sufficiently_known boolean"


def online_kernel(dimension: int, vector: str = "x", reward: str = "reward", ridge: float = RIDGE, exploration: float = EXPLORATION) -> Kernel:
    """Scores a row by what was known before it, then learns from it. The state of an action is bounded.

    The state holds the inverse of (ridge I + sum x xᵀ), which a rank-one update (Sherman and Morrison) keeps, the
    sum of r x, and the count. A row without a usable vector is not scored, one without a usable reward not learnt.
    """

    def learn(rows: dict[str, list], state: object) -> tuple[dict[str, list], object]:
        inverse = np.eye(dimension) / ridge if state is None else np.array(state[0]).reshape(dimension, dimension)
        total = np.zeros(dimension) if state is None else np.array(state[1])
        n = 0 if state is None else state[2]
        out: dict[str, list] = {name: [] for name in ("expected_reward", "uncertainty", "lower_bound", "observations", "sufficiently_known")}
        for x, r in zip(rows[vector], rows[reward]):
            x = None if x is None else np.array([np.nan if v is None else v for v in x], dtype=float)
            if x is None or len(x) != dimension or not np.isfinite(x).all():
                scored: tuple = (None, None, None, n, False)
            else:
                seen = inverse @ x
                spread = float(x @ seen)
                expected, uncertainty = float(seen @ total), max(0.0, spread) ** 0.5
                scored = (expected, uncertainty, expected - exploration * uncertainty, n, n >= 20 and uncertainty <= 0.75)
                if r is not None and r == r:
                    inverse = inverse - np.outer(seen, seen) / (1.0 + spread)
                    total = total + min(REWARD_LIMIT, max(-REWARD_LIMIT, r)) * x
                    n += 1
            for name, value in zip(out, scored):
                out[name].append(value)
        return out, [inverse.ravel().tolist(), total.tolist(), n]

    return learn


def online_predictions(
    samples: DataFrame, order: Sequence[str], dimension: int, action: str = "action", vector: str = "x", reward: str = "reward"
) -> DataFrame:
    """Every sample scored by the model of its action as it was before the sample; one pass, heavy actions by segments.

    Returns the action, the order columns and the scores. ``streaming.event_order.in_event_order`` takes the same kernel.
    """
    rows = samples.select(action, *order, F.col(vector).cast("array<double>").alias(vector), F.col(reward).cast("double").alias(reward))
    return fold(rows, [action], order, online_kernel(dimension, vector, reward), ONLINE_OUTPUTS)


def shadow_choice(
    scored: DataFrame, decision: Sequence[str], ordinal: str, required: float = 0.05, minimum: int = 30, target: str | None = None
) -> DataFrame:
    """Per decision the allowed candidate with the highest lower bound, and whether it would act.

    scored: decision keys, action, reversible, safety_passed, lower_bound, expected_reward,
    uncertainty, observations, and an ordinal that breaks ties in favour of the earlier candidate.
    ``target`` names the column of what a candidate acts on; the chosen one's is returned as ``target``.
    """
    chosen = [F.col(target).alias("target")] if target else []
    allowed = (F.col("action") != "None") & F.col("reversible") & F.col("safety_passed")
    best = F.max_by(
        F.when(allowed, F.struct("action", *chosen, "expected_reward", "uncertainty", "lower_bound", "observations")),
        F.when(allowed, F.struct(F.col("lower_bound"), (-F.col(ordinal)).alias("o"))),
    )
    rows = scored.groupBy(*decision).agg(best.alias("b"))
    reason = S.first_match(
        [
            (F.col("b").isNull(), "no_reversible_safe_candidate"),
            (F.col("b.observations") < minimum, "insufficient_measured_outcomes"),
            (F.col("b.lower_bound") <= required, "lower_bound_does_not_beat_baseline"),
        ],
        "shadow_candidate_beats_baseline",
    )
    return rows.select(
        *decision, "b.*", reason.alias("reason"), (reason == "shadow_candidate_beats_baseline").alias("would_act")
    )


def evaluate_policies(logged: DataFrame, policy: Sequence[str], minimum: int = 30, z: float = 1.96) -> DataFrame:
    """Inverse-propensity estimate of each candidate policy against the baseline, with the verdict.

    logged: policy, logged_action, candidate_action, reward, baseline_reward, logging_propensity,
    causal_support, observed. One combinable aggregate, so a policy of any size is one record.
    """
    q = F.col("logging_propensity")
    valid = F.coalesce((q > 0.0) & (q <= 1.0) & ~F.isnan(q), F.lit(False))
    matched = valid & (F.col("logged_action") == F.col("candidate_action")) & F.col("observed")
    weight = F.when(matched, 1.0 / q)
    weighted = F.when(matched, S.clamp(F.col("reward") / q, -10.0, 10.0))
    rows = logged.groupBy(*policy).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~valid).alias("__bad"),
        F.count_if(matched).alias("matched"),
        F.count_if(matched & F.col("causal_support")).alias("__causal"),
        F.coalesce(F.avg(F.when(valid, F.col("baseline_reward"))), F.lit(0.0)).alias("baseline"),
        F.avg(weighted).alias("estimate"),
        F.when(F.count_if(matched) > 1, F.stddev_samp(weighted)).otherwise(F.lit(0.0)).alias("__sd"),
        F.sum(weight).alias("__w"),
        F.sum(weight * weight).alias("__ww"),
    )
    none, bad = F.col("matched") == 0, F.col("__bad") > 0
    error = F.col("__sd") / F.sqrt(F.col("matched"))
    rows = rows.withColumns(
        {
            "standard_error": F.when(none, 0.0).otherwise(error),
            "lower_benefit": F.when(none, 0.0).otherwise(F.col("estimate") - F.col("baseline") - z * error),
            "effective_sample_size": F.when(none, 0.0).otherwise(F.col("__w") * F.col("__w") / F.col("__ww")),
            "estimate": F.coalesce("estimate", F.lit(0.0)),
        }
    )
    overlap = ~none & ~bad & (F.col("effective_sample_size") >= minimum)
    causal = F.col("__causal") == F.col("matched")
    enough = overlap & causal & (F.col("matched") >= minimum)
    promoted = enough & (F.col("lower_benefit") > 0.0)
    reason = S.first_match(
        [
            (bad, "invalid_logging_propensity"),
            (none, "no_observed_actions_matched_candidate"),
            (~overlap, "insufficient_effective_sample_size_or_overlap"),
            (~causal, "causal_checksum_missing_for_observed_outcomes"),
            (~enough, "insufficient_matched_observed_samples"),
            (promoted, "causally_supported_policy_beats_baseline_at_requested_confidence"),
        ],
        "candidate_policy_lower_bound_does_not_beat_baseline",
    )
    return rows.withColumns({"promotion_eligible": promoted, "reason": reason}).drop(
        "__bad", "__causal", "__sd", "__w", "__ww"
    )


def private_update(delta: Column, clip: float, noise: float = 0.0, seed: int = 0) -> Column:
    """Struct(original_norm, protected, clipped_norm) of an update vector, clipped to an L2 norm.

    Noise, when asked for, is a hash-seeded normal draw per row and position, so that a recomputed
    task repeats it; production seeds must be secret.
    """
    limit = max(0.001, clip)
    length = lambda values: F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
    measured = F.struct(delta.alias("delta"), length(delta).alias("norm"))
    protect = lambda m: F.struct(
        m["norm"].alias("original_norm"), _protect(m["delta"], m["norm"], limit, noise, seed).alias("protected")
    )
    done = lambda u: F.struct(u["original_norm"], u["protected"], length(u["protected"]).alias("clipped_norm"))
    return S.let(S.let(measured, protect), done)


def _protect(delta: Column, norm: Column, limit: float, noise: float, seed: int) -> Column:
    scale = F.when(norm > limit, F.lit(limit) / norm).otherwise(F.lit(1.0))
    unit = lambda h: (F.shiftrightunsigned(h, 11) + 0.5) / float(2**53)

    def one(v: Column, i: Column) -> Column:
        if noise <= 0.0:
            return v * scale
        h1, h2 = F.xxhash64(delta, i, F.lit(seed)), F.xxhash64(delta, i, F.lit(seed + 1))
        return v * scale + noise * F.sqrt(-2.0 * F.log(unit(h1))) * F.cos(unit(h2) * (2.0 * np.pi))

    return F.transform(delta, one)


def fleet_mean(updates: DataFrame, vector: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean of the protected vectors per position, as rows (groups, position, mean)."""
    cells = updates.select(*groups, F.posexplode(vector).alias("position", "v"))
    return cells.groupBy(*groups, "position").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("updates"))
