"""Probability calibration, conformal prediction, drift and out-of-distribution scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators.ranking import prefix_sums
from pulsefleet.session import checkpointed

EPS = 1e-6
# The temperature grid 0.10, 0.11 ... 4.00 and the sigmoid fit.
TEMPERATURES = [step / 100.0 for step in range(10, 401)]
FIT_STEPS, FIT_RATE = 500, 0.05
ONE_TASK_ROWS = 200_000


def clip(p: Column) -> Column:
    return F.least(F.lit(1.0 - EPS), F.greatest(F.lit(EPS), p.cast("double")))


def logit(p: Column) -> Column:
    return F.log(clip(p) / (1.0 - clip(p)))


def distinct_scores(df: DataFrame, label: str, probability: str) -> DataFrame:
    """(p, pos, neg) per distinct probability: what every fit below works on."""
    y = F.col(label)
    return df.groupBy(F.col(probability).cast("double").alias("p")).agg(
        F.sum(y.cast("long")).alias("pos"), F.sum((1 - y).cast("long")).alias("neg")
    )


def _loss(p: Column) -> Column:
    q = clip(p)
    return -(F.col("pos") * F.log(q) + F.col("neg") * F.log(1.0 - q))


def identity_loss(scores: DataFrame) -> DataFrame:
    return scores.agg((F.sum(_loss(F.col("p"))) / F.sum(F.col("pos") + F.col("neg"))).alias("log_loss"))


def fit_temperature(scores: DataFrame) -> DataFrame:
    """Grid temperature with the lowest log-loss, the smaller one on a tie.

    Each distinct score meets the fixed grid; partial sums leave one row per temperature and task.
    """
    grid = F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("temperature")
    tried = scores.select("pos", "neg", logit(F.col("p")).alias("z"), grid)
    loss = _loss(1.0 / (1.0 + F.exp(-F.col("z") / F.col("temperature"))))
    losses = tried.groupBy("temperature").agg((F.sum(loss) / F.sum(F.col("pos") + F.col("neg"))).alias("log_loss"))
    return losses.agg(F.min(F.struct("log_loss", "temperature")).alias("best")).select("best.temperature", "best.log_loss")


def fit_sigmoid(scores: DataFrame, steps: int = FIT_STEPS, rate: float = FIT_RATE) -> tuple[float, float]:
    """(a, b) after full-batch gradient steps from (1, 0).

    When the distinct scores fit one task, all steps run in one Arrow call; otherwise each step is
    one aggregate over the checkpointed distinct scores. Only two sums come to the driver per step.
    """
    rows = scores.count()
    if rows <= ONE_TASK_ROWS:

        def descend(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("p")
            p = np.clip(pdf["p"].to_numpy(), EPS, 1.0 - EPS)
            z = np.log(p / (1.0 - p))
            pos, weight = pdf["pos"].to_numpy(float), (pdf["pos"] + pdf["neg"]).to_numpy(float)
            n, a, b = weight.sum(), 1.0, 0.0
            for _ in range(steps):
                error = weight / (1.0 + np.exp(-(a * z + b))) - pos
                a, b = a - rate * float((error * z).sum()) / n, b - rate * float(error.sum()) / n
            return pd.DataFrame({"a": [a], "b": [b]})

        one = scores.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(
            lambda pdf: descend(pdf), "a double, b double"
        )
        row = one.first()
        return row["a"], row["b"]
    base = checkpointed(scores.withColumn("z", logit(F.col("p"))))
    n = base.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0]
    a, b = 1.0, 0.0
    for _ in range(steps):
        error = (F.col("pos") + F.col("neg")) / (1.0 + F.exp(-(F.col("z") * a + b))) - F.col("pos")
        row = base.agg(F.sum(error * F.col("z")).alias("ea"), F.sum(error).alias("eb")).first()
        a, b = a - rate * row["ea"] / n, b - rate * row["eb"] / n
    return a, b


def calibrated(p: Column, method: Column, temperature: Column, a: Column, b: Column) -> Column:
    z = logit(p)
    squash = lambda x: clip(1.0 / (1.0 + F.exp(-x)))
    return (
        F.when(method == "temperature", squash(z / temperature))
        .when(method == "sigmoid", squash(a * z + b))
        .otherwise(clip(p))
    )


def select_calibrator(df: DataFrame, label: str, probability: str) -> DataFrame:
    """One row per method with its parameters, log-loss and whether it is chosen.

    The lowest loss wins; identity, temperature, sigmoid is the order on a tie.
    """
    scores = checkpointed(distinct_scores(df, label, probability))
    a, b = fit_sigmoid(scores)
    total = F.sum(F.col("pos") + F.col("neg"))
    sigmoid = scores.agg((F.sum(_loss(1.0 / (1.0 + F.exp(-(logit(F.col("p")) * a + b))))) / total).alias("log_loss"))
    null = F.lit(None).cast("double")
    shape = lambda frame, place, name, t, x, y: frame.select(
        F.lit(place).alias("place"),
        F.lit(name).alias("method"),
        t.alias("temperature"),
        x.alias("a"),
        y.alias("b"),
        "log_loss",
    )
    options = (
        shape(identity_loss(scores), 0, "identity", null, null, null)
        .unionByName(shape(fit_temperature(scores), 1, "temperature", F.col("temperature"), null, null))
        .unionByName(shape(sigmoid, 2, "sigmoid", null, F.lit(a), F.lit(b)))
    )
    best = options.agg(F.min(F.struct("log_loss", "place")).alias("__best"))
    return options.join(F.broadcast(best), options["place"] == F.col("__best.place"), "left").select(
        "method", "temperature", "a", "b", "log_loss", F.col("__best").isNotNull().alias("chosen")
    )


def apply_calibrator(df: DataFrame, probability: str, options: DataFrame, out: str = "calibrated") -> DataFrame:
    """Apply the chosen method; the fitted model is one row of four numbers."""
    chosen = options.where("chosen").first()
    lit = lambda v: F.lit(v).cast("double")
    value = calibrated(
        F.col(probability), F.lit(chosen["method"]), lit(chosen["temperature"]), lit(chosen["a"]), lit(chosen["b"])
    )
    return df.withColumn(out, value)


# -- conformal ------------------------------------------------------------------------------


def conformal_threshold(df: DataFrame, label: str, probability: str, alpha: float = 0.10) -> DataFrame:
    """Score at rank ceil((n+1)(1-alpha)) of the nonconformity scores, as one row."""
    p = F.col(probability).cast("double")
    score = F.when(F.col(label) == 1, 1.0 - p).otherwise(p)
    counts = df.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("conformal calibration needs at least one row")
    index = min(total - 1, max(0, ceil((total + 1) * (1.0 - alpha)) - 1))
    ranked = prefix_sums(counts.withColumn("__all", F.lit(0)), ["__all"], "score", ["n"])
    hit = ranked.where((F.col("n_before") <= index) & (F.col("n_before") + F.col("n") > index))
    return hit.select(F.col("score").alias("threshold"), F.lit(total).alias("calibration_rows"))


def conformal_set(p: Column, threshold: Column, allow_empty: bool = False) -> Column:
    """Struct(labels, abstain) of a prediction set; an empty set widens to both labels."""
    keep = F.array_compact(
        F.array(
            F.when(1.0 - (1.0 - p) <= threshold, F.lit(0)),
            F.when(1.0 - p <= threshold, F.lit(1)),
        )
    )
    empty = F.size(keep) == 0
    labels = keep if allow_empty else F.when(empty, F.array(F.lit(0), F.lit(1))).otherwise(keep)
    return F.struct(labels.alias("labels"), (F.size(keep) != 1).alias("abstain"))


# -- drift and out-of-distribution ----------------------------------------------------------


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, feature, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*ids, F.explode(entries).alias("e")).select(*ids, "e.feature", "e.value")


def drift(
    reference: DataFrame, current: DataFrame, groups: Sequence[str], expected_coverage: Column, observed_coverage: Column
) -> DataFrame:
    """Mean normalised shift and coverage drop per group, with the five-level verdict.

    reference: (feature, mean, scale); current: (groups, feature, mean). Features that are missing
    on either side are ignored; a group with none left has an infinite shift.
    """
    # The reference has one row per feature; a shuffle by feature would make as many hot keys.
    both = current.withColumnRenamed("mean", "__now").join(F.broadcast(reference), "feature", "left")
    shift = F.abs(F.col("__now") - F.col("mean")) / F.greatest(F.coalesce("scale", F.lit(0.0)), F.lit(1e-6))
    rows = both.groupBy(*groups).agg(F.avg(shift).alias("__s"))
    drop = F.greatest(F.lit(0.0), expected_coverage - observed_coverage)
    out = rows.withColumns(
        {"normalized_shift": F.coalesce("__s", F.lit(float("inf"))), "coverage_drop": drop}
    ).drop("__s")
    return out.withColumn("level", S.drift_level("normalized_shift", "coverage_drop"))


def ood_scores(
    df: DataFrame,
    reference: Mapping[str, tuple[float, float]],
    missing_fraction: Column,
    disagreement: Column,
    support_match: Column,
    threshold: float = 0.25,
) -> DataFrame:
    """Out-of-distribution score, verdict and reasons of each row.

    reference maps a feature to (median, scale); it is a small parameter, so the features stay
    columns and no unpivot or shuffle is needed.
    """
    usable, distances, reasons = [], [], []
    for name, (median, scale) in reference.items():
        value = F.col(name).cast("double")
        ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & F.lit(scale > 0.0)
        usable.append(ok.cast("int"))
        gap = F.least(F.lit(1.0), F.abs(value - median) / (6.0 * max(scale, 1e-300)))
        distances.append(F.when(ok, gap).otherwise(F.lit(0.0)))
        reasons.append(F.when(~ok, F.lit(f"missing_or_invalid:{name}")))
    count, total = sum(usable[1:], usable[0]), sum(distances[1:], distances[0])
    feature_score = F.when(count == 0, F.lit(1.0)).otherwise(total / count)
    reasons += [
        F.when(missing_fraction > 0.10, F.lit("missingness")),
        F.when(disagreement > 0.20, F.lit("model_disagreement")),
        F.when(~support_match, F.lit("outside_support_envelope")),
    ]
    one = F.lit(1.0)
    score = F.least(
        one,
        feature_score * 0.50
        + F.least(one, missing_fraction) * 0.20
        + F.least(one, disagreement) * 0.20
        + F.when(support_match, F.lit(0.0)).otherwise(F.lit(0.10)),
    )
    return df.withColumns({"ood_score": score, "ood_reasons": F.array_compact(F.array(*reasons))}).withColumn(
        "ood_accepted", (F.col("ood_score") <= threshold) & (F.size("ood_reasons") == 0)
    )
