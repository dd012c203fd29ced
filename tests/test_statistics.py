import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsefleet.functions import binomial as Bn
from pulsefleet.functions import scoring as S
from pulsefleet.operators import benchstats as B
from pulsefleet.operators import calibration as C
from pulsefleet.operators import evaluation as V
from pulsefleet.operators import ranking as R
from pulsefleet.session import BROADCAST_ROWS, SEGMENT_ROWS


def pairs(spark, ys, ps):
    return spark.createDataFrame(list(zip(ys, ps)), "label int, probability double")


def test_perfect_ranking(spark):
    m = V.evaluate_binary(pairs(spark, [0, 0, 1, 1], [0.05, 0.2, 0.8, 0.95]), "label", "probability").first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (2, 0, 0, 2)
    assert m["balanced_accuracy"] > 0.99 and m["critical_recall_wilson_lower"] > 0.30
    assert m["auroc"] == 1.0 and m["auprc"] == 1.0


def test_rank_metrics_match_brute_force(spark):
    rng = random.Random(3)
    ys = [rng.randint(0, 1) for _ in range(400)]
    ps = [round(rng.random(), 2) for _ in ys]
    got = V.evaluate_binary(pairs(spark, ys, ps), "label", "probability").first()
    pos, neg = [p for p, y in zip(ps, ys) if y], [p for p, y in zip(ps, ys) if not y]
    auroc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    area, tp = 0.0, 0
    for i, (p, y) in enumerate(sorted(zip(ps, ys), reverse=True), 1):
        tp += y
        area += y * tp / i
    assert got["auroc"] == pytest.approx(auroc, abs=1e-12)
    assert got["auprc"] == pytest.approx(area / len(pos), abs=1e-12)


@pytest.mark.parametrize("low,high", [(0, 0), (0, 5), (10, 2500), (0, 9000), (1500, 90000), (3000, 3001), (10**9, 10**9 + 10**7)])
def test_harmonic_gap(spark, low, high):
    row = spark.range(1).select(F.lit(low).cast("long").alias("a"), F.lit(high).cast("long").alias("b"))
    got = row.select(V._harmonic_gap(F.col("a"), F.col("b"))).first()[0]
    exact = math.fsum(1.0 / k for k in range(low + 1, high + 1)) if high < 10**6 else math.log1p((high - low) / low)
    assert got == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_single_class_scores_zero(spark):
    m = V.evaluate_binary(pairs(spark, [1, 1], [0.4, 0.6]), "label", "probability").first()
    assert m["auroc"] == 0.0


def test_risk_coverage_has_ten_rows(spark):
    assert V.risk_coverage(pairs(spark, [0, 0, 1, 1], [0.05, 0.2, 0.8, 0.95]), "label", "probability").count() == 10


def test_slices(spark):
    df = spark.createDataFrame([("d1", "w", 0, 0.1), ("d2", "w", 1, 0.9)], "device string, work string, label int, probability double")
    out = V.evaluate_slices(df, "label", "probability", ["device", "work"])
    assert sorted((r["field"], r["value"]) for r in out.collect()) == [("device", "d1"), ("device", "d2"), ("work", "w")]


def test_exact_bounds_golden(spark):
    lower, upper = Bn.bounds(np.array([0, 97, 11]), np.array([100, 100, 10]), 0.95)
    assert lower[0] == 0.0 and round(float(upper[0]), 6) == 0.029513
    assert 0.90 < lower[1] < upper[1] < 1.0
    assert math.isnan(lower[2]) and math.isnan(upper[2])


def test_bounds_match_the_binomial_tail():
    def cdf(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in [(1, 10), (5, 10), (9, 10), (3, 200), (150, 200)]:
        lower, upper = Bn.bounds(np.array([k]), np.array([n]), 0.95)
        assert cdf(k, n, upper[0]) == pytest.approx(0.05, abs=1e-8)
        assert 1 - cdf(k - 1, n, lower[0]) == pytest.approx(0.05, abs=1e-8)


def test_selective_risk_certificate(spark):
    rows = spark.createDataFrame([(0, 100, 100), (5, 10, 100), (0, 0, 100), (11, 10, 100)], "e long, a long, t long")
    out = [r for r in V.selective_risk(rows, "e", "a", "t", 0.10, 0.80).collect()]
    assert [r["certified"] for r in out] == [True, False, False, False]
    assert out[2]["reason"] == out[3]["reason"] == "invalid_or_empty_evidence" and out[3]["error_upper_bound"] == 1.0


FLAGS = ["eligible", "accepted", "correct", "critical_event", "critical_detected", "committed_action", "severe_harm", "rollback_attempted", "rollback_succeeded", "protected_policy_violation"]


def test_one_perfect_episode_is_not_certified(spark):
    schema = "episode_id string, support_slice string, " + ", ".join(f"{f} boolean" for f in FLAGS)
    values = [f not in ("severe_harm", "protected_policy_violation") for f in FLAGS]
    report = V.certify_slices(spark.createDataFrame([("e", "slice", *values)], schema))
    row = report.where("level = 'overall'").first()
    assert row["status"] == "NOT_CERTIFIED" and "correct_outcome_lower_bound_failed" in row["failures"]
    assert V.certification_status(report).first()["status"] == "NOT_CERTIFIED"


def test_calibrator_keeps_order(spark):
    df = pairs(spark, [1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1, 0.3])
    options = C.select_calibrator(df, "label", "probability")
    chosen = options.where("chosen").first()
    assert options.where("chosen").count() == 1 and chosen["log_loss"] < 1.0
    scored = {r["probability"]: r["calibrated"] for r in C.apply_calibrator(df, "probability", options).collect()}
    assert scored[0.9] > scored[0.1]


def test_sigmoid_fit_paths_agree(spark, monkeypatch):
    scores = C.distinct_scores(pairs(spark, [1, 1, 0, 0, 1], [0.9, 0.6, 0.4, 0.2, 0.3]), "label", "probability")
    one = C.fit_sigmoid(scores, steps=5)
    monkeypatch.setattr(C, "ONE_TASK_ROWS", 0)
    assert C.fit_sigmoid(scores, steps=5) == pytest.approx(one, abs=1e-12)


def test_conformal_abstains_in_the_middle(spark):
    df = pairs(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    t = C.conformal_threshold(df, "label", "probability").first()["threshold"]
    row = spark.range(1).select(C.conformal_set(F.lit(0.5), F.lit(t)).alias("s")).first()["s"]
    assert row["abstain"] and row["labels"] == [0, 1]


def test_ood_and_drift_fail_closed(spark):
    df = spark.createDataFrame([(100.0,)], "cpu double")
    o = C.ood_scores(df, {"cpu": (10.0, 5.0)}, F.lit(0.2), F.lit(0.3), F.lit(False)).first()
    assert not o["ood_accepted"] and len(o["ood_reasons"]) == 3
    reference = spark.createDataFrame([("cpu", 10.0, 5.0)], "feature string, mean double, scale double")
    now = spark.createDataFrame([("g", "cpu", 60.0)], "g string, feature string, mean double")
    d = C.drift(reference, now, ["g"], F.lit(0.9), F.lit(0.4)).first()
    assert d["level"] == "CERTIFICATE_INVALID"
    unknown = spark.createDataFrame([("g", "gpu", 60.0)], "g string, feature string, mean double")
    assert C.drift(reference, unknown, ["g"], F.lit(0.9), F.lit(0.9)).first()["level"] == "CERTIFICATE_INVALID"


def test_exact_quantiles_on_both_plans(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(round(v, 2))) for g in ("a", "b") for v in rng.normal(size=300)]
    df = spark.createDataFrame(rows, "g string, v double")
    expect = {g: np.quantile([v for k, v in rows if k == g], [0.5, 0.95]) for g in ("a", "b")}
    for limit in ("1000000", "20"):
        spark.conf.set(SEGMENT_ROWS, limit)
        got = R.exact_quantiles(df, ["g"], "v", {"m": 0.5, "h": 0.95}).collect()
        spark.conf.unset(SEGMENT_ROWS)
        for r in got:
            assert (r["m"], r["h"]) == pytest.approx(tuple(expect[r["g"]]), abs=1e-12)


def test_global_rank_with_heavy_ties(spark, monkeypatch):
    rows = [(f"k{i}", 7 if i % 3 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v long")
    one_task = {r["k"]: r["rank"] for r in R.global_rank(df, "v", "k").collect()}
    monkeypatch.setattr(R, "ONE_TASK_ROWS", 0)
    ranks = [(r["rank"], r["v"], r["k"]) for r in R.global_rank(df, "v", "k").collect()]
    ranks.sort()
    assert [r for r, _, _ in ranks] == list(range(1, 901))
    assert [v for _, v, _ in ranks] == sorted(v for _, v in rows)
    assert {k: r for r, _, k in ranks} == one_task


def bench_rows(spark, crash=0, notes=""):
    samples, runs = [], []
    for i in range(1, 11):
        for variant, base in (("windows_baseline", 100.0), ("subject_optimizer", 35.0)):
            run = f"{variant}-{i}"
            for s in range(5):
                samples.append(("d", "coding", "warm", "latency", variant, i, run, "ms", "lower", base + s * (10 if base == 100 else 5)))
            c = crash if variant == "subject_optimizer" and i == 1 else 0
            position = 1 + (i + (variant == "subject_optimizer")) % 2
            runs.append(("d", "coding", "warm", "latency", variant, run, i, position, c, 0, 0, 0, 2.0, 4, 100.0, 4, notes, "b", "AC", "COOL"))
    return (
        spark.createDataFrame(samples, "device_id string, scenario string, run_type string, metric string, variant string, iteration int, run_id string, unit string, direction string, sample double"),
        spark.createDataFrame(
            runs,
            "device_id string, scenario string, run_type string, metric string, variant string, run_id string, iteration int, order_index int, crashes int, app_reloads int, "
            "user_apps_touched int, rollback_failures int, cpu_sum double, cpu_n int, memory_sum double, memory_n int, notes string, os_build string, power_mode string, thermal_state string",
        ),
    )


def test_qualified_claim(spark):
    row = B.comparison_report(*bench_rows(spark), replicates=200).first()
    assert row["claim_status"] == "QUALIFIED_2X_RESPONSIVENESS" and row["ci_low"] > 0


def test_crash_and_synthetic_notes_block_the_claim(spark):
    report = B.comparison_report(*bench_rows(spark, crash=1), replicates=50)
    row = report.first()
    assert row["claim_status"] == "NO_CLAIM" and not row["zero_safety_regressions"]
    assert B.negative_results(report).count() == 1
    row = B.comparison_report(*bench_rows(spark, notes="SYNTHETIC sample"), replicates=50).first()
    assert row["claim_status"] == "NO_CLAIM" and not row["non_synthetic_data"]


def test_plan_is_reproducible_and_balanced(spark):
    devices = spark.createDataFrame([("lab",)], "device_id string")
    one, two = (B.run_plan(devices, seed=42).orderBy("run_id").collect() for _ in range(2))
    assert one == two and len(one) == 5 * 2 * 10 * 2
    assert {r["order_index"] for r in one} == {1, 2}
    with pytest.raises(ValueError):
        B.run_plan(devices, repetitions=1)


def test_plan_is_dealt_over_tasks(spark, monkeypatch):
    devices = spark.createDataFrame([(f"d{i}",) for i in range(6)] + [(None,), ("d0",)], "device_id string").coalesce(1)
    whole = B.run_plan(devices, repetitions=10)
    assert whole.rdd.getNumPartitions() == 1
    monkeypatch.setattr(B, "TASK_RUNS", 400)
    dealt = B.run_plan(devices, repetitions=10)
    assert dealt.rdd.getNumPartitions() == 4
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect())) and dealt.count() == 8 * 200


def test_prediction_payload(spark):
    p = {"NORMAL": F.lit(0.10), "WARNING": F.lit(0.20), "CRITICAL": F.lit(0.60), "RECOVERY": F.lit(0.10)}
    row = spark.range(1).select(*[c.alias(n) for n, c in S.prediction_payload(p).items()]).first()
    assert row["predicted_class"] == "CRITICAL" and row["confidence"] == 54.4
    assert row["risk"] == pytest.approx(0.2 * 18 + 0.2 * 66 + 0.6 * 92)


def test_wilson_and_improvement(spark):
    row = spark.range(1).select(
        S.wilson_lower(F.lit(0), F.lit(0)).alias("w"), S.relative_improvement(F.lit(0.0), F.lit(5.0), F.lit("lower")).alias("z"),
        S.relative_improvement(F.lit(10.0), F.lit(15.0), F.lit("higher")).alias("h"),
    ).first()
    assert (row["w"], row["z"], row["h"]) == (0.0, 0.0, 0.5)


@pytest.mark.parametrize("budget", [1_000_000, 10])
def test_bootstrap_by_counts_equals_drawing_one_by_one(spark, budget):
    """Groups of several sizes, two of them equal; counts sent to the pairs, and met by shuffle."""
    rng = random.Random(8)
    sizes = {"a": 12, "b": 12, "c": 1, "d": 30}
    rows = [(g, 3 * i, rng.uniform(50, 90), rng.uniform(20, 80)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, iteration int, baseline_p95 double, candidate_p95 double")
    spark.conf.set(BROADCAST_ROWS, str(budget))
    try:
        out = B.bootstrap_interval(df, ["g"], F.lit("lower"), 7, 200)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["g"]: (r["ci_low"], r["ci_high"]) for r in out.collect()}
    finally:
        spark.conf.unset(BROADCAST_ROWS)
    assert ("BroadcastHashJoin" in plan) == (budget > 10)
    for g, n in sizes.items():
        own, gains = [r for r in rows if r[0] == g], []
        for rep in range(200):
            at = [int(hashlib.md5(f"7:{rep}:{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]
            b, c = sum(own[i][2] for i in at) / n, sum(own[i][3] for i in at) / n
            gains.append((b - c) / b)
        assert got[g] == pytest.approx(tuple(np.quantile(gains, [0.025, 0.975])), abs=1e-9)


def test_bootstrap_keeps_the_pairs_where_they_are(spark):
    """The pairs themselves are dealt by group once; rows per replicate are never shuffled."""
    rows = [(f"g{i % 50}", i // 50, 50.0 + i % 7, 40.0 + i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, iteration int, baseline_p95 double, candidate_p95 double")
    out = B.bootstrap_interval(df, ["g"], F.lit("lower"), 7, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(g#" in line]
    assert len(shuffled) == 1 and "REPARTITION_BY_COL" in shuffled[0] and "SortAggregate" not in plan
    assert "hashpartitioning(g#" not in plan.replace(shuffled[0], "")
    assert out.count() == 50


def test_bootstrap_of_no_pairs(spark):
    df = spark.createDataFrame([], "g string, iteration int, baseline_p95 double, candidate_p95 double")
    assert B.bootstrap_interval(df, ["g"], F.lit("lower"), 7, 20).count() == 0
