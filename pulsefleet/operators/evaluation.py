"""Evaluation of binary and multiclass predictions, certificates and readiness reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.functions.binomial import exact_bounds
from pulsefleet.operators.ranking import prefix_sums

EULER = 0.5772156649015329


def _bounded(p: Column, eps: float = 1e-12) -> Column:
    return F.least(F.lit(1.0 - eps), F.greatest(F.lit(eps), p.cast("double")))


def compressed(df: DataFrame, groups: Sequence[str], label: str, probability: str) -> DataFrame:
    """Counts of positives and negatives per distinct clipped probability.

    Every metric below needs only these counts, so raw rows are combined on the map side once.
    """
    y = F.col(label)
    return (
        df.withColumn("p", _bounded(F.col(probability)))
        .groupBy(*groups, "p")
        .agg(F.sum(y.cast("long")).alias("pos"), F.sum((1 - y).cast("long")).alias("neg"))
    )


def confusion_metrics(counts: DataFrame, groups: Sequence[str], threshold: float = 0.5) -> DataFrame:
    p, pos, neg, n = F.col("p"), F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    on = p >= threshold
    total = counts.groupBy(*groups).agg(
        F.sum(F.when(~on, neg).otherwise(0)).alias("tn"),
        F.sum(F.when(on, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~on, pos).otherwise(0)).alias("fn"),
        F.sum(F.when(on, pos).otherwise(0)).alias("tp"),
        F.sum(n).alias("n"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("__sq"),
        F.sum(-pos * F.log(p) - neg * F.log(1 - p)).alias("__ll"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall_n, recall_p = S.ratio(tn, tn + fp), S.ratio(tp, tp + fn)
    f1_n, f1_p = S.ratio(2 * tn, 2 * tn + fp + fn), S.ratio(2 * tp, 2 * tp + fp + fn)
    return total.select(
        *groups,
        "n",
        "tn",
        "fp",
        "fn",
        "tp",
        ((recall_n + recall_p) / 2.0).alias("balanced_accuracy"),
        ((f1_n + f1_p) / 2.0).alias("macro_f1"),
        (F.col("__sq") / F.col("n")).alias("brier"),
        (F.col("__ll") / F.col("n")).alias("log_loss"),
        recall_p.alias("critical_recall"),
        S.wilson_lower(tp, tp + fn).alias("critical_recall_wilson_lower"),
    )


def _harmonic_gap(low: Column, high: Column) -> Column:
    """H(high) - H(low) for integers 0 <= low <= high, stable for large arguments."""
    exact = F.aggregate(
        F.sequence(low + 1, F.greatest(high, low + 1)), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k
    )
    a, b = low.cast("double"), high.cast("double")
    tail = lambda x: 1.0 / (2 * x) - 1.0 / (12 * x * x) + 1.0 / (120 * x * x * x * x)
    smooth = F.log1p((b - a) / a) + tail(b) - tail(a)
    # The series serves long gaps that start far out; a long gap from near zero adds its head exactly.
    head = F.lit(2000)
    from_head = F.log(b / 2000.0) + tail(b) - F.lit(1 / 4000.0 - 1 / (12 * 2000.0**2) + 1 / (120 * 2000.0**4))
    near = F.aggregate(F.sequence(low + 1, F.greatest(head, low + 1)), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k)
    return (
        F.when(high <= low, F.lit(0.0))
        .when(high - low <= 2000, exact)
        .when(low >= 2000, smooth)
        .otherwise(near + from_head)
    )


def rank_metrics(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AUROC with average tie ranks and step AUPRC (within a tie positives come first).

    With T positives and N rows above a tie group, its k-th positive has precision (T+k)/(N+k), so
    the group adds n + (T-N)(H(N+n)-H(N)) over the positives of the whole set.
    """
    groups = list(groups)
    keyed = counts if groups else counts.withColumn("__all", F.lit(0))
    parts = groups or ["__all"]
    ranked = prefix_sums(keyed, parts, "p", ["pos", "neg"])
    totals = keyed.groupBy(*parts).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    ranked = ranked.join(totals, parts)
    pos, neg = F.col("pos"), F.col("neg")
    below = F.col("pos_before") + F.col("neg_before")
    rank = below + (pos + neg + 1) / 2.0
    above_pos = F.col("__P") - F.col("pos_before") - pos
    above = F.col("__P") + F.col("__N") - below - pos - neg
    step = pos + (above_pos - above) * _harmonic_gap(above, above + pos)
    sums = ranked.groupBy(*parts, "__P", "__N").agg(F.sum(rank * pos).alias("__rank"), F.sum(step).alias("__area"))
    P, N = F.col("__P").cast("double"), F.col("__N").cast("double")
    return sums.select(
        *groups,
        F.when((P == 0) | (N == 0), F.lit(0.0)).otherwise((F.col("__rank") - P * (P + 1) / 2.0) / (P * N)).alias("auroc"),
        F.when(P == 0, F.lit(0.0)).otherwise(F.col("__area") / P).alias("auprc"),
    )


def calibration_error(counts: DataFrame, groups: Sequence[str], bins: int = 10) -> DataFrame:
    bucket = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins).cast("int"))
    n = F.col("pos") + F.col("neg")
    per_bin = counts.groupBy(*groups, bucket.alias("__bin")).agg(
        F.sum(n).alias("__n"), F.sum(F.col("p") * n).alias("__p"), F.sum("pos").alias("__y")
    )
    gap = F.abs(F.col("__p") / F.col("__n") - F.col("__y") / F.col("__n"))
    return per_bin.groupBy(*groups).agg(
        (F.sum(gap * F.col("__n")) / F.sum("__n")).alias("expected_calibration_error"),
        F.max(gap).alias("maximum_calibration_error"),
    )


def evaluate_binary(
    df: DataFrame, label: str, probability: str, groups: Sequence[str] = (), threshold: float = 0.5, bins: int = 10
) -> DataFrame:
    """All binary metrics, one row per group."""
    groups = list(groups)
    parts = groups or ["__all"]
    source = df if groups else df.withColumn("__all", F.lit(0))
    counts = compressed(source, parts, label, probability)
    out = (
        confusion_metrics(counts, parts, threshold)
        .join(rank_metrics(counts, parts), parts)
        .join(calibration_error(counts, parts, bins), parts)
    )
    return out if groups else out.drop("__all")


def evaluate_slices(df: DataFrame, label: str, probability: str, fields: Sequence[str]) -> DataFrame:
    """Metrics per value of each field: rows are combined first, then unpivoted to (field, value)."""
    y = F.col(label)
    combined = (
        df.withColumn("p", F.col(probability).cast("double"))
        .groupBy(*fields, "p")
        .agg(F.sum(y.cast("long")).alias("pos"), F.sum((1 - y).cast("long")).alias("neg"))
    )
    slices = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN")).alias("value"))
            for f in fields
        ]
    )
    long = combined.select(F.explode(slices).alias("s"), "p", "pos", "neg").select("s.field", "s.value", "p", "pos", "neg")
    counts = (
        long.withColumn("p", _bounded(F.col("p"))).groupBy("field", "value", "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    parts = ["field", "value"]
    return (
        confusion_metrics(counts, parts).join(rank_metrics(counts, parts), parts).join(calibration_error(counts, parts), parts)
    )


def risk_coverage(df: DataFrame, label: str, probability: str, points: int = 10) -> DataFrame:
    """Coverage and risk at confidence thresholds k/points, from one pass over the rows.

    A row counts for every threshold up to its confidence, so rows are bucketed by the highest one
    and the small bucket table is accumulated.
    """
    p = F.col(probability).cast("double")
    confidence = F.abs(p - 0.5) * 2.0
    wrong = ((p >= 0.5) != (F.col(label) == 1)).cast("long")
    # The highest k with confidence >= k/points, compared exactly as the thresholds are.
    reached = sum(((confidence >= F.lit(k / points)).cast("int") for k in range(1, points + 1)), F.lit(0))
    buckets = df.groupBy(reached.alias("__k")).agg(F.count(F.lit(1)).alias("__n"), F.sum(wrong).alias("__e"))
    ladder = df.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("k"))
    per_k = buckets.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__k")))).groupBy("k").agg(
        F.sum("__n").alias("__n"), F.sum("__e").alias("__e")
    )
    total = per_k.where("k = 0").select(F.col("__n").alias("__total"), F.lit(1).alias("__one"))
    joined = ladder.join(per_k, "k", "left").withColumn("__one", F.lit(1)).join(total, "__one", "left")
    n, e = F.coalesce("__n", F.lit(0)), F.coalesce("__e", F.lit(0))
    return joined.select(
        (F.col("k") / points).alias("confidence_threshold"),
        S.ratio(n, F.coalesce("__total", F.lit(0))).alias("coverage"),
        S.ratio(e, n).alias("risk"),
    )


def selective_risk(
    rows: DataFrame, errors: str, accepted: str, total: str, maximum_error: float, minimum_coverage: float
) -> DataFrame:
    """Certificate per row of counts; invalid or empty evidence fails with open bounds."""
    e, a, t = F.col(errors), F.col(accepted), F.col(total)
    invalid = F.coalesce((a <= 0) | (t <= 0) | (a > t) | (e < 0) | (e > a), F.lit(True))
    coverage, error = exact_bounds(a, t), exact_bounds(e, a)
    bounded = rows.withColumns({"__c": coverage, "__e": error, "__bad": invalid})
    upper = F.when(F.col("__bad"), F.lit(1.0)).otherwise(F.col("__e.upper"))
    lower = F.when(F.col("__bad"), F.lit(0.0)).otherwise(F.col("__c.lower"))
    passed = ~F.col("__bad") & (upper <= maximum_error) & (lower >= minimum_coverage)
    return bounded.withColumns(
        {
            "certified": passed,
            "error_upper_bound": upper,
            "coverage_lower_bound": lower,
            "reason": F.when(F.col("__bad"), "invalid_or_empty_evidence")
            .when(passed, "certified")
            .otherwise("risk_or_coverage_bound_failed"),
        }
    ).drop("__c", "__e", "__bad")


def risk_coverage_report(
    df: DataFrame,
    label: str,
    probability: str,
    thresholds: Sequence[float],
    maximum_error: float = 0.10,
    minimum_coverage: float = 0.50,
) -> DataFrame:
    """Selective-risk certificate per threshold t, accepting p >= t or p <= 1 - t.

    The thresholds are a parameter list, so each is a pair of conditional sums of one aggregate.
    """
    p, y = F.col(probability).cast("double"), F.col(label) == 1
    wrong = (p >= 0.5) != y
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        inside = (p >= t) | (p <= 1.0 - t)
        aggs += [F.count_if(inside).alias(f"a{i}"), F.count_if(inside & wrong).alias(f"e{i}")]
    one = df.agg(*aggs)
    entries = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("accepted"), F.col(f"e{i}").alias("errors"))
            for i, t in enumerate(thresholds)
        ]
    )
    rows = one.select("total", F.explode(entries).alias("r")).select("r.threshold", "r.errors", "r.accepted", "total")
    return selective_risk(rows, "errors", "accepted", "total", maximum_error, minimum_coverage)


# Fixed values of the certification policy.
POLICY = {
    "confidence": 0.95,
    "correct_lower_minimum": 0.99,
    "coverage_lower_minimum": 0.70,
    "critical_recall_lower_minimum": 0.97,
    "severe_harm_upper_maximum": 0.001,
}


def certify_slices(episodes: DataFrame, slice_column: str = "support_slice", policy: Mapping[str, float] = POLICY) -> DataFrame:
    """One row per slice and one for ``global``, with exact bounds, failures and status."""
    flag = F.col
    n = lambda condition: F.count_if(condition)
    eligible, accepted = flag("eligible"), flag("eligible") & flag("accepted")
    critical = flag("eligible") & flag("critical_event")
    named = F.coalesce(F.nullif(F.col(slice_column), F.lit("")), F.lit("unspecified"))
    counted = (
        episodes.withColumn("__slice", named)
        .rollup("__slice")
        .agg(
            F.grouping("__slice").alias("__all"),
            n(eligible).alias("eligible_episodes"),
            n(accepted).alias("resolved_episodes"),
            n(accepted & flag("correct")).alias("correct_outcomes"),
            n(critical).alias("critical_events"),
            n(critical & flag("critical_detected")).alias("critical_detected"),
            n(flag("committed_action")).alias("committed_actions"),
            n(flag("committed_action") & flag("severe_harm")).alias("severe_harmful_actions"),
            n(flag("rollback_attempted")).alias("rollback_attempts"),
            n(flag("rollback_attempted") & flag("rollback_succeeded")).alias("rollback_successes"),
            n(flag("protected_policy_violation")).alias("violations"),
        )
    )
    c = policy["confidence"]
    bound = lambda k, total: exact_bounds(F.col(k), F.col(total), c)
    rows = counted.withColumns(
        {
            "__correct": bound("correct_outcomes", "resolved_episodes"),
            "__coverage": bound("resolved_episodes", "eligible_episodes"),
            "__critical": bound("critical_detected", "critical_events"),
            "__harm": bound("severe_harmful_actions", "committed_actions"),
        }
    ).withColumns(
        {
            "correct_lower_bound": F.coalesce("__correct.lower", F.lit(0.0)),
            "coverage_lower_bound": F.coalesce("__coverage.lower", F.lit(0.0)),
            "critical_recall_lower_bound": F.coalesce("__critical.lower", F.lit(0.0)),
            "severe_harm_upper_bound": F.coalesce("__harm.upper", F.lit(1.0)),
        }
    )
    none = lambda name: F.col(name) == 0
    code = lambda condition, text: F.when(condition, F.lit(text))
    failures = F.array_compact(
        F.array(
            code(none("eligible_episodes"), "no_eligible_episodes"),
            F.when(none("resolved_episodes"), F.lit("no_resolved_episodes")).when(
                F.col("correct_lower_bound") < policy["correct_lower_minimum"], F.lit("correct_outcome_lower_bound_failed")
            ),
            code(
                ~none("eligible_episodes") & (F.col("coverage_lower_bound") < policy["coverage_lower_minimum"]),
                "coverage_lower_bound_failed",
            ),
            F.when(none("critical_events"), F.lit("no_critical_user_impact_episodes")).when(
                F.col("critical_recall_lower_bound") < policy["critical_recall_lower_minimum"],
                F.lit("critical_recall_lower_bound_failed"),
            ),
            F.when(none("committed_actions"), F.lit("no_committed_action_evidence")).when(
                F.col("severe_harm_upper_bound") >= policy["severe_harm_upper_maximum"],
                F.lit("severe_harm_upper_bound_failed"),
            ),
            F.when(none("rollback_attempts"), F.lit("no_injected_rollback_evidence")).when(
                F.col("rollback_successes") != F.col("rollback_attempts"), F.lit("rollback_failure")
            ),
            code(F.col("violations") > 0, "protected_or_foreground_policy_violation"),
        )
    )
    return (
        rows.withColumn("failures", failures)
        .withColumns(
            {
                "support_slice": F.when(F.col("__all") == 1, "global").otherwise(F.col("__slice")),
                "level": F.when(F.col("__all") == 1, "overall").otherwise("slice"),
                "status": F.when(F.size("failures") == 0, "CERTIFIED_AUTOMATIC").otherwise("NOT_CERTIFIED"),
            }
        )
        .drop("__correct", "__coverage", "__critical", "__harm", "__slice", "__all")
    )


def certification_status(report: DataFrame) -> DataFrame:
    """One row: certified only when the overall row and every slice are."""
    passed = F.col("status") == "CERTIFIED_AUTOMATIC"
    return report.agg(
        F.coalesce(F.bool_and(passed), F.lit(False)).alias("certified"),
        F.count_if(~passed).alias("failing_rows"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("status", F.when(F.col("certified"), "CERTIFIED_AUTOMATIC").otherwise("NOT_CERTIFIED"))


# -- multiclass -----------------------------------------------------------------------------


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def multiclass_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, from the confusion matrix."""
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")),
            )
        ).alias("s"),
        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    per = sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.given").alias("predicted"),
        (F.sum("hit") / 2).cast("long").alias("hits"),
    )
    precision, recall = S.ratio("hits", "predicted"), S.ratio("hits", "support")
    return per.select(
        "class",
        "support",
        "predicted",
        "hits",
        precision.alias("precision"),
        recall.alias("recall"),
        S.ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def multiclass_totals(matrix: DataFrame) -> DataFrame:
    """Accuracy and false positive and negative counts, by label id and by severity rank.

    Label ids put RECOVERY above CRITICAL; the severity rank puts it with NORMAL.
    """
    ident = lambda c: S.by_value(F.col(c), {name: i for i, name in enumerate(S.LABELS)}, -1)
    a, p, n = ident("actual"), ident("predicted"), F.col("n")
    ra, rp = S.severity_rank("actual"), S.severity_rank("predicted")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    return matrix.agg(
        F.sum(n).alias("rows"),
        (count(a == p) / F.sum(n)).alias("accuracy"),
        count((p > a) & (p >= 1)).alias("false_positives"),
        count((p < a) & (a >= 1)).alias("false_negatives"),
        count(rp > ra).alias("over_severe"),
        count(rp < ra).alias("under_severe"),
    )


# Fixed values of the readiness requirements.
MIN_SAMPLES = 1000
MIN_CLASS_ROWS = {"NORMAL": 300, "WARNING": 300, "CRITICAL": 150, "RECOVERY": 150}
MIN_RECALL = {"CRITICAL": 0.85, "RECOVERY": 0.75}
PREFERRED_RECALL = {"WARNING": 0.80, "NORMAL": 0.80}


def readiness(class_rows: DataFrame, recalls: DataFrame) -> DataFrame:
    """One row with status, blockers and warnings. class_rows: (class, rows); recalls: (class, recall)."""
    spark = class_rows.sparkSession
    needs = spark.createDataFrame(
        [(i, c, MIN_CLASS_ROWS[c], MIN_RECALL.get(c), PREFERRED_RECALL.get(c)) for i, c in enumerate(MIN_CLASS_ROWS)],
        "place int, class string, need long, need_recall double, want_recall double",
    )
    joined = needs.join(class_rows, "class", "left").join(recalls, "class", "left")
    rows, recall = F.coalesce("rows", F.lit(0)), F.coalesce("recall", F.lit(0.0))
    found = joined.agg(
        F.sum(rows).alias("samples"),
        F.array_sort(F.collect_list(F.when(rows < F.col("need"), F.struct("place", F.concat("class", F.lit("_rows")).alias("c"))))).alias("few"),
        F.array_sort(F.collect_list(F.when(recall < F.col("need_recall"), F.struct("place", F.concat("class", F.lit("_recall")).alias("c"))))).alias("low"),
        F.array_sort(F.collect_list(F.when(recall < F.col("want_recall"), F.struct("place", F.concat("class", F.lit("_recall")).alias("c"))))).alias("weak"),
    )
    text = lambda c: F.transform(F.col(c), lambda e: e["c"])
    few_samples = F.when(F.col("samples") < MIN_SAMPLES, F.array(F.lit("samples"))).otherwise(F.array().cast("array<string>"))
    blockers = F.concat(few_samples, text("few"), text("low"))
    return found.select(
        "samples",
        blockers.alias("blockers"),
        text("weak").alias("warnings"),
        F.when(F.size(blockers) == 0, "production_candidate").otherwise("research_only").alias("status"),
    )


# -- simple baselines -----------------------------------------------------------------------


def majority_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("event_rate")).withColumn(
        "label", (F.col("event_rate") >= 0.5).cast("int")
    )


def resource_rule(cpu: Column, mem: Column, disk_free: Column) -> Column:
    """Score of the fixed resource rule; the label is score >= 0.70."""
    return S.clamp(0.45 * cpu / 100.0 + 0.45 * mem / 100.0 + 0.10 * (100.0 - disk_free) / 100.0, 0.0, 1.0)
