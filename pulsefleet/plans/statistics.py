"""Queries for evaluation, certificates, calibration, drift and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.functions.binomial import exact_bounds
from pulsefleet.operators import benchstats as B
from pulsefleet.operators import calibration as C
from pulsefleet.operators import evaluation as V
from pulsefleet.operators import ranking as R
from pulsefleet.operators import windows as W
from pulsefleet.operators.quality import SCENARIOS, VARIANTS, duplicate_ids, quarantined_rows, with_errors, benchmark_rules
from pulsefleet.plans.history import KEY, ORDER, OVER, _LABEL_CTES, _label_sql, r
from pulsefleet.plans.quality import certification_episodes
from pulsefleet.plans.registry import query
from pulsefleet.session import shared_folder
from pulsefleet.sources.files import read_benchmark_runs, read_certification_episodes
from pulsefleet.plans.views import pressure_sql, predictions, table, telemetry, with_predictions, with_telemetry

# -- binary evaluation ----------------------------------------------------------------------


def _confusion_sql(group: str = "") -> str:
    """Confusion metrics over a relation ``b`` with label and p."""
    return f"""
cnf AS (SELECT {group} count(*) AS n, count(*) FILTER (label = 0 AND p < 0.5) AS tn, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label = 1 AND p >= 0.5) AS tp,
  avg((label - p) * (label - p)) AS brier, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss FROM b {"GROUP BY ALL" if group else ""}),
met AS (SELECT *, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS rn, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rp,
  CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END AS fneg,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS fpos FROM cnf)"""


_WILSON = """CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE greatest(0, (rp + 1.96 * 1.96 / (2.0 * (tp + fn))
 - 1.96 * sqrt((rp * (1 - rp) + 1.96 * 1.96 / (4.0 * (tp + fn))) / (tp + fn))) / (1 + 1.96 * 1.96 / (tp + fn))) END"""
_CLIP = "least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, probability))"


@query(
    "d17_binary_metrics",
    with_predictions(
        f"""SELECT n, tn, fp, fn, tp, round((rn + rp) / 2, 6) AS balanced_accuracy, round((fneg + fpos) / 2, 6) AS macro_f1,
 round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(rp, 6) AS critical_recall FROM met""",
        f"b AS (SELECT label, {_CLIP} AS p FROM pred)",
        _confusion_sql(),
    ),
)
def d17_binary_metrics(spark, folder):
    counts = V.compressed(predictions(spark, folder), [], "label", "probability")
    m = V.confusion_metrics(counts, [])
    rounded = ["balanced_accuracy", "macro_f1", "brier", "log_loss", "critical_recall"]
    return m.select("n", "tn", "fp", "fn", "tp", *[r(c).alias(c) for c in rounded])


_RANKS = """
rnk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS avg_rank,
  sum(label) OVER (ORDER BY p DESC, label DESC ROWS UNBOUNDED PRECEDING) AS tp,
  row_number() OVER (ORDER BY p DESC, label DESC) AS i FROM b),
tot AS (SELECT sum(label)::DOUBLE AS pos, count(*) - sum(label)::DOUBLE AS neg FROM b)"""


@query(
    "d18_auroc",
    with_predictions(
        "SELECT round((sum(avg_rank * label) - any_value(pos) * (any_value(pos) + 1) / 2) / (any_value(pos) * any_value(neg)), 6) AS auroc FROM rnk, tot",
        f"b AS (SELECT label, {_CLIP} AS p FROM pred)",
        _RANKS,
    ),
)
def d18_auroc(spark, folder):
    counts = V.compressed(predictions(spark, folder), [], "label", "probability")
    return V.rank_metrics(counts, []).select(r("auroc").alias("auroc"))


@query(
    "d19_auprc",
    with_predictions(
        "SELECT round(sum(CASE WHEN label = 1 THEN tp / i ELSE 0 END) / any_value(pos), 6) AS auprc FROM rnk, tot",
        f"b AS (SELECT label, {_CLIP} AS p FROM pred)",
        _RANKS,
    ),
)
def d19_auprc(spark, folder):
    counts = V.compressed(predictions(spark, folder), [], "label", "probability")
    return V.rank_metrics(counts, []).select(r("auprc").alias("auprc"))


@query(
    "d20_calibration_error",
    with_predictions(
        """SELECT round(sum(gap * n) / sum(n), 6) AS expected_calibration_error, round(max(gap), 6) AS maximum_calibration_error
FROM (SELECT count(*) AS n, abs(avg(p) - avg(label)) AS gap FROM b GROUP BY least(9, CAST(floor(p * 10) AS INT)))""",
        f"b AS (SELECT label, {_CLIP} AS p FROM pred)",
    ),
)
def d20_calibration_error(spark, folder):
    counts = V.compressed(predictions(spark, folder), [], "label", "probability")
    e = V.calibration_error(counts, [])
    return e.select(*[r(c).alias(c) for c in ("expected_calibration_error", "maximum_calibration_error")])


@query(
    "d21_wilson_bound",
    with_predictions(
        f"SELECT workload_class, tp, fn, round({_WILSON}, 6) + 0 AS wilson_lower FROM met",
        f"b AS (SELECT workload_class, label, {_CLIP} AS p FROM pred)",
        _confusion_sql("workload_class,"),
    ),
)
def d21_wilson_bound(spark, folder):
    counts = V.compressed(predictions(spark, folder), ["workload_class"], "label", "probability")
    m = V.confusion_metrics(counts, ["workload_class"])
    return m.select("workload_class", "tp", "fn", r("critical_recall_wilson_lower").alias("wilson_lower"))


@query(
    "d22_risk_coverage",
    with_predictions(
        """SELECT k / 10 AS confidence_threshold, round(count(*) FILTER (hit) / count(*), 6) AS coverage,
 round(CASE WHEN count(*) FILTER (hit) = 0 THEN 0 ELSE count(*) FILTER (hit AND (probability >= 0.5) <> (label = 1)) / count(*) FILTER (hit) END, 6) AS risk
FROM (SELECT *, abs(probability - 0.5) * 2.0 >= k / 10 AS hit FROM pred, range(1, 11) AS s(k)) GROUP BY k"""
    ),
)
def d22_risk_coverage(spark, folder):
    curve = V.risk_coverage(predictions(spark, folder), "label", "probability")
    return curve.select("confidence_threshold", r("coverage").alias("coverage"), r("risk").alias("risk"))


_SLICE_B = f"""b AS (SELECT field, value, label, {_CLIP} AS p FROM (
 SELECT 'device_id' AS field, device_id AS value, label, probability FROM pred
 UNION ALL SELECT 'workload_class', workload_class, label, probability FROM pred
 UNION ALL SELECT 'application_family', application_family, label, probability FROM pred))"""


@query(
    "d23_slice_metrics",
    with_predictions(
        """SELECT met.field, met.value, n, round((rn + rp) / 2, 6) AS balanced_accuracy, round(brier, 6) AS brier,
 round(CASE WHEN pos = 0 OR neg = 0 THEN 0 ELSE (rsum - pos * (pos + 1) / 2) / (pos * neg) END, 6) + 0 AS auroc,
 round(CASE WHEN pos = 0 THEN 0 ELSE asum / pos END, 6) + 0 AS auprc
FROM met JOIN (SELECT field, value, sum(avg_rank * label) AS rsum, sum(CASE WHEN label = 1 THEN tp / i ELSE 0 END) AS asum,
   sum(label)::DOUBLE AS pos, count(*) - sum(label)::DOUBLE AS neg FROM rnk GROUP BY ALL) x ON met.field = x.field AND met.value = x.value""",
        _SLICE_B,
        _confusion_sql("field, value,"),
        """rnk AS (SELECT *, rank() OVER (PARTITION BY field, value ORDER BY p) + (count(*) OVER (PARTITION BY field, value, p) - 1) / 2.0 AS avg_rank,
  sum(label) OVER (PARTITION BY field, value ORDER BY p DESC, label DESC ROWS UNBOUNDED PRECEDING) AS tp,
  row_number() OVER (PARTITION BY field, value ORDER BY p DESC, label DESC) AS i FROM b)""",
    ),
)
def d23_slice_metrics(spark, folder):
    m = V.evaluate_slices(predictions(spark, folder), "label", "probability", ["device_id", "workload_class", "application_family"])
    return m.select("field", "value", "n", *[r(c).alias(c) for c in ("balanced_accuracy", "brier", "auroc", "auprc")])


# -- exact bounds ---------------------------------------------------------------------------


def clopper_pearson_sql(k: str, n: str, source: str, keys: str, name: str) -> str:
    """Recursive bisection on the binomial tail itself, which needs no beta function."""
    cdf = (
        "list_sum(list_transform(range(0, {top}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
        " + i * ln(m) + (n - i) * ln(1 - m))))"
    )
    upper, lower = cdf.format(top="k + 1"), cdf.format(top="k")
    return f"""
{name} AS (
  SELECT {keys}, {k}::BIGINT AS k, {n}::BIGINT AS n, 0 AS step, 0.0::DOUBLE AS ul, 1.0::DOUBLE AS uh, 0.0::DOUBLE AS ll, 1.0::DOUBLE AS lh FROM {source} WHERE {n} > 0
  UNION ALL
  SELECT {keys}, k, n, step + 1, CASE WHEN uc > 0.05 THEN um ELSE ul END, CASE WHEN uc > 0.05 THEN uh ELSE um END,
    CASE WHEN lc > 0.95 THEN lm ELSE ll END, CASE WHEN lc > 0.95 THEN lh ELSE lm END
  FROM (SELECT *, (ul + uh) / 2 AS um, (ll + lh) / 2 AS lm,
     CASE WHEN k = n THEN 1 ELSE (SELECT {upper} FROM (SELECT (ul + uh) / 2 AS m)) END AS uc,
     CASE WHEN k = 0 THEN 0 ELSE (SELECT {lower} FROM (SELECT (ll + lh) / 2 AS m)) END AS lc FROM {name} WHERE step < 45))"""


def _bounds_select(name: str) -> str:
    return f"(SELECT *, CASE WHEN k = 0 THEN 0 ELSE (ll + lh) / 2 END AS lower, CASE WHEN k = n THEN 1 ELSE (ul + uh) / 2 END AS upper FROM {name} WHERE step = 45)"


@query(
    "d24_exact_bounds",
    "WITH RECURSIVE "
    + with_predictions("", "cnt AS (SELECT workload_class, device_id, count(*) FILTER (label = 1) AS s, count(*) AS t FROM pred GROUP BY ALL)",
        clopper_pearson_sql("s", "t", "cnt", "workload_class, device_id", "bnd"))[5:]
    + f"SELECT workload_class, device_id, k AS successes, n AS total, round(lower, 6) + 0.0::DOUBLE AS lower, round(upper, 6) + 0.0::DOUBLE AS upper FROM {_bounds_select('bnd')}",
)
def d24_exact_bounds(spark, folder):
    counts = predictions(spark, folder).groupBy("workload_class", "device_id").agg(
        F.sum(F.col("label").cast("long")).alias("successes"), F.count(F.lit(1)).alias("total")
    )
    b = counts.withColumn("b", exact_bounds(F.col("successes"), F.col("total")))
    return b.select(
        "workload_class", "device_id", "successes", "total", r(F.col("b.lower")).alias("lower"), r(F.col("b.upper")).alias("upper")
    )


_THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.97]
_CERT_TAIL = f"""SELECT {{keys}}, a.k AS accepted, a.n AS total, e.k AS errors, round(a.lower, 6) + 0.0::DOUBLE AS coverage_lower_bound,
 round(e.upper, 6) + 0.0::DOUBLE AS error_upper_bound, e.upper <= {{me}} AND a.lower >= {{mc}} AS certified
FROM {_bounds_select('cov')} a JOIN {_bounds_select('err')} e USING ({{keys}})"""


@query(
    "d25_selective_risk_certificate",
    "WITH RECURSIVE "
    + with_predictions("", """cnt AS (SELECT workload_class, count(*) AS t, count(*) FILTER (abs(probability - 0.5) * 2 >= 0.3) AS acc,
   count(*) FILTER (abs(probability - 0.5) * 2 >= 0.3 AND (probability >= 0.5) <> (label = 1)) AS er FROM pred GROUP BY ALL)""",
        clopper_pearson_sql("acc", "t", "cnt", "workload_class", "cov"), clopper_pearson_sql("er", "acc", "cnt", "workload_class", "err"))[5:]
    + _CERT_TAIL.format(keys="workload_class", me="0.6", mc="0.5"),
)
def d25_selective_risk_certificate(spark, folder):
    p = F.col("probability")
    inside = F.abs(p - 0.5) * 2 >= 0.3
    counts = predictions(spark, folder).groupBy("workload_class").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(inside).alias("accepted"),
        F.count_if(inside & ((p >= 0.5) != (F.col("label") == 1))).alias("errors"),
    )
    c = V.selective_risk(counts, "errors", "accepted", "total", 0.6, 0.5)
    return c.select(
        "workload_class", "accepted", "total", "errors", r("coverage_lower_bound").alias("coverage_lower_bound"),
        r("error_upper_bound").alias("error_upper_bound"), "certified",
    )


@query(
    "d26_risk_coverage_report",
    "WITH RECURSIVE "
    + with_predictions("", f"""cnt AS (SELECT threshold, count(*) AS t, count(*) FILTER (probability >= threshold OR probability <= 1 - threshold) AS acc,
   count(*) FILTER ((probability >= threshold OR probability <= 1 - threshold) AND (probability >= 0.5) <> (label = 1)) AS er
   FROM pred, (SELECT unnest({_THRESHOLDS})::DOUBLE AS threshold) GROUP BY ALL)""",
        clopper_pearson_sql("acc", "t", "cnt", "threshold", "cov"), clopper_pearson_sql("er", "acc", "cnt", "threshold", "err"))[5:]
    + _CERT_TAIL.format(keys="threshold", me="0.10", mc="0.50"),
)
def d26_risk_coverage_report(spark, folder):
    c = V.risk_coverage_report(predictions(spark, folder), "label", "probability", _THRESHOLDS)
    return c.select(
        "threshold", "accepted", "total", "errors", r("coverage_lower_bound").alias("coverage_lower_bound"),
        r("error_upper_bound").alias("error_upper_bound"), "certified",
    )


_CERT_COUNTS = """
e AS (SELECT d.lang AS slice, l.doc_id % 5 <> 0 AS el, l.doc_id % 6 <> 0 AS ac, quality = 1 AS ok, l.doc_id % 3 = 0 AS cr,
   l.doc_id % 3 = 0 AND l.doc_id % 8 <> 0 AS cd, l.doc_id % 4 <> 0 AS act, toxic = 1 AS harm, l.doc_id % 9 = 0 AS rb
  FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT CASE WHEN grouping(slice) = 1 THEN 'global' ELSE slice END AS support_slice, count(*) FILTER (el) AS eligible_episodes,
  count(*) FILTER (el AND ac) AS resolved_episodes, count(*) FILTER (el AND ac AND ok) AS correct_outcomes, count(*) FILTER (el AND cr) AS critical_events,
  count(*) FILTER (el AND cd) AS critical_detected, count(*) FILTER (act) AS committed_actions, count(*) FILTER (act AND harm) AS severe_harmful_actions,
  count(*) FILTER (rb) AS rollback_attempts FROM e GROUP BY ROLLUP (slice))"""


@query(
    "d27_slice_certification",
    "WITH RECURSIVE "
    + _CERT_COUNTS.strip()
    + ", " + clopper_pearson_sql("correct_outcomes", "resolved_episodes", "s", "support_slice", "c1")
    + ", " + clopper_pearson_sql("resolved_episodes", "eligible_episodes", "s", "support_slice", "c2")
    + ", " + clopper_pearson_sql("critical_detected", "critical_events", "s", "support_slice", "c3")
    + ", " + clopper_pearson_sql("severe_harmful_actions", "committed_actions", "s", "support_slice", "c4")
    + f"""SELECT * EXCLUDE (l1, l2, l3, u4), round(l1, 6) + 0.0::DOUBLE AS correct_lower_bound, round(l2, 6) + 0.0::DOUBLE AS coverage_lower_bound,
 round(l3, 6) + 0.0::DOUBLE AS critical_recall_lower_bound, round(u4, 6) + 0.0::DOUBLE AS severe_harm_upper_bound,
 concat_ws(',', CASE WHEN eligible_episodes = 0 THEN 'no_eligible_episodes' END, CASE WHEN resolved_episodes = 0 THEN 'no_resolved_episodes' WHEN l1 < 0.99 THEN 'correct_outcome_lower_bound_failed' END,
  CASE WHEN eligible_episodes > 0 AND l2 < 0.70 THEN 'coverage_lower_bound_failed' END, CASE WHEN critical_events = 0 THEN 'no_critical_user_impact_episodes' WHEN l3 < 0.97 THEN 'critical_recall_lower_bound_failed' END,
  CASE WHEN committed_actions = 0 THEN 'no_committed_action_evidence' WHEN u4 >= 0.001 THEN 'severe_harm_upper_bound_failed' END, CASE WHEN rollback_attempts = 0 THEN 'no_injected_rollback_evidence' END) AS failures,
 'NOT_CERTIFIED' AS status FROM (SELECT s.*, coalesce(x1.lower, 0) AS l1, coalesce(x2.lower, 0) AS l2, coalesce(x3.lower, 0) AS l3, coalesce(x4.upper, 1) AS u4
FROM s LEFT JOIN {_bounds_select('c1')} x1 USING (support_slice) LEFT JOIN {_bounds_select('c2')} x2 USING (support_slice)
 LEFT JOIN {_bounds_select('c3')} x3 USING (support_slice) LEFT JOIN {_bounds_select('c4')} x4 USING (support_slice))""",
)
def d27_slice_certification(spark, folder):
    report = V.certify_slices(certification_episodes(spark, folder))
    bounds = ("correct_lower_bound", "coverage_lower_bound", "critical_recall_lower_bound", "severe_harm_upper_bound")
    return report.select(
        "support_slice", "eligible_episodes", "resolved_episodes", "correct_outcomes", "critical_events", "critical_detected",
        "committed_actions", "severe_harmful_actions", "rollback_attempts", *[r(b).alias(b) for b in bounds],
        F.array_join("failures", ",").alias("failures"), "status",
    )


@query(
    "d28_certification_status",
    "WITH " + _CERT_COUNTS.strip() + " SELECT false AS certified, count(*) AS failing_rows, count(*) AS rows, 'NOT_CERTIFIED' AS status FROM s",
)
def d28_certification_status(spark, folder):
    return V.certification_status(V.certify_slices(certification_episodes(spark, folder)))


@query(
    "d28_certified_slices",
    """SELECT coalesce(o_orderstatus, 'global') AS support_slice, count(*) AS episodes, CASE WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 AND power(0.05, 1.0 / count(*)) >= 0.99 AND power(0.05, 1.0 / count(*) FILTER (o_orderkey % 4 = 0)) >= 0.97
 AND 1 - power(0.05, 1.0 / count(*)) < 0.001 THEN 'CERTIFIED_AUTOMATIC' ELSE 'NOT_CERTIFIED' END AS status FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())""",
)
def d28_certified_slices(spark, folder):
    """Orders as faultless episodes: slices are certified once they are large, but for the one without rollbacks.

    Without a fault the exact bounds have a closed form, which the SQL uses.
    """
    yes, critical = F.lit(True), F.col("o_orderkey") % 4 == 0
    episodes = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("episode_id"), F.lit("MEASURED_QOE").alias("label_provenance"), F.col("o_orderstatus").alias("support_slice"),
        yes.alias("eligible"), yes.alias("accepted"), yes.alias("correct"), critical.alias("critical_event"), critical.alias("critical_detected"),
        yes.alias("committed_action"), F.lit(False).alias("severe_harm"), (F.col("o_orderstatus") != "O").alias("rollback_attempted"),
        (F.col("o_orderstatus") != "O").alias("rollback_succeeded"), F.lit(False).alias("protected_policy_violation"),
    )
    return V.certify_slices(episodes).select("support_slice", F.col("eligible_episodes").alias("episodes"), "status")


# -- multiclass and readiness ---------------------------------------------------------------

_PAIRS = """
act AS (SELECT device_id, seq, CASE WHEN n_future = 5 THEN {label} END AS actual,
   CASE WHEN p >= 82 THEN 'CRITICAL' WHEN p >= 58 THEN 'WARNING' WHEN seq % 9 = 0 THEN 'RECOVERY' ELSE 'NORMAL' END AS predicted
  FROM (SELECT fut.*, prs.p FROM fut JOIN prs USING (device_id, seq)) WHERE n_future = 5)"""
_PAIR_CTES = (*_LABEL_CTES, _PAIRS.format(label=_label_sql()))


def labelled_pairs(spark, folder):
    """Future label against a rule on the current pressure."""
    rows = W.future_labels(telemetry(spark, folder), KEY, ORDER).withColumn("p", S.pressure("cpu", "mem", "disk"))
    predicted = (
        F.when(F.col("p") >= 82, "CRITICAL").when(F.col("p") >= 58, "WARNING").when(F.col("seq") % 9 == 0, "RECOVERY").otherwise("NORMAL")
    )
    return rows.select(F.col("label").alias("actual"), predicted.alias("predicted"))


@query(
    "d29_multiclass_report",
    with_telemetry(
        """SELECT class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(g) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits,
 round(CASE WHEN sum(g) = 0 THEN 0 ELSE sum(h) / sum(g) END, 6) + 0 AS precision, round(CASE WHEN sum(s) = 0 THEN 0 ELSE sum(h) / sum(s) END, 6) + 0 AS recall
FROM (SELECT actual AS class, 1 AS s, 0 AS g, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS h FROM act
 UNION ALL SELECT predicted, 0, 1, 0 FROM act) GROUP BY class""",
        *_PAIR_CTES,
    ),
)
def d29_multiclass_report(spark, folder):
    m = V.multiclass_report(V.confusion_matrix(labelled_pairs(spark, folder), "actual", "predicted"))
    return m.select("class", "support", "predicted", "hits", r("precision").alias("precision"), r("recall").alias("recall"))


@query(
    "d29_multiclass_totals",
    with_telemetry(
        """SELECT count(*) AS rows, round(count(*) FILTER (a = p) / count(*), 6) AS accuracy, count(*) FILTER (p > a AND p >= 1) AS false_positives,
 count(*) FILTER (p < a AND a >= 1) AS false_negatives, count(*) FILTER (p % 3 > a % 3) AS over_severe, count(*) FILTER (p % 3 < a % 3) AS under_severe
FROM (SELECT list_position(['NORMAL', 'WARNING', 'CRITICAL', 'RECOVERY'], actual) - 1 AS a, list_position(['NORMAL', 'WARNING', 'CRITICAL', 'RECOVERY'], predicted) - 1 AS p FROM act)""",
        *_PAIR_CTES,
    ),
)
def d29_multiclass_totals(spark, folder):
    m = V.multiclass_totals(V.confusion_matrix(labelled_pairs(spark, folder), "actual", "predicted"))
    return m.select("rows", r("accuracy").alias("accuracy"), "false_positives", "false_negatives", "over_severe", "under_severe")


@query(
    "d30_readiness",
    with_telemetry(
        """SELECT CAST(sum(s) AS BIGINT) AS samples, CASE WHEN count(*) FILTER (s < need) + count(*) FILTER (rec < low) + CASE WHEN sum(s) < 1000 THEN 1 ELSE 0 END = 0
  THEN 'production_candidate' ELSE 'research_only' END AS status,
 concat_ws(',', CASE WHEN sum(s) < 1000 THEN 'samples' END, string_agg(CASE WHEN s < need THEN class || '_rows' END, ',' ORDER BY place),
  string_agg(CASE WHEN rec < low THEN class || '_recall' END, ',' ORDER BY place)) AS blockers,
 coalesce(string_agg(CASE WHEN rec < want THEN class || '_recall' END, ',' ORDER BY place), '') AS warnings
FROM (SELECT class, place, need, low, want, coalesce(s, 0) AS s, coalesce(h / s, 0) AS rec FROM
  (VALUES ('NORMAL', 0, 300, NULL, 0.8), ('WARNING', 1, 300, NULL, 0.8), ('CRITICAL', 2, 150, 0.85, NULL), ('RECOVERY', 3, 150, 0.75, NULL)) v(class, place, need, low, want)
  LEFT JOIN (SELECT actual, count(*) AS s, count(*) FILTER (actual = predicted) AS h FROM act GROUP BY actual) a ON a.actual = v.class)""",
        *_PAIR_CTES,
    ),
)
def d30_readiness(spark, folder):
    report = V.multiclass_report(V.confusion_matrix(labelled_pairs(spark, folder), "actual", "predicted"))
    out = V.readiness(report.select("class", F.col("support").alias("rows")), report.select("class", "recall"))
    return out.select("samples", "status", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"))


# -- calibration, conformal, drift ----------------------------------------------------------

_CLIP6 = "least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, {}))"
_Z = f"ln({_CLIP6.format('probability')} / (1 - {_CLIP6.format('probability')}))"


def _grid_sql() -> str:
    q = _CLIP6.format("1 / (1 + exp(-z / t))")
    return f"""grd AS (SELECT t, avg(-(label * ln({q}) + (1 - label) * ln(1 - {q}))) AS loss
 FROM (SELECT label, {_Z} AS z FROM pred), (SELECT s / 100 AS t FROM range(10, 401) AS x(s)) GROUP BY t)"""


@query(
    "d39_fit_temperature",
    with_predictions("SELECT arg_min(t, loss) AS temperature, round(min(loss), 6) AS log_loss FROM grd", _grid_sql()),
)
def d39_fit_temperature(spark, folder):
    scores = C.distinct_scores(predictions(spark, folder), "label", "probability")
    return C.fit_temperature(scores).select("temperature", r("log_loss").alias("log_loss"))


_DESCENT = f"""
cmp AS (SELECT {_Z} AS z, count(*)::DOUBLE AS w, sum(label)::DOUBLE AS y FROM pred GROUP BY ALL),
gd AS (SELECT 0 AS step, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b
 UNION ALL SELECT step + 1, a - 0.05 * (SELECT sum((w / (1 + exp(-(a * z + b))) - y) * z) / sum(w) FROM cmp),
   b - 0.05 * (SELECT sum(w / (1 + exp(-(a * z + b))) - y) / sum(w) FROM cmp) FROM gd WHERE step < 500)"""


@query(
    "d40_fit_sigmoid",
    "WITH RECURSIVE " + with_predictions("", _DESCENT)[5:] + "SELECT round(a, 6) + 0 AS a, round(b, 6) + 0 AS b FROM gd WHERE step = 500",
)
def d40_fit_sigmoid(spark, folder):
    options = C.select_calibrator(predictions(spark, folder), "label", "probability")
    return options.where(F.col("method") == "sigmoid").select(r("a").alias("a"), r("b").alias("b"))


_OPTIONS = f"""opt AS (
  SELECT 0 AS place, 'identity' AS method, avg(-(label * ln({_CLIP6.format('probability')}) + (1 - label) * ln(1 - {_CLIP6.format('probability')}))) AS loss FROM pred
  UNION ALL SELECT 1, 'temperature', min(loss) FROM grd
  UNION ALL SELECT 2, 'sigmoid', sum(-(y * ln(q) + (w - y) * ln(1 - q))) / sum(w) FROM (SELECT *, {_CLIP6.format('1 / (1 + exp(-(a * z + b)))')} AS q FROM cmp, gd WHERE step = 500))"""


@query(
    "d41_select_calibrator",
    "WITH RECURSIVE "
    + with_predictions("", _DESCENT, _grid_sql(), _OPTIONS)[5:]
    + "SELECT method, round(loss, 6) AS log_loss, place = (SELECT arg_min(place, (loss, place)) FROM opt) AS chosen FROM opt",
)
def d41_select_calibrator(spark, folder):
    options = C.select_calibrator(predictions(spark, folder), "label", "probability")
    return options.select("method", r("log_loss").alias("log_loss"), "chosen")


@query(
    "d41_calibrated",
    "WITH RECURSIVE "
    + with_predictions("", _DESCENT, _grid_sql(), _OPTIONS)[5:]
    + f"""SELECT label, count(*) AS n, round(avg(CASE place WHEN 0 THEN {_CLIP6.format('probability')} WHEN 1 THEN {_CLIP6.format('1 / (1 + exp(-z / t))')}
  ELSE {_CLIP6.format('1 / (1 + exp(-(a * z + b)))')} END), 6) AS calibrated FROM (SELECT *, {_Z} AS z FROM pred), (SELECT arg_min(place, (loss, place)) AS place FROM opt),
 (SELECT arg_min(t, loss) AS t FROM grd), (SELECT a, b FROM gd WHERE step = 500) GROUP BY label""",
)
def d41_calibrated(spark, folder):
    """The chosen calibrator applied to all predictions."""
    pred = predictions(spark, folder)
    done = C.apply_calibrator(pred, "probability", C.select_calibrator(pred, "label", "probability"))
    return done.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("calibrated")).alias("calibrated"))


@query(
    "d42_conformal_sets",
    with_predictions(
        """SELECT threshold, CASE WHEN (p <= threshold) = (1 - p <= threshold) THEN '0,1' WHEN p <= threshold THEN '0' ELSE '1' END AS labels,
 (p <= threshold) = (1 - p <= threshold) AS abstain, count(*) AS rows
FROM (SELECT probability AS p FROM pred), (SELECT score AS threshold FROM scr, (SELECT count(*) AS n FROM scr)
  WHERE i = least(n, greatest(1, CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT)))) GROUP BY ALL""",
        "scr AS (SELECT CASE WHEN label = 1 THEN 1.0 - probability ELSE probability END AS score, row_number() OVER (ORDER BY CASE WHEN label = 1 THEN 1.0 - probability ELSE probability END) AS i FROM pred)",
    ),
)
def d42_conformal_sets(spark, folder):
    pred = predictions(spark, folder)
    threshold = C.conformal_threshold(pred, "label", "probability").first()["threshold"]
    chosen = pred.withColumn("s", C.conformal_set(F.col("probability"), F.lit(threshold)))
    return chosen.groupBy(
        F.lit(threshold).alias("threshold"), F.array_join("s.labels", ",").alias("labels"), F.col("s.abstain").alias("abstain")
    ).agg(F.count(F.lit(1)).alias("rows"))


_DRIFT_FEATURES = ("cpu", "mem", "net")


@query(
    "d43_drift_levels",
    with_telemetry(
        """SELECT device_id, round(shift, 4) + 0 AS normalized_shift, round(dropped, 6) + 0 AS coverage_drop,
 CASE WHEN shift >= 6 OR dropped >= 0.3 THEN 'CERTIFICATE_INVALID' WHEN shift >= 4 OR dropped >= 0.2 THEN 'DETERMINISTIC_MONITOR_ONLY'
  WHEN shift >= 2.5 OR dropped >= 0.1 THEN 'RECOMMENDATION_ONLY' WHEN shift >= 1.5 OR dropped >= 0.05 THEN 'COLLECT_MORE_EVIDENCE' ELSE 'NORMAL' END AS level
FROM (SELECT device_id, (abs(c - gc) / greatest(sc, 1e-6) + abs(m - gm) / greatest(sm, 1e-6) + abs(x - gx) / greatest(sx, 1e-6)) / 3 AS shift, greatest(0, 0.9 - cov) AS dropped
 FROM (SELECT device_id, avg(cpu) AS c, avg(mem) AS m, avg(net) AS x, count(*) FILTER (mem < 85) / count(*) AS cov FROM tel GROUP BY device_id),
  (SELECT avg(cpu) AS gc, avg(mem) AS gm, avg(net) AS gx, stddev_pop(cpu) / 10 AS sc, stddev_pop(mem) / 10 AS sm, stddev_pop(net) / 10 AS sx FROM tel))"""
    ),
)
def d43_drift_levels(spark, folder):
    """Device means against fleet means, with a tenth of the fleet spread as scale."""
    tel = telemetry(spark, folder)
    fleet = tel.agg(
        *[F.avg(c).alias(f"m_{c}") for c in _DRIFT_FEATURES], *[(F.stddev_pop(c) / 10).alias(f"s_{c}") for c in _DRIFT_FEATURES]
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("scale")) for c in _DRIFT_FEATURES]
    )
    reference = fleet.select(F.explode(entries).alias("e")).select("e.*")
    devices = tel.groupBy("device_id").agg(
        *[F.avg(c).alias(c) for c in _DRIFT_FEATURES], (F.count_if(F.col("mem") < 85) / F.count(F.lit(1))).alias("coverage")
    )
    now = C.unpivot(devices, ["device_id", "coverage"], _DRIFT_FEATURES).withColumnRenamed("value", "mean")
    rows = C.drift(reference, now, ["device_id", "coverage"], F.lit(0.9), F.col("coverage"))
    return rows.select("device_id", r("normalized_shift", 4).alias("normalized_shift"), r("coverage_drop").alias("coverage_drop"), "level")


@query(
    "d44_ood_scores",
    with_telemetry(
        """SELECT device_id, seq, round(score, 6) + 0 AS ood_score, score <= 0.25 AND len(reasons) = 0 AS ood_accepted, array_to_string(reasons, ',') AS ood_reasons
FROM (SELECT device_id, seq, least(1, 0.5 * (least(1, abs(cpu - 50) / 180) + CASE WHEN bad THEN 0 ELSE least(1, abs(mem - 50) / 240) END) / CASE WHEN bad THEN 1 ELSE 2 END
   + 0.2 * least(1, mf) + 0.2 * least(1, dg) + CASE WHEN ok THEN 0 ELSE 0.1 END) AS score,
  list_filter([CASE WHEN bad THEN 'missing_or_invalid:memory' END, CASE WHEN mf > 0.1 THEN 'missingness' END, CASE WHEN dg > 0.2 THEN 'model_disagreement' END,
   CASE WHEN NOT ok THEN 'outside_support_envelope' END], lambda x: x IS NOT NULL) AS reasons
 FROM (SELECT *, seq % 19 = 0 AS bad, seq % 13 / 100 AS mf, seq % 23 / 100 AS dg, phase <> 'error' AS ok FROM tel))"""
    ),
)
def d44_ood_scores(spark, folder):
    tel = telemetry(spark, folder).withColumn("memory", F.when(F.col("seq") % 19 != 0, F.col("mem")))
    rows = C.ood_scores(
        tel, {"cpu": (50.0, 30.0), "memory": (50.0, 40.0)}, F.col("seq") % 13 / 100, F.col("seq") % 23 / 100, F.col("phase") != "error"
    )
    return rows.select("device_id", "seq", r("ood_score").alias("ood_score"), "ood_accepted", F.array_join("ood_reasons", ",").alias("ood_reasons"))


@query(
    "d45_baseline_predictions",
    with_telemetry(
        f"""SELECT count(*) AS rows, round(avg(rate), 6) AS event_rate, count(*) FILTER (score >= 0.7) AS rule_events, round(avg(score), 6) AS mean_rule_score,
 count(*) FILTER (coalesce(prev, rate) >= 0.5) AS persistence_events, count(*) FILTER ((coalesce(prev, rate) >= 0.5) = (event = 1)) AS persistence_hits
FROM (SELECT *, lag(event) OVER ({OVER}) AS prev, avg(event) OVER () AS rate,
   least(1, greatest(0, 0.45 * cpu / 100 + 0.45 * mem / 100 + 0.10 * (100 - disk) / 100)) AS score
 FROM (SELECT *, CASE WHEN phase = 'error' THEN 1 ELSE 0 END AS event FROM tel))"""
    ),
)
def d45_baseline_predictions(spark, folder):
    """Majority rate, resource rule and persistence on the error events."""
    from pulsefleet.operators.ordered import Ordered

    tel = telemetry(spark, folder).withColumn("event", F.when(F.col("phase") == "error", 1).otherwise(0))
    rate = V.majority_rate(tel, "event").first()["event_rate"]
    seq = Ordered(tel, KEY, ORDER, before=1)
    seq.with_columns({"previous": F.lag("event").over(seq.window)})
    rows = seq.result().withColumns(
        {
            "score": V.resource_rule(F.col("cpu"), F.col("mem"), F.col("disk")),
            "persisted": F.coalesce(F.col("previous").cast("double"), F.lit(rate)) >= 0.5,
        }
    )
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        r(F.lit(rate)).alias("event_rate"),
        F.count_if(F.col("score") >= 0.70).alias("rule_events"),
        r(F.avg("score")).alias("mean_rule_score"),
        F.count_if("persisted").alias("persistence_events"),
        F.count_if(F.col("persisted") == (F.col("event") == 1)).alias("persistence_hits"),
    )


@query(
    "d45_event_ewma",
    with_telemetry(
        """SELECT device_id, round(least(1, greatest(0, sum(event * power(0.7, total - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END))), 6) + 0 AS probability FROM ewm GROUP BY device_id""",
        f"ewm AS (SELECT device_id, CASE WHEN phase = 'error' THEN 1.0::DOUBLE ELSE 0 END AS event, row_number() OVER ({OVER}) AS i, count(*) OVER (PARTITION BY device_id) AS total FROM tel)",
    ),
)
def d45_event_ewma(spark, folder):
    tel = telemetry(spark, folder).withColumn("event", F.when(F.col("phase") == "error", 1.0).otherwise(0.0))
    return W.ewma_last(tel, KEY, ORDER, "event", 0.3).select("device_id", r(S.clamp(F.col("ewma"), 0.0, 1.0)).alias("probability"))


# -- benchmark runs -------------------------------------------------------------------------

_VARIANT = {"N": "windows_baseline", "A": "subject_optimizer", "R": "process_lasso"}


def bench_samples(spark, folder):
    """One measured value per order line. The flag is the variant, the status the scenario."""
    flag = F.col("l_returnflag")
    factor = F.when(flag == "A", 0.4).when(flag == "R", 0.9).otherwise(1.0)
    return table(spark, folder, "lineitem").select(
        F.lit("lab").alias("device_id"),
        F.when(F.col("l_linestatus") == "O", "coding").otherwise("gaming").alias("scenario"),
        F.when(F.col("l_linenumber") <= 3, "cold").otherwise("warm").alias("run_type"),
        F.lit("latency").alias("metric"),
        S.by_value(flag, _VARIANT, "razer_cortex").alias("variant"),
        (F.col("l_orderkey") % 12).alias("iteration"),
        F.concat_ws("-", "l_returnflag", "l_linestatus", (F.col("l_orderkey") % 12).cast("string"), (F.col("l_linenumber") <= 3).cast("string")).alias("run_id"),
        F.lit("ms").alias("unit"),
        F.lit("lower").alias("direction"),
        (F.col("l_extendedprice") * factor).alias("sample"),
        F.when((flag == "R") & (F.col("l_quantity") >= 50), 1).otherwise(0).alias("crashes"),
        (F.col("l_discount") * 10).alias("cpu"),
        (F.col("l_tax") * 500).alias("memory"),
    )


def bench_runs(spark, folder):
    """One row per run and metric."""
    run = [*B.GROUP, "variant", "run_id", "iteration"]
    place = F.when(F.col("variant") == "windows_baseline", F.col("iteration") % 3).otherwise((F.col("iteration") + 1) % 3) + 1
    return (
        bench_samples(spark, folder)
        .groupBy(*run)
        .agg(
            F.max("crashes").alias("crashes"),
            F.sum("cpu").alias("cpu_sum"),
            F.count("cpu").alias("cpu_n"),
            F.sum("memory").alias("memory_sum"),
            F.count("memory").alias("memory_n"),
        )
        .select(
            "*",
            place.alias("order_index"),
            F.lit("").alias("notes"),
            *[F.lit(0).alias(c) for c in ("app_reloads", "user_apps_touched", "rollback_failures")],
            F.lit("26200").alias("os_build"),
            F.lit("AC").alias("power_mode"),
            F.lit("COOL").alias("thermal_state"),
        )
    )


BENCH = """
smp AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'coding' ELSE 'gaming' END AS scenario, CASE WHEN l_linenumber <= 3 THEN 'cold' ELSE 'warm' END AS run_type,
  CASE l_returnflag WHEN 'N' THEN 'windows_baseline' WHEN 'A' THEN 'subject_optimizer' ELSE 'process_lasso' END AS variant, l_orderkey % 12 AS iteration,
  l_extendedprice * CASE l_returnflag WHEN 'A' THEN 0.4::DOUBLE WHEN 'R' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS sample,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN 1 ELSE 0 END AS crashes, l_discount * 10 AS cpu, l_tax * 500 AS memory FROM lineitem)"""
RUN_P95 = "p95 AS (SELECT scenario, run_type, variant, iteration, quantile_cont(sample, 0.95) AS p95 FROM smp GROUP BY ALL)"
PAIRS = """prs AS (SELECT c.scenario, c.run_type, c.variant, c.iteration, b.p95 AS bp, c.p95 AS cp FROM p95 c JOIN p95 b
  ON b.variant = 'windows_baseline' AND c.variant <> 'windows_baseline' AND b.scenario = c.scenario AND b.run_type = c.run_type AND b.iteration = c.iteration)"""
_BENCH_KEYS = ["scenario", "run_type", "variant"]


@query(
    "d11_distribution_summary",
    f"""WITH {BENCH} SELECT scenario, run_type, variant, count(*) AS count, round(quantile_cont(sample, 0.5), 4) AS median, round(quantile_cont(sample, 0.95), 4) AS p95,
 round(quantile_cont(sample, 0.99), 4) AS p99, round(avg(sample), 4) AS mean FROM smp GROUP BY ALL""",
)
def d11_distribution_summary(spark, folder):
    rows = B.summarize(bench_samples(spark, folder), [*B.GROUP, "variant"])
    return rows.select(*_BENCH_KEYS, "count", *[r(c, 4).alias(c) for c in ("median", "p95", "p99", "mean")])


@query(
    "d12_run_p95",
    f"WITH {BENCH}, {RUN_P95} SELECT scenario, run_type, variant, iteration, round(p95, 6) AS p95 FROM p95",
)
def d12_run_p95(spark, folder):
    return B.run_p95(bench_samples(spark, folder)).select(*_BENCH_KEYS, "iteration", r("p95").alias("p95"))


_GAIN = "CASE WHEN {b} = 0 THEN 0 ELSE ({b} - {c}) / abs({b}) END"


@query(
    "d13_relative_improvement",
    f"WITH {BENCH}, {RUN_P95}, {PAIRS} SELECT scenario, run_type, variant, iteration, round({_GAIN.format(b='bp', c='cp')}, 6) + 0 AS improvement FROM prs",
)
def d13_relative_improvement(spark, folder):
    """Paired by iteration within a group (also the pairing join)."""
    pairs = B.pair_runs(B.run_p95(bench_samples(spark, folder)))
    gain = S.relative_improvement("baseline_p95", "candidate_p95", F.lit("lower"))
    return pairs.select(*_BENCH_KEYS, "iteration", r(gain).alias("improvement"))


BOOT = f"""
num AS (SELECT *, row_number() OVER g - 1 AS i, count(*) OVER (PARTITION BY scenario, run_type, variant) AS n FROM prs
  WINDOW g AS (PARTITION BY scenario, run_type, variant ORDER BY iteration)),
drw AS (SELECT scenario, run_type, variant, rep, CAST('0x' || substr(md5('20260711:' || rep || ':' || i), 1, 8) AS BIGINT) % n AS i FROM num, range(0, 2000) AS s(rep)),
rpl AS (SELECT scenario, run_type, variant, rep, avg(bp) AS b, avg(cp) AS c FROM drw JOIN num USING (scenario, run_type, variant, i) GROUP BY ALL),
ci AS (SELECT scenario, run_type, variant, quantile_cont({_GAIN.format(b='b', c='c')}, 0.025) AS ci_low, quantile_cont({_GAIN.format(b='b', c='c')}, 0.975) AS ci_high FROM rpl GROUP BY ALL)"""


@query(
    "d14_bootstrap_interval",
    f"WITH {BENCH}, {RUN_P95}, {PAIRS}, {BOOT} SELECT scenario, run_type, variant, round(ci_low, 6) + 0 AS ci_low, round(ci_high, 6) + 0 AS ci_high FROM ci",
)
def d14_bootstrap_interval(spark, folder):
    pairs = B.pair_runs(B.run_p95(bench_samples(spark, folder)))
    ci = B.bootstrap_interval(pairs, [*B.GROUP, "variant"], F.lit("lower"), 20260711)
    return ci.select(*_BENCH_KEYS, r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"))


GATES = """
gat AS (SELECT c.scenario, c.run_type, c.variant, c.runs >= 10 AND b.runs >= 10 AS minimum_runs, p.paired AS paired_runs, c.crashes = 0 AS zero_safety_regressions,
  c.cpu <= 1 AS cpu_ok, c.memory <= 60 AS memory_ok FROM
 (SELECT scenario, run_type, variant, count(DISTINCT iteration) AS runs, max(crashes) AS crashes, avg(cpu) AS cpu, avg(memory) AS memory FROM smp GROUP BY ALL) c
 JOIN (SELECT scenario, run_type, count(DISTINCT iteration) AS runs FROM smp WHERE variant = 'windows_baseline' GROUP BY ALL) b USING (scenario, run_type)
 JOIN (SELECT scenario, run_type, variant, count(*) AS paired FROM prs GROUP BY ALL) p ON p.scenario = c.scenario AND p.run_type = c.run_type AND p.variant = c.variant)"""


@query(
    "d15_quality_gates",
    f"""WITH {BENCH}, {RUN_P95}, {PAIRS}, {GATES} SELECT scenario, run_type, variant, paired_runs, minimum_runs, paired_runs >= 10 AS paired_randomized_runs,
 paired_runs = 12 AS order_randomized, true AS environment_consistent, true AS non_synthetic_data, zero_safety_regressions,
 cpu_ok AS cpu_overhead_within_1_percent, memory_ok AS memory_overhead_within_60_mb,
 minimum_runs AND paired_runs = 12 AND zero_safety_regressions AND cpu_ok AND memory_ok AS passed FROM gat""",
)
def d15_quality_gates(spark, folder):
    rows = B.quality_gates(bench_runs(spark, folder))
    return rows.select(
        *_BENCH_KEYS, "paired_runs", "minimum_runs", "paired_randomized_runs", "order_randomized", "environment_consistent",
        "non_synthetic_data", "zero_safety_regressions", "cpu_overhead_within_1_percent", "memory_overhead_within_60_mb", "passed",
    )


@query(
    "d16_comparison_report",
    f"""WITH {BENCH}, {RUN_P95}, {PAIRS}, {BOOT}, {GATES},
dst AS (SELECT scenario, run_type, variant, count(*) AS n, quantile_cont(sample, 0.95) AS p FROM smp GROUP BY ALL)
SELECT c.scenario, c.run_type, c.variant, b.n AS baseline_count, c.n AS candidate_count, round({_GAIN.format(b='b.p', c='c.p')}, 6) + 0 AS p95_improvement,
 round(ci_low, 6) + 0 AS ci_low,
 CASE WHEN NOT (minimum_runs AND paired_runs = 12 AND zero_safety_regressions AND cpu_ok AND memory_ok AND ci_low > 0) THEN 'NO_CLAIM'
  WHEN {_GAIN.format(b='b.p', c='c.p')} >= 0.5 THEN 'QUALIFIED_2X_RESPONSIVENESS' ELSE 'QUALIFIED_IMPROVEMENT' END AS claim_status
FROM dst c JOIN dst b ON b.variant = 'windows_baseline' AND c.variant <> 'windows_baseline' AND b.scenario = c.scenario AND b.run_type = c.run_type
JOIN ci ON ci.scenario = c.scenario AND ci.run_type = c.run_type AND ci.variant = c.variant
JOIN gat ON gat.scenario = c.scenario AND gat.run_type = c.run_type AND gat.variant = c.variant""",
)
def d16_comparison_report(spark, folder):
    """Baseline group against every other variant, with claim status; no comparison is dropped."""
    rows = B.comparison_report(bench_samples(spark, folder), bench_runs(spark, folder))
    return rows.select(
        *_BENCH_KEYS, "baseline_count", "candidate_count", r("p95_improvement").alias("p95_improvement"), r("ci_low").alias("ci_low"), "claim_status"
    )


def bench_records(spark, folder):
    """Benchmark run records, one per supplier and order line number, with planted defects.

    The sample lists hold three numbers each, whatever the table size.
    """
    key = F.col("l_orderkey") % 40
    number = lambda c: F.array(F.min(c), F.avg(c), F.max(c))
    runs = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        number("l_extendedprice").alias("latency"), number("l_quantity").alias("rate"), F.min("l_discount").alias("cpu"), F.min(key).alias("k")
    )
    k = F.col("l_suppkey") * 7 + F.col("l_linenumber")
    known = F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (k % 5 + 1).cast("int"))
    return runs.select(
        F.when(k % 31 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(k % 37 == 0, " ").otherwise(F.concat_ws("-", F.col("l_suppkey"), F.col("l_linenumber"))).alias("run_id"),
        F.lit("lab").alias("device_id"),
        F.when(k % 41 == 0, "cooking").otherwise(known).alias("scenario"),
        F.when(k % 2 == 0, "windows_baseline").otherwise("subject_optimizer").alias("variant"),
        F.when(k % 3 == 0, "cold").otherwise("warm").alias("run_type"),
        F.when(k % 43 == 0, -1).otherwise((k % 10).cast("int")).alias("iteration"),
        F.lit(1).alias("order_index"),
        F.create_map(
            F.lit("latency"),
            F.struct(F.lit("ms").alias("unit"), F.lit("lower").alias("direction"), F.when(k % 47 == 0, F.array().cast("array<double>")).otherwise(F.col("latency")).alias("samples")),
            F.lit("rate"),
            F.struct(F.lit("1/s").alias("unit"), F.when(k % 53 == 0, "sideways").otherwise("higher").alias("direction"), F.col("rate").alias("samples")),
        ).alias("metrics"),
        F.struct(
            F.array("cpu").alias("cpu_percent_samples"), F.array("cpu").alias("memory_mb_samples"),
            F.array(F.when(k % 59 == 0, F.lit(float("nan"))).otherwise(F.col("cpu"))).alias("disk_write_kbps_samples"),
        ).alias("optimizer_overhead"),
        F.struct(
            F.when(k % 61 == 0, -1).otherwise(0).alias("crashes"), F.lit(0).alias("app_reloads"), F.lit(0).alias("user_apps_touched"), F.lit(0).alias("rollback_failures")
        ).alias("safety"),
    )


_RECORD = "(SELECT DISTINCT l_suppkey, l_linenumber, l_suppkey * 7 + l_linenumber AS k FROM lineitem)"


@query(
    "b4_benchmark_contract",
    " UNION ALL ".join(
        f"SELECT '{code}' AS error, count(*) AS runs FROM {_RECORD} WHERE k % {m} = 0 HAVING count(*) > 0"
        for code, m in {
            "schema_version": 31, "run_id": 37, "unknown_scenario": 41, "iteration": 43, "metric_samples": 47,
            "metric_direction": 53, "overhead_disk_write_kbps_samples": 59, "negative_crashes": 61,
        }.items()
    ),
)
def b4_benchmark_contract(spark, folder):
    bad = quarantined_rows(with_errors(bench_records(spark, folder), benchmark_rules()))
    return bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "a4_metric_rows",
    """SELECT metric, unit, count(*) AS runs, CAST(sum(n) AS BIGINT) AS samples, round(sum(t), 3) AS total FROM (
 SELECT 'latency' AS metric, 'ms' AS unit, CASE WHEN k % 47 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN k % 47 = 0 THEN 0 ELSE a END AS t FROM r
 UNION ALL SELECT 'rate', '1/s', 3, b FROM r) GROUP BY ALL""".replace(
        " FROM r\n", " FROM (SELECT l_suppkey * 7 + l_linenumber AS k, min(l_extendedprice) + avg(l_extendedprice) + max(l_extendedprice) AS a FROM lineitem GROUP BY l_suppkey, l_linenumber)\n"
    ).replace(" b FROM r)", " b FROM (SELECT min(l_quantity) + avg(l_quantity) + max(l_quantity) AS b FROM lineitem GROUP BY l_suppkey, l_linenumber))"),
)
def a4_metric_rows(spark, folder):
    """Runs flattened to one row per metric, then to one per sample."""
    rows = B.explode_metrics(bench_records(spark, folder).select("run_id", "metrics"))
    per = rows.groupBy("metric", "unit").agg(F.count(F.lit(1)).alias("runs"))
    values = B.sample_rows(rows).groupBy("metric", "unit").agg(F.count(F.lit(1)).alias("samples"), F.sum("sample").alias("total"))
    return per.join(values, ["metric", "unit"]).select("metric", "unit", "runs", "samples", r("total", 3).alias("total"))


@query(
    "a13_run_plan",
    """SELECT 'c' || c_custkey || '-' || sc || '-' || rt || '-' || lpad(CAST(it AS VARCHAR), 3, '0') || '-' || v AS run_id, sc AS scenario, v AS variant, rt AS run_type,
 CAST(it AS INT) AS iteration, CAST(row_number() OVER (PARTITION BY c_custkey, sc, rt, it ORDER BY md5('42|c' || c_custkey || '|' || sc || '|' || rt || '|' || it || '|' || v)) AS INT) AS order_index
FROM customer, (SELECT unnest([{scenarios}]) AS sc), (SELECT unnest(['cold', 'warm']) AS rt), range(1, 11) AS s(it),
 (SELECT unnest([{variants}]) AS v)""".format(
        scenarios=", ".join(f"'{s}'" for s in SCENARIOS), variants=", ".join(f"'{v}'" for v in VARIANTS)
    ),
)
def a13_run_plan(spark, folder):
    devices = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("device_id"))
    plan = B.run_plan(devices, SCENARIOS, VARIANTS, 10, 42)
    return plan.select("run_id", "scenario", "variant", "run_type", "iteration", "order_index")


@query(
    "a2_run_files",
    " UNION ALL ".join(
        f"SELECT '{code}' AS code, count(*) AS runs FROM {_RECORD} WHERE k % 37 <> 0 AND k % 59 <> 0 AND {rule} HAVING count(*) > 0"
        for code, rule in {
            "schema_version": "k % 31 = 0", "unknown_scenario": "k % 41 = 0", "iteration": "k % 43 = 0", "metric_samples": "k % 47 = 0",
            "metric_direction": "k % 53 = 0", "negative_crashes": "k % 61 = 0", "malformed": "k % 50 = 1",
            "(valid)": "k % 31 <> 0 AND k % 41 <> 0 AND k % 43 <> 0 AND k % 47 <> 0 AND k % 53 <> 0 AND k % 61 <> 0",
        }.items()
    ),
)
def a2_run_files(spark, folder):
    """Runs written as JSON lines, some lines cut short, read back into valid runs and rejected lines."""
    k = F.col("k")
    runs = bench_records(spark, folder).withColumn("k", F.split("run_id", "-")[0].try_cast("long") * 7 + F.split("run_id", "-")[1].try_cast("long"))
    runs = runs.where((k % 37 != 0) & (k % 59 != 0))
    text = F.to_json(F.struct(*[c for c in runs.columns if c != "k"]))
    lines = runs.select(F.explode(F.when(k % 50 == 1, F.array(text, F.substring(text, 1, 40))).otherwise(F.array(text))).alias("value"))
    path = shared_folder(spark)
    lines.write.text(path)
    good, bad = read_benchmark_runs(spark, path)
    codes = bad.select(F.when(F.array_contains("errors", "malformed"), F.array(F.lit("malformed"))).otherwise(F.col("errors")).alias("errors"))
    rejected = codes.select(F.explode("errors").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("runs"))
    return rejected.union(good.agg(F.lit("(valid)").alias("code"), F.count(F.lit(1)).alias("runs")))


@query(
    "a5_episode_files",
    """SELECT d.lang AS support_slice, count(*) AS episodes, count(*) FILTER (l.doc_id % 5 <> 0) AS eligible, count(*) FILTER (l.doc_id % 50 = 1) AS rejected
FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""",
)
def a5_episode_files(spark, folder):
    """Certification episodes written as JSON lines beside broken copies of some, and read back."""
    rows = certification_episodes(spark, folder)
    text = F.to_json(F.struct(*rows.columns))
    broken = F.concat(F.col("support_slice"), F.lit("|"), F.substring(text, 1, 30))
    lines = rows.select(
        F.explode(F.when(F.col("episode_id").cast("long") % 50 == 1, F.array(text, broken)).otherwise(F.array(text))).alias("value")
    )
    path = shared_folder(spark)
    lines.write.text(path)
    good, bad = read_certification_episodes(spark, path)
    counts = good.groupBy("support_slice").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("eligible").alias("eligible"))
    rejected = bad.groupBy(F.substring_index("value", "|", 1).alias("support_slice")).agg(F.count(F.lit(1)).alias("rejected"))
    return counts.join(rejected, "support_slice", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))


@query(
    "a2_duplicate_runs",
    "SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS run_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def a2_duplicate_runs(spark, folder):
    runs = table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"))
    return duplicate_ids(runs, "run_id")


@query(
    "d10_device_medians",
    with_telemetry(
        """SELECT device_id, count(*) AS count, round(median(cpu), 6) + 0 AS cpu, round(median(mem), 6) + 0 AS mem, round(median(disk), 6) + 0 AS disk,
 round(median(net), 6) + 0 AS net, round(median(process), 6) + 0 AS process, tier FROM
 (SELECT *, CASE WHEN normal >= 30 THEN 'labelled' WHEN low > 0 THEN 'low_pressure' ELSE 'all' END AS tier FROM
  (SELECT *, count(*) FILTER (is_normal) OVER d AS normal, count(*) FILTER (is_low) OVER d AS low FROM
   (SELECT *, phase = 'view' AND device_id % 2 = 0 AS is_normal, cpu < 80 * 0.65 AND mem < 85 * 0.8 AND disk > 20 AS is_low FROM tel) WINDOW d AS (PARTITION BY device_id)))
 WHERE CASE tier WHEN 'labelled' THEN is_normal WHEN 'low_pressure' THEN is_low ELSE true END GROUP BY device_id, tier"""
    ),
)
def d10_device_medians(spark, folder):
    from pulsefleet.operators.rollups import normal_rows

    tel = telemetry(spark, folder)
    label = F.when((F.col("phase") == "view") & (F.col("device_id") % 2 == 0), "normal").otherwise("AUTO")
    rows = normal_rows(tel.withColumn("scenario_label", label), KEY, "scenario_label")
    medians = R.device_medians(rows, ["device_id", "tier"], list(W.DEFAULT_BASELINE))
    return medians.select("device_id", "count", *[r(c).alias(c) for c in W.DEFAULT_BASELINE], "tier")
