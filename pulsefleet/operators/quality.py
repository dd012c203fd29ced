"""Record contracts: rule sets that list every violation of a row, and split valid from quarantined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the version 3 record contracts.
SCHEMA_VERSION = 3
PROVENANCE = ("SYNTHETIC", "CONTROLLED_LAB", "WEAK_HEURISTIC", "MANUAL_REVIEW", "MEASURED_QOE")
CERTIFIABLE = ("CONTROLLED_LAB", "MANUAL_REVIEW", "MEASURED_QOE")
OUTCOMES = ("USER_IMPACT_EVENT", "NO_USER_IMPACT_EVENT")
COMMON_FIELDS = (
    "schema_version",
    "monotonic_timestamp_ms",
    "wall_timestamp_utc",
    "device_id",
    "session_id",
    "episode_id",
    "windows_build_family",
    "hardware",
    "collector_health",
    "feature_source_versions",
    "provenance",
)
RECORD_FIELDS = {
    "telemetry_frame": (
        "foreground",
        "workload_phase",
        "resources",
        "resources.cpu_percent",
        "resources.memory_percent",
        "resources.disk_free_percent",
        "normalized_resources",
        "normalized_resources.cpu_robust_z",
        "normalized_resources.memory_robust_z",
        "normalized_resources.disk_robust_z",
    ),
    "workload_episode": (
        "workload_class",
        "start_reason",
        "end_reason",
        "start_monotonic_ms",
        "end_monotonic_ms",
        "stable_baseline",
        "observation_interval_ms",
        "outcome_interval_ms",
        "data_quality",
    ),
    "outcome_label": ("primary_outcome", "label_confidence", "qoe_evidence"),
    "action_outcome": ("transaction_id", "action_type", "outcome", "rollback", "measured_effect"),
}


def with_errors(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add ``errors``: the codes of all rules whose condition holds (null counts as holding)."""
    codes = [F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules]
    return df.withColumn("errors", F.array_compact(F.array(*codes)))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def certifiable(provenance: Column) -> Column:
    return F.upper(provenance).isin(*CERTIFIABLE)


def _field_type(schema: T.StructType, path: str) -> T.DataType | None:
    here: T.DataType | None = schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.fieldNames():
            return None
        here = here[part].dataType
    return here


def missing(df: DataFrame, path: str) -> Column:
    """A required field is present, not null and, for text, not empty."""
    kind = _field_type(df.schema, path)
    if kind is None:
        return F.lit(True)
    value = F.col(path)
    return (value.isNull() | (value == "")) if isinstance(kind, T.StringType) else value.isNull()


def contract_rules(df: DataFrame, record: str, for_certification: bool = False) -> list[tuple[str, Column]]:
    """Rules of one record type against the columns that ``df`` has."""
    fields = COMMON_FIELDS + RECORD_FIELDS[record]
    rules = [(f"missing:{path}", missing(df, path)) for path in fields]
    has = lambda name: name in df.columns
    unless_null = lambda condition: F.coalesce(condition, F.lit(False))
    if has("schema_version"):
        rules.append(("schema_version", unless_null(F.col("schema_version") != SCHEMA_VERSION)))
    if has("provenance"):
        rules.append(("provenance", unless_null(~F.upper("provenance").isin(*PROVENANCE))))
        if for_certification and record in ("outcome_label", "action_outcome"):
            rules.append(("weak_provenance", unless_null(~certifiable(F.col("provenance")))))
    if record == "workload_episode" and has("start_monotonic_ms") and has("end_monotonic_ms"):
        rules.append(("interval", unless_null(F.col("end_monotonic_ms") <= F.col("start_monotonic_ms"))))
    if record == "outcome_label" and has("primary_outcome"):
        rules.append(("primary_outcome", unless_null(~F.upper("primary_outcome").isin(*OUTCOMES))))
    return rules


def validate(df: DataFrame, record: str, for_certification: bool = False) -> DataFrame:
    return with_errors(df, contract_rules(df, record, for_certification))


# -- labels ---------------------------------------------------------------------------------


def contradictory_labels(labels: DataFrame) -> DataFrame:
    """Episodes with more than one outcome."""
    seen = labels.groupBy("episode_id").agg(F.count_distinct(F.upper("primary_outcome")).alias("outcomes"))
    return seen.where(F.col("outcomes") > 1)


def class_counts(df: DataFrame, column: Column, domain: Sequence[str]) -> DataFrame:
    """Rows per class of a fixed domain, zero-filled."""
    spark = df.sparkSession
    counted = df.groupBy(column.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(c,) for c in domain], "class string")
    return names.join(counted, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("rows"))


def label_report(labels: DataFrame, for_certification: bool = False) -> DataFrame:
    """One row: totals, class counts, contradictions, and whether the labels are accepted."""
    per_episode = labels.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(certifiable(F.col("provenance")).cast("int")).alias("eligible"),
        F.count_distinct(F.upper("primary_outcome")).alias("outcomes"),
        *[F.sum((F.upper("primary_outcome") == o).cast("int")).alias(o.lower()) for o in OUTCOMES],
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = per_episode.agg(
        zero("n").alias("total"),
        zero("eligible").alias("eligible"),
        zero((F.col("outcomes") > 1).cast("int")).alias("contradictory_episodes"),
        *[zero(o.lower()).alias(o.lower()) for o in OUTCOMES],
    )
    ok = (F.col("total") > 0) & (F.col("contradictory_episodes") == 0)
    if for_certification:
        ok = ok & (F.col("eligible") == F.col("total"))
    return total.withColumn("accepted", ok)


# -- benchmark records ----------------------------------------------------------------------

# Fixed values of the benchmark record contract.
SCENARIOS = ("student_browser", "coding", "video_meeting", "gaming", "post_boot")
BASELINE_VARIANT = "windows_baseline"
# The name under which a lab records the optimizer it tests; callers with another name pass theirs.
SUBJECT_VARIANT = "subject_optimizer"
VARIANTS = (BASELINE_VARIANT, SUBJECT_VARIANT, "microsoft_pc_manager", "process_lasso", "razer_cortex")
RUN_TYPES = ("cold", "warm")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def benchmark_rules(schema_version: int = 1, variants: Sequence[str] = VARIANTS) -> list[tuple[str, Column]]:
    """Rules for benchmark runs in the schema of ``sources.files.BENCHMARK_RUN``."""
    text = lambda name: (name, F.col(name).isNull() | (F.trim(name) == ""))
    known = lambda name, domain: (f"unknown_{name}", ~F.col(name).isin(*domain))
    counter = lambda path: (f"negative_{path.split('.')[-1]}", F.coalesce(F.col(path), F.lit(0)) < 0)
    metrics = F.map_values("metrics")
    overhead = lambda name: (
        f"overhead_{name}",
        F.coalesce(F.exists(f"optimizer_overhead.{name}", lambda x: ~finite(x)), F.lit(False)),
    )
    return [
        ("schema_version", ~F.col("schema_version").eqNullSafe(F.lit(schema_version))),
        *[text(n) for n in ("run_id", "device_id", "scenario", "variant", "run_type")],
        known("scenario", SCENARIOS),
        known("variant", variants),
        known("run_type", RUN_TYPES),
        ("iteration", F.col("iteration") < 0),
        ("order_index", F.col("order_index") < 0),
        ("metrics", F.col("metrics").isNull() | (F.size("metrics") < 1)),
        ("metric_name", F.exists(F.map_keys("metrics"), lambda k: k == "")),
        ("metric_unit", F.exists(metrics, lambda m: m["unit"].isNull() | (m["unit"] == ""))),
        ("metric_direction", F.exists(metrics, lambda m: m["direction"].isNull() | ~m["direction"].isin("lower", "higher"))),
        (
            "metric_samples",
            F.exists(
                metrics,
                lambda m: m["samples"].isNull() | (F.size(m["samples"]) < 1) | F.exists(m["samples"], lambda x: ~finite(x)),
            ),
        ),
        *[overhead(n) for n in ("cpu_percent_samples", "memory_mb_samples", "disk_write_kbps_samples")],
        *[counter(f"safety.{n}") for n in ("crashes", "app_reloads", "user_apps_touched", "rollback_failures")],
    ]


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# -- locked certification episodes ----------------------------------------------------------

CERTIFICATION_FLAGS = (
    "eligible",
    "accepted",
    "correct",
    "critical_event",
    "critical_detected",
    "committed_action",
    "severe_harm",
    "rollback_attempted",
    "rollback_succeeded",
    "protected_policy_violation",
)
# (consequence, premise): the first may only be true where the second is.
IMPLICATIONS = (
    ("accepted", "eligible"),
    ("critical_detected", "critical_event"),
    ("severe_harm", "committed_action"),
    ("rollback_succeeded", "rollback_attempted"),
)


def locked_episode_errors(episodes: DataFrame, manifest_ids: DataFrame) -> DataFrame:
    """(episode_id, error) of every violation, with ids missing on either side."""
    rules = [("weak_provenance", ~F.col("label_provenance").isin(*CERTIFIABLE))]
    rules += [(f"not_boolean:{f}", F.col(f).isNull()) for f in CERTIFICATION_FLAGS]
    rules += [
        (f"{then}_without_{given}", F.coalesce(F.col(then) & ~F.col(given), F.lit(False)))
        for then, given in IMPLICATIONS
    ]
    rules.append(("empty_id", F.col("episode_id").isNull() | (F.col("episode_id") == "")))
    row_errors = with_errors(episodes, rules).select("episode_id", F.explode("errors").alias("error"))
    repeated = duplicate_ids(episodes, "episode_id").select("episode_id", F.lit("duplicate_id").alias("error"))
    a = episodes.select("episode_id").distinct().withColumn("__e", F.lit(True))
    b = manifest_ids.select("episode_id").distinct().withColumn("__m", F.lit(True))
    sides = a.join(b, "episode_id", "full_outer").select(
        "episode_id",
        F.when(F.col("__m").isNull(), "not_in_manifest").when(F.col("__e").isNull(), "missing_from_input").alias("error"),
    )
    return row_errors.unionByName(repeated).unionByName(sides.where(F.col("error").isNotNull()))
