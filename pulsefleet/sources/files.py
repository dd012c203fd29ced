"""Readers: metric history, benchmark runs, certification episodes, model windows, event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefleet.operators.quality import VARIANTS, benchmark_rules, duplicate_ids, with_errors
from pulsefleet.operators.windows import SERIES, WINDOW

METRIC_DEFAULTS = {
    "net_down_kbps": 0.0,
    "net_up_kbps": 0.0,
    "process_count": 0,
    "top_process": "",
    "top_process_cpu": 0.0,
    "top_process_mem": 0.0,
    "scenario_label": "AUTO",
}
_KINDS = {float: "double", int: "int", str: "string"}
METRIC_HISTORY = (
    """device_id string, ts long, cpu double, mem double, disk double, net_down_kbps double, net_up_kbps double,
    process_count int, scenario_label string, top_process string, top_process_cpu double, top_process_mem double"""
)


def read_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """Metric history from Parquet files of any schema age; order is a matter of the consumer.

    The schema is that of the newest age, so no footers are merged; columns a file lacks are null.
    """
    return metrics_view(spark.read.schema(METRIC_HISTORY).parquet(*paths))


def metrics_view(stored: DataFrame) -> DataFrame:
    """History with absent columns at their default, ``net`` = down + up, and upper-case labels."""
    out = stored
    for name, default in METRIC_DEFAULTS.items():
        kind = _KINDS[type(default)]
        value = F.col(name).cast(kind) if name in stored.columns else F.lit(None).cast(kind)
        out = out.withColumn(name, F.coalesce(value, F.lit(default)))
    return out.withColumns(
        {"net": F.col("net_down_kbps") + F.col("net_up_kbps"), "scenario_label": F.upper(F.trim("scenario_label"))}
    ).drop("net_down_kbps", "net_up_kbps")


# -- benchmark runs -------------------------------------------------------------------------

# Schemas are DDL text, so that importing this module needs no session.
BENCHMARK_RUN = (
    """schema_version int, run_id string, device_id string, scenario string, variant string, run_type string,
    iteration int, order_index int,
    metrics map<string, struct<unit: string, direction: string, samples: array<double>>>,
    optimizer_overhead struct<cpu_percent_samples: array<double>, memory_mb_samples: array<double>,
      disk_write_kbps_samples: array<double>>,
    safety struct<crashes: int, app_reloads: int, user_apps_touched: int, rollback_failures: int>,
    environment map<string, string>, notes string"""
)


def read_benchmark_runs(spark: SparkSession, path: str, variants: Sequence[str] = VARIANTS) -> tuple[DataFrame, DataFrame]:
    """(valid runs, rejected lines) of a JSON-lines file or folder.

    Blank lines are skipped. A line that is not an object, breaks the contract, or repeats a run id
    is rejected with its codes and its text.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        "value",
        F.from_json(
            "value",
            BENCHMARK_RUN + ", _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ).alias("r"),
    )
    rows = parsed.select("value", "r.*")
    fields = [c for c in rows.columns if c not in ("value", "_corrupt")]
    checked = with_errors(rows, [("malformed", F.col("_corrupt").isNotNull()), *benchmark_rules(variants=variants)])
    repeated = duplicate_ids(rows.where(F.col("run_id").isNotNull()), "run_id").select("run_id", F.lit(True).alias("__dup"))
    checked = checked.join(repeated, "run_id", "left").withColumn(
        "errors", F.when(F.col("__dup"), F.array_append("errors", F.lit("duplicate_run_id"))).otherwise(F.col("errors"))
    )
    good = checked.where(F.size("errors") == 0).select(*fields)
    return good, checked.where(F.size("errors") > 0).select(F.col("value").alias("line"), "errors")


def overhead_sums(runs: DataFrame) -> DataFrame:
    """Runs with sum and count of their overhead samples, as the quality gates take them."""
    total = lambda path: F.aggregate(F.coalesce(F.col(path), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    count = lambda path: F.size(F.coalesce(F.col(path), F.array().cast("array<double>")))
    cpu, memory = "optimizer_overhead.cpu_percent_samples", "optimizer_overhead.memory_mb_samples"
    flags = ("crashes", "app_reloads", "user_apps_touched", "rollback_failures")
    return runs.select(
        *[c for c in runs.columns if c not in ("optimizer_overhead", "safety", "environment")],
        total(cpu).alias("cpu_sum"),
        count(cpu).alias("cpu_n"),
        total(memory).alias("memory_sum"),
        count(memory).alias("memory_n"),
        *[F.coalesce(F.col(f"safety.{f}"), F.lit(0)).alias(f) for f in flags],
        *[F.col("environment")[e].alias(e) for e in ("os_build", "power_mode", "thermal_state")],
    )


# -- certification episodes -----------------------------------------------------------------

CERTIFICATION_EPISODE = (
    """episode_id string, label_provenance string, support_slice string, eligible boolean, accepted boolean,
    correct boolean, critical_event boolean, critical_detected boolean, committed_action boolean,
    severe_harm boolean, rollback_attempted boolean, rollback_succeeded boolean, protected_policy_violation boolean"""
)


def read_certification_episodes(spark: SparkSession, path: str, as_list: bool = False) -> tuple[DataFrame, DataFrame]:
    """(episodes, rejected texts) of JSON lines; ``as_list`` imports files that are one JSON list each.

    A list cannot be cut, so one task reads a whole file: import it once and keep lines. A line that is
    no record of the schema is rejected; of a list, records that break it are.
    """
    texts = spark.read.text(path, wholetext=as_list)
    if as_list:
        texts = texts.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    options = {"columnNameOfCorruptRecord": "corrupt"}
    rows = texts.where(F.trim("value") != "").select(
        "value", F.from_json("value", CERTIFICATION_EPISODE + ", corrupt string", options).alias("r")
    )
    good = rows.where("r is not null and r.corrupt is null").select("r.*").drop("corrupt")
    return good, rows.where("r is null or r.corrupt is not null").select("value")


# -- model input windows --------------------------------------------------------------------

HISTORY_FIELDS = dict(
    zip(
        SERIES,
        (
            "cpu_history",
            "mem_history",
            "disk_history",
            "net_history",
            "process_history",
            "top_process_cpu_history",
            "top_process_mem_history",
        ),
    )
)
REQUIRED_HISTORY = ("cpu", "mem", "disk")


def window_rows(packets: DataFrame) -> DataFrame:
    """Packets with ``values``: per series the last eight numbers; absent series become zeros.

    ``error`` names a required series with fewer than eight samples, and is null for a usable packet.
    """
    zeros = F.array_repeat(F.lit(0.0), WINDOW)
    series, short = [], []
    for name, field in HISTORY_FIELDS.items():
        present = field in packets.columns
        raw = F.col(field).cast("array<double>") if present else F.lit(None).cast("array<double>")
        size = F.coalesce(F.size(raw), F.lit(0))
        tail = F.slice(raw, F.greatest(F.lit(1), size - WINDOW + 1), WINDOW)
        if name in REQUIRED_HISTORY:
            short.append(F.when(size < WINDOW, F.lit(f"{field} too short")))
            series.append(tail.alias(name))
        else:
            series.append(F.coalesce(tail, zeros).alias(name))
    return packets.withColumns({"values": F.struct(*series), "error": F.coalesce(*short)})


def window_values(column: str = "values") -> dict[str, list[Column]]:
    """Columns of a window struct in the form ``windows.feature_columns`` takes."""
    return {name: [F.get(F.col(f"{column}.{name}"), i) for i in range(WINDOW)] for name in SERIES}


# -- event logs -----------------------------------------------------------------------------


def event_log(lines: DataFrame, fields: Sequence[str], casts: dict[str, str] | None = None) -> DataFrame:
    """Typed rows of a JSON log whose values are all strings; works on batch and stream ``value`` rows.

    Lines that are no JSON object give no row; see ``malformed_lines``.
    """
    entry = lines.where(~_malformed()).select(F.from_json("value", "map<string, string>").alias("m"))
    casts = casts or {}
    pick = lambda name: F.col("m")[name].try_cast(casts[name]) if name in casts else F.col("m")[name]
    return entry.select(*[pick(name).alias(name) for name in fields])


def _malformed() -> Column:
    """A line is malformed unless it is blank or an object: text that cannot be parsed gives null or no entry."""
    parsed = F.from_json("value", "map<string, string>")
    empty = F.regexp_replace("value", r"\s", "") == "{}"
    return F.coalesce((parsed.isNull() | (F.size(parsed) == 0)) & ~empty, F.lit(True))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """The lines of a log that are no JSON object."""
    return lines.where(_malformed() & (F.coalesce(F.trim("value"), F.lit("")) != "")).select("value")


def read_event_log(spark: SparkSession, path: str, fields: Sequence[str], casts: dict[str, str] | None = None) -> DataFrame:
    return event_log(spark.read.text(path), fields, casts)
