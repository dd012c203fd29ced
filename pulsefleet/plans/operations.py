"""Queries for audit roll-ups, keyed table maintenance, retention and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefleet.functions import scoring as S
from pulsefleet.operators import episodes as E
from pulsefleet.operators import rollups as R
from pulsefleet.operators import tables as K
from pulsefleet.operators import windows as W
from pulsefleet.plans.history import KEY, ORDER, OVER, r
from pulsefleet.plans.registry import query
from pulsefleet.plans.views import TELEMETRY, pressure_sql, processes, table, telemetry, with_processes, with_telemetry
from pulsefleet.session import shared_folder
from pulsefleet.sources import migrations
from pulsefleet.sources.migrations import Step


def audits(spark, folder):
    """Recorded decisions, one per event."""
    return telemetry(spark, folder).withColumn("risk", S.pressure("cpu", "mem", "disk")).select(
        "device_id", "t", "seq", "risk",
        F.when(F.col("risk") >= 65, "CRITICAL").when(F.col("risk") >= 45, "WARNING").otherwise("NORMAL").alias("level"),
        F.col("phase").alias("root_cause"),
        F.concat(F.lit("GATE_"), F.col("seq") % 4).alias("gate"),
        F.concat(F.lit("target_"), F.col("seq") % 7).alias("target"),
        (F.col("seq") % 11 == 0).alias("hard_block"), (F.col("seq") % 13 == 0).alias("target_protected"), (F.col("seq") % 17 == 0).alias("target_denied"),
        "net", "mem", "cpu",
    )


AUDITS = f"""
aud AS (SELECT device_id, t, seq, risk, CASE WHEN risk >= 65 THEN 'CRITICAL' WHEN risk >= 45 THEN 'WARNING' ELSE 'NORMAL' END AS level, phase AS root_cause,
  'GATE_' || (seq % 4) AS gate, 'target_' || (seq % 7) AS target, seq % 11 = 0 AS hard_block, seq % 13 = 0 AS target_protected, seq % 17 = 0 AS target_denied, net, mem, cpu
 FROM (SELECT *, {pressure_sql()} AS risk FROM tel))"""


def audit_sql(body: str) -> str:
    return with_telemetry(body, AUDITS)


@query(
    "d1_label_coverage",
    with_telemetry(
        """SELECT class, coalesce(n, 0) AS rows FROM (SELECT unnest(['NORMAL', 'WARNING', 'CRITICAL', 'RECOVERY', 'AUTO']) AS class) d LEFT JOIN
 (SELECT coalesce(CASE phase WHEN 'view' THEN 'NORMAL' WHEN 'error' THEN 'CRITICAL' END, 'AUTO') AS label, count(*) AS n FROM tel GROUP BY 1) c ON c.label = d.class"""
    ),
)
def d1_label_coverage(spark, folder):
    label = F.when(F.col("phase") == "view", "normal").when(F.col("phase") == "error", "Critical")
    return R.label_coverage(telemetry(spark, folder).withColumn("scenario_label", label), "scenario_label")


@query("d2_decisions_by_level", audit_sql("SELECT level, count(*) AS n, round(avg(risk), 1) AS avg_risk FROM aud GROUP BY level"))
def d2_decisions_by_level(spark, folder):
    return R.counts_by(audits(spark, folder), ["level"], {"avg_risk": "risk"})


@query(
    "d2_top_root_causes",
    audit_sql("SELECT root_cause, gate, count(*) AS n FROM aud GROUP BY ALL ORDER BY n DESC, root_cause, gate LIMIT 8"),
)
def d2_top_root_causes(spark, folder):
    return R.top_groups(R.counts_by(audits(spark, folder), ["root_cause", "gate"]), 8, ["root_cause", "gate"])


@query("d3_plans_by_status", audit_sql("SELECT level AS status, count(*) AS n, round(avg(mem), 1) AS avg_readiness FROM aud GROUP BY level"))
def d3_plans_by_status(spark, folder):
    plans = audits(spark, folder).withColumnRenamed("level", "status")
    return R.counts_by(plans, ["status"], {"avg_readiness": "mem"})


@query(
    "d3_top_actions",
    audit_sql("SELECT root_cause AS action_type, target AS action_name, gate, count(*) AS n FROM aud GROUP BY ALL ORDER BY n DESC, action_type, action_name, gate LIMIT 8"),
)
def d3_top_actions(spark, folder):
    plans = audits(spark, folder).withColumnsRenamed({"root_cause": "action_type", "target": "action_name"})
    groups = ["action_type", "action_name", "gate"]
    return R.top_groups(R.counts_by(plans, groups), 8, groups)


@query(
    "d4_verifications_by_outcome",
    audit_sql("SELECT level AS status, root_cause AS outcome, count(*) AS n, round(avg(risk - mem / 2), 1) + 0 AS avg_delta, round(avg(mem), 1) AS avg_confidence FROM aud GROUP BY ALL"),
)
def d4_verifications_by_outcome(spark, folder):
    rows = audits(spark, folder).withColumnsRenamed({"level": "status", "root_cause": "outcome"}).withColumn("delta", F.col("risk") - F.col("mem") / 2)
    return R.counts_by(rows, ["status", "outcome"], {"avg_delta": "delta", "avg_confidence": "mem"}).withColumn(
        "avg_delta", F.col("avg_delta") + F.lit(0.0)
    )


@query(
    "d4_top_simulated_actions",
    audit_sql("SELECT root_cause AS action, target, count(*) AS n, round(avg(risk), 1) AS risk_before, round(avg(risk * 0.8::DOUBLE), 1) AS risk_after FROM aud GROUP BY ALL ORDER BY n DESC, action, target LIMIT 8"),
)
def d4_top_simulated_actions(spark, folder):
    rows = audits(spark, folder).withColumnRenamed("root_cause", "action").withColumn("after", F.col("risk") * 0.8)
    return R.top_groups(R.counts_by(rows, ["action", "target"], {"risk_before": "risk", "risk_after": "after"}), 8, ["action", "target"])


@query("d5_policy_levels", audit_sql("SELECT level, gate AS reason_code, count(*) AS n, round(avg(risk), 1) AS avg_score FROM aud GROUP BY ALL"))
def d5_policy_levels(spark, folder):
    return R.counts_by(audits(spark, folder).withColumnRenamed("gate", "reason_code"), ["level", "reason_code"], {"avg_score": "risk"})


@query(
    "d5_blocked_targets",
    audit_sql("SELECT target, gate, count(*) AS n FROM aud WHERE hard_block OR target_protected OR target_denied GROUP BY ALL ORDER BY n DESC, target, gate LIMIT 8"),
)
def d5_blocked_targets(spark, folder):
    blocked = audits(spark, folder).where("hard_block OR target_protected OR target_denied")
    return R.top_groups(R.counts_by(blocked, ["target", "gate"]), 8, ["target", "gate"])


@query("d7_baseline_status", audit_sql("SELECT level AS status, root_cause AS dominant_metric, count(*) AS n, round(avg(risk), 1) AS avg_anomaly, round(avg(mem), 1) AS avg_confidence FROM aud GROUP BY ALL"))
def d7_baseline_status(spark, folder):
    rows = audits(spark, folder).withColumnsRenamed({"level": "status", "root_cause": "dominant_metric"})
    return R.counts_by(rows, ["status", "dominant_metric"], {"avg_anomaly": "risk", "avg_confidence": "mem"})


_HEALTH_SQL = """
cyc AS (SELECT device_id, count(*) AS total_cycles, count(*) FILTER (warm) AS warmup, count(*) FILTER (NOT warm AND cached) AS cached,
   count(*) FILTER (NOT warm AND NOT cached AND fb) AS fallback, count(*) FILTER (ran) AS model_attempts, count(*) FILTER (ran AND won) AS model_successes,
   count(*) AS storage_writes, count(*) FILTER (seq % 50 = 0 AND device_id % 4 = 0) AS storage_failures
  FROM (SELECT *, i < 3 AS warm, phase = 'view' AS cached, phase = 'signup' AS fb, phase <> 'view' AS ran, phase <> 'signup' AND NOT (device_id % 5 = 0 AND mem > 40) AS won
   FROM (SELECT *, seq % 60 AS i FROM tel)) GROUP BY device_id),
hth AS (SELECT *, CASE WHEN model_attempts = 0 THEN 100 ELSE model_successes * 100 / model_attempts END AS ms, fallback * 100 / greatest(1, total_cycles - warmup) AS fr,
   (storage_writes - storage_failures) * 100 / storage_writes AS ss FROM cyc),
hst AS (SELECT *, least(100, greatest(0, 100 - fr * 0.45::DOUBLE - (100 - ms) * 0.35::DOUBLE - (100 - ss) * 0.2::DOUBLE)) AS score,
   CASE WHEN ss < 80 OR 100 - ms >= 70 THEN 'CRITICAL' WHEN total_cycles < 10 THEN 'STARTING' WHEN ss < 95 OR fr > 35 OR 100 - ms > 35 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM hth)"""


def health(spark, folder):
    tel = telemetry(spark, folder)
    phase = F.col("phase")
    cycles = tel.select(
        "device_id",
        (F.col("seq") % 60 >= 3).alias("has_window"),
        (phase != "view").alias("ran_model"),
        F.when(phase == "signup", "FALLBACK").otherwise("MODEL").alias("source"),
        F.when(phase == "view", "cache").when(phase == "signup", "fallback").otherwise("service").alias("path"),
        ((phase != "signup") & ~((F.col("device_id") % 5 == 0) & (F.col("mem") > 40))).alias("model_success"),
    )
    writes = tel.select("device_id", (~((F.col("seq") % 50 == 0) & (F.col("device_id") % 4 == 0))).alias("ok"))
    return R.runtime_health(cycles, writes, KEY, W.ewma_last(tel, KEY, ORDER, "net", 0.15))


@query(
    "d31_runtime_health",
    with_telemetry(
        """SELECT device_id, total_cycles, warmup, cached, fallback, model_attempts, model_successes, storage_failures, round(ms, 6) AS model_success_rate, round(fr, 6) AS fallback_rate,
 round(ss, 6) AS storage_success_rate, round(score, 6) AS availability_score, status FROM hst""",
        _HEALTH_SQL,
    ),
)
def d31_runtime_health(spark, folder):
    rates = ("model_success_rate", "fallback_rate", "storage_success_rate", "availability_score")
    return health(spark, folder).select(
        "device_id", "total_cycles", "warmup", "cached", "fallback", "model_attempts", "model_successes", "storage_failures",
        *[r(c).alias(c) for c in rates], "status",
    )


@query(
    "d6_health_by_status",
    with_telemetry(
        "SELECT status, count(*) AS n, round(avg(score), 1) AS avg_availability, round(avg(ms), 1) AS avg_model_success, round(avg(ss), 1) AS avg_storage_success FROM hst GROUP BY status",
        _HEALTH_SQL,
    ),
)
def d6_health_by_status(spark, folder):
    return R.counts_by(
        health(spark, folder), ["status"],
        {"avg_availability": "availability_score", "avg_model_success": "model_success_rate", "avg_storage_success": "storage_success_rate"},
    )


@query(
    "d8_recent_waste_leaders",
    """SELECT event_type AS name, 'C' || (user_id % 3) AS category, round(avg(value), 1) AS avg_waste, round(max(value), 1) AS max_gain, count(*) AS samples FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL ORDER BY avg_waste DESC, max_gain DESC, name, category LIMIT 10""",
)
def d8_recent_waste_leaders(spark, folder):
    """Groups of the week before the newest event."""
    rows = telemetry(spark, folder).select("t", F.col("phase").alias("name"), F.concat(F.lit("C"), F.col("device_id") % 3).alias("category"), "net")
    recent = R.since_newest(rows, "t", 7 * 86_400_000_000)
    return (
        recent.groupBy("name", "category")
        .agg(F.round(F.avg("net"), 1).alias("avg_waste"), F.round(F.max("net"), 1).alias("max_gain"), F.count(F.lit(1)).alias("samples"))
        .orderBy(F.col("avg_waste").desc(), F.col("max_gain").desc(), "name", "category")
        .limit(10)
    )


@query(
    "d9_recent_foreground_apps",
    """SELECT epoch_us(max(ts)) AS last_seen, user_id % 20 AS app, event_type AS kind, round(max(value), 2) AS max_focus, count(*) AS samples FROM events
GROUP BY app, kind ORDER BY last_seen DESC, app, kind LIMIT 12""",
)
def d9_recent_foreground_apps(spark, folder):
    rows = telemetry(spark, folder).select("t", (F.col("device_id") % 20).alias("app"), F.col("phase").alias("kind"), "net")
    aggs = [F.round(F.max("net"), 2).alias("max_focus"), F.count(F.lit(1)).alias("samples")]
    return R.recent_groups(rows, ["app", "kind"], "t", aggs, 12)


@query(
    "d9_intent_states",
    with_telemetry(
        """SELECT CASE WHEN idle < 30 THEN 'ACTIVE' WHEN idle < 300 THEN 'IDLE' ELSE 'AWAY' END AS user_state, phase AS app_kind, count(*) AS n
FROM (SELECT *, net * 4 AS idle FROM tel) GROUP BY ALL"""
    ),
)
def d9_intent_states(spark, folder):
    rows = telemetry(spark, folder).withColumn("user_state", S.user_state(F.col("net") * 4))
    return R.counts_by(rows.withColumnRenamed("phase", "app_kind"), ["user_state", "app_kind"])


@query(
    "d37_reliability_budget",
    """SELECT c_nationkey, round(sum(CASE WHEN c_custkey % 9 <> 0 THEN 0.001::DOUBLE ELSE 0 END), 6) AS total_allocated,
 count(*) FILTER (c_custkey % 9 = 0 OR c_acctbal < 0 OR c_acctbal / 1e7 > 0.001 OR c_custkey % 31 = 0) AS component_violations,
 count(*) FILTER (c_custkey % 9 = 0 OR c_acctbal < 0 OR c_acctbal / 1e7 > 0.001 OR c_custkey % 31 = 0) = 0 AND sum(CASE WHEN c_custkey % 9 <> 0 THEN 0.001::DOUBLE ELSE 0 END) <= 0.01 AS accepted
FROM customer GROUP BY c_nationkey""".replace("CASE WHEN c_custkey % 9 <> 0 THEN", "CASE WHEN c_custkey % 9 <> 0 AND c_acctbal >= 0 AND c_custkey % 31 <> 0 THEN"),
)
def d37_reliability_budget(spark, folder):
    report = R.budget_report(budget_components(spark, folder), ["c_nationkey"])
    return report.select("c_nationkey", r("total_allocated").alias("total_allocated"), "component_violations", "accepted")


def budget_components(spark, folder):
    return table(spark, folder, "customer").select(
        "c_nationkey",
        F.when(F.col("c_custkey") % 31 != 0, F.col("c_name")).alias("component"),
        (F.col("c_custkey") % 9 != 0).alias("measured"),
        (F.col("c_acctbal") / 1e7).alias("error_upper_bound"),
        F.lit(0.001).alias("requested"),
    )


@query(
    "d37_budget_violations",
    """SELECT c_nationkey, CASE WHEN c_custkey % 31 = 0 THEN 'unnamed_component' WHEN c_custkey % 9 = 0 OR c_acctbal < 0 THEN c_name || ':unmeasured_or_invalid'
 ELSE c_name || ':upper_bound_exceeds_budget' END AS violation FROM customer
WHERE c_custkey % 31 = 0 OR c_custkey % 9 = 0 OR c_acctbal < 0 OR c_acctbal / 1e7 > 0.001""",
)
def d37_budget_violations(spark, folder):
    return R.budget_violations(budget_components(spark, folder), ["c_nationkey"])


@query(
    "e12_collector_states",
    with_telemetry(
        """SELECT CASE WHEN NOT (disk > 55) THEN 'UNAVAILABLE' WHEN NOT (cpu < 60) THEN 'OVER_BUDGET' WHEN seq % 2 = 0 THEN 'HEALTHY' ELSE 'SCHEDULED_REUSE' END AS status,
 'cpu=' || CASE WHEN cpu < 90 THEN 0 ELSE 1 END || ';mem=' || CASE WHEN seq % 3 <> 0 THEN 0 ELSE 1 END AS mask, count(*) AS n FROM tel GROUP BY ALL"""
    ),
)
def e12_collector_states(spark, folder):
    """Health row and missingness mask of each sample's collectors."""
    status = E.collector_status(F.col("disk") > 55, F.col("cpu") < 60, F.col("seq") % 2 == 0)
    mask = E.missingness_mask({"cpu": F.col("cpu") < 90, "mem": F.col("seq") % 3 != 0})
    return telemetry(spark, folder).groupBy(status.alias("status"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d46_collector_cost",
    with_telemetry(
        """SELECT device_id, round(any_value(lst), 6) AS last_duration, round(list_sort(list(net))[CAST(ceil((count(*) - 1) * 0.5) AS INT) + 1], 6) AS p50_duration,
 round(list_sort(list(net))[CAST(ceil((count(*) - 1) * 0.95) AS INT) + 1], 6) AS p95_duration, any_value(okay) AS healthy
FROM (SELECT *, first(net) OVER d AS lst, first(phase <> 'error') OVER d AS okay, row_number() OVER d AS i FROM tel WINDOW d AS (PARTITION BY device_id ORDER BY t DESC, seq DESC)) WHERE i <= 64 GROUP BY device_id"""
    ),
)
def d46_collector_cost(spark, folder):
    tel = telemetry(spark, folder).withColumn("ok", F.col("phase") != "error")
    rows = W.collector_cost(tel, KEY, ORDER, "net", "ok")
    return rows.select("device_id", *[r(c).alias(c) for c in ("last_duration", "p50_duration", "p95_duration")], "healthy")


# -- latest, recent, newest -----------------------------------------------------------------


@query(
    "f1_latest_per_device",
    with_telemetry("SELECT device_id, max(t) AS t, arg_max(phase, (t, seq)) AS phase, round(arg_max(net, (t, seq)), 6) AS net FROM tel GROUP BY device_id"),
)
def f1_latest_per_device(spark, folder):
    return K.latest_by_key(telemetry(spark, folder), KEY, ORDER).select("device_id", "t", "phase", r("net").alias("net"))


@query(
    "f2_recent_per_device",
    audit_sql("SELECT device_id, seq, level, CAST(trunc(risk) AS INT) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t DESC, seq DESC) AS i FROM aud) WHERE i <= 5"),
)
def f2_recent_per_device(spark, folder):
    rows = K.newest_rows(audits(spark, folder), KEY, ORDER, 5)
    return rows.select("device_id", "seq", "level", F.col("risk").cast("int").alias("risk"))


@query("f2_recent_overall", audit_sql("SELECT device_id, seq, level, CAST(trunc(risk) AS INT) AS risk FROM aud ORDER BY t DESC, seq DESC LIMIT 25"))
def f2_recent_overall(spark, folder):
    rows = K.newest_rows(audits(spark, folder), [], ORDER, 25)
    return rows.select("device_id", "seq", "level", F.col("risk").cast("int").alias("risk"))


@query(
    "f6_actions_at_newest",
    """SELECT o_orderkey, o_orderpriority AS action FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 8""",
)
def f6_actions_at_newest(spark, folder):
    newest = R.at_newest(table(spark, folder, "orders"), "o_orderdate")
    return newest.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(8).select("o_orderkey", F.col("o_orderpriority").alias("action"))


# -- keyed tables ---------------------------------------------------------------------------


@query(
    "a1_read_metrics",
    with_telemetry(
        """SELECT device_id, seq, round(cpu, 6) AS cpu, round(coalesce(CASE WHEN seq % 5 <> 0 THEN net END, 0) + 1.5::DOUBLE, 6) AS net, CAST(0 AS INT) AS process_count, '' AS top_process,
 CASE WHEN phase = 'error' THEN 'WARNING' ELSE 'AUTO' END AS scenario_label FROM tel"""
    ),
)
def a1_read_metrics(spark, folder):
    """History in the metrics schema: absent columns get their default, labels are upper-cased."""
    from pulsefleet.sources.files import metrics_view

    stored = telemetry(spark, folder).select(
        "device_id", "t", "seq", "cpu", "mem", "disk",
        F.when(F.col("seq") % 5 != 0, F.col("net")).alias("net_down_kbps"), F.lit(1.5).alias("net_up_kbps"),
        F.when(F.col("phase") == "error", "warning").alias("scenario_label"),
    )
    return metrics_view(stored).select("device_id", "seq", r("cpu").alias("cpu"), r("net").alias("net"), "process_count", "top_process", "scenario_label")


@query(
    "a6_runtime_windows",
    """SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'disk_history too short' END AS error, CASE WHEN vec_id % 9 <> 0 THEN round(list_avg(v[-8:]), 6) + 0 END AS cpu_mean,
 CASE WHEN vec_id % 9 <> 0 THEN round(v[1], 6) + 0 END AS mem_last, CASE WHEN vec_id % 9 <> 0 THEN 0.0::DOUBLE END AS net_max FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)""",
)
def a6_runtime_windows(spark, folder):
    """Parallel history arrays as model windows; an absent series is zeros, a short one is an error."""
    from pulsefleet.sources.files import window_rows, window_values

    v = F.col("embedding").cast("array<double>")
    packets = table(spark, folder, "embeddings").select(
        "vec_id", v.alias("cpu_history"), F.reverse(v).alias("mem_history"), F.when(F.col("vec_id") % 9 == 0, F.slice(v, 1, 7)).otherwise(v).alias("disk_history")
    )
    rows = window_rows(packets)
    f = W.feature_columns(window_values())
    only = lambda c: F.when(F.col("error").isNull(), r(c))
    return rows.select("vec_id", "error", only(f["cpu_mean"]).alias("cpu_mean"), only(f["mem_last"]).alias("mem_last"), only(f["net_max"]).alias("net_max"))


@query(
    "a12_device_export",
    """SELECT CAST(l_orderkey AS VARCHAR) AS episode_id, l_orderkey * 10 + l_linenumber AS observed_at, l_quantity AS cpu_percent, l_discount AS memory_percent, l_tax AS disk_free_percent,
 l_extendedprice AS network_down_kbps, 0.0::DOUBLE AS network_up_kbps, l_linenumber AS process_count, l_returnflag AS collector_health FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7""",
)
def a12_device_export(spark, folder):
    """The rows of a device's CSV export, in time order."""
    from pulsefleet.sources.sinks import device_export

    key = F.col("l_orderkey")
    summaries = table(spark, folder, "lineitem").select(
        key.cast("string").alias("episode_id"), (key * 10 + F.col("l_linenumber")).alias("observed_at"), F.col("l_quantity").alias("cpu_percent"), F.col("l_discount").alias("memory_percent"),
        F.col("l_tax").alias("disk_free_percent"), F.col("l_extendedprice").alias("network_down_kbps"), F.lit(0.0).alias("network_up_kbps"), F.col("l_linenumber").alias("process_count"),
        F.col("l_returnflag").alias("collector_health"),
    )
    episodes = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("episode_id"), F.col("o_custkey").cast("string").alias("device_id"))
    return device_export(summaries, episodes, "7")


@query("a15_event_log", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS entries FROM events GROUP BY 1")
def a15_event_log(spark, folder):
    """JSON lines of text fields read into typed columns."""
    from pulsefleet.sources.files import event_log

    lines = table(spark, folder, "events").select(F.col("props").alias("value"))
    return event_log(lines, ["k", "missing"], {"k": "int"}).groupBy("k").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "a3_conform_columns",
    "SELECT c_custkey AS device_id, c_name AS platform, round(c_acctbal, 2) AS balance, 3 AS schema_version, 'UNKNOWN' AS gpu_tier FROM customer",
)
def a3_conform_columns(spark, folder):
    schema = T.StructType.fromDDL("device_id long, platform string, balance double, schema_version int, gpu_tier string")
    stored = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("device_id"), F.col("c_name").alias("platform"), F.round("c_acctbal", 2).alias("balance")
    )
    return K.conform(stored, schema, {"schema_version": 3, "gpu_tier": "UNKNOWN"})


#: Layouts of the device table: each step adds columns to those before.
DEVICE_STEPS = (
    Step(16, "devices", "device_id long, balance double"),
    Step(17, "platforms", "platform string", {"platform": "UNKNOWN"}),
    Step(18, "tiers", "gpu_tier string, cores int", {"gpu_tier": "UNKNOWN"}),
    Step(19, "evidence", "runs long", {"runs": 0}),
)


@query(
    "a3_migrated_devices",
    """SELECT c_custkey AS device_id, round(c_acctbal, 2) AS balance, CASE WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' ELSE c_name END AS platform,
 CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE 'UNKNOWN' END AS gpu_tier, CASE WHEN c_custkey % 3 = 2 THEN c_custkey % 16 END AS cores, 0 AS runs,
 16 + c_custkey % 3 AS written_version, 19 AS schema_version, 4 AS applied, 0 AS applied_again FROM customer""",
)
def a3_migrated_devices(spark, folder):
    """Rows written in three layouts, brought to the newest by the ledger; a second migration has nothing to do."""
    base = shared_folder(spark)
    key = F.col("c_custkey")
    devices = table(spark, folder, "customer").select(
        key.alias("device_id"), F.round("c_acctbal", 2).alias("balance"), F.col("c_name").alias("platform"),
        F.col("c_mktsegment").alias("gpu_tier"), (key % 16).cast("int").alias("cores"),
    )
    applied = []
    for n, step in enumerate(DEVICE_STEPS[:3]):
        applied += migrations.migrate(spark, base, DEVICE_STEPS[: n + 1], step.version)
        migrations.write_rows(devices.where(F.col("device_id") % 3 == n), base, DEVICE_STEPS)
    applied += migrations.migrate(spark, base, DEVICE_STEPS, 19)
    again = migrations.migrate(spark, base, DEVICE_STEPS, 20)
    return migrations.read_rows(spark, base, DEVICE_STEPS).withColumns(
        {"schema_version": F.lit(migrations.version(spark, base)), "applied": F.lit(len(applied)), "applied_again": F.lit(len(again))}
    )


@query(
    "a8_last_write_wins",
    "SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM orders GROUP BY ALL",
)
def a8_last_write_wins(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    last = K.latest_by_key(rows, ["o_custkey", "o_orderstatus"], ["o_orderkey"])
    return last.withColumn("o_totalprice", r("o_totalprice", 2))


@query(
    "a9_merge_upsert",
    """SELECT o_custkey, min(o_orderkey) AS created_at, max(o_orderkey) AS last_seen, arg_max(o_orderpriority, o_orderkey) AS descriptor, max(o_orderstatus = 'F') AS promoted
FROM orders GROUP BY o_custkey""",
)
def a9_merge_upsert(spark, folder):
    """The even orders are the stored table, the odd ones the change set."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        "o_custkey", k.alias("created_at"), k.alias("last_seen"), F.col("o_orderpriority").alias("descriptor"),
        (F.col("o_orderstatus") == "F").alias("promoted"), k.alias("version"),
    )
    rules = {"created_at": "min", "last_seen": "max", "descriptor": "last", "promoted": "max"}
    return K.merge_keyed(rows.where(k % 2 == 0), rows.where(k % 2 == 1), ["o_custkey"], "version", rules)


@query(
    "a10_insert_absent",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey""",
)
def a10_insert_absent(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    base = rows.where(F.col("o_orderstatus") == "F")
    fresh = rows.where(F.col("o_orderstatus") != "F")
    return K.insert_absent(base, fresh, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "a11_replace_children",
    """SELECT CASE WHEN new THEN 'new' ELSE 'kept' END AS origin, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM (
 SELECT l_linenumber, false AS new FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
 UNION ALL SELECT 100, true FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""",
)
def a11_replace_children(spark, folder):
    """The lines of pending orders are replaced by one new line each."""
    children = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.lit("kept").alias("origin"))
    pending = table(spark, folder, "orders").where(F.col("o_orderstatus") == "P")
    delta = pending.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(100).alias("l_linenumber"), F.lit("new").alias("origin"))
    merged = K.replace_children(children, delta, ["l_orderkey"])
    return merged.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").alias("numbers"))


@query(
    "a16_retain_by_age",
    with_telemetry("SELECT device_id, count(*) AS kept, min(t) AS oldest FROM (SELECT *, max(t) OVER (PARTITION BY device_id) AS newest FROM tel) WHERE t >= newest - 604800000000 GROUP BY device_id"),
)
def a16_retain_by_age(spark, folder):
    kept = K.retain_age(telemetry(spark, folder), KEY, "t", 7 * 86_400_000_000)
    return kept.groupBy("device_id").agg(F.count(F.lit(1)).alias("kept"), F.min("t").alias("oldest"))


@query(
    "a17_retain_by_count",
    with_telemetry("SELECT phase, count(*) AS kept, min(seq) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY t DESC, seq DESC) AS i FROM tel) WHERE i <= 1200 GROUP BY phase"),
)
def a17_retain_by_count(spark, folder):
    kept = K.retain_newest(telemetry(spark, folder), ["phase"], ORDER, 1200, floor=1000)
    return kept.groupBy("phase").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("oldest"))


_CUTOFF = "TIMESTAMP '1998-01-01'"


@query(
    "a18_cascade_retention",
    f"""SELECT 'summaries' AS name, count(*) AS rows FROM lineitem WHERE l_shipdate >= {_CUTOFF}
UNION ALL SELECT 'baselines', count(*) FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < {_CUTOFF})
UNION ALL SELECT 'outcomes', count(*) FROM orders WHERE o_orderdate >= {_CUTOFF}
UNION ALL SELECT 'health', count(*) FROM events WHERE ts >= {_CUTOFF}
UNION ALL SELECT 'episodes', count(*) FROM orders WHERE o_orderdate + INTERVAL 90 DAY >= {_CUTOFF}""",
)
def a18_cascade_retention(spark, folder):
    """Four tables age by their own clock; the baselines go with their summaries."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    summary_id = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("summary_id")
    tables = {
        "summaries": lines.select(summary_id, F.col("l_shipdate").alias("observed_at")),
        "baselines": lines.select(summary_id),
        "outcomes": orders.select(F.col("o_orderdate").alias("observed_at")),
        "health": table(spark, folder, "events").select(F.col("ts").alias("observed_at")),
        "episodes": orders.select((F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("ended_at")),
    }
    clocks = {"summaries": "observed_at", "outcomes": "observed_at", "health": "observed_at", "episodes": "ended_at"}
    out = K.cascade_retention(tables, clocks, F.lit("1998-01-01").cast("timestamp_ntz"), {"baselines": ("summaries", "summary_id")})
    return K.union_all([f.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, f in out.items()])


_ERASED = ("devices", "descriptors", "sessions")
_OF_EPISODES = ("summaries", "qoe_outcomes", "label_provenance", "action_outcomes")


@query(
    "a19_erase_devices",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'), ep AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM gone))
SELECT name, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)) AS rows FROM (VALUES ('devices'), ('descriptors'), ('sessions')) v(name)
UNION ALL SELECT 'episodes', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT name, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM ep)) FROM (VALUES ('qoe_outcomes'), ('label_provenance'), ('action_outcomes')) v(name)
UNION ALL SELECT name, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM ep)) FROM (VALUES ('summaries'), ('baselines')) v(name)""",
)
def a19_erase_devices(spark, folder):
    """Customers of a segment are erased from all nine tables."""
    customers = table(spark, folder, "customer").withColumn("device_id", F.col("c_custkey"))
    episodes = table(spark, folder, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("episode_id"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("summary_id")
    )
    tables = {name: customers for name in _ERASED}
    tables |= {name: episodes.select("episode_id") for name in _OF_EPISODES}
    tables |= {"episodes": episodes, "summaries": lines, "baselines": lines.select("summary_id")}
    doomed = customers.where(F.col("c_mktsegment") == "HOUSEHOLD")
    out = K.erase_devices(tables, doomed, "episodes", "summaries", ["baselines"], _OF_EPISODES, ["episodes", *_ERASED])
    return K.union_all([f.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, f in out.items()])


@query(
    "a9_update_present",
    """SELECT o_orderkey AS id, CASE WHEN n > 4 THEN 'LARGE' ELSE o_orderstatus END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def a9_update_present(spark, folder):
    """The status of orders with many lines is overwritten; rows without an order are ignored."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    many = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).count().where("count > 4")
    absent = spark.createDataFrame([(-1,)], "id long")
    delta = many.select("id").union(absent).withColumn("status", F.lit("LARGE"))
    return K.update_where_present(orders, delta, ["id"], ["status"])


@query(
    "a22_matrix_codec",
    """SELECT label, vec_id, 2 AS rows, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 3, 4) + 0 AS total FROM embeddings""",
)
def a22_matrix_codec(spark, folder):
    """A matrix of a vector and its double, written as text and read back."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, folder, "embeddings").select("label", "vec_id", K.encode_matrix(F.array(x, F.transform(x, lambda v: v * 2.0))).alias("text"))
    back = rows.withColumn("m", K.decode_matrix(F.col("text")))
    total = F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, v: a + v)
    return back.select("label", "vec_id", F.size("m").alias("rows"), r(total, 4).alias("total"))


@query(
    "a14_report_file",
    """SELECT lang, count(*) AS rows, CASE WHEN lang = 'en' THEN NULL ELSE max(n_chars) END AS longest FROM documents GROUP BY lang""",
)
def a14_report_file(spark, folder):
    """Report rows written as JSON lines and read back; null fields stay."""
    from pulsefleet.session import shared_folder
    from pulsefleet.sources.sinks import write_report

    report = table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("longest"))
    report = report.withColumn("longest", F.when(F.col("lang") != "en", F.col("longest")))
    path = shared_folder(spark)
    write_report(report, path)
    return spark.read.schema("lang string, rows long, longest long").json(path)


@query(
    "a20_pseudonyms",
    "SELECT c_custkey, 'dev-' || sha256(c_name) AS device, substr(sha256('salt' || c_nationkey || '|' || c_mktsegment), 1, 32) AS token FROM customer",
)
def a20_pseudonyms(spark, folder):
    salt = F.concat(F.lit("salt"), F.col("c_nationkey"))
    return table(spark, folder, "customer").select(
        "c_custkey", K.pseudonym("c_name").alias("device"), K.category_token(salt, F.col("c_mktsegment")).alias("token")
    )


@query(
    "a22_vector_codec",
    "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0 AS total FROM embeddings",
)
def a22_vector_codec(spark, folder):
    """Vectors written as text and read back."""
    as_double = F.col("embedding").cast("array<double>")
    text = table(spark, folder, "embeddings").select("vec_id", K.encode_vector(as_double).alias("text"))
    back = text.withColumn("v", K.decode_vector(F.col("text")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", F.size("v").cast("long").alias("n"), r(total, 4).alias("total"))


# -- predicates and joins -------------------------------------------------------------------


@query(
    "b8_normalise_labels",
    """SELECT CASE WHEN x IN ('NORMAL', 'WARNING', 'CRITICAL', 'RECOVERY') THEN x ELSE 'AUTO' END AS label, count(*) AS n FROM
 (SELECT regexp_replace(upper(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'normal' WHEN 'MACHINERY' THEN 'Warning' ELSE c_mktsegment END), '[- ]', '_', 'g') AS x FROM customer) GROUP BY 1""",
)
def b8_normalise_labels(spark, folder):
    raw = S.by_value(F.col("c_mktsegment"), {"HOUSEHOLD": "normal", "MACHINERY": "Warning"}, "other-label")
    return table(spark, folder, "customer").groupBy(S.normalise_label(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b9_normal_rows",
    with_telemetry(
        """SELECT tier, count(*) AS rows, count(DISTINCT device_id) AS devices FROM
 (SELECT *, CASE WHEN normal >= 30 THEN 'labelled' WHEN low > 0 THEN 'low_pressure' ELSE 'all' END AS tier FROM
  (SELECT *, count(*) FILTER (is_normal) OVER d AS normal, count(*) FILTER (is_low) OVER d AS low FROM
   (SELECT *, phase IN ('view', 'click') AND device_id % 2 = 0 AS is_normal, cpu < 52 AND mem < 68 AND disk > 20 AND device_id % 7 <> 1 AS is_low FROM tel) WINDOW d AS (PARTITION BY device_id)))
 WHERE CASE tier WHEN 'labelled' THEN is_normal WHEN 'low_pressure' THEN is_low ELSE true END GROUP BY tier"""
    ),
)
def b9_normal_rows(spark, folder):
    tel = telemetry(spark, folder)
    tel = tel.withColumns(
        {
            "label": F.when(F.col("phase").isin("view", "click") & (F.col("device_id") % 2 == 0), "Normal").otherwise("AUTO"),
            "cpu": F.when(F.col("device_id") % 7 == 1, 90.0).otherwise(F.col("cpu")),
        }
    )
    rows = R.normal_rows(tel, KEY, "label")
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("device_id").alias("devices"))


@query(
    "b10_name_lists",
    with_processes("SELECT name IN ('chrome.exe', 'vlc.exe') AS allowed, name IN ('csrss.exe', 'steam_updater.exe') AS denied, count(*) AS n FROM proc GROUP BY ALL"),
)
def b10_name_lists(spark, folder):
    rows = processes(spark, folder)
    allowed = K.in_name_list(F.col("name"), " Chrome.exe, vlc.exe,")
    denied = K.in_name_list(F.col("name"), "CSRSS.EXE,steam_updater.exe")
    return rows.groupBy(allowed.alias("allowed"), denied.alias("denied")).agg(F.count(F.lit(1)).alias("n"))


@query("b11_status_filters", audit_sql("SELECT level, count(*) AS n FROM aud WHERE level IN ('WARNING', 'CRITICAL') AND (hard_block OR target_protected) GROUP BY level"))
def b11_status_filters(spark, folder):
    rows = audits(spark, folder).where(F.col("level").isin("WARNING", "CRITICAL") & (F.col("hard_block") | F.col("target_protected")))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c1_summaries_with_episodes",
    """SELECT o_orderpriority, l_linestatus, count(*) AS summaries, round(sum(l_quantity), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def c1_summaries_with_episodes(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linestatus", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority", "l_linestatus").agg(F.count(F.lit(1)).alias("summaries"), r(F.sum("l_quantity"), 2).alias("total"))


@query(
    "c2_orphan_rows",
    """SELECT 'without_order' AS side, count(*) AS rows FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'with_order', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def c2_orphan_rows(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, name: customers.join(orders, "c_custkey", how).agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("rows"))
    return count("left_anti", "without_order").unionByName(count("left_semi", "with_order"))


@query(
    "c3_paired_runs",
    """WITH s AS (SELECT l_returnflag AS variant, l_orderkey % 50 AS iteration, l_linestatus AS run_type, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT c.variant, c.iteration, c.run_type, round(b.v, 6) AS baseline, round(c.v, 6) AS candidate FROM s c JOIN s b USING (iteration, run_type) WHERE b.variant = 'N' AND c.variant <> 'N'""",
)
def c3_paired_runs(spark, folder):
    from pulsefleet.operators.benchstats import pair_runs

    runs = table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("variant"), (F.col("l_orderkey") % 50).alias("iteration"), F.col("l_linestatus").alias("run_type")
    ).agg(F.avg("l_quantity").alias("p95"))
    pairs = pair_runs(runs, ["run_type"], baseline="N")
    return pairs.select("variant", "iteration", "run_type", r("baseline_p95").alias("baseline"), r("candidate_p95").alias("candidate"))


@query(
    "c4_variant_contracts",
    "SELECT l_linenumber, count(DISTINCT l_linestatus || l_returnflag) AS contracts FROM lineitem GROUP BY l_linenumber HAVING count(DISTINCT l_linestatus || l_returnflag) > 1",
)
def c4_variant_contracts(spark, folder):
    """Groups whose variants disagree on unit or direction."""
    from pulsefleet.operators.benchstats import contract_conflicts

    rows = table(spark, folder, "lineitem").select("l_linenumber", F.col("l_linestatus").alias("unit"), F.col("l_returnflag").alias("direction"))
    return contract_conflicts(rows, ["l_linenumber"])


@query(
    "c10_feature_reference_join",
    with_telemetry(
        """SELECT feature, count(*) AS rows, round(avg(abs(value - mean)), 6) AS mean_gap FROM
 (SELECT unnest([{'feature': 'cpu', 'value': cpu}, {'feature': 'mem', 'value': mem}, {'feature': 'net', 'value': net}], recursive := true) FROM tel) u
 JOIN (VALUES ('cpu', 40.0::DOUBLE), ('mem', 50.0::DOUBLE), ('disk', 60.0::DOUBLE)) ref(feature, mean) USING (feature) GROUP BY feature"""
    ),
)
def c10_feature_reference_join(spark, folder):
    from pulsefleet.operators.calibration import unpivot

    long = unpivot(telemetry(spark, folder), [], ["cpu", "mem", "net"])
    reference = spark.createDataFrame([("cpu", 40.0), ("mem", 50.0), ("disk", 60.0)], "feature string, mean double")
    joined = long.join(F.broadcast(reference), "feature")
    return joined.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), r(F.avg(F.abs(F.col("value") - F.col("mean")))).alias("mean_gap"))
