"""Process rows: waste scores, classification, ranking, candidates and recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators.tables import in_name_list

# Process names and name tokens per class.
CRITICAL_NAMES = (
    "system", "registry", "idle", "smss.exe", "csrss.exe", "wininit.exe", "winlogon.exe", "services.exe",
    "lsass.exe", "svchost.exe", "fontdrvhost.exe", "dwm.exe", "spoolsv.exe", "audiodg.exe", "conhost.exe",
    "wudfhost.exe",
)
SECURITY_NAMES = (
    "msmpeng.exe", "securityhealthservice.exe", "securityhealthsystray.exe", "nissrv.exe", "senseir.exe",
    "mssense.exe", "mpdefendercoreservice.exe",
)
SECURITY_TOKENS = ("antivirus", "defender", "firewall")
BROWSER_NAMES = (
    "chrome.exe", "msedge.exe", "firefox.exe", "brave.exe", "opera.exe", "vivaldi.exe", "browser.exe",
)
UPDATER_TOKENS = (
    "update", "updater", "onedrive", "googledrive", "dropbox", "steam", "adobe", "teams", "slack", "sync",
)
AUDIO_VIDEO_NAMES, AUDIO_VIDEO_TOKENS = ("audiodg.exe",), ("zoom", "teams", "discord", "obs", "vlc")
COMPILER_NAMES, COMPILER_TOKENS = ("cl.exe", "link.exe", "msbuild.exe"), ("clang", "gcc", "ninja")
SERVICE_PATHS = ("\\windows\\system32\\", "\\windows\\syswow64\\")
PROTECTED_SAFETY = ("PROTECTED", "USER_ACTIVE")
FOREGROUND_CATEGORIES = ("FOREGROUND_APP", "FOREGROUND_FULLSCREEN_APP", "ACTIVE_APP_FAMILY", "RECENT_USER_APP")


def named(name: Column, names: Sequence[str], tokens: Sequence[str] = ()) -> Column:
    lowered = F.lower(name)
    return lowered.isin(*names) | S.has_any(lowered, tokens) if tokens else lowered.isin(*names)


def is_audio_video(name: Column) -> Column:
    return named(name, AUDIO_VIDEO_NAMES, AUDIO_VIDEO_TOKENS)


def is_compiler(name: Column) -> Column:
    return named(name, COMPILER_NAMES, COMPILER_TOKENS)


def waste_score() -> Column:
    io = F.col("io_read_kbps") + F.col("io_write_kbps")
    return S.clamp(
        F.least(F.lit(40.0), F.col("cpu") * 1.8)
        + F.least(F.lit(38.0), F.col("private_mb") / 18.0)
        + F.least(F.lit(22.0), io / 250.0)
        + F.when(F.col("has_visible_window"), 0.0).otherwise(8.0)
        + F.when((F.col("lifetime_sec") > 300.0) & (F.col("private_mb") > 250.0), 6.0).otherwise(0.0)
    )


def with_intent(processes: DataFrame, intents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Process rows with the intent columns of their tick; a tick without intent has no foreground."""
    joined = processes.join(intents, list(keys), "left")
    return joined.withColumns(
        {
            "foreground_pid": F.coalesce("foreground_pid", F.lit(0)),
            "foreground_process": F.coalesce("foreground_process", F.lit("")),
            "is_fullscreen": F.coalesce("is_fullscreen", F.lit(False)),
            "recent_pids": F.coalesce("recent_pids", F.array().cast("array<bigint>")),
        }
    )


# Fixed values per category: safety when trusted and when not, importance, safety score when trusted
# and when not, reclaimable shares of private memory and working set, recommendation, and the waste
# score from which the second recommendation applies.
CLASSES = (
    ("SYSTEM_CRITICAL", "PROTECTED", "PROTECTED", 100.0, 0.0, 0.0, 0.0, 0.0, "protect", None, None),
    ("SECURITY", "PROTECTED", "PROTECTED", 100.0, 0.0, 0.0, 0.0, 0.0, "protect", None, None),
    ("FOREGROUND_FULLSCREEN_APP", "USER_ACTIVE", "USER_ACTIVE", 100.0, 0.0, 0.0, 0.0, 0.0, "protect_fullscreen_app", None, None),
    ("FOREGROUND_APP", "USER_ACTIVE", "USER_ACTIVE", 95.0, 5.0, 5.0, 0.0, 0.0, "protect_foreground", None, None),
    ("ACTIVE_APP_FAMILY", "USER_ACTIVE", "USER_ACTIVE", 88.0, 8.0, 8.0, 0.0, 0.0, "protect_active_app_family", None, None),
    ("RECENT_USER_APP", "OBSERVE_ONLY", "OBSERVE_ONLY", 82.0, 18.0, 18.0, 0.0, 0.0, "observe_recent_user_app", None, None),
    ("USER_APP", "OBSERVE_ONLY", "OBSERVE_ONLY", 78.0, 25.0, 25.0, 0.0, 0.0, "observe_visible_app", None, None),
    ("BROWSER_CHILD", "CANDIDATE", "CAUTIOUS", 42.0, 68.0, 45.0, 0.55, 0.45, "observe_browser_child", 55.0, "sleep_or_trim_candidate"),
    ("UPDATER_SYNC", "CANDIDATE", "CAUTIOUS", 30.0, 76.0, 48.0, 0.60, 0.50, "observe_updater", 45.0, "delay_or_lower_priority_candidate"),
    ("WINDOWS_SERVICE", "OBSERVE_ONLY", "OBSERVE_ONLY", 72.0, 20.0, 20.0, 0.0, 0.0, "observe_service", None, None),
    ("BACKGROUND_HELPER", "CANDIDATE", "CANDIDATE", 38.0, 62.0, 62.0, 0.50, 0.40, "observe_background_helper", 50.0, "lower_priority_or_trim_candidate"),
    ("UNKNOWN", "CAUTIOUS", "CAUTIOUS", 58.0, 35.0, 35.0, 0.0, 0.0, "observe_unknown", None, None),
)
CLASS_REASONS = {
    "SYSTEM_CRITICAL": "critical windows process",
    "SECURITY": "security/antivirus process",
    "BROWSER_CHILD": "browser background process",
    "UPDATER_SYNC": "updater/sync style process",
    "WINDOWS_SERVICE": "windows service context",
    "UNKNOWN": "unknown process identity",
}


def class_table(spark: SparkSession) -> DataFrame:
    """The class dimension: one row per category and trust, 24 rows in all."""
    rows = []
    for name, safe, unsafe, weight, score, low, private, working, quiet, busy_at, busy in CLASSES:
        rest = (private, working, quiet, busy_at, busy, CLASS_REASONS.get(name))
        rows += [(name, True, safe, weight, score, *rest), (name, False, unsafe, weight, low, *rest)]
    return spark.createDataFrame(
        rows,
        "category string, __trusted boolean, safety string, importance_score double, safety_score double, "
        "__private double, __working double, __quiet string, __busy_at double, __busy string, __why string",
    )


def classify(df: DataFrame) -> DataFrame:
    """Category, safety, scores, intent flags, recommendation and reasons of each process row.

    Needs the process columns and the intent columns of ``with_intent``. The category is decided
    once, by the first matching rule; everything else is looked up from it.
    """
    name, pid, front = F.col("name"), F.col("pid"), F.col("foreground_pid")
    is_front = (pid != 0) & (pid == front)
    shields = F.coalesce(F.col("app_kind").isin(*S.PROTECTED_APP_KINDS), F.lit(False))
    same_name = (F.col("foreground_process") != "") & (name != "") & (F.lower(name) == F.lower("foreground_process"))
    df = df.withColumns(
        {
            "__front": is_front,
            "__recent": F.array_contains("recent_pids", pid),
            "__family": shields & (same_name | ((pid == front) & (F.col("foreground_process") != "") & (name != ""))),
            "__trusted": F.coalesce(F.col("trusted_path") | F.col("signed_trusted"), F.lit(False)),
            "waste_score": waste_score(),
            "is_foreground": F.col("is_foreground") | is_front,
            "is_system_critical": (pid <= 4) | named(name, CRITICAL_NAMES),
        }
    )
    path = F.lower("exe_path")
    service = (F.col("session_id") == 0) | path.contains(SERVICE_PATHS[0]) | path.contains(SERVICE_PATHS[1])
    category = S.first_match(
        [
            (F.col("is_system_critical"), "SYSTEM_CRITICAL"),
            (named(name, SECURITY_NAMES, SECURITY_TOKENS), "SECURITY"),
            (F.col("__front") & F.col("is_fullscreen"), "FOREGROUND_FULLSCREEN_APP"),
            (F.col("is_foreground"), "FOREGROUND_APP"),
            (F.col("__family"), "ACTIVE_APP_FAMILY"),
            (F.col("__recent"), "RECENT_USER_APP"),
            (F.col("has_visible_window"), "USER_APP"),
            (named(name, BROWSER_NAMES), "BROWSER_CHILD"),
            (S.has_any(F.lower(name), UPDATER_TOKENS), "UPDATER_SYNC"),
            (service, "WINDOWS_SERVICE"),
            (F.col("__trusted"), "BACKGROUND_HELPER"),
        ],
        "UNKNOWN",
    )
    # A one-element inline keeps the rule chain in one place: filters on the category are applied to
    # its result instead of being pushed below it as another copy of the chain.
    df = df.select("*", F.inline(F.array(F.struct(category.alias("category")))))
    # A join, not a chain of conditions per output: filters on the outputs stay short expressions.
    df = df.join(F.broadcast(class_table(df.sparkSession)), ["category", "__trusted"])
    io = F.col("io_read_kbps") + F.col("io_write_kbps")
    says = lambda condition, text: F.when(condition, F.lit(text))
    reasons = (
        says(F.col("cpu") >= 20.0, "high cpu"),
        says(F.col("private_mb") >= 350.0, "high private memory"),
        says(F.col("working_set_mb") >= 500.0, "large working set"),
        says(io >= 1024.0, "active disk io"),
        says(~F.col("has_visible_window"), "background or hidden"),
        says(F.col("is_foreground"), "foreground user app"),
        says(F.col("__recent"), "recently active user app"),
        F.when(F.col("__family"), F.concat(F.lit("same family as active "), F.col("app_kind"))),
        says(F.col("is_fullscreen") & F.col("__front"), "fullscreen foreground app"),
        says(F.col("__trusted"), "trusted install path/signature"),
        F.col("__why"),
    )
    role = (
        F.when(F.col("__front"), F.when(F.col("is_fullscreen"), "foreground_fullscreen").otherwise("foreground"))
        .when(F.col("__family"), "active_app_family")
        .when(F.col("__recent"), "recent_app")
        .otherwise("none")
    )
    gain = F.least(F.col("private_mb") * F.col("__private"), F.col("working_set_mb") * F.col("__working"))
    return df.withColumns(
        {
            "expected_gain_mb": F.greatest(F.lit(0.0), gain),
            "recommendation": F.when(F.col("waste_score") >= F.col("__busy_at"), F.col("__busy")).otherwise(F.col("__quiet")),
            "reasons": F.array_compact(F.array(*reasons)),
            "reason": reason_text(F.array_compact(F.array(*reasons))),
            "is_recently_active": F.col("__recent"),
            "matches_user_intent": F.col("__front") | F.col("__recent") | F.col("__family"),
            "intent_role": role,
        }
    ).drop(*[c for c in df.columns if c.startswith("__")])


def reason_text(reasons: Column) -> Column:
    """The first three reasons, or that there is none."""
    return F.when(F.size(reasons) == 0, "no strong signal yet").otherwise(F.array_join(F.slice(reasons, 1, 3), ", "))


def pressure_rank() -> Column:
    """Rank that picks the processes kept per tick."""
    safety = F.col("safety")
    return (
        F.col("waste_score")
        + F.col("safety_score") * 0.55
        - F.col("importance_score") * 0.35
        - F.when(safety == "PROTECTED", 100.0).when(safety == "USER_ACTIVE", 80.0).when(safety == "OBSERVE_ONLY", 25.0).otherwise(0.0)
        + F.when(F.col("expected_gain_mb") >= 250.0, 8.0).otherwise(0.0)
        + F.when(F.col("cpu") >= 15.0, 6.0).otherwise(0.0)
    )


def top_processes(df: DataFrame, tick: Sequence[str], ordinal: Sequence[str], limit: int = 20) -> DataFrame:
    """The highest ranked processes of each tick; ``ordinal`` keeps the sort stable on ties."""
    ranked = df.withColumn("pressure_rank", pressure_rank())
    w = Window.partitionBy(*tick).orderBy(F.col("pressure_rank").desc(), *ordinal)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def policy_protected() -> Column:
    return (
        F.col("safety").isin(*PROTECTED_SAFETY)
        | F.col("is_system_critical")
        | F.col("is_foreground")
        | F.col("matches_user_intent")
        | F.col("is_recently_active")
    )


def candidate_rank() -> Column:
    return (
        F.col("waste_score")
        + F.col("safety_score") * 0.65
        + F.least(F.lit(18.0), F.col("expected_gain_mb") / 32.0)
        + F.least(F.lit(16.0), F.col("cpu") * 0.8)
        + F.least(F.lit(14.0), F.col("private_mb") / 90.0)
        - F.col("importance_score") * 0.40
        - F.when(F.col("safety") == "CAUTIOUS", 14.0).when(F.col("safety") == "OBSERVE_ONLY", 28.0).otherwise(0.0)
        - F.when(policy_protected(), 150.0).otherwise(0.0)
        - F.when((F.col("expected_gain_mb") <= 0.0) & (F.col("cpu") < 12.0), 10.0).otherwise(0.0)
    )


def best_candidates(
    df: DataFrame,
    tick: Sequence[str],
    ordinal: Sequence[str],
    allow: str = "",
    deny: str = "",
    protected: DataFrame | None = None,
) -> DataFrame:
    """Best optimisation candidate of each tick and how many were eligible.

    protected holds (tick, pid) on the critical path; it is removed by an anti join.
    """
    open_rows = df if protected is None else df.join(protected.select(*tick, "pid"), [*tick, "pid"], "left_anti")
    name = F.col("name")
    eligible = open_rows.withColumns({"__deny": in_name_list(name, deny), "allowed_by_policy": in_name_list(name, allow)}).where(
        ~F.col("__deny") & ~policy_protected() & ~((F.col("safety_score") < 35.0) & (F.col("safety") != "CANDIDATE"))
    )
    ranked = eligible.withColumn("rank", candidate_rank())
    # The first of equal ranks wins, so the negated ordinal breaks ties.
    best = F.max_by(
        F.struct("pid", "name", "category", "safety", "safety_score", "expected_gain_mb", "rank", "allowed_by_policy"),
        F.struct("rank", *[(-F.col(o)).alias(f"o{i}") for i, o in enumerate(ordinal)]),
    )
    return ranked.groupBy(*tick).agg(best.alias("best"), F.count(F.lit(1)).alias("candidate_count")).select(
        *tick, "best.*", "candidate_count"
    )


def recommended_action(root_cause: Column, has_target: Column) -> Column:
    """Action for a root cause; most need a target process."""
    needs = lambda action: F.when(has_target, F.lit(action)).otherwise(F.lit("increase_observation"))
    return S.first_match(
        [
            (root_cause == "disk", "review_disk_cleanup"),
            (root_cause == "network", "review_network_activity"),
            (root_cause == "paging_pressure", needs("dry_run_lower_memory_priority")),
            (root_cause.isin("disk_contention", "foreground_latency", "cpu"), needs("dry_run_lower_priority")),
            (root_cause == "memory", needs("dry_run_memory_trim")),
            (root_cause.isin("process", "process_count"), needs("dry_run_sleep_candidate")),
        ],
        "increase_observation",
    )


@dataclass(frozen=True)
class AutopilotRules:
    max_actions: int = 4
    weak_memory_mb: float = 4608.0
    memory_pressure: float = 78.0
    cpu_pressure: float = 70.0
    disk_free_pressure: float = 8.0
    min_safety: float = 55.0


def autopilot_recommendations(
    df: DataFrame, tick: Sequence[str], ordinal: Sequence[str], rules: AutopilotRules = AutopilotRules()
) -> DataFrame:
    """Up to ``max_actions`` reversible background actions per tick, ranked."""
    category, safety = F.col("category"), F.col("safety")
    protected = (
        F.col("is_foreground")
        | F.col("is_recently_active")
        | F.col("matches_user_intent")
        | (safety == "USER_ACTIVE")
        | category.isin(*FOREGROUND_CATEGORIES)
    )
    background = category.isin("UPDATER_SYNC", "BROWSER_CHILD", "BACKGROUND_HELPER")
    wanted = (
        (F.col("pid") != 0)
        & ~protected
        & (safety != "PROTECTED")
        & ~F.col("is_system_critical")
        & (F.col("safety_score") >= rules.min_safety)
        & ((F.col("waste_score") >= 35.0) | (F.col("private_mb") >= 160.0) | (F.col("cpu") >= 8.0) | background)
    )
    rank = F.greatest(
        F.lit(0.0),
        F.col("waste_score") * 1.25
        + F.col("safety_score") * 0.70
        + F.least(F.lit(28.0), F.col("private_mb") / 18.0)
        + F.least(F.lit(18.0), F.col("cpu") * 1.1)
        + S.by_value(category, {"UPDATER_SYNC": 28.0, "BROWSER_CHILD": 24.0, "BACKGROUND_HELPER": 14.0}, 0.0)
        + F.when(F.col("has_visible_window"), 0.0).otherwise(10.0)
        + S.by_value(safety, {"CANDIDATE": 10.0, "CAUTIOUS": -10.0}, 0.0)
        + F.when(F.col("signed_trusted") | F.col("trusted_path"), 4.0).otherwise(0.0),
    )
    action = S.first_match(
        [
            (category == "UPDATER_SYNC", "delay_background_updater"),
            (category == "BROWSER_CHILD", "sleep_unused_browser_helper"),
            ((F.col("private_mb") >= 180.0) | (F.col("working_set_mb") >= 260.0), "trim_background_working_set"),
            (F.col("cpu") >= 8.0, "lower_background_priority"),
        ],
        "observe_background_candidate",
    )
    kind = S.by_value(
        action,
        {
            "delay_background_updater": "sync_control",
            "sleep_unused_browser_helper": "browser_helper",
            "trim_background_working_set": "memory_pressure",
            "lower_background_priority": "cpu_pressure",
        },
        "observation",
    )
    visible = F.col("has_visible_window") | F.upper(category).rlike("USER_APP|FOREGROUND|RECENT")
    ranked = df.where(wanted).withColumn("__rank", rank)
    w = Window.partitionBy(*tick).orderBy(F.col("__rank").desc(), *ordinal)
    return (
        ranked.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= rules.max_actions)
        .withColumns(
            {
                "action_type": kind,
                "action_name": action,
                "expected_ram_mb": F.greatest(F.lit(0.0), F.col("expected_gain_mb")),
                "expected_cpu_drop": F.least(F.lit(18.0), F.greatest(F.lit(0.0), F.col("cpu") * 0.55)),
                "user_app_touched": visible,
                "reversible": F.lit(True),
            }
        )
        .drop("__rank")
    )


def autopilot_results(
    systems: DataFrame, recommendations: DataFrame, tick: Sequence[str], rules: AutopilotRules = AutopilotRules()
) -> DataFrame:
    """Status of each tick from its system sample and its recommendations.

    systems: tick, cpu, mem, disk, total_memory_mb, risk, level, baseline_anomaly, plan_gain_mb.
    """
    per_tick = recommendations.groupBy(*tick).agg(
        F.count(F.lit(1)).alias("actions_recommended"),
        F.sum("expected_ram_mb").alias("__ram"),
        F.sum("expected_cpu_drop").alias("__cpu"),
        F.count_if("user_app_touched").alias("user_apps_touched"),
        F.min_by("action_name", "rank").alias("primary_action"),
        F.min_by("name", "rank").alias("primary_target"),
    )
    rows = systems.join(per_tick, list(tick), "left").fillna(0, ["actions_recommended", "user_apps_touched"])
    low_end = (F.col("total_memory_mb") > 0.0) & (F.col("total_memory_mb") <= rules.weak_memory_mb)
    active = (
        low_end
        | (F.col("mem") >= rules.memory_pressure)
        | (F.col("cpu") >= rules.cpu_pressure)
        | (F.col("disk") <= rules.disk_free_pressure)
        | (F.col("level") != "NORMAL")
    )
    disk = F.when(F.col("disk") <= rules.disk_free_pressure, S.clamp((rules.disk_free_pressure - F.col("disk")) * 12.5)).otherwise(0.0)
    pressure = S.clamp(
        S.clamp(F.col("mem")) * 0.46 + S.clamp(F.col("cpu")) * 0.30 + F.col("risk") * 0.16 + F.col("baseline_anomaly") * 0.08 + disk
    )
    status = S.first_match(
        [
            ((F.col("actions_recommended") > 0) & (F.col("user_apps_touched") == 0), "READY_DRY_RUN"),
            (F.col("actions_recommended") > 0, "REVIEW_REQUIRED"),
            (active, "NO_SAFE_TARGET"),
        ],
        "OBSERVING",
    )
    return rows.withColumns(
        {
            "low_end_device": low_end,
            "active": active,
            "pressure_score": pressure,
            "estimated_ram_mb": F.least(F.coalesce("__ram", F.lit(0.0)), F.col("plan_gain_mb") + 1536.0),
            "estimated_cpu_drop": S.clamp(F.least(F.coalesce("__cpu", F.lit(0.0)), F.lit(45.0))),
            "status": status,
        }
    ).drop("__ram", "__cpu")
