"""Scalar scores and rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class labels in id order, and the risk each label stands for.
LABELS = ("NORMAL", "WARNING", "CRITICAL", "RECOVERY")
LABEL_RISK = {"NORMAL": 18.0, "RECOVERY": 18.0, "WARNING": 66.0, "CRITICAL": 92.0}
UNKNOWN_RISK = 50.0


@dataclass(frozen=True)
class Thresholds:
    cpu: int = 80
    mem: int = 85
    disk: int = 10


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def pressure_parts(cpu, mem, disk, t: Thresholds = Thresholds()) -> tuple[Column, Column, Column]:
    """CPU, memory and disk pressure, each 0..100 relative to its threshold."""
    cpu, mem, disk = col(cpu), col(mem), col(disk)
    return (
        clamp(cpu / max(1, t.cpu) * 100.0),
        clamp(mem / max(1, t.mem) * 100.0),
        F.when(disk < t.disk, clamp((t.disk - disk) / max(1, t.disk) * 100.0)).otherwise(F.lit(0.0)),
    )


def pressure(cpu, mem, disk, t: Thresholds = Thresholds()) -> Column:
    c, m, d = pressure_parts(cpu, mem, disk, t)
    return clamp(c * 0.42 + m * 0.42 + d * 0.16)


def by_value(c: Column, table: Mapping[str, object], default) -> Column:
    """A ``when`` chain over a small fixed table."""
    chain = None
    for key, value in table.items():
        chain = F.when(c == key, F.lit(value)) if chain is None else chain.when(c == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """Value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def label_risk(label) -> Column:
    return by_value(col(label), LABEL_RISK, UNKNOWN_RISK)


def severity_rank(label) -> Column:
    """Severity order: RECOVERY and unknown labels rank with NORMAL."""
    return by_value(F.upper(F.trim(col(label))), {"CRITICAL": 2, "WARNING": 1}, 0)


def normalise_label(label) -> Column:
    text = F.regexp_replace(F.upper(col(label)), "[- ]", "_")
    return F.when(text.isin(*LABELS), text).otherwise(F.lit("AUTO"))


# -- live decision scores -------------------------------------------------------------------


def deviation_score(value, earlier_n, earlier_mean, earlier_std) -> Column:
    """Distance of a value from its earlier history; 0 before four earlier samples exist."""
    value, n, mean, std = col(value), col(earlier_n), col(earlier_mean), col(earlier_std)
    gap = F.abs(value - mean)
    return (
        F.when(F.coalesce(n, F.lit(0)) < 4, F.lit(0.0))
        .when(std < 1e-6, F.when(gap > 0, F.lit(50.0)).otherwise(F.lit(0.0)))
        .otherwise(clamp(gap / F.greatest(F.lit(1.0), std * 2.0) * 100.0))
    )


def anomaly_score(cpu, mem, disk, net, process, top_cpu, top_mem_mb, top_waste) -> Column:
    boost = (
        F.when(col(top_cpu) >= 45.0, 15.0).otherwise(0.0)
        + F.when(col(top_mem_mb) >= 500.0, 10.0).otherwise(0.0)
        + F.when(col(top_waste) >= 70.0, 8.0).otherwise(0.0)
    )
    return clamp(
        col(cpu) * 0.28 + col(mem) * 0.24 + col(disk) * 0.18 + col(net) * 0.15 + col(process) * 0.15 + boost
    )


def pressure_above(value, threshold: float) -> Column:
    value = col(value)
    if threshold <= 0:
        return F.lit(0.0)
    return F.when(value < threshold, clamp(value / threshold * 45.0)).otherwise(
        clamp(55.0 + (value - threshold) / max(1.0, 100.0 - threshold) * 45.0)
    )


def live_root_cause(cols: Mapping[str, Column], t: Thresholds = Thresholds()) -> Column:
    """Strongest of the live pressure signals as struct(name, score); the earlier one wins a tie.

    cols: cpu, mem, disk, net, process_count, net_deviation, process_deviation, top_cpu,
    top_private_mb, top_waste and, where measured, qoe, page_reads, disk_queue, input_ms.
    """
    c = cols
    disk = F.when(
        c["disk"] <= t.disk, clamp(55.0 + (t.disk - c["disk"]) / max(1, t.disk) * 45.0)
    ).otherwise(clamp((100.0 - c["disk"]) / 100.0 * 35.0))
    signals = [
        ("cpu", pressure_above(c["cpu"], t.cpu)),
        ("memory", pressure_above(c["mem"], t.mem)),
        ("disk", disk),
        ("network", clamp(c["net_deviation"] + F.least(F.lit(35.0), c["net"] / 512.0))),
        (
            "process_count",
            clamp(c["process_deviation"] + F.greatest(F.lit(0.0), (c["process_count"] - 180) / 2.0)),
        ),
    ]
    if "qoe" in c:
        only = lambda score: F.when(c["qoe"], score)
        signals += [
            ("paging_pressure", only(clamp(c["page_reads"] / 250.0 * 100.0))),
            ("disk_contention", only(clamp(c["disk_queue"] / 4.0 * 100.0))),
            ("foreground_latency", only(clamp(c["input_ms"]))),
        ]
    signals.append(
        (
            "process",
            clamp(
                c["top_cpu"] * 0.9 + F.least(F.lit(35.0), c["top_private_mb"] / 20.0) + c["top_waste"] * 0.45
            ),
        )
    )
    ranked = F.array(
        *[
            F.when(
                score.isNotNull(),
                F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")),
            )
            for place, (name, score) in enumerate(signals)
        ]
    )
    # The struct orders by score, then by place; callers read its name and score.
    return F.array_max(F.array_compact(ranked))


def fused_risk(
    ai_probability,
    ai_confidence,
    ai_source,
    anomaly,
    pressure_score,
    baseline_adjustment=0.0,
    qoe_adjustment=0.0,
) -> Column:
    """Weighted risk: the model weight depends on its source and confidence, pressure takes the rest."""
    weight = (
        F.when(col(ai_source) == "MODEL", 0.35 + 0.30 * clamp(col(ai_confidence)) / 100.0)
        .when(col(ai_source) == "FALLBACK", F.lit(0.35))
        .otherwise(F.lit(0.20))
    )
    rest = F.greatest(F.lit(0.0), 1.0 - weight - 0.25)
    return clamp(
        col(ai_probability) * weight
        + col(anomaly) * 0.25
        + col(pressure_score) * rest
        + baseline_adjustment
        + qoe_adjustment
    )


def qoe_adjustment(input_ms, page_reads, disk_queue, dropped_frames) -> Column:
    return (
        F.least(F.lit(7.0), F.greatest(F.lit(0.0), col(input_ms) - 25.0) / 10.0)
        + F.least(F.lit(5.0), col(page_reads) / 100.0)
        + F.least(F.lit(5.0), col(disk_queue) * 1.5)
        + F.least(F.lit(3.0), col(dropped_frames))
    )


def risk_level(risk, cpu, mem, disk, warning: float = 45.0, critical: float = 65.0) -> Column:
    emergency = (col(cpu) >= 97.0) | (col(mem) >= 97.0) | (col(disk) <= 3.0)
    return (
        F.when(emergency | (col(risk) >= critical), "CRITICAL")
        .when(col(risk) >= warning, "WARNING")
        .otherwise("NORMAL")
    )


# -- prediction payload and window diagnosis ------------------------------------------------


def prediction_payload(probabilities: Mapping[str, Column]) -> dict[str, Column]:
    """Expected risk, confidence, class and action from the class probabilities."""
    p = {name: F.coalesce(col(probabilities.get(name, F.lit(0.0))), F.lit(0.0)) for name in LABELS}
    ordered = F.sort_array(F.array(*p.values()), asc=False)
    top, second = F.element_at(ordered, 1), F.element_at(ordered, 2)
    risk = sum((p[name] * LABEL_RISK[name] for name in LABELS), F.lit(0.0))
    chosen = first_match([(p[name] == top, name) for name in LABELS[:-1]], LABELS[-1])
    return {
        "risk": F.round(clamp(risk), 4),
        "confidence": F.round((top * 0.72 + (top - second) * 0.28) * 100.0, 4),
        "predicted_class": chosen,
        "recommended_action": by_value(
            chosen, {"CRITICAL": "prepare_manual_review", "WARNING": "increase_observation"}, "monitor_only"
        ),
    }


def window_diagnosis(f: Mapping[str, Column], predicted_class, t: Thresholds = Thresholds()) -> Column:
    """Struct(primary, severity, score, reason, reasons) for one feature window.

    f: cpu, mem, disk, net (last values), cpu_slope, mem_slope, net_median, process_delta,
    top_cpu, top_mem.
    """
    label = col(predicted_class)
    entry = lambda when, name, score, reason: F.when(
        when,
        F.struct(
            (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"),
            F.lit(name).alias("primary"),
            F.lit(reason).alias("reason"),
        ),
    )
    signals = [
        entry(f["mem"] >= t.mem * 0.95, "memory", f["mem"] / max(1, t.mem), "memory near threshold"),
        entry(f["cpu"] >= t.cpu * 0.95, "cpu", f["cpu"] / max(1, t.cpu), "cpu near threshold"),
        entry(f["disk"] <= t.disk, "disk", (t.disk - f["disk"] + 1.0) / max(1, t.disk), "disk space low"),
        entry(f["mem_slope"] > 0.8, "memory", 0.75, "memory rising"),
        entry(f["cpu_slope"] > 1.5, "cpu", 0.70, "cpu rising"),
        entry(
            f["net"] > F.greatest(F.lit(1024.0), f["net_median"] * 2.5), "network", 0.65, "network spike"
        ),
        entry(f["process_delta"] >= 8, "process_count", 0.60, "process count rising"),
        entry(f["top_cpu"] >= 35.0, "top_process_cpu", f["top_cpu"] / 100.0, "top process cpu pressure"),
        entry(
            f["top_mem"] >= 700.0,
            "top_process_memory",
            F.least(F.lit(1.0), f["top_mem"] / 2000.0),
            "top process memory pressure",
        ),
        entry(label == "RECOVERY", "recovery", 0.70, "pressure improving"),
    ]
    calm = label == "NORMAL"
    fallback = F.array(
        F.struct(
            F.lit(0.20).alias("score"),
            F.when(calm, "stable").otherwise("forecast").alias("primary"),
            F.when(calm, "resource pattern stable").otherwise("forecast trend elevated").alias("reason"),
        )
    )
    listed = let(F.array_compact(F.array(*signals)), lambda found: F.when(F.size(found) > 0, found).otherwise(fallback))
    # Highest score first; the array order breaks ties, so carry the position.
    placed = F.transform(
        listed, lambda e, i: F.struct((-e["score"]).alias("k"), i.alias("i"), e.alias("e"))
    )
    ranked = F.transform(F.array_sort(placed), lambda e: e["e"])
    return let(F.struct(ranked.alias("ranked"), label.alias("label")), _diagnosis_fields)


def _diagnosis_fields(d: Column) -> Column:
    ranked, label = d["ranked"], d["label"]
    top = F.element_at(ranked, 1)
    return F.struct(
        top["primary"].alias("primary"),
        F.when((top["score"] >= 1.0) | (label == "CRITICAL"), "critical")
        .when(top["score"] >= 0.65, "warning")
        .otherwise("normal")
        .alias("severity"),
        F.round(F.least(F.lit(100.0), top["score"] * 100.0), 4).alias("score"),
        top["reason"].alias("reason"),
        F.transform(F.slice(ranked, 1, 3), lambda e: e["reason"]).alias("reasons"),
    )


# -- user intent, device and workload rules -------------------------------------------------

# Name and title tokens per application kind, in the order they are tested.
APP_KIND_TOKENS = (
    ("BROWSER", ("chrome", "msedge", "firefox", "brave", "opera", "vivaldi"), ()),
    ("IDE", ("code", "devenv", "clion", "pycharm", "idea", "studio"), ()),
    ("COMMUNICATION", ("teams", "zoom", "discord", "slack", "meet"), ()),
    ("MEDIA", ("vlc", "spotify", "wmplayer"), ("youtube", "netflix")),
    ("OFFICE", ("winword", "excel", "powerpnt", "onenote", "acrobat"), ()),
    ("TERMINAL", ("powershell", "pwsh", "cmd", "windowsterminal"), ()),
    ("SHELL", ("explorer",), ()),
    ("GAME", ("steam", "epicgames", "riot", "minecraft"), ("game",)),
)
PROTECTED_APP_KINDS = ("BROWSER", "IDE", "COMMUNICATION", "GAME", "MEDIA")


def has_any(text: Column, tokens: Sequence[str]) -> Column:
    return text.rlike("|".join(tokens)) if tokens else F.lit(False)


def app_kind(name, title) -> Column:
    name, title = F.lower(col(name)), F.lower(col(title))
    return first_match(
        [(has_any(name, in_name) | has_any(title, in_title), kind) for kind, in_name, in_title in APP_KIND_TOKENS],
        "UNKNOWN",
    )


def user_state(idle_seconds) -> Column:
    idle = col(idle_seconds)
    return F.when(idle < 30.0, "ACTIVE").when(idle < 300.0, "IDLE").otherwise("AWAY")


def foreground_behaviour(is_fullscreen, state, foreground_pid) -> Column:
    return (
        F.when(col(is_fullscreen), "FULLSCREEN")
        .when(col(state) == "AWAY", "AWAY")
        .when(col(foreground_pid) == 0, "NO_FOREGROUND")
        .otherwise("INTERACTIVE")
    )


def device_tiers(memory_mb, logical_cpus, on_ac) -> dict[str, Column]:
    return {
        "cpu_core_tier": F.concat(col(logical_cpus).cast("string"), F.lit("_LOGICAL")),
        "ram_tier": F.concat(F.floor((col(memory_mb) + 511) / 1024).cast("string"), F.lit("GB")),
        "power_mode": F.when(col(on_ac), "AC").otherwise("BATTERY_OR_UNKNOWN"),
    }


# Workload phases; positions 1..10 are the one-hot slots of the context vector.
WORKLOAD_PHASES = (
    "UNKNOWN",
    "APP_LAUNCHING",
    "ACTIVE_INTERACTION",
    "PASSIVE_PLAYBACK",
    "COMPILATION",
    "GAMING",
    "VIDEO_MEETING",
    "LARGE_FILE_TRANSFER",
    "USER_IDLE",
    "BATTERY_SAVER",
    "POST_BOOT_STABILIZATION",
)


def workload_phase(c: Mapping[str, Column]) -> Column:
    """First matching workload phase.

    c: uptime_ms, user_state, idle_seconds, on_battery, battery_percent, app_kind, is_fullscreen,
    compiler_busy, net_kbps, top_io_kbps, foreground_pid, focus_seconds, input_available, input_ms.
    """
    kind, full = c["app_kind"], c["is_fullscreen"]
    return first_match(
        [
            (c["uptime_ms"] < 180000, "POST_BOOT_STABILIZATION"),
            ((c["user_state"] == "AWAY") | (c["idle_seconds"] >= 300.0), "USER_IDLE"),
            (c["on_battery"] & (c["battery_percent"] <= 25), "BATTERY_SAVER"),
            (kind == "COMMUNICATION", "VIDEO_MEETING"),
            ((kind == "GAME") | (full & (kind != "MEDIA")), "GAMING"),
            ((kind == "MEDIA") | ((kind == "BROWSER") & full & (c["idle_seconds"] >= 5.0)), "PASSIVE_PLAYBACK"),
            (c["compiler_busy"], "COMPILATION"),
            ((c["net_kbps"] >= 2048.0) | (c["top_io_kbps"] >= 4096.0), "LARGE_FILE_TRANSFER"),
            ((c["foreground_pid"] != 0) & (c["focus_seconds"] <= 8.0), "APP_LAUNCHING"),
            (c["user_state"] == "ACTIVE", "ACTIVE_INTERACTION"),
            (c["input_available"] & (c["input_ms"] > 50.0), "ACTIVE_INTERACTION"),
        ],
        "UNKNOWN",
    )


def context_vector(c: Mapping[str, Column]) -> Column:
    """22 numbers: a constant, eleven scaled measurements and the one-hot workload phase.

    c: cpu, mem, disk, input_ms, page_reads, disk_queue, dropped_frames, criticality, safety,
    total_memory_mb, net_kbps, phase.
    """
    scaled = [
        F.lit(1.0),
        clamp(c["cpu"] / 100.0, 0.0, 1.0),
        clamp(c["mem"] / 100.0, 0.0, 1.0),
        clamp((10.0 - c["disk"]) / 10.0, 0.0, 1.0),
        clamp(c["input_ms"] / 100.0, 0.0, 2.0),
        clamp(c["page_reads"] / 500.0, 0.0, 2.0),
        clamp(c["disk_queue"] / 5.0, 0.0, 2.0),
        clamp(c["dropped_frames"] / 10.0, 0.0, 2.0),
        clamp(c["criticality"] / 100.0, 0.0, 1.0),
        clamp(c["safety"] / 100.0, 0.0, 1.0),
        clamp(c["total_memory_mb"] / 8192.0, 0.0, 2.0),
        clamp(c["net_kbps"] / 4096.0, 0.0, 2.0),
    ]
    hot = [F.when(c["phase"] == phase, 1.0).otherwise(0.0) for phase in WORKLOAD_PHASES[1:]]
    return F.array(*scaled, *hot)


def evidence_decision(
    safety_required, tier, maximum_tier, risk_reduction, cpu_cost, latency_ms, minimum: float = 0.20
) -> Column:
    """Struct(collect, reason): is a measurement worth its cost under the governor's tier cap."""
    gain = col(risk_reduction)
    cost = F.greatest(F.lit(0.1), col(cpu_cost) + col(latency_ms) / 10.0)
    reason = first_match(
        [
            (col(safety_required), "safety_required"),
            (col(tier) > col(maximum_tier), "governor_tier_cap"),
            (gain <= 0.0, "no_expected_value"),
            (gain / cost >= minimum, "positive_risk_reduction"),
        ],
        "insufficient_risk_reduction",
    )
    return F.struct(
        reason.isin("safety_required", "positive_risk_reduction").alias("collect"), reason.alias("reason")
    )


# -- small statistics -----------------------------------------------------------------------


def relative_improvement(baseline, candidate, direction) -> Column:
    baseline, candidate = col(baseline), col(candidate)
    gain = F.when(col(direction) == "lower", baseline - candidate).otherwise(candidate - baseline)
    return F.when(baseline == 0, F.lit(0.0)).otherwise(gain / F.abs(baseline))


def wilson_lower(successes, total, z: float = 1.96) -> Column:
    k, n = col(successes).cast("double"), col(total).cast("double")
    p = k / n
    margin = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n)
    bound = (p + z * z / (2.0 * n) - margin) / (1.0 + z * z / n)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), bound))


def ratio(numerator, denominator) -> Column:
    """Quotient that is 0 for an empty denominator."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def drift_level(shift, drop) -> Column:
    shift, drop = col(shift), col(drop)
    return first_match(
        [
            ((shift >= 6.0) | (drop >= 0.30), "CERTIFICATE_INVALID"),
            ((shift >= 4.0) | (drop >= 0.20), "DETERMINISTIC_MONITOR_ONLY"),
            ((shift >= 2.5) | (drop >= 0.10), "RECOMMENDATION_ONLY"),
            ((shift >= 1.5) | (drop >= 0.05), "COLLECT_MORE_EVIDENCE"),
        ],
        "NORMAL",
    )


PREDICTION_FIELDS = (
    "risk double, probability double, confidence double, class string, reason string, "
    "root_cause struct<primary:string,severity:string>, model_readiness string, "
    "model_generated_at string, feature_count double, recommended_action string, safe_to_heal boolean"
)


def parse_prediction(text) -> Column:
    """Struct of the prediction fields in a payload; a bare number is a plain risk value.

    A payload that is not readable, or whose risk is outside 0..100, gives risk -1.
    """
    text = col(text)
    is_object = F.substring(text, 1, 1) == "{"
    parsed = F.struct(
        F.from_json(F.when(is_object, text), PREDICTION_FIELDS).alias("obj"),
        is_object.alias("is_object"),
        F.when(~is_object, text.try_cast("double")).alias("number"),
    )
    return let(parsed, _prediction_fields)


def _prediction_fields(parsed: Column) -> Column:
    obj, is_object = parsed["obj"], parsed["is_object"]
    risk = F.coalesce(obj["risk"], obj["probability"], parsed["number"], F.lit(-1.0))
    valid = (risk >= 0.0) & (risk <= 100.0)
    pick = lambda of_object, of_number: F.when(is_object, of_object).otherwise(of_number)
    keep = lambda value, default: F.when(valid, value).otherwise(F.lit(default))
    named = lambda field, default: F.coalesce(F.nullif(field, F.lit("")), F.lit(default))
    by_risk = F.when(risk >= 75.0, "CRITICAL").when(risk >= 55.0, "WARNING").otherwise("NORMAL")
    cause = obj["root_cause"]
    return F.struct(
        F.when(valid, risk).otherwise(F.lit(-1.0)).alias("risk"),
        keep(clamp(pick(F.coalesce(obj["confidence"], F.lit(0.0)), F.lit(55.0))), 0.0).alias("confidence"),
        keep(pick(named(obj["class"], "UNKNOWN"), by_risk), "UNKNOWN").alias("predicted_class"),
        keep(pick(named(obj["reason"], "N/A"), F.lit("legacy model probability")), "N/A").alias("reason"),
        keep(pick(named(cause["primary"], "unknown"), F.lit("legacy_probability")), "unknown").alias("root_cause"),
        keep(pick(named(cause["severity"], "normal"), F.lit("normal")), "normal").alias("severity"),
        keep(pick(named(obj["model_readiness"], "unknown"), F.lit("unknown")), "unknown").alias("readiness"),
        keep(pick(F.coalesce(obj["feature_count"], F.lit(0.0)).cast("int"), F.lit(0)), 0).alias("feature_count"),
        keep(pick(named(obj["recommended_action"], "monitor_only"), F.lit("monitor_only")), "monitor_only").alias(
            "recommended_action"
        ),
        keep(pick(F.coalesce(obj["safe_to_heal"], F.lit(False)), F.lit(False)), False).alias("safe_to_heal"),
    )
