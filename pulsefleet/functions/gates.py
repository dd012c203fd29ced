"""Decision gates as column expressions: mechanism check, cascade, certificate, policy, impact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S


def mechanism_check(c: Mapping[str, Column]) -> Column:
    """Struct(root_cause, support, sufficient, action_allowed, reason) from measured evidence.

    c: telemetry_complete, qoe_degraded, memory, hard_faults, storage_latency, storage_queue, cpu,
    runnable, process_storm, thermal, network, reversible.
    """
    entered = c["telemetry_complete"] & c["qoe_degraded"]
    found = S.first_match(
        [
            (~entered, F.struct(F.lit("UNKNOWN").alias("cause"), F.lit(0.0).alias("support"))),
            *[
                (condition, F.struct(F.lit(cause).alias("cause"), F.lit(support).alias("support")))
                for cause, support, condition in (
                    ("MEMORY_PAGING", 0.90, (c["memory"] >= 85.0) & (c["hard_faults"] >= 20.0)),
                    ("STORAGE_LATENCY", 0.90, (c["storage_latency"] >= 30.0) & (c["storage_queue"] >= 1.0)),
                    ("CPU_SCHEDULING", 0.80, (c["cpu"] >= 80.0) & (c["runnable"] >= 0.70)),
                    ("PROCESS_STORM", 0.80, c["process_storm"] >= 0.75),
                    ("THERMAL_POWER", 0.80, c["thermal"] >= 25.0),
                    ("NETWORK_CONTENTION", 0.80, c["network"] >= 80.0),
                )
            ],
        ],
        F.struct(F.lit("UNKNOWN").alias("cause"), F.lit(0.0).alias("support")),
    )
    enough = found["support"] >= 0.75
    allowed = enough & c["reversible"]
    reason = S.first_match(
        [
            (~c["telemetry_complete"], "telemetry_incomplete"),
            (~c["qoe_degraded"], "no_user_impact_to_explain"),
            (found["cause"] == "UNKNOWN", "no_supported_mechanism"),
            (allowed, "mechanism_supported_reversible_recommendation"),
            (enough, "mechanism_supported_but_action_not_reversible"),
        ],
        "insufficient_mechanistic_evidence",
    )
    return F.struct(
        found["cause"].alias("root_cause"),
        found["support"].alias("support"),
        enough.alias("sufficient"),
        allowed.alias("action_allowed"),
        reason.alias("reason"),
    )


def cascade(c: Mapping[str, Column], mechanism_sufficient: Column) -> Column:
    """Struct(route, specialist, temporal_model, accepted, reason).

    c: telemetry_complete, anomaly, cpu, memory, disk_latency, probability, disagreement, ood,
    error_bound, envelope_match, missingness_ok, causal_support.
    """
    stable = (c["anomaly"] < 0.15) & (c["cpu"] < 70.0) & (c["memory"] < 80.0) & (c["disk_latency"] < 20.0)
    complete = c["telemetry_complete"]
    route = S.first_match(
        [(~complete, "ESCALATE"), (stable, "STABLE"), (c["anomaly"] < 0.55, "POSSIBLE_EVENT")], "ESCALATE"
    )
    abstain = (
        (c["disagreement"] > 0.20)
        | (c["ood"] > 0.25)
        | (c["error_bound"] > 0.10)
        | ~c["envelope_match"]
        | ~c["missingness_ok"]
        | ~c["causal_support"]
        | ~mechanism_sufficient
    )
    accepted = complete & ~stable & ~abstain & (c["probability"] >= 0.50)
    reason = S.first_match(
        [
            (~complete, "telemetry_incomplete_escalate"),
            (stable, "sentinel_stable_monitoring_only"),
            (abstain, "failure_critic_abstained"),
            (accepted, "specialist_and_critic_support_recommendation"),
        ],
        "specialist_event_below_recommendation_threshold",
    )
    calm = complete & stable
    return F.struct(
        route.alias("route"),
        (~calm).alias("specialist"),
        (route == "ESCALATE").alias("temporal_model"),
        accepted.alias("accepted"),
        reason.alias("reason"),
    )


# Drift levels in order of severity.
DRIFT_LEVELS = (
    "NORMAL",
    "COLLECT_MORE_EVIDENCE",
    "RECOMMENDATION_ONLY",
    "DETERMINISTIC_MONITOR_ONLY",
    "CERTIFICATE_INVALID",
)
ENVELOPE = ("windows_build_family", "cpu_core_tier", "ram_tier", "storage_tier", "workload_class")


def reliability_gate(cert: Mapping[str, Column], row: Mapping[str, Column]) -> Column:
    """Struct(accepted, reason): the first failing check, or the mode a valid certificate grants.

    cert: certificate_id, model_hash, schema_hash, issued_at, expires_at, max_error, min_coverage,
    for_research and one array column per envelope field. row: now, model_hash, schema_hash, the
    envelope values, data_ok, drift, ood, error_bound, coverage_bound. A left join that finds no
    certificate leaves null columns, which fail closed.
    """
    fails = lambda condition: F.coalesce(condition, F.lit(True))
    inside = None
    for field in ENVELOPE:
        one = (row[field] != "") & F.array_contains(cert[field], row[field])
        inside = one if inside is None else inside & one
    invalid = row["drift"] == "CERTIFICATE_INVALID"
    reason = S.first_match(
        [
            (F.coalesce(cert["certificate_id"], F.lit("")) == "", "certificate_missing"),
            (
                fails((cert["expires_at"] <= row["now"]) | (cert["expires_at"] <= cert["issued_at"])),
                "certificate_expired",
            ),
            (
                fails((cert["model_hash"] != row["model_hash"]) | (cert["schema_hash"] != row["schema_hash"])),
                "artifact_hash_mismatch",
            ),
            (fails(~inside), "outside_supported_envelope"),
            (fails(~row["data_ok"]), "data_quality_rejected"),
            (fails(invalid), "certificate_invalidated_by_drift"),
            (row["drift"] == "DETERMINISTIC_MONITOR_ONLY", "drift_requires_monitor_only"),
            (fails(row["ood"] > 0.25), "ood_rejected"),
            (fails(row["error_bound"] > cert["max_error"]), "error_budget_exceeded"),
            (fails(row["coverage_bound"] < cert["min_coverage"]), "coverage_lower_bound_failed"),
            (cert["for_research"], "research_certificate_recommendation_only"),
        ],
        "valid_certificate_recommendation_only",
    )
    return F.struct(reason.endswith("_recommendation_only").alias("accepted"), reason.alias("reason"))


PROTECTED_CATEGORIES = (
    "SYSTEM_CRITICAL",
    "SECURITY",
    "FOREGROUND_FULLSCREEN_APP",
    "FOREGROUND_APP",
    "ACTIVE_APP_FAMILY",
)


@dataclass(frozen=True)
class PolicySwitches:
    auto_heal: bool = False
    safe_mode: bool = True
    dry_run: bool = True
    allow: str = ""
    deny: str = ""
    required_score: float = 90.0


def policy_waterfall(c: Mapping[str, Column], s: PolicySwitches = PolicySwitches()) -> Column:
    """Struct(score, level, code) of a recorded decision with its plan and verification.

    c: target_name, target_pid, category, safety, intent_protected, denied_candidate, is_foreground,
    candidate_safety, action_confidence, safety_gate, safe_to_heal, risk_level, action, root_cause,
    plan_status, plan_executes, plan_readiness, plan_needs_approval, simulated_pass, simulated_fail,
    verification_blocked, verification_confidence.
    """
    from pulsefleet.operators.tables import in_name_list

    denied = in_name_list(c["target_name"], s.deny) | c["denied_candidate"]
    allowed = in_name_list(c["target_name"], s.allow)
    shielded = c["category"].isin(*PROTECTED_CATEGORIES) | c["safety"].isin("PROTECTED", "USER_ACTIVE") | c["intent_protected"]
    active = (c["target_pid"] != 0) & c["is_foreground"]
    cost = lambda condition, points: F.when(condition, points).otherwise(0.0)
    critical = c["risk_level"] == "CRITICAL"
    score = S.clamp(
        c["candidate_safety"] * 0.22
        + c["action_confidence"] * 0.20
        + c["plan_readiness"] * 0.22
        + c["verification_confidence"] * 0.16
        + cost(c["simulated_pass"], 15.0)
        + cost(critical, 5.0)
        - cost(shielded, 45.0)
        - cost(active, 35.0)
        - cost(denied, 60.0)
        - cost(~allowed & (c["target_pid"] != 0), 18.0)
        - (0.0 if s.auto_heal else 10.0)
        - (10.0 if s.safe_mode else 0.0)
        - (10.0 if s.dry_run else 0.0)
        - cost(c["simulated_fail"], 25.0)
        - cost(c["verification_blocked"], 20.0)
    )
    model_ok = (c["safety_gate"] != "MODEL_CONFIDENCE_BLOCKED") & (c["action_confidence"] >= 85.0)
    ready = (
        (c["safe_to_heal"] & critical)
        & (c["plan_executes"] & (c["plan_status"] == "READY"))
        & (c["simulated_pass"] & ~c["verification_blocked"])
        & ((c["action_confidence"] >= 85.0) & (c["plan_readiness"] >= 75.0) & (c["verification_confidence"] >= 70.0))
    )
    gate = c["safety_gate"]
    steps = [
        ((c["action"] == "monitor_only") | (c["plan_status"] == "OBSERVE"), "NO_ACTION", "SIMULATION_ONLY"),
        (denied, "DENYLIST_TARGET", "FORBIDDEN"),
        (shielded, "PROTECTED_TARGET", "FORBIDDEN"),
        (active, "USER_ACTIVE_TARGET", "FORBIDDEN"),
        (gate == "NO_SAFE_TARGET", "NO_SAFE_TARGET", "FORBIDDEN"),
        ((gate == "COOLDOWN") | (c["plan_status"] == "COOLDOWN"), "COOLDOWN_ACTIVE", "SIMULATION_ONLY"),
        (c["root_cause"].isin("disk", "network") | c["plan_needs_approval"], "USER_REVIEW_REQUIRED", "REVIEW_REQUIRED"),
        (c["simulated_fail"], "VERIFICATION_FAILED", "FORBIDDEN"),
        (~c["simulated_pass"], "VERIFICATION_NOT_READY", "SIMULATION_ONLY"),
        (F.lit(not s.auto_heal), "AUTO_HEAL_DISABLED", "SIMULATION_ONLY"),
        (F.lit(s.safe_mode), "SAFE_MODE_ENABLED", "SIMULATION_ONLY"),
        (F.lit(s.dry_run), "DRY_RUN_ENABLED", "SIMULATION_ONLY"),
        (~allowed, "ALLOWLIST_REQUIRED", "REVIEW_REQUIRED"),
        (~model_ok, "MODEL_GATE_FAILED", "SIMULATION_ONLY"),
        (~ready, "READINESS_GATE_FAILED", "SIMULATION_ONLY"),
        (score < s.required_score, "POLICY_SCORE_LOW", "SIMULATION_ONLY"),
    ]
    code = S.first_match([(condition, name) for condition, name, _ in steps], "EXECUTION_ELIGIBLE")
    level = S.first_match([(condition, lvl) for condition, _, lvl in steps], "EXECUTION_ELIGIBLE")
    return F.struct(score.alias("score"), level.alias("level"), code.alias("code"))


def policy_replay(
    audits: DataFrame, plans: DataFrame, verifications: DataFrame, keys: Sequence[str], switches: PolicySwitches = PolicySwitches()
) -> DataFrame:
    """Recorded decisions judged anew: audits with score, level, code, and whether the recorded code agrees.

    audits hold keys, the decision's columns and ``recorded_code``; plans and verifications hold keys and
    their columns (see ``policy_waterfall``), one row per decision at most. A decision without a plan only
    observes; one without a verification is blocked.
    """
    rows = audits.join(plans, list(keys), "left").join(verifications, list(keys), "left")
    missing = {
        "plan_status": "OBSERVE", "plan_executes": False, "plan_readiness": 0.0, "plan_needs_approval": False,
        "simulated_pass": False, "simulated_fail": False, "verification_blocked": True, "verification_confidence": 0.0,
    }
    rows = rows.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in missing.items()})
    judged = rows.withColumn("__g", policy_waterfall({c: F.col(c) for c in rows.columns}, switches))
    agrees = F.col("__g.code").eqNullSafe(F.col("recorded_code"))
    return judged.select(*audits.columns, "__g.score", "__g.level", "__g.code", agrees.alias("agrees"))


# The contract's texts for the reason codes of gates, impact and the learned policy.
REASON_TEXTS = {
    "online_disabled": "online execution is disabled by configuration",
    "policy_not_promoted": "shadow policy has not passed offline promotion gates",
    "no_intervention_selected": "shadow policy selected the no-intervention baseline",
    "benefit_below_gate": "action lower-confidence benefit does not exceed the online gate",
    "deterministic_policy_refused": "deterministic safety policy did not grant execution eligibility",
    "outside_policy_boundary": "target safety or performance-criticality is outside the online policy boundary",
    "protected_target": "foreground, system-critical, or intent-matching target is protected",
    "approval_required": "online action requires explicit approval",
    "not_measured": "measured verification requires an executed transaction and two valid snapshots",
    "foreground_regressed": "foreground process regressed or stopped responding",
    "page_fault_guardrail": "page-fault rate exceeded the safety guardrail",
    "harmful_threshold": "measured resource outcome crossed the harmful threshold",
    "helpful_threshold": "measured resource improvement exceeded the helpful threshold",
    "too_small": "measured effect was safe but too small to claim improvement",
    "no_reversible_safe_candidate": "no reversible candidate passed deterministic safety",
    "insufficient_measured_outcomes": "insufficient measured outcomes; remain on no-intervention baseline",
    "lower_bound_does_not_beat_baseline": "lower-confidence benefit does not beat no intervention",
    "shadow_candidate_beats_baseline": "shadow candidate beats baseline with required lower-confidence benefit",
}


def reason_text(code: Column) -> Column:
    """The contract's text of a reason code; other codes stand for themselves."""
    return S.by_value(code, REASON_TEXTS, code)


def online_gate(c: Mapping[str, Column], min_benefit: float = 0.05, min_safety: float = 90.0, max_criticality: float = 30.0) -> Column:
    """First reason an online action is refused, or ``eligible`` (budget and cooldown come after).

    c: enabled, promoted, would_act, lower_bound, policy_eligible, hard_block, target_safety,
    target_criticality, target_pid, foreground_pid, system_critical, matches_intent, needs_approval,
    approved.
    """
    return S.first_match(
        [
            (~c["enabled"], "online_disabled"),
            (~c["promoted"], "policy_not_promoted"),
            (~c["would_act"], "no_intervention_selected"),
            (c["lower_bound"] <= min_benefit, "benefit_below_gate"),
            (~c["policy_eligible"] | c["hard_block"], "deterministic_policy_refused"),
            ((c["target_safety"] < min_safety) | (c["target_criticality"] > max_criticality), "outside_policy_boundary"),
            (
                (c["target_pid"] == 0) | (c["target_pid"] == c["foreground_pid"]) | c["system_critical"] | c["matches_intent"],
                "protected_target",
            ),
            (c["needs_approval"] & ~c["approved"], "approval_required"),
        ],
        "eligible",
    )


# Outcome thresholds of a measured action.
HELPFUL_CPU, HELPFUL_MEMORY_MB = 5.0, 48.0
HARMFUL_CPU, HARMFUL_MEMORY_MB, HARMFUL_FAULTS = 12.0, 128.0, 150.0
HELPFUL_SCORE, HARMFUL_SCORE = 0.20, -0.20


def action_impact(pre: Mapping[str, Column], post: Mapping[str, Column], executed: Column) -> Column:
    """Struct of deltas, reward, confidence, status and rollback flag from two snapshots.

    pre, post: t_ms, cpu, available_mb, page_faults, working_set_mb, foreground_alive,
    foreground_hung, measured. A missing snapshot (null from an outer join) is not measured.
    """
    measured = executed & F.coalesce(pre["measured"], F.lit(False)) & F.coalesce(post["measured"], F.lit(False))
    seconds = F.greatest(F.lit(0.001), (post["t_ms"] - pre["t_ms"]) / 1000.0)
    cpu = pre["cpu"] - post["cpu"]
    memory = post["available_mb"] - pre["available_mb"]
    faults = F.greatest(F.lit(0.0), (post["page_faults"] - pre["page_faults"]) / seconds)
    reward = (
        S.clamp(cpu / HELPFUL_CPU, -2.0, 2.0) * 0.45
        + S.clamp(memory / HELPFUL_MEMORY_MB, -2.0, 2.0) * 0.45
        - S.clamp(faults / HARMFUL_FAULTS, 0.0, 2.0) * 0.10
    )
    confidence = S.clamp(35.0 + F.least(F.lit(45.0), seconds * 3.0) + 20.0)
    foreground_bad = pre["foreground_alive"] & (~post["foreground_alive"] | post["foreground_hung"])
    fault_bad = faults >= HARMFUL_FAULTS
    harmful = (
        foreground_bad | fault_bad | (cpu <= -HARMFUL_CPU) | (memory <= -HARMFUL_MEMORY_MB) | (reward <= HARMFUL_SCORE)
    )
    helpful = (reward >= HELPFUL_SCORE) & ((cpu >= HELPFUL_CPU) | (memory >= HELPFUL_MEMORY_MB))
    status = S.first_match(
        [(~measured, "PLANNED"), (harmful, "VERIFIED_HARMFUL"), (helpful, "VERIFIED_HELPFUL")], "VERIFIED_NEUTRAL"
    )
    only = lambda value: F.when(measured, value)
    return F.struct(
        status.alias("status"),
        only(cpu).alias("cpu_delta"),
        only(memory).alias("available_memory_delta"),
        only(pre["working_set_mb"] - post["working_set_mb"]).alias("working_set_delta"),
        only(faults).alias("hard_faults_per_second"),
        only(reward).alias("reward"),
        only(confidence).alias("confidence"),
        (measured & harmful).alias("rollback_required"),
        S.first_match(
            [
                (~measured, "not_measured"),
                (foreground_bad, "foreground_regressed"),
                (fault_bad, "page_fault_guardrail"),
                (harmful, "harmful_threshold"),
                (helpful, "helpful_threshold"),
            ],
            "too_small",
        ).alias("reason"),
    )
