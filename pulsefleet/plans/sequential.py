"""Queries for the folded operators; the SQL twins step through each device recursively."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefleet.operators import sequential as Q
from pulsefleet.plans.history import KEY, ORDER, OVER, r
from pulsefleet.plans.registry import query
from pulsefleet.plans.views import telemetry, with_telemetry

_NUM = f"num AS (SELECT *, row_number() OVER ({OVER}) AS i FROM tel)"
_VALUES = ("cpu", "mem", "disk", "net", "process", "top_cpu", "top_mem")


def _baseline_sql() -> str:
    first, dev, nxt = [], [], []
    for k, (c, (_, _, floor, low)) in enumerate(zip(_VALUES, Q.BASELINE_METRICS)):
        first.append(f"{c} AS m{k}, {floor * floor}::DOUBLE AS v{k}, 0.0::DOUBLE AS d{k}")
        delta = f"(m{k} - {c})" if low else f"({c} - m{k})"
        dev.append(
            f"least(100, greatest(0, greatest(0, {delta} / greatest(1, greatest({floor}::DOUBLE, sqrt(v{k})))) / 1.6::DOUBLE * 35)) AS d{k}"
        )
        a = f"(CASE WHEN d{k} >= 70 THEN 0.006::DOUBLE WHEN d{k} >= 45 THEN 0.012::DOUBLE WHEN n < 30 THEN 0.08::DOUBLE ELSE 0.025::DOUBLE END)"
        nxt.append(
            f"m{k} + {a} * ({c} - m{k}) AS m{k}, greatest((1 - {a}) * v{k} + {a} * ({c} - m{k}) * ({c} - m{k}), {floor * floor}::DOUBLE) AS v{k}, d{k}"
        )
    keep = ", ".join(_VALUES)
    olds = ", ".join(f"m{k}, v{k}" for k in range(7))
    score = " + ".join(f"d{k} * {m[1]}::DOUBLE" for k, m in enumerate(Q.BASELINE_METRICS))
    best = "greatest(" + ", ".join(f"d{k}" for k in range(7)) + ")"
    dominant = " ".join(f"WHEN d{k} = {best} THEN '{m[0]}'" for k, m in enumerate(Q.BASELINE_METRICS))
    steps = f"""
stp AS (SELECT device_id, seq, i, 1 AS n, {", ".join(first)} FROM num WHERE i = 1
 UNION ALL
 SELECT device_id, seq, i, n + 1 AS n, {", ".join(nxt)} FROM
  (SELECT x.device_id, x.seq, x.i, n, {keep}, {olds}, {", ".join(dev)} FROM
    (SELECT num.*, n, {olds} FROM stp JOIN num ON num.device_id = stp.device_id AND num.i = stp.i + 1) x))"""
    body = f"""SELECT device_id, seq, CAST(n AS BIGINT) AS sample_count, n >= 30 AS ready,
 round(CASE WHEN n >= 30 THEN least(100, greatest(45, n / 90 * 100)) ELSE least(45, n / 30 * 45) END, 4) AS confidence,
 round(CASE WHEN n >= 30 THEN score ELSE least(35, score * 0.35::DOUBLE) END, 4) + 0 AS anomaly_score, round(m0, 4) + 0 AS cpu_mean, round(m6, 4) + 0 AS top_mem_mean,
 CASE {dominant} END AS dominant_metric,
 CASE WHEN n < 30 THEN 'WARMING_UP' WHEN score >= 75 THEN 'ANOMALOUS' WHEN score >= 45 THEN 'SHIFTING' ELSE 'STABLE' END AS status
FROM (SELECT *, least(100, greatest(0, {score})) AS score FROM stp)"""
    return "WITH RECURSIVE " + with_telemetry("", _NUM, steps)[5:] + body


@query("e9_adaptive_baseline", _baseline_sql())
def e9_adaptive_baseline(spark, folder):
    rows = Q.adaptive_baseline(telemetry(spark, folder), KEY, ORDER, list(_VALUES))
    return rows.select(
        "device_id", "seq", "sample_count", "ready", r("confidence", 4).alias("confidence"), r("anomaly_score", 4).alias("anomaly_score"),
        r(F.get("means", 0), 4).alias("cpu_mean"), r(F.get("means", 6), 4).alias("top_mem_mean"), "dominant_metric", "status",
    )


HOUR_S, DAY_S = 3600.0, 86400.0


@query(
    "e16_action_cooldown",
    "WITH RECURSIVE "
    + with_telemetry("", "nph AS (SELECT device_id, phase, t, seq, row_number() OVER (PARTITION BY device_id, phase ORDER BY t, seq) AS i FROM tel)",
        f"""stp AS (SELECT device_id, phase, seq, i, t AS last, true AS accepted FROM nph WHERE i = 1
 UNION ALL SELECT n.device_id, n.phase, n.seq, n.i, CASE WHEN n.t - last >= {int(2 * DAY_S * 1e6)} THEN n.t ELSE last END, n.t - last >= {int(2 * DAY_S * 1e6)}
  FROM stp JOIN nph n ON n.device_id = stp.device_id AND n.phase = stp.phase AND n.i = stp.i + 1)""")[5:]
    + "SELECT device_id, phase, seq, accepted FROM stp",
)
def e16_action_cooldown(spark, folder):
    """Cooldown of two days per device and action."""
    rows = Q.cooldown(telemetry(spark, folder), ["device_id", "phase"], ORDER, seconds=2 * DAY_S)
    return rows.select("device_id", "phase", "seq", "accepted")


@query(
    "e17_action_budget",
    "WITH RECURSIVE "
    + with_telemetry("", f"num AS (SELECT *, t // 120 AS ts, row_number() OVER ({OVER}) AS i FROM tel)",
        """stp AS (SELECT device_id, seq, phase, i, [ts] AS recent, [{'k': phase, 'u': ts + 600000000}] AS cool, 'accepted' AS verdict FROM num WHERE i = 1
 UNION ALL SELECT device_id, seq, phase, i, CASE WHEN v = 'accepted' THEN list_append(rec, ts) ELSE rec END,
   CASE WHEN v = 'accepted' THEN list_append(col, {'k': phase, 'u': ts + 600000000}) ELSE col END, v
  FROM (SELECT *, CASE WHEN len(rec) >= 3 THEN 'budget_exhausted' WHEN len(list_filter(col, lambda x: x.k = phase)) > 0 THEN 'cooldown_active' ELSE 'accepted' END AS v
   FROM (SELECT n.device_id, n.seq, n.phase, n.i, n.ts, list_filter(recent, lambda x: n.ts - x < 3600000000) AS rec, list_filter(cool, lambda x: x.u > n.ts) AS col
    FROM stp JOIN num n ON n.device_id = stp.device_id AND n.i = stp.i + 1)))""")[5:]
    + "SELECT device_id, seq, phase, verdict FROM stp",
)
def e17_action_budget(spark, folder):
    """Three actions per hour and ten minutes per action, on a clock that runs 120 times faster."""
    tel = telemetry(spark, folder).withColumn("ts", F.floor(F.col("t") / 120))
    rows = Q.action_budget(tel, KEY, ["ts", "seq"], ["phase"])
    return rows.select("device_id", "seq", "phase", "verdict")


_ST, _EL, _IM, _BU = 21600000, 3600000, 1800000, 172800000


@query(
    "e18_adaptive_sampling",
    "WITH RECURSIVE "
    + with_telemetry("", f"""num AS (SELECT device_id, seq, t // 1000 AS now, mem >= 60 AS elevated, mem >= 95 AS severe, net > 150 AS moved, seq % 5 <> 0 AS cheap,
   row_number() OVER ({OVER}) AS i FROM tel)""",
        f"""stp AS (SELECT device_id, seq, i, now AS last, CAST(NULL AS BIGINT) AS burst, NOT cheap AS slow, true AS capture, 'initial_sample' AS reason FROM num WHERE i = 1
 UNION ALL SELECT device_id, seq, i, CASE WHEN take THEN now ELSE last END, nb, CASE WHEN take THEN NOT cheap ELSE slow END, take, why FROM
 (SELECT *, CASE WHEN (moved OR severe) AND now - last >= {_IM} THEN true
    WHEN moved OR severe OR elevated THEN CASE WHEN now - nb >= {_BU} AND NOT severe THEN now - last >= {_ST} * CASE WHEN slow THEN 2 ELSE 1 END
       ELSE now - last >= {_EL} * CASE WHEN slow AND NOT severe THEN 2 ELSE 1 END END
    ELSE now - last >= {_ST} * CASE WHEN slow THEN 2 ELSE 1 END END AS take,
   CASE WHEN (moved OR severe) AND now - last >= {_IM} THEN CASE WHEN moved THEN 'foreground_changed' ELSE 'forced_escalation' END
    WHEN moved OR severe OR elevated THEN CASE WHEN now - nb >= {_BU} AND NOT severe THEN 'focused_burst_capped' ELSE 'elevated_risk' END
    WHEN slow THEN 'overhead_backoff' ELSE 'stable_interval' END AS why
  FROM (SELECT n.*, last, slow, CASE WHEN (n.moved OR n.severe) AND n.now - last >= {_IM} THEN burst
     WHEN n.moved OR n.severe OR n.elevated THEN coalesce(burst, n.now) END AS nb
   FROM stp JOIN num n ON n.device_id = stp.device_id AND n.i = stp.i + 1)))""")[5:]
    + "SELECT device_id, seq, capture, reason FROM stp",
)
def e18_adaptive_sampling(spark, folder):
    """Sampling decisions with intervals stretched to the event spacing of the table."""
    no = F.lit(False)
    tel = telemetry(spark, folder).select(
        "device_id", "t", "seq", (F.col("mem") >= 60).alias("elevated"), (F.col("mem") >= 95).alias("severe"),
        (F.col("net") > 150).alias("foreground_changed"), no.alias("invalid"), no.alias("safety"),
        (F.col("seq") % 5 != 0).alias("within_budget"), no.alias("collector_failed"),
    )
    tel = tel.withColumn("t", F.floor(F.col("t") / 1000))
    rows = Q.adaptive_sampling(
        tel, KEY, ORDER, stable_ms=_ST, elevated_ms=_EL, immediate_ms=_IM, burst_ms=_BU
    )
    return rows.select("device_id", "seq", "capture", "reason")


@query(
    "e14_recent_apps",
    "WITH RECURSIVE "
    + with_telemetry("", f"num AS (SELECT device_id, seq, t, seq % 12 AS app, row_number() OVER ({OVER}) AS i FROM tel)",
        f"""stp AS (SELECT device_id, seq, i, [{{'a': app, 's': t}}] AS apps FROM num WHERE i = 1
 UNION ALL SELECT n.device_id, n.seq, n.i, list_filter(
   CASE WHEN len(list_filter(apps, lambda x: x.a = n.app)) > 0 THEN list_transform(apps, lambda x: {{'a': x.a, 's': CASE WHEN x.a = n.app THEN n.t ELSE x.s END}})
    ELSE list_slice(list_concat([{{'a': n.app, 's': n.t}}], apps), 1, 8) END, lambda x: n.t - x.s <= {int(3 * DAY_S * 1e6)})
  FROM stp JOIN num n ON n.device_id = stp.device_id AND n.i = stp.i + 1)""")[5:]
    + "SELECT device_id, seq, array_to_string(list_transform(apps, lambda x: x.a), ',') AS recent_apps FROM stp",
)
def e14_recent_apps(spark, folder):
    """Apps of the last three days, at most eight remembered."""
    tel = telemetry(spark, folder).withColumn("app", F.col("seq") % 12)
    rows = Q.recent_apps(tel, KEY, ORDER, "app", window=3 * DAY_S * 1e6)
    return rows.select("device_id", "seq", F.array_join("recent_apps", ",").alias("recent_apps"))
