"""Queries for process ranking, graph, decision scores, gates, and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefleet.functions import gates as G
from pulsefleet.functions import scoring as S
from pulsefleet.operators import graph as N
from pulsefleet.operators import learning as L
from pulsefleet.operators import process as P
from pulsefleet.operators import rollups as R
from pulsefleet.operators import windows as W
from pulsefleet.plans.history import DEVIATION_CTE, KEY, ORDER, OVER, deviation_sql, r
from pulsefleet.plans.registry import query
from pulsefleet.plans.views import PROCESSES, pressure_sql, processes, table, telemetry, with_telemetry

TICK = ["device_id", "tick"]
ORDINAL = ["pid", "line_supplier", "private_mb", "cpu", "io_write_kbps"]


def intents(spark, folder):
    """One intent row per tick; some ticks have none, and in some nothing is in the foreground."""
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("device_id"),
        k.alias("tick"),
        F.when(k % 11 == 5, 0).otherwise((k % 7 + 1) * 10).alias("foreground_pid"),
        F.when(k % 4 == 0, "Chrome.exe").otherwise("editor.exe").alias("foreground_process"),
        S.by_value(F.col("o_orderstatus"), {"F": "BROWSER", "P": "GAME"}, "UNKNOWN").alias("app_kind"),
        (k % 5 == 0).alias("is_fullscreen"),
        F.when(k % 3 == 0, F.array(F.lit(20).cast("long"), F.lit(30).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("recent_pids"),
        F.element_at(F.array(*[F.lit(p) for p in S.WORKLOAD_PHASES]), (k % 11 + 1).cast("int")).alias("workload_phase"),
    ).where("tick % 13 <> 0")


def classified(spark, folder):
    return P.classify(P.with_intent(processes(spark, folder), intents(spark, folder), TICK))


_PHASES_SQL = "[" + ", ".join(f"'{p}'" for p in S.WORKLOAD_PHASES) + "]"
CLASSIFIED = f"""
itn AS (SELECT o_custkey AS device_id, o_orderkey AS tick, CASE WHEN o_orderkey % 11 = 5 THEN 0 ELSE (o_orderkey % 7 + 1) * 10 END AS fpid, CASE WHEN o_orderkey % 4 = 0 THEN 'chrome.exe' ELSE 'editor.exe' END AS fproc,
  CASE o_orderstatus WHEN 'F' THEN 'BROWSER' WHEN 'P' THEN 'GAME' ELSE 'UNKNOWN' END AS app_kind, o_orderkey % 5 = 0 AS fullscreen, o_orderkey % 3 = 0 AS has_recent,
  {_PHASES_SQL}[o_orderkey % 11 + 1] AS workload_phase FROM orders WHERE o_orderkey % 13 <> 0),
pin AS (SELECT proc.*, coalesce(fpid, 0) AS fpid, coalesce(fullscreen, false) AS fullscreen, workload_phase, app_kind, coalesce(fproc, '') AS fproc,
  coalesce(has_recent, false) AS has_recent FROM proc LEFT JOIN itn USING (device_id, tick)),
flg AS (SELECT *, pid = fpid AS front, has_recent AND pid IN (20, 30) AS recent, trusted_path AS trusted,
  coalesce(app_kind <> 'UNKNOWN', false) AND (pid = fpid OR name = fproc) AS family, pid <= 4 OR name IN ('csrss.exe', 'audiodg.exe') AS critical,
  least(100, least(40, cpu * 1.8::DOUBLE) + least(38, private_mb / 18) + least(22, (io_read_kbps + io_write_kbps) / 250) + CASE WHEN has_visible_window THEN 0 ELSE 8 END
    + CASE WHEN lifetime_sec > 300 AND private_mb > 250 THEN 6 ELSE 0 END) AS waste FROM pin),
cat AS (SELECT *, CASE WHEN critical THEN 'SYSTEM_CRITICAL' WHEN name = 'msmpeng.exe' THEN 'SECURITY' WHEN front AND fullscreen THEN 'FOREGROUND_FULLSCREEN_APP'
  WHEN front THEN 'FOREGROUND_APP' WHEN family THEN 'ACTIVE_APP_FAMILY' WHEN recent THEN 'RECENT_USER_APP' WHEN has_visible_window THEN 'USER_APP'
  WHEN name IN ('chrome.exe', 'firefox.exe') THEN 'BROWSER_CHILD' WHEN name IN ('steam_updater.exe', 'onedrive.exe') THEN 'UPDATER_SYNC'
  WHEN session_id = 0 OR contains(lower(exe_path), '\\windows\\system32\\') THEN 'WINDOWS_SERVICE' WHEN trusted THEN 'BACKGROUND_HELPER' ELSE 'UNKNOWN' END AS category FROM flg),
cls AS (SELECT *, CASE WHEN category IN ('SYSTEM_CRITICAL', 'SECURITY') THEN 'PROTECTED' WHEN category IN ('FOREGROUND_FULLSCREEN_APP', 'FOREGROUND_APP', 'ACTIVE_APP_FAMILY') THEN 'USER_ACTIVE'
   WHEN category IN ('RECENT_USER_APP', 'USER_APP', 'WINDOWS_SERVICE') THEN 'OBSERVE_ONLY' WHEN category = 'BACKGROUND_HELPER' THEN 'CANDIDATE' WHEN category = 'UNKNOWN' THEN 'CAUTIOUS'
   WHEN trusted THEN 'CANDIDATE' ELSE 'CAUTIOUS' END AS safety,
  CAST(CASE category WHEN 'SYSTEM_CRITICAL' THEN 100 WHEN 'SECURITY' THEN 100 WHEN 'FOREGROUND_FULLSCREEN_APP' THEN 100 WHEN 'FOREGROUND_APP' THEN 95 WHEN 'ACTIVE_APP_FAMILY' THEN 88
   WHEN 'RECENT_USER_APP' THEN 82 WHEN 'USER_APP' THEN 78 WHEN 'BROWSER_CHILD' THEN 42 WHEN 'UPDATER_SYNC' THEN 30 WHEN 'WINDOWS_SERVICE' THEN 72 WHEN 'BACKGROUND_HELPER' THEN 38 ELSE 58 END AS DOUBLE) AS importance,
  CAST(CASE category WHEN 'FOREGROUND_APP' THEN 5 WHEN 'ACTIVE_APP_FAMILY' THEN 8 WHEN 'RECENT_USER_APP' THEN 18 WHEN 'USER_APP' THEN 25 WHEN 'BROWSER_CHILD' THEN CASE WHEN trusted THEN 68 ELSE 45 END
   WHEN 'UPDATER_SYNC' THEN CASE WHEN trusted THEN 76 ELSE 48 END WHEN 'WINDOWS_SERVICE' THEN 20 WHEN 'BACKGROUND_HELPER' THEN 62 WHEN 'UNKNOWN' THEN 35 ELSE 0 END AS DOUBLE) AS safe_score,
  CASE category WHEN 'BROWSER_CHILD' THEN greatest(0, least(private_mb * 0.55::DOUBLE, working_set_mb * 0.45::DOUBLE)) WHEN 'UPDATER_SYNC' THEN greatest(0, least(private_mb * 0.6::DOUBLE, working_set_mb * 0.5::DOUBLE))
   WHEN 'BACKGROUND_HELPER' THEN greatest(0, least(private_mb * 0.5::DOUBLE, working_set_mb * 0.4::DOUBLE)) ELSE 0.0::DOUBLE END AS gain FROM cat)"""
_ORD = "pid, line_supplier, private_mb, cpu, io_write_kbps"


def process_sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([PROCESSES.strip(), CLASSIFIED.strip(), *ctes]) + "\n" + body


@query(
    "h6_process_classes",
    process_sql(
        """SELECT category, safety, count(*) AS n, round(sum(waste), 3) AS waste, round(sum(importance), 3) AS importance, round(sum(safe_score), 3) AS safety_score, round(sum(gain), 3) AS gain,
 count(*) FILTER (front OR recent OR family) AS intent_rows FROM cls GROUP BY ALL"""
    ),
)
def h6_process_classes(spark, folder):
    total = lambda c: r(F.sum(c), 3)
    return classified(spark, folder).groupBy("category", "safety").agg(
        F.count(F.lit(1)).alias("n"), total("waste_score").alias("waste"), total("importance_score").alias("importance"),
        total("safety_score").alias("safety_score"), total("expected_gain_mb").alias("gain"), F.count_if("matches_user_intent").alias("intent_rows"),
    )


_WHY = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CLASS_REASONS.items()) + " END"


_REASONS = f"""list_filter([CASE WHEN cpu >= 20 THEN 'high cpu' END, CASE WHEN private_mb >= 350 THEN 'high private memory' END,
 CASE WHEN working_set_mb >= 500 THEN 'large working set' END, CASE WHEN io_read_kbps + io_write_kbps >= 1024 THEN 'active disk io' END,
 CASE WHEN NOT has_visible_window THEN 'background or hidden' END, CASE WHEN front THEN 'foreground user app' END,
 CASE WHEN recent THEN 'recently active user app' END, CASE WHEN family THEN 'same family as active ' || app_kind END,
 CASE WHEN fullscreen AND front THEN 'fullscreen foreground app' END, CASE WHEN trusted THEN 'trusted install path/signature' END, {_WHY}],
 lambda x: x IS NOT NULL)"""
_REASON = "CASE WHEN len(why) = 0 THEN 'no strong signal yet' ELSE array_to_string(why[1:3], ', ') END"
_ADVICE = "CASE " + " ".join(
    (f"WHEN category = '{c[0]}' AND waste >= {c[9]} THEN '{c[10]}' " if c[10] else "") + f"WHEN category = '{c[0]}' THEN '{c[8]}'" for c in P.CLASSES
) + " END"


@query(
    "h6_process_reasons",
    process_sql(f"SELECT {_REASON} AS reason, count(*) AS n, CAST(sum(len(why)) AS BIGINT) AS reasons FROM (SELECT {_REASONS} AS why FROM cls) GROUP BY 1"),
)
def h6_process_reasons(spark, folder):
    return classified(spark, folder).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("reasons")).alias("reasons")
    )


@query(
    "d8_waste_candidates",
    process_sql(
        f"""SELECT name, category, safety, recommendation, {_REASON} AS reason, round(avg(waste), 1) AS avg_waste, round(max(gain), 1) + 0 AS max_gain,
 round(max(private_mb), 1) AS max_private_mb, count(*) AS samples FROM (SELECT *, {_REASONS} AS why, {_ADVICE} AS recommendation FROM cls)
WHERE tick >= (SELECT max(tick) FROM cls) - 3600 GROUP BY ALL ORDER BY avg_waste DESC, max_gain DESC, name, category, safety, recommendation, reason LIMIT 12"""
    ),
)
def d8_waste_candidates(spark, folder):
    """The twelve most wasteful groups of the last 3600 ticks."""
    keys = ["name", "category", "safety", "recommendation", "reason"]
    recent = R.since_newest(classified(spark, folder), "tick", 3600)
    rows = recent.groupBy(*keys).agg(
        F.round(F.avg("waste_score"), 1).alias("avg_waste"), r(F.max("expected_gain_mb"), 1).alias("max_gain"),
        F.round(F.max("private_mb"), 1).alias("max_private_mb"), F.count(F.lit(1)).alias("samples"),
    )
    return rows.orderBy(F.desc("avg_waste"), F.desc("max_gain"), *keys).limit(12)


@query("c5_rows_with_intent", process_sql("SELECT app_kind, fullscreen AS is_fullscreen, count(*) AS n, count(*) FILTER (front) AS foreground_rows FROM flg GROUP BY ALL"))
def c5_rows_with_intent(spark, folder):
    rows = P.with_intent(processes(spark, folder), intents(spark, folder), TICK)
    return rows.groupBy("app_kind", "is_fullscreen").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pid") == F.col("foreground_pid")).alias("foreground_rows")
    )


_PRESSURE_RANK = """waste + safe_score * 0.55::DOUBLE - importance * 0.35::DOUBLE - CASE safety WHEN 'PROTECTED' THEN 100 WHEN 'USER_ACTIVE' THEN 80 WHEN 'OBSERVE_ONLY' THEN 25 ELSE 0 END
 + CASE WHEN gain >= 250 THEN 8 ELSE 0 END + CASE WHEN cpu >= 15 THEN 6 ELSE 0 END"""


@query(
    "f3_top_processes",
    process_sql(f"SELECT tick, place, pid, name, round(rank, 6) + 0 AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY device_id, tick ORDER BY rank DESC, {_ORD}) AS INT) AS place FROM (SELECT *, {_PRESSURE_RANK} AS rank FROM cls)) WHERE place <= 20"),
)
def f3_top_processes(spark, folder):
    top = P.top_processes(classified(spark, folder), TICK, ORDINAL, limit=20)
    return top.select("tick", "place", "pid", "name", r("pressure_rank").alias("rank"))


_CANDIDATE_RANK = """waste + safe_score * 0.65::DOUBLE + least(18, gain / 32) + least(16, cpu * 0.8::DOUBLE) + least(14, private_mb / 90) - importance * 0.4::DOUBLE
 - CASE safety WHEN 'CAUTIOUS' THEN 14 WHEN 'OBSERVE_ONLY' THEN 28 ELSE 0 END - CASE WHEN gain <= 0 AND cpu < 12 THEN 10 ELSE 0 END"""
_POLICY = "safety IN ('PROTECTED', 'USER_ACTIVE') OR critical OR front OR recent OR family"


@query(
    "f4_best_candidate",
    process_sql(
        f"""SELECT tick, arg_max(pid, (rank, -pid, -line_supplier, -private_mb, -cpu, -io_write_kbps)) AS pid, count(*) AS candidate_count
FROM (SELECT *, {_CANDIDATE_RANK} AS rank FROM cls WHERE NOT ({_POLICY}) AND name NOT IN ('vlc.exe') AND NOT (safe_score < 35 AND safety <> 'CANDIDATE') AND NOT pid = 40) GROUP BY device_id, tick"""
    ),
)
def f4_best_candidate(spark, folder):
    """Process 40 of every tick is on the critical path and removed by the anti join."""
    rows = classified(spark, folder)
    protected = rows.where(F.col("pid") == 40).select(*TICK, "pid").distinct()
    best = P.best_candidates(rows, TICK, ORDINAL, deny="VLC.exe", protected=protected)
    return best.select("tick", "pid", "candidate_count")


@query(
    "c9_unprotected_rows",
    process_sql("SELECT count(*) AS n, count(DISTINCT tick) AS ticks FROM cls WHERE (device_id, tick, pid) NOT IN (SELECT device_id, tick, pid FROM cls WHERE safety = 'PROTECTED')"),
)
def c9_unprotected_rows(spark, folder):
    rows = classified(spark, folder)
    protected = rows.where(F.col("safety") == "PROTECTED").select(*TICK, "pid").distinct()
    open_rows = rows.join(protected, [*TICK, "pid"], "left_anti")
    return open_rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tick").alias("ticks"))


_AUTOPILOT_CTES = (
    f"""wnt AS (SELECT *, greatest(0, waste * 1.25::DOUBLE + safe_score * 0.7::DOUBLE + least(28, private_mb / 18) + least(18, cpu * 1.1::DOUBLE)
   + CASE category WHEN 'UPDATER_SYNC' THEN 28 WHEN 'BROWSER_CHILD' THEN 24 WHEN 'BACKGROUND_HELPER' THEN 14 ELSE 0 END + CASE WHEN has_visible_window THEN 0 ELSE 10 END
   + CASE safety WHEN 'CANDIDATE' THEN 10 WHEN 'CAUTIOUS' THEN -10 ELSE 0 END + CASE WHEN trusted THEN 4 ELSE 0 END) AS arank,
  CASE WHEN category = 'UPDATER_SYNC' THEN 'delay_background_updater' WHEN category = 'BROWSER_CHILD' THEN 'sleep_unused_browser_helper'
   WHEN private_mb >= 180 OR working_set_mb >= 260 THEN 'trim_background_working_set' WHEN cpu >= 8 THEN 'lower_background_priority' ELSE 'observe_background_candidate' END AS action_name
  FROM cls WHERE NOT (front OR recent OR family OR category IN ('FOREGROUND_APP', 'FOREGROUND_FULLSCREEN_APP', 'ACTIVE_APP_FAMILY', 'RECENT_USER_APP')) AND safety <> 'PROTECTED'
   AND NOT critical AND safe_score >= 55 AND (waste >= 35 OR private_mb >= 160 OR cpu >= 8 OR category IN ('UPDATER_SYNC', 'BROWSER_CHILD', 'BACKGROUND_HELPER'))),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, tick ORDER BY arank DESC, {_ORD}) AS place FROM wnt) WHERE place <= 4)""",
)


@query(
    "f5_autopilot_actions",
    process_sql("SELECT action_name, place AS rank, count(*) AS n, round(sum(gain), 3) AS ram, round(sum(least(18, greatest(0, cpu * 0.55::DOUBLE))), 3) AS cpu_drop FROM rec GROUP BY ALL", *_AUTOPILOT_CTES),
)
def f5_autopilot_actions(spark, folder):
    rec = P.autopilot_recommendations(classified(spark, folder), TICK, ORDINAL)
    return rec.groupBy("action_name", F.col("rank").cast("long").alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("expected_ram_mb"), 3).alias("ram"), r(F.sum("expected_cpu_drop"), 3).alias("cpu_drop")
    )


@query(
    "f5_autopilot_status",
    process_sql(
        """SELECT status, count(*) AS ticks, round(sum(ram), 3) AS ram, round(sum(pressure), 3) AS pressure FROM
 (SELECT CASE WHEN n > 0 THEN 'READY_DRY_RUN' WHEN active THEN 'NO_SAFE_TARGET' ELSE 'OBSERVING' END AS status, least(coalesce(g, 0), 1546.0::DOUBLE) AS ram,
  least(100, greatest(0, mem * 0.46::DOUBLE + cpu * 0.3::DOUBLE + risk * 0.16::DOUBLE + 26.0::DOUBLE * 0.08::DOUBLE + CASE WHEN disk <= 8 THEN least(100, greatest(0, (8 - disk) * 12.5)) ELSE 0 END)) AS pressure
 FROM (SELECT *, ram <= 4608 OR mem >= 78 OR cpu >= 70 OR disk <= 8 OR level <> 'NORMAL' AS active FROM
   (SELECT o_custkey AS device_id, o_orderkey AS tick, CAST(o_orderkey % 100 AS DOUBLE) AS mem, CAST(o_custkey % 90 AS DOUBLE) AS cpu, CAST(o_orderkey % 50 AS DOUBLE) AS disk, CAST(2048 * (1 + o_custkey % 5) AS DOUBLE) AS ram,
     CAST(o_orderkey % 70 AS DOUBLE) AS risk, CASE WHEN o_orderkey % 70 >= 65 THEN 'CRITICAL' ELSE 'NORMAL' END AS level FROM orders))
 LEFT JOIN (SELECT device_id, tick, count(*) AS n, sum(gain) AS g FROM rec GROUP BY ALL) USING (device_id, tick)) GROUP BY status""",
        *_AUTOPILOT_CTES,
    ),
)
def f5_autopilot_status(spark, folder):
    rec = P.autopilot_recommendations(classified(spark, folder), TICK, ORDINAL)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda x: x.cast("double")
    systems = table(spark, folder, "orders").select(
        c.alias("device_id"), k.alias("tick"), number(k % 100).alias("mem"), number(c % 90).alias("cpu"), number(k % 50).alias("disk"),
        number(2048 * (1 + c % 5)).alias("total_memory_mb"), number(k % 70).alias("risk"), F.when(k % 70 >= 65, "CRITICAL").otherwise("NORMAL").alias("level"),
        F.lit(26.0).alias("baseline_anomaly"), F.lit(10.0).alias("plan_gain_mb"),
    )
    out = P.autopilot_results(systems, rec, TICK)
    return out.groupBy("status").agg(
        F.count(F.lit(1)).alias("ticks"), r(F.sum("estimated_ram_mb"), 3).alias("ram"), r(F.sum("pressure_score"), 3).alias("pressure")
    )


# -- graph ----------------------------------------------------------------------------------

_FAMILY = """fam AS (SELECT device_id, tick, fpid AS node FROM itn WHERE fpid <> 0 UNION
  SELECT p.device_id, p.tick, p.pid FROM fam JOIN proc p ON p.device_id = fam.device_id AND p.tick = fam.tick AND p.parent_pid = fam.node)"""


#: The family by session and table folder: the queries of a session share one search.
_FAMILIES: dict[tuple[str, str], DataFrame] = {}


def family(spark, folder):
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FAMILIES:
        edges = processes(spark, folder).select(*TICK, "parent_pid", "pid")
        _FAMILIES[key] = N.foreground_family(edges, intents(spark, folder), TICK)
    return _FAMILIES[key]


@query("i1_foreground_family", process_sql("SELECT tick, count(*) AS members FROM fam GROUP BY tick", _FAMILY, recursive=True))
def i1_foreground_family(spark, folder):
    return family(spark, folder).groupBy("tick").agg(F.count(F.lit(1)).alias("members"))


@query(
    "c6_parent_child_edges",
    process_sql(
        """SELECT weight, count(*) AS edges FROM (SELECT CASE WHEN f.node IS NOT NULL THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END AS weight
 FROM proc p JOIN (SELECT DISTINCT device_id, tick, pid FROM proc) q ON q.device_id = p.device_id AND q.tick = p.tick AND q.pid = p.parent_pid
 LEFT JOIN fam f ON f.device_id = p.device_id AND f.tick = p.tick AND f.node = p.parent_pid WHERE p.parent_pid <> 0) GROUP BY weight""",
        _FAMILY, recursive=True,
    ),
)
def c6_parent_child_edges(spark, folder):
    edges = N.family_edges(processes(spark, folder), family(spark, folder), TICK)
    return edges.groupBy("weight").agg(F.count(F.lit(1)).alias("edges"))


_CRITICALITY = """crt AS (SELECT c.*, f.node IS NOT NULL AS infam, greatest(
   CASE WHEN front THEN 100 ELSE 0 END, CASE WHEN f.node IS NOT NULL AND NOT front THEN 92 ELSE 0 END, CASE WHEN front OR recent OR family THEN 95 ELSE 0 END, CASE WHEN recent THEN 82 ELSE 0 END,
   CASE WHEN has_visible_window THEN 72 ELSE 0 END, CASE WHEN critical OR safety = 'PROTECTED' THEN 100 ELSE 0 END,
   CASE WHEN name IN ('audiodg.exe', 'vlc.exe') AND workload_phase IN ('VIDEO_MEETING', 'PASSIVE_PLAYBACK', 'GAMING') THEN 96 ELSE 0 END,
   CASE WHEN name IN ('clang.exe', 'ninja.exe') AND workload_phase = 'COMPILATION' THEN 88 ELSE 0 END,
   CASE WHEN io_read_kbps + io_write_kbps > 1024 AND workload_phase IN ('APP_LAUNCHING', 'LARGE_FILE_TRANSFER') THEN 75 ELSE 0 END, 10)::DOUBLE AS criticality
  FROM cls c LEFT JOIN fam f ON f.device_id = c.device_id AND f.tick = c.tick AND f.node = c.pid)"""


def nodes(spark, folder):
    return N.criticality(classified(spark, folder), family(spark, folder), TICK)


@query(
    "i2_criticality",
    process_sql("SELECT criticality, criticality >= 70 OR critical AS protected, infam OR front OR recent OR family AS on_path, count(*) AS n FROM crt GROUP BY ALL", _FAMILY, _CRITICALITY, recursive=True),
)
def i2_criticality(spark, folder):
    return nodes(spark, folder).groupBy(
        "criticality", F.col("protected_from_intervention").alias("protected"), F.col("on_foreground_path").alias("on_path")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "i3_workload_protection",
    process_sql(
        """SELECT reason, count(*) AS n FROM (SELECT coalesce(CASE WHEN workload_phase = 'COMPILATION' AND name IN ('clang.exe', 'ninja.exe') THEN 'compilation and IDE dependency protected'
  WHEN workload_phase = 'GAMING' AND (front OR name IN ('audiodg.exe', 'steam_updater.exe')) THEN 'game, audio, or launcher dependency protected'
  WHEN workload_phase = 'VIDEO_MEETING' AND name = 'audiodg.exe' THEN 'meeting audio/video dependency protected'
  WHEN workload_phase = 'PASSIVE_PLAYBACK' AND (name IN ('audiodg.exe', 'vlc.exe') OR front OR recent OR family) THEN 'media playback dependency protected' END,
  CASE WHEN criticality >= 70 OR critical OR front THEN 'critical path' END) AS reason FROM crt) WHERE reason IS NOT NULL GROUP BY reason""",
        _FAMILY, _CRITICALITY, recursive=True,
    ),
)
def i3_workload_protection(spark, folder):
    return N.protected_processes(nodes(spark, folder), TICK).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c8_target_criticality",
    process_sql(
        """SELECT coalesce(k, 100.0::DOUBLE) AS target_criticality, count(*) AS n FROM (SELECT device_id, tick, (tick % 9 + 1) * 10 AS pid FROM itn)
 LEFT JOIN (SELECT device_id, tick, pid, max(criticality) AS k FROM crt GROUP BY ALL) USING (device_id, tick, pid) GROUP BY 1""",
        _FAMILY, _CRITICALITY, recursive=True,
    ),
)
def c8_target_criticality(spark, folder):
    decisions = intents(spark, folder).select(*TICK, ((F.col("tick") % 9 + 1) * 10).alias("target_pid"))
    rows = N.target_criticality(decisions, nodes(spark, folder), TICK)
    return rows.groupBy("target_criticality").agg(F.count(F.lit(1)).alias("n"))


# -- decision scores ------------------------------------------------------------------------


@query(
    "h1_pressure",
    with_telemetry(f"SELECT phase, count(*) AS n, round(avg(p), 6) AS mean_pressure, round(max(p), 6) AS peak FROM (SELECT *, {pressure_sql()} AS p FROM tel) GROUP BY phase"),
)
def h1_pressure(spark, folder):
    rows = telemetry(spark, folder).withColumn("p", S.pressure("cpu", "mem", "disk"))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p")).alias("mean_pressure"), r(F.max("p")).alias("peak"))


@query(
    "h2_label_risk",
    "SELECT c_mktsegment AS segment, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 92.0::DOUBLE WHEN 'MACHINERY' THEN 66.0::DOUBLE WHEN 'BUILDING' THEN 18.0::DOUBLE ELSE 50.0::DOUBLE END AS risk, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS severity, count(*) AS n FROM customer GROUP BY ALL",
)
def h2_label_risk(spark, folder):
    label = S.by_value(F.col("c_mktsegment"), {"HOUSEHOLD": "CRITICAL", "MACHINERY": "WARNING", "BUILDING": "RECOVERY"}, "OTHER")
    return table(spark, folder, "customer").groupBy(
        F.col("c_mktsegment").alias("segment"), S.label_risk(label).alias("risk"), S.severity_rank(label).alias("severity")
    ).agg(F.count(F.lit(1)).alias("n"))


def scored_ticks(spark, folder):
    """Telemetry with deviations and the inputs of the live decision."""
    rows = W.deviation_scores(telemetry(spark, folder), KEY, ORDER, ["cpu", "mem", "disk", "net", "process"])
    c = {
        "cpu": F.col("cpu"), "mem": F.col("mem"), "disk": F.col("disk"), "net": F.col("net"), "process_count": F.col("process"),
        "net_deviation": F.col("net_deviation"), "process_deviation": F.col("process_deviation"), "top_cpu": F.col("top_cpu"),
        "top_private_mb": F.col("top_mem"), "top_waste": F.col("mem") * 0.7, "qoe": F.col("seq") % 3 == 0, "page_reads": F.col("net") * 2,
        "disk_queue": F.col("mem") / 25, "input_ms": F.col("cpu"),
    }
    source = S.by_value(F.col("phase"), {"view": "MODEL", "click": "FALLBACK"}, "WARMING UP")
    rows = rows.withColumns(
        {
            "anomaly": S.anomaly_score("cpu_deviation", "mem_deviation", "disk_deviation", "net_deviation", "process_deviation", "top_cpu", "top_mem", F.col("mem") * 0.7),
            "pressure": S.pressure("cpu", "mem", "disk"),
            "cause": S.live_root_cause(c),
            "source": source,
        }
    )
    adjust = F.when(F.col("seq") % 3 == 0, S.qoe_adjustment("cpu", F.col("net") * 2, F.col("mem") / 25, F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("risk", S.fused_risk("mem", "cpu", "source", "anomaly", "pressure", 0.0, adjust)).withColumn(
        "level", S.risk_level("risk", "cpu", "mem", "disk")
    )


_LIVE = (
    DEVIATION_CTE,
    "dsc AS (SELECT *, " + ", ".join(f"CAST({deviation_sql(c)} AS DOUBLE) AS d_{c}" for c in ("cpu", "mem", "disk", "net", "process")) + " FROM dev)",
    f"""liv AS (SELECT *, least(100, d_cpu * 0.28::DOUBLE + d_mem * 0.24::DOUBLE + d_disk * 0.18::DOUBLE + d_net * 0.15::DOUBLE + d_process * 0.15::DOUBLE + CASE WHEN top_cpu >= 45 THEN 15 ELSE 0 END
    + CASE WHEN top_mem >= 500 THEN 10 ELSE 0 END + CASE WHEN mem * 0.7::DOUBLE >= 70 THEN 8 ELSE 0 END) AS anomaly, {pressure_sql()} AS pressure,
   CASE WHEN cpu < 80 THEN least(100, greatest(0, cpu / 80 * 45)) ELSE least(100, 55 + (cpu - 80) / 20 * 45) END AS s0,
   CASE WHEN mem < 85 THEN least(100, greatest(0, mem / 85 * 45)) ELSE least(100, 55 + (mem - 85) / 15 * 45) END AS s1,
   CASE WHEN disk <= 10 THEN least(100, 55 + (10 - disk) / 10 * 45) ELSE least(100, greatest(0, (100 - disk) / 100 * 35)) END AS s2,
   least(100, d_net + least(35, net / 512)) AS s3, least(100, d_process + greatest(0, (process - 180) / 2)) AS s4,
   CASE WHEN seq % 3 = 0 THEN least(100, net * 2 / 250 * 100) ELSE -1 END AS s5, CASE WHEN seq % 3 = 0 THEN least(100, mem / 25 / 4 * 100) ELSE -1 END AS s6,
   CASE WHEN seq % 3 = 0 THEN least(100, cpu) ELSE -1 END AS s7, least(100, top_cpu * 0.9::DOUBLE + least(35, top_mem / 20) + mem * 0.7::DOUBLE * 0.45::DOUBLE) AS s8 FROM dsc)""",
)


@query(
    "h4_live_root_cause",
    with_telemetry(
        """SELECT device_id, seq, round(top, 6) + 0 AS score, CASE top WHEN s0 THEN 'cpu' WHEN s1 THEN 'memory' WHEN s2 THEN 'disk' WHEN s3 THEN 'network' WHEN s4 THEN 'process_count'
 WHEN s5 THEN 'paging_pressure' WHEN s6 THEN 'disk_contention' WHEN s7 THEN 'foreground_latency' ELSE 'process' END AS cause FROM (SELECT *, greatest(s0, s1, s2, s3, s4, s5, s6, s7, s8) AS top FROM liv)""",
        *_LIVE,
    ),
)
def h4_live_root_cause(spark, folder):
    return scored_ticks(spark, folder).select("device_id", "seq", r(F.col("cause.score")).alias("score"), F.col("cause.name").alias("cause"))


@query(
    "h5_risk_fusion",
    with_telemetry(
        """SELECT device_id, seq, round(risk, 4) + 0 AS risk, CASE WHEN cpu >= 97 OR mem >= 97 OR disk <= 3 OR risk >= 65 THEN 'CRITICAL' WHEN risk >= 45 THEN 'WARNING' ELSE 'NORMAL' END AS level
FROM (SELECT *, least(100, greatest(0, mem * w + anomaly * 0.25::DOUBLE + pressure * (1 - w - 0.25::DOUBLE) + CASE WHEN seq % 3 = 0 THEN least(7, greatest(0, cpu - 25) / 10) + least(5, net * 2 / 100) + least(5, mem / 25 * 1.5::DOUBLE) ELSE 0 END)) AS risk
 FROM (SELECT *, CASE phase WHEN 'view' THEN 0.35::DOUBLE + 0.3::DOUBLE * cpu / 100 WHEN 'click' THEN 0.35::DOUBLE ELSE 0.2::DOUBLE END AS w FROM liv))""",
        *_LIVE,
    ),
)
def h5_risk_fusion(spark, folder):
    return scored_ticks(spark, folder).select("device_id", "seq", r("risk", 4).alias("risk"), "level")


_DIAG = [
    ("mem >= 85 * 0.95::DOUBLE", "memory", "mem / 85", "memory near threshold"),
    ("cpu >= 80 * 0.95::DOUBLE", "cpu", "cpu / 80", "cpu near threshold"),
    ("disk <= 10", "disk", "(10 - disk + 1) / 10", "disk space low"),
    ("mem_slope > 0.8", "memory", "0.75::DOUBLE", "memory rising"),
    ("cpu_slope > 1.5", "cpu", "0.7::DOUBLE", "cpu rising"),
    ("net > greatest(1024, net_median * 2.5)", "network", "0.65::DOUBLE", "network spike"),
    ("growth >= 8", "process_count", "0.6::DOUBLE", "process count rising"),
    ("top_cpu >= 35", "top_process_cpu", "top_cpu / 100", "top process cpu pressure"),
    ("top_mem >= 700", "top_process_memory", "least(1, top_mem / 2000)", "top process memory pressure"),
    ("label = 'RECOVERY'", "recovery", "0.7::DOUBLE", "pressure improving"),
]


@query(
    "h3_window_diagnosis",
    with_telemetry(
        """SELECT device_id, seq, best.p AS primary_cause, round(least(100, -best.k * 100), 4) AS score, CASE WHEN -best.k >= 1 OR label = 'CRITICAL' THEN 'critical' WHEN -best.k >= 0.65::DOUBLE THEN 'warning' ELSE 'normal' END AS severity,
 array_to_string(list_transform(list_slice(ranked, 1, 3), lambda x: x.r), ', ') AS reasons
FROM (SELECT *, ranked[1] AS best FROM (SELECT *, CASE WHEN len(found) > 0 THEN list_sort(found) ELSE [{'k': -0.2::DOUBLE, 'i': 0, 'p': CASE WHEN label = 'NORMAL' THEN 'stable' ELSE 'forecast' END,
  'r': CASE WHEN label = 'NORMAL' THEN 'resource pattern stable' ELSE 'forecast trend elevated' END}] END AS ranked FROM (SELECT *, list_filter(["""
        + ", ".join(f"CASE WHEN {c} THEN {{'k': -({s}), 'i': {i}, 'p': '{p}', 'r': '{t}'}} END" for i, (c, p, s, t) in enumerate(_DIAG))
        + """], lambda x: x IS NOT NULL) AS found FROM win WHERE n8 = 8)))""",
        f"num AS (SELECT *, {pressure_sql()} AS press, row_number() OVER ({OVER}) AS i FROM tel)",
        f"""win AS (SELECT device_id, seq, cpu, mem, disk, net, top_cpu, top_mem, CASE WHEN press >= 82 THEN 'CRITICAL' WHEN press >= 58 THEN 'WARNING' WHEN seq % 9 = 0 THEN 'RECOVERY' ELSE 'NORMAL' END AS label,
   count(*) OVER w AS n8, median(net) OVER w AS net_median, process - first(process) OVER w AS growth, regr_slope(cpu, i) OVER w AS cpu_slope, regr_slope(mem, i) OVER w AS mem_slope
  FROM num WINDOW w AS ({OVER} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))""",
    ),
)
def h3_window_diagnosis(spark, folder):
    tel = telemetry(spark, folder).withColumn("press", S.pressure("cpu", "mem", "disk"))
    label = F.when(F.col("press") >= 82, "CRITICAL").when(F.col("press") >= 58, "WARNING").when(F.col("seq") % 9 == 0, "RECOVERY").otherwise("NORMAL")
    rows = W.window_features(tel.withColumn("label", label), KEY, ORDER)
    f = {
        "cpu": F.col("cpu"), "mem": F.col("mem"), "disk": F.col("disk"), "net": F.col("net"), "cpu_slope": F.col("cpu_slope"), "mem_slope": F.col("mem_slope"),
        "net_median": F.col("net_median"), "process_delta": F.col("process_growth"), "top_cpu": F.col("top_cpu"), "top_mem": F.col("top_mem"),
    }
    # The features carry the spike over the median, which gives the median back.
    spike = F.col("net_spike")
    rows = rows.withColumn("net_median", F.when(spike > 0, F.col("net") - spike).otherwise(F.lit(1e12)))
    d = rows.withColumn("d", S.window_diagnosis(f, "label"))
    return d.select(
        "device_id", "seq", F.col("d.primary").alias("primary_cause"), r(F.col("d.score"), 4).alias("score"), F.col("d.severity").alias("severity"),
        F.array_join("d.reasons", ", ").alias("reasons"),
    )


@query(
    "h7_user_intent",
    """SELECT CASE WHEN contains(p, 'red') THEN 'BROWSER' WHEN contains(p, 'ring') THEN 'IDE' ELSE 'UNKNOWN' END AS app_kind, CASE WHEN p_size < 10 THEN 'ACTIVE' WHEN p_size < 30 THEN 'IDLE' ELSE 'AWAY' END AS user_state, count(*) AS n
FROM (SELECT *, lower(p_name) AS p FROM part) GROUP BY ALL""",
)
def h7_user_intent(spark, folder):
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("p_name", "red", "Chrome"), "ring", "CODE"), "(?i)(?!chrome|code)\\b(game|cmd|meet|obs)\\b", "x")
    idle = F.when(F.col("p_size") < 10, 5.0).when(F.col("p_size") < 30, 30.0).otherwise(300.0)
    return table(spark, folder, "part").groupBy(S.app_kind(name, F.lit("")).alias("app_kind"), S.user_state(idle).alias("user_state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h8_workload_phase",
    """SELECT phase, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 100 < 2 THEN 'POST_BOOT_STABILIZATION' WHEN l_quantity >= 49 THEN 'USER_IDLE' WHEN l_tax = 0 AND l_discount < 0.03 THEN 'BATTERY_SAVER'
 WHEN l_linenumber = 3 THEN 'VIDEO_MEETING' WHEN l_linenumber = 4 OR (l_returnflag = 'R' AND l_linenumber <> 5) THEN 'GAMING' WHEN l_linenumber = 5 OR (l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity >= 5) THEN 'PASSIVE_PLAYBACK'
 WHEN l_partkey % 17 = 0 THEN 'COMPILATION' WHEN l_extendedprice / 20 >= 2048 THEN 'LARGE_FILE_TRANSFER' WHEN l_suppkey % 5 <> 0 AND l_quantity / 4 <= 8 THEN 'APP_LAUNCHING' WHEN l_quantity < 30 THEN 'ACTIVE_INTERACTION'
 WHEN l_linestatus = 'O' AND l_extendedprice / 1000 > 50 THEN 'ACTIVE_INTERACTION' ELSE 'UNKNOWN' END AS phase FROM lineitem) GROUP BY phase""",
)
def h8_workload_phase(spark, folder):
    kinds = {1: "BROWSER", 2: "IDE", 3: "COMMUNICATION", 4: "GAME", 5: "MEDIA"}
    idle = F.when(F.col("l_quantity") >= 49, 300.0).otherwise(F.col("l_quantity"))
    phase = S.workload_phase(
        {
            "uptime_ms": F.when(F.col("l_orderkey") % 100 < 2, 1000).otherwise(500000), "user_state": S.user_state(idle), "idle_seconds": idle,
            "on_battery": F.col("l_tax") == 0, "battery_percent": F.when(F.col("l_discount") < 0.03, 20).otherwise(60),
            "app_kind": S.by_value(F.col("l_linenumber"), kinds, "UNKNOWN"), "is_fullscreen": F.col("l_returnflag") == "R",
            "compiler_busy": F.col("l_partkey") % 17 == 0, "net_kbps": F.col("l_extendedprice") / 20, "top_io_kbps": F.lit(0.0),
            "foreground_pid": F.col("l_suppkey") % 5, "focus_seconds": F.col("l_quantity") / 4, "input_available": F.col("l_linestatus") == "O",
            "input_ms": F.col("l_extendedprice") / 1000,
        }
    )
    return table(spark, folder, "lineitem").groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


_CTX_SQL = "1 + 2 * least(1, cpu / 100) + 3 * least(1, mem / 100) + 4 * least(1, greatest(0, (10 - disk) / 10)) + 5 * least(2, top_cpu / 100) + 6 * least(2, net / 500) + 7 * least(2, mem / 5) + 8 * least(2, cpu / 10) + 9 * least(1, mem / 100) + 10 * least(1, disk / 100) + 11 * 0.5 + 12 * least(2, net / 4096)"


@query(
    "h10_context_vector",
    with_telemetry(
        f"SELECT device_id, seq, 22 AS dimension, round({_CTX_SQL} + CASE WHEN seq % 11 = 0 THEN 0 ELSE 12 + seq % 11 END, 4) + 0 AS weighted_sum FROM tel".replace("11 * 0.5", "11 * 0.5::DOUBLE")
    ),
)
def h10_context_vector(spark, folder):
    c = {n: F.col(n) for n in ("cpu", "mem", "disk")} | {
        "input_ms": F.col("top_cpu"), "page_reads": F.col("net"), "disk_queue": F.col("mem"), "dropped_frames": F.col("cpu"), "criticality": F.col("mem"),
        "safety": F.col("disk"), "total_memory_mb": F.lit(4096.0), "net_kbps": F.col("net"),
        "phase": F.element_at(F.array(*[F.lit(p) for p in S.WORKLOAD_PHASES]), (F.col("seq") % 11 + 1).cast("int")),
    }
    rows = telemetry(spark, folder).withColumn("x", S.context_vector(c))
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("device_id", "seq", F.size("x").alias("dimension"), r(weighted, 4).alias("weighted_sum"))


@query(
    "h16_evidence_value",
    with_telemetry(
        """SELECT reason, reason IN ('safety_required', 'positive_risk_reduction') AS collect, count(*) AS n FROM (SELECT CASE WHEN seq % 10 = 0 THEN 'safety_required' WHEN seq % 4 > 1 THEN 'governor_tier_cap' WHEN mem < 20 THEN 'no_expected_value'
 WHEN (mem - 20) / greatest(0.1, cpu + net / 10) >= 0.2 THEN 'positive_risk_reduction' ELSE 'insufficient_risk_reduction' END AS reason FROM (SELECT * REPLACE (CASE WHEN mem <= 20 THEN 19.0::DOUBLE ELSE mem END AS mem) FROM tel)) GROUP BY ALL"""
    ),
)
def h16_evidence_value(spark, folder):
    d = S.evidence_decision(F.col("seq") % 10 == 0, F.col("seq") % 4, F.lit(1), F.col("mem") - 20, "cpu", "net")
    return telemetry(spark, folder).select(d.alias("d")).groupBy(F.col("d.reason").alias("reason"), F.col("d.collect").alias("collect")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h17_parse_predictions",
    with_telemetry(
        """SELECT device_id, seq, risk, round(CASE WHEN risk < 0 THEN 0 ELSE confidence END, 4) + 0 AS confidence, CASE WHEN risk < 0 THEN 'UNKNOWN' ELSE cls END AS predicted_class FROM (SELECT device_id, seq,
  CASE WHEN seq % 10 = 9 THEN -1.0::DOUBLE WHEN seq % 4 = 3 THEN mem WHEN seq % 4 = 2 THEN -1.0::DOUBLE ELSE mem END AS risk, CASE WHEN seq % 4 = 3 THEN 55 ELSE least(100, net) END AS confidence,
  CASE WHEN seq % 4 = 3 THEN CASE WHEN mem >= 75 THEN 'CRITICAL' WHEN mem >= 55 THEN 'WARNING' ELSE 'NORMAL' END WHEN seq % 4 = 1 THEN 'UNKNOWN' ELSE phase END AS cls FROM tel)"""
    ),
)
def h17_parse_predictions(spark, folder):
    """Objects, an object with a probability, an out-of-range object, bare numbers and broken text."""
    text = (
        F.when(F.col("seq") % 10 == 9, F.lit("not a number"))
        .when(F.col("seq") % 4 == 3, F.col("mem").cast("string"))
        .when(F.col("seq") % 4 == 2, F.to_json(F.struct((F.col("mem") + 200).alias("risk"))))
        .when(F.col("seq") % 4 == 1, F.to_json(F.struct(F.col("mem").alias("probability"), F.col("net").alias("confidence"))))
        .otherwise(F.to_json(F.struct(F.col("mem").alias("risk"), F.col("net").alias("confidence"), F.col("phase").alias("class"))))
    )
    rows = telemetry(spark, folder).withColumn("text", text).withColumn("p", S.parse_prediction("text"))
    return rows.select("device_id", "seq", F.col("p.risk").alias("risk"), r(F.col("p.confidence"), 4).alias("confidence"), F.col("p.predicted_class").alias("predicted_class"))


@query(
    "h18_prediction_payload",
    with_telemetry(
        """SELECT device_id, seq, round(a * 18 + b * 66 + c * 92 + d * 18, 4) AS risk, round((v[1] * 0.72::DOUBLE + (v[1] - v[2]) * 0.28::DOUBLE) * 100, 4) + 0 AS confidence,
 CASE v[1] WHEN a THEN 'NORMAL' WHEN b THEN 'WARNING' WHEN c THEN 'CRITICAL' ELSE 'RECOVERY' END AS predicted_class FROM (SELECT *, list_reverse_sort([a, b, c, d]) AS v FROM
 (SELECT device_id, seq, (mem + 1) / s AS a, (cpu + 1) / s AS b, (disk + 1) / s AS c, (top_cpu + 1) / s AS d FROM (SELECT *, mem + cpu + disk + top_cpu + 4 AS s FROM tel)))"""
    ),
)
def h18_prediction_payload(spark, folder):
    total = F.col("mem") + F.col("cpu") + F.col("disk") + F.col("top_cpu") + 4
    p = {"NORMAL": "mem", "WARNING": "cpu", "CRITICAL": "disk", "RECOVERY": "top_cpu"}
    payload = S.prediction_payload({k: (F.col(v) + 1) / total for k, v in p.items()})
    return telemetry(spark, folder).select("device_id", "seq", r(payload["risk"], 4).alias("risk"), r(payload["confidence"], 4).alias("confidence"), payload["predicted_class"].alias("predicted_class"))


@query(
    "h19_device_tiers",
    """SELECT CAST(s_suppkey % 16 + 1 AS VARCHAR) || '_LOGICAL' AS cpu_core_tier, CAST((s_suppkey * 100 + 511) // 1024 AS VARCHAR) || 'GB' AS ram_tier, CASE WHEN s_acctbal > 0 THEN 'AC' ELSE 'BATTERY_OR_UNKNOWN' END AS power_mode,
 CASE WHEN s_suppkey % 6 = 0 THEN 'FULLSCREEN' WHEN s_suppkey % 7 = 0 THEN 'AWAY' WHEN s_suppkey % 5 = 0 THEN 'NO_FOREGROUND' ELSE 'INTERACTIVE' END AS behaviour, count(*) AS n FROM supplier GROUP BY ALL""",
)
def h19_device_tiers(spark, folder):
    k = F.col("s_suppkey")
    tiers = S.device_tiers(k * 100, k % 16 + 1, F.col("s_acctbal") > 0)
    behaviour = S.foreground_behaviour(k % 6 == 0, F.when(k % 7 == 0, "AWAY").otherwise("ACTIVE"), k % 5)
    return table(spark, folder, "supplier").groupBy(*[c.alias(n) for n, c in tiers.items()], behaviour.alias("behaviour")).agg(F.count(F.lit(1)).alias("n"))


# -- gates ----------------------------------------------------------------------------------


def _mechanism():
    return G.mechanism_check(
        {
            "telemetry_complete": F.col("seq") % 12 != 0, "qoe_degraded": F.col("seq") % 5 != 0, "memory": F.col("mem"), "hard_faults": F.col("net"),
            "storage_latency": F.col("cpu"), "storage_queue": F.col("top_cpu") / 20, "cpu": F.col("cpu"), "runnable": F.col("mem") / 100,
            "process_storm": F.col("top_cpu") / 60, "thermal": F.col("mem") / 2, "network": F.col("net"), "reversible": F.col("phase") != "purchase",
        }
    )


_MECH = """mch AS (SELECT *, CASE WHEN seq % 12 = 0 OR seq % 5 = 0 THEN 'UNKNOWN' WHEN mem >= 85 AND net >= 20 THEN 'MEMORY_PAGING' WHEN cpu >= 30 AND top_cpu / 20 >= 1 THEN 'STORAGE_LATENCY' WHEN cpu >= 80 AND mem / 100 >= 0.7 THEN 'CPU_SCHEDULING'
  WHEN top_cpu / 60 >= 0.75 THEN 'PROCESS_STORM' WHEN mem / 2 >= 25 THEN 'THERMAL_POWER' WHEN net >= 80 THEN 'NETWORK_CONTENTION' ELSE 'UNKNOWN' END AS cause FROM tel)"""


@query(
    "h11_mechanism_check",
    with_telemetry(
        """SELECT cause AS root_cause, CASE WHEN seq % 12 = 0 THEN 'telemetry_incomplete' WHEN seq % 5 = 0 THEN 'no_user_impact_to_explain' WHEN cause = 'UNKNOWN' THEN 'no_supported_mechanism'
 WHEN phase <> 'purchase' THEN 'mechanism_supported_reversible_recommendation' ELSE 'mechanism_supported_but_action_not_reversible' END AS reason, count(*) AS n FROM mch GROUP BY ALL""",
        _MECH,
    ),
)
def h11_mechanism_check(spark, folder):
    rows = telemetry(spark, folder).withColumn("m", _mechanism())
    return rows.groupBy(F.col("m.root_cause").alias("root_cause"), F.col("m.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h12_cascade_routing",
    with_telemetry(
        """SELECT route, reason, count(*) AS n FROM (SELECT CASE WHEN seq % 12 = 0 THEN 'ESCALATE' WHEN stable THEN 'STABLE' WHEN mem / 100 < 0.55 THEN 'POSSIBLE_EVENT' ELSE 'ESCALATE' END AS route,
  CASE WHEN seq % 12 = 0 THEN 'telemetry_incomplete_escalate' WHEN stable THEN 'sentinel_stable_monitoring_only' WHEN seq % 23 / 100 > 0.2 OR seq % 7 = 0 OR cause = 'UNKNOWN' THEN 'failure_critic_abstained'
   WHEN disk >= 70 THEN 'specialist_and_critic_support_recommendation' ELSE 'specialist_event_below_recommendation_threshold' END AS reason
  FROM (SELECT *, mem / 100 < 0.15 AND cpu < 70 AND mem < 80 AND net < 20 AS stable FROM mch)) GROUP BY ALL""",
        _MECH,
    ),
)
def h12_cascade_routing(spark, folder):
    rows = telemetry(spark, folder).withColumn("m", _mechanism())
    yes = F.lit(True)
    c = {
        "telemetry_complete": F.col("seq") % 12 != 0, "anomaly": F.col("mem") / 100, "cpu": F.col("cpu"), "memory": F.col("mem"), "disk_latency": F.col("net"),
        "probability": (F.col("disk") - 20) / 100, "disagreement": F.col("seq") % 23 / 100, "ood": F.lit(0.1), "error_bound": F.lit(0.05),
        "envelope_match": F.col("seq") % 7 != 0, "missingness_ok": yes, "causal_support": yes,
    }
    rows = rows.withColumn("c", G.cascade(c, F.col("m.sufficient")))
    return rows.groupBy(F.col("c.route").alias("route"), F.col("c.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h13_reliability_gate",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_regionkey = 4 THEN 'certificate_missing' WHEN 1000 <= c_custkey % 1100 THEN 'certificate_expired' WHEN c_custkey % 13 = 0 THEN 'artifact_hash_mismatch'
 WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'outside_supported_envelope' WHEN c_custkey % 17 = 0 THEN 'data_quality_rejected' WHEN c_custkey % 19 = 0 THEN 'certificate_invalidated_by_drift'
 WHEN c_custkey % 19 = 1 THEN 'drift_requires_monitor_only' WHEN c_acctbal / 10000 > 0.9 THEN 'ood_rejected' WHEN c_custkey % 23 = 0 THEN 'error_budget_exceeded' WHEN c_custkey % 29 = 0 THEN 'coverage_lower_bound_failed'
 WHEN n_regionkey % 2 = 0 THEN 'research_certificate_recommendation_only' ELSE 'valid_certificate_recommendation_only' END AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY reason""",
)
def h13_reliability_gate(spark, folder):
    """Customers against the certificate of their region; the last region has none."""
    certs = table(spark, folder, "region").where(F.col("r_regionkey") < 4).select(
        F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("cert"), F.col("r_regionkey")).alias("certificate_id"), F.lit("m1").alias("cert_model"), F.lit("s1").alias("cert_schema"),
        F.lit(0).alias("issued_at"), F.lit(1000).alias("expires_at"), F.lit(0.1).alias("max_error"), F.lit(0.5).alias("min_coverage"), (F.col("r_regionkey") % 2 == 0).alias("for_research"),
        F.array(F.lit("w11")).alias("builds"), F.array(F.lit("BUILDING"), F.lit("HOUSEHOLD"), F.lit("MACHINERY")).alias("workloads"),
    )
    k = F.col("c_custkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(certs, "n_regionkey", "left")
    one = F.lit("w11")
    cert = {n: F.col(n) for n in ("certificate_id", "issued_at", "expires_at", "max_error", "min_coverage", "for_research")}
    cert |= {"model_hash": F.col("cert_model"), "schema_hash": F.col("cert_schema"), "workload_class": F.col("workloads")}
    cert |= {f: F.col("builds") for f in ("windows_build_family", "cpu_core_tier", "ram_tier", "storage_tier")}
    row = {
        "now": k % 1100, "model_hash": F.when(k % 13 == 0, "m0").otherwise("m1"), "schema_hash": F.lit("s1"), "workload_class": F.col("c_mktsegment"), "data_ok": k % 17 != 0,
        "drift": F.when(k % 19 == 0, "CERTIFICATE_INVALID").when(k % 19 == 1, "DETERMINISTIC_MONITOR_ONLY").otherwise("NORMAL"),
        "ood": F.when(F.col("c_acctbal") / 10000 > 0.9, 0.3).otherwise(0.1), "error_bound": F.when(k % 23 == 0, 0.2).otherwise(0.05), "coverage_bound": F.when(k % 29 == 0, 0.4).otherwise(0.8),
    }
    row |= {f: one for f in ("windows_build_family", "cpu_core_tier", "ram_tier", "storage_tier")}
    gate = G.reliability_gate(cert, row)
    return rows.groupBy(gate["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h14_policy_waterfall",
    with_telemetry(
        """SELECT code, level, count(*) AS n, round(sum(score), 3) + 0 AS score FROM (SELECT CASE WHEN phase = 'view' THEN 'NO_ACTION' WHEN seq % 7 = 0 THEN 'DENYLIST_TARGET' WHEN seq % 5 = 0 THEN 'PROTECTED_TARGET' WHEN seq % 11 = 0 THEN 'USER_ACTIVE_TARGET'
  WHEN seq % 13 = 0 THEN 'COOLDOWN_ACTIVE' WHEN phase = 'click' THEN 'USER_REVIEW_REQUIRED' WHEN mem < 20 THEN 'VERIFICATION_FAILED' WHEN mem < 40 THEN 'VERIFICATION_NOT_READY' WHEN seq % 3 <> 0 THEN 'ALLOWLIST_REQUIRED'
  WHEN cpu < 60 THEN 'MODEL_GATE_FAILED' WHEN mem < 60 THEN 'READINESS_GATE_FAILED' WHEN score < 90 THEN 'POLICY_SCORE_LOW' ELSE 'EXECUTION_ELIGIBLE' END AS code,
  CASE WHEN phase = 'view' THEN 'SIMULATION_ONLY' WHEN seq % 7 = 0 OR seq % 5 = 0 OR seq % 11 = 0 THEN 'FORBIDDEN' WHEN seq % 13 = 0 THEN 'SIMULATION_ONLY' WHEN phase = 'click' THEN 'REVIEW_REQUIRED' WHEN mem < 20 THEN 'FORBIDDEN'
  WHEN mem < 40 THEN 'SIMULATION_ONLY' WHEN seq % 3 <> 0 THEN 'REVIEW_REQUIRED' WHEN cpu < 60 OR mem < 60 OR score < 90 THEN 'SIMULATION_ONLY' ELSE 'EXECUTION_ELIGIBLE' END AS level, score FROM
 (SELECT *, least(100, greatest(0, 100 * 0.22::DOUBLE + (cpu + 25) * 0.2::DOUBLE + (mem + 15) * 0.22::DOUBLE + (mem + 10) * 0.16::DOUBLE + CASE WHEN mem >= 40 THEN 15 ELSE 0 END + 5 - CASE WHEN seq % 5 = 0 THEN 45 ELSE 0 END - CASE WHEN seq % 11 = 0 THEN 35 ELSE 0 END
  - CASE WHEN seq % 7 = 0 THEN 60 ELSE 0 END - CASE WHEN seq % 7 = 0 OR seq % 3 <> 0 THEN 18 ELSE 0 END - CASE WHEN mem < 20 THEN 25 ELSE 0 END)) AS score FROM tel)) GROUP BY ALL"""
    ),
)
def h14_policy_waterfall(spark, folder):
    k, mem = F.col("seq"), F.col("mem")
    no, yes = F.lit(False), F.lit(True)
    c = {
        "target_name": F.when(k % 7 == 0, "Denied.exe").when(k % 3 == 0, "good.exe").otherwise("other.exe"), "target_pid": F.lit(77), "category": F.lit("BACKGROUND_HELPER"),
        "safety": F.when(k % 5 == 0, "PROTECTED").otherwise("CANDIDATE"), "intent_protected": no, "denied_candidate": no, "is_foreground": k % 11 == 0, "candidate_safety": F.lit(100.0),
        "action_confidence": F.col("cpu") + 25, "safety_gate": F.when(k % 13 == 0, "COOLDOWN").otherwise("MODEL_CALIBRATION_REQUIRED"), "safe_to_heal": yes, "risk_level": F.lit("CRITICAL"),
        "action": F.when(F.col("phase") == "view", "monitor_only").otherwise("act"), "root_cause": F.when(F.col("phase") == "click", "disk").otherwise("cpu"), "plan_status": F.lit("READY"),
        "plan_executes": yes, "plan_readiness": mem + 15, "plan_needs_approval": no, "simulated_pass": mem >= 40, "simulated_fail": mem < 20, "verification_blocked": no, "verification_confidence": mem + 10,
    }
    switches = G.PolicySwitches(auto_heal=True, safe_mode=False, dry_run=False, allow="good.exe", deny="denied.exe")
    rows = telemetry(spark, folder).withColumn("g", G.policy_waterfall(c, switches))
    return rows.groupBy(F.col("g.code").alias("code"), F.col("g.level").alias("level")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("g.score"), 3).alias("score"))


_SWITCHES = {"open": (True, False, False), "safe": (True, True, False), "dry": (True, False, True), "off": (False, False, False)}


@query(
    "h14_policy_replay",
    with_telemetry(
        """SELECT setting, code, count(*) AS n, count(*) FILTER (code = recorded) AS agreeing, round(sum(score), 3) + 0 AS score FROM (
 SELECT *, CASE WHEN phase = 'view' OR NOT planned THEN 'NO_ACTION' WHEN seq % 7 = 0 THEN 'DENYLIST_TARGET' WHEN seq % 5 = 0 THEN 'PROTECTED_TARGET' WHEN seq % 11 = 0 THEN 'USER_ACTIVE_TARGET'
  WHEN seq % 13 = 0 THEN 'COOLDOWN_ACTIVE' WHEN phase = 'click' THEN 'USER_REVIEW_REQUIRED' WHEN verified AND mem < 20 THEN 'VERIFICATION_FAILED' WHEN NOT verified OR mem < 40 THEN 'VERIFICATION_NOT_READY'
  WHEN NOT heals THEN 'AUTO_HEAL_DISABLED' WHEN safe THEN 'SAFE_MODE_ENABLED' WHEN dry THEN 'DRY_RUN_ENABLED' WHEN seq % 3 <> 0 THEN 'ALLOWLIST_REQUIRED'
  WHEN cpu < 60 THEN 'MODEL_GATE_FAILED' WHEN mem < 60 THEN 'READINESS_GATE_FAILED' WHEN score < 90 THEN 'POLICY_SCORE_LOW' ELSE 'EXECUTION_ELIGIBLE' END AS code FROM (
 SELECT *, CASE WHEN phase = 'view' THEN 'NO_ACTION' ELSE 'DRY_RUN_ENABLED' END AS recorded,
  least(100, greatest(0, 100 * 0.22::DOUBLE + (cpu + 25) * 0.2::DOUBLE + CASE WHEN planned THEN mem + 15 ELSE 0 END * 0.22::DOUBLE + CASE WHEN verified THEN mem + 10 ELSE 0 END * 0.16::DOUBLE
   + CASE WHEN verified AND mem >= 40 THEN 15 ELSE 0 END + 5 - CASE WHEN seq % 5 = 0 THEN 45 ELSE 0 END - CASE WHEN seq % 11 = 0 THEN 35 ELSE 0 END - CASE WHEN seq % 7 = 0 THEN 60 ELSE 0 END
   - CASE WHEN seq % 7 = 0 OR seq % 3 <> 0 THEN 18 ELSE 0 END - CASE WHEN heals THEN 0 ELSE 10 END - CASE WHEN safe THEN 10 ELSE 0 END - CASE WHEN dry THEN 10 ELSE 0 END
   - CASE WHEN verified AND mem < 20 THEN 25 ELSE 0 END - CASE WHEN verified THEN 0 ELSE 20 END)) AS score
 FROM (SELECT *, seq % 17 <> 0 AS planned, seq % 19 <> 0 AS verified FROM tel),
  (VALUES ('open', true, false, false), ('safe', true, true, false), ('dry', true, false, true), ('off', false, false, false)) v(setting, heals, safe, dry))) GROUP BY ALL"""
    ),
)
def h14_policy_replay(spark, folder):
    """Audits joined to their plans and verifications, some missing, judged anew under four settings."""
    tel, k, no = telemetry(spark, folder), F.col("seq"), F.lit(False)
    keys = ["device_id", "seq"]
    audits = tel.select(
        *keys, F.when(k % 7 == 0, "Denied.exe").when(k % 3 == 0, "good.exe").otherwise("other.exe").alias("target_name"), F.lit(77).alias("target_pid"),
        F.lit("BACKGROUND_HELPER").alias("category"), F.when(k % 5 == 0, "PROTECTED").otherwise("CANDIDATE").alias("safety"), no.alias("intent_protected"),
        no.alias("denied_candidate"), (k % 11 == 0).alias("is_foreground"), F.lit(100.0).alias("candidate_safety"), (F.col("cpu") + 25).alias("action_confidence"),
        F.when(k % 13 == 0, "COOLDOWN").otherwise("MODEL_CALIBRATION_REQUIRED").alias("safety_gate"), F.lit(True).alias("safe_to_heal"), F.lit("CRITICAL").alias("risk_level"),
        F.when(F.col("phase") == "view", "monitor_only").otherwise("act").alias("action"), F.when(F.col("phase") == "click", "disk").otherwise("cpu").alias("root_cause"),
        F.when(F.col("phase") == "view", "NO_ACTION").otherwise("DRY_RUN_ENABLED").alias("recorded_code"),
    )
    plans = tel.where(k % 17 != 0).select(
        *keys, F.lit("READY").alias("plan_status"), F.lit(True).alias("plan_executes"), (F.col("mem") + 15).alias("plan_readiness"), no.alias("plan_needs_approval")
    )
    verifications = tel.where(k % 19 != 0).select(
        *keys, (F.col("mem") >= 40).alias("simulated_pass"), (F.col("mem") < 20).alias("simulated_fail"), no.alias("verification_blocked"), (F.col("mem") + 10).alias("verification_confidence")
    )
    out = None
    for name, (heals, safe, dry) in _SWITCHES.items():
        switches = G.PolicySwitches(auto_heal=heals, safe_mode=safe, dry_run=dry, allow="good.exe", deny="denied.exe")
        part = G.policy_replay(audits, plans, verifications, keys, switches).select(F.lit(name).alias("setting"), "code", "agrees", "score")
        out = part if out is None else out.union(part)
    return out.groupBy("setting", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agrees").alias("agreeing"), r(F.sum("score"), 3).alias("score")
    )


@query(
    "h15_online_gate",
    with_telemetry(
        """SELECT CASE WHEN device_id % 10 = 0 THEN 'online_disabled' WHEN device_id % 10 = 1 THEN 'policy_not_promoted' WHEN phase = 'view' THEN 'no_intervention_selected' WHEN net / 100 <= 0.05 THEN 'benefit_below_gate' WHEN seq % 6 = 0 THEN 'deterministic_policy_refused'
 WHEN disk < 60 OR cpu > 60 THEN 'outside_policy_boundary' WHEN seq % 8 = 0 THEN 'protected_target' WHEN seq % 2 = 0 THEN 'approval_required' ELSE 'eligible' END AS verdict, count(*) AS n FROM tel GROUP BY 1"""
    ),
)
def h15_online_gate(spark, folder):
    k, no = F.col("seq"), F.lit(False)
    verdict = G.online_gate(
        {
            "enabled": F.col("device_id") % 10 != 0, "promoted": F.col("device_id") % 10 != 1, "would_act": F.col("phase") != "view", "lower_bound": F.col("net") / 100, "policy_eligible": k % 6 != 0,
            "hard_block": no, "target_safety": F.col("disk") + 30, "target_criticality": F.col("cpu") / 2, "target_pid": F.lit(5), "foreground_pid": F.when(k % 8 == 0, 5).otherwise(9),
            "system_critical": no, "matches_intent": no, "needs_approval": F.lit(True), "approved": k % 2 == 1,
        }
    )
    return telemetry(spark, folder).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def impact_rows(spark, folder):
    """Latest snapshot before and after each transaction (an order), joined; either side may be missing."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), (F.col("l_linenumber") % 2 == 1).alias("is_pre"), (F.col("l_linenumber") * 10000).alias("t_ms"), F.col("l_partkey").alias("o1"), F.col("l_suppkey").alias("o2"),
        F.col("l_extendedprice").alias("o3"), (F.col("l_quantity") * 2).alias("cpu"), (F.col("l_extendedprice") / 100).alias("available_mb"), (F.col("l_partkey") % 5000).cast("double").alias("page_faults"),
        F.col("l_quantity").alias("working_set_mb"), (F.col("l_suppkey") % 20 != 0).alias("foreground_alive"), F.lit(False).alias("foreground_hung"), F.lit(True).alias("measured"),
    )
    fields = ["t_ms", "cpu", "available_mb", "page_faults", "working_set_mb", "foreground_alive", "foreground_hung", "measured"]
    latest = lambda rows, name: rows.groupBy("transaction_id").agg(F.max_by(F.struct(*fields), F.struct("t_ms", "o1", "o2", "o3")).alias(name))
    pre, post = latest(lines.where("is_pre"), "pre"), latest(lines.where("not is_pre"), "post")
    joined = pre.join(post, "transaction_id", "full_outer")
    side = lambda s: {f: F.col(f"{s}.{f}") for f in fields}
    return joined.withColumn("i", G.action_impact(side("pre"), side("post"), F.lit(True)))


_IMPACT = """
snp AS (SELECT *, l_linenumber % 2 = 1 AS is_pre, l_linenumber * 10000 AS t_ms, l_quantity * 2 AS cpu, l_extendedprice / 100 AS mb, CAST(l_partkey % 5000 AS DOUBLE) AS faults, l_suppkey % 20 <> 0 AS alive FROM lineitem),
lat AS (SELECT l_orderkey, is_pre, arg_max({'t': t_ms, 'cpu': cpu, 'mb': mb, 'f': faults, 'w': l_quantity, 'alive': alive}, (t_ms, l_partkey, l_suppkey, l_extendedprice)) AS s FROM snp GROUP BY ALL),
prd AS (SELECT l_orderkey, a.s AS a, b.s AS b FROM (SELECT * FROM lat WHERE is_pre) a FULL JOIN (SELECT * FROM lat WHERE NOT is_pre) b USING (l_orderkey)),
dlt AS (SELECT l_orderkey, a IS NOT NULL AND b IS NOT NULL AS ok, a.cpu - b.cpu AS dc, b.mb - a.mb AS dm, a.w - b.w AS dw, greatest(0, (b.f - a.f) / greatest(0.001, (b.t - a.t) / 1000)) AS hf, a.alive AND NOT b.alive AS bad FROM prd),
imp AS (SELECT *, 0.45::DOUBLE * least(2, greatest(-2, dc / 5)) + 0.45::DOUBLE * least(2, greatest(-2, dm / 48)) - 0.1::DOUBLE * least(2, greatest(0, hf / 150)) AS reward FROM dlt)"""


@query(
    "h9_action_impact",
    f"""WITH {_IMPACT} SELECT CASE WHEN NOT ok THEN 'PLANNED' WHEN bad OR hf >= 150 OR dc <= -12 OR dm <= -128 OR reward <= -0.2::DOUBLE THEN 'VERIFIED_HARMFUL' WHEN reward >= 0.2::DOUBLE AND (dc >= 5 OR dm >= 48) THEN 'VERIFIED_HELPFUL' ELSE 'VERIFIED_NEUTRAL' END AS status,
 count(*) AS n, round(coalesce(sum(CASE WHEN ok THEN reward END), 0), 3) + 0 AS reward FROM imp GROUP BY 1""",
)
def h9_action_impact(spark, folder):
    return impact_rows(spark, folder).groupBy(F.col("i.status").alias("status")).agg(F.count(F.lit(1)).alias("n"), r(F.coalesce(F.sum("i.reward"), F.lit(0.0)), 3).alias("reward"))


@query(
    "c7_snapshot_pairs",
    f"WITH {_IMPACT} SELECT l_orderkey AS transaction_id, round(dc, 4) + 0 AS cpu_delta, round(dm, 4) + 0 AS available_memory_delta, round(dw, 4) + 0 AS working_set_delta FROM imp WHERE ok",
)
def c7_snapshot_pairs(spark, folder):
    rows = impact_rows(spark, folder).where(F.col("i.status") != "PLANNED")
    return rows.select("transaction_id", *[r(F.col(f"i.{c}"), 4).alias(c) for c in ("cpu_delta", "available_memory_delta", "working_set_delta")])


# -- learning -------------------------------------------------------------------------------


@query(
    "d32_off_policy_evaluation",
    """SELECT policy, total, matched, round(baseline, 6) AS baseline, round(estimate, 6) + 0 AS estimate, round(se, 6) AS standard_error, round(estimate - baseline - 1.96 * se, 6) + 0 AS lower_benefit, round(ess, 4) AS effective_sample_size,
 matched >= 30 AND ess >= 30 AND causal = matched AND estimate - baseline - 1.96 * se > 0 AS promotion_eligible FROM (SELECT policy, count(*) AS total, count(*) FILTER (m) AS matched, count(*) FILTER (m AND c) AS causal, avg(0.1::DOUBLE) AS baseline,
  avg(CASE WHEN m THEN w END) AS estimate, stddev_samp(CASE WHEN m THEN w END) / sqrt(count(*) FILTER (m)) AS se, power(sum(CASE WHEN m THEN 1 / q END), 2) / sum(CASE WHEN m THEN 1 / q / q END) AS ess
 FROM (SELECT *, least(10, greatest(-10, reward / q)) AS w FROM (SELECT l_returnflag AS policy, l_linenumber = l_orderkey % 7 + 1 AND l_quantity > 5 AS m, l_returnflag <> 'R' OR l_quantity > 6 AS c, 0.2::DOUBLE + l_tax AS q, l_discount * 10 - 0.3::DOUBLE AS reward FROM lineitem)) GROUP BY policy)""",
)
def d32_off_policy_evaluation(spark, folder):
    logged = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("policy"), F.col("l_linenumber").cast("long").alias("logged_action"), (F.col("l_orderkey") % 7 + 1).alias("candidate_action"),
        (F.col("l_discount") * 10 - 0.3).alias("reward"), F.lit(0.1).alias("baseline_reward"), (0.2 + F.col("l_tax")).alias("logging_propensity"),
        ((F.col("l_returnflag") != "R") | (F.col("l_quantity") > 6)).alias("causal_support"), (F.col("l_quantity") > 5).alias("observed"),
    )
    out = L.evaluate_policies(logged, ["policy"])
    return out.select(
        "policy", "total", "matched", r("baseline").alias("baseline"), r("estimate").alias("estimate"), r("standard_error").alias("standard_error"),
        r("lower_benefit").alias("lower_benefit"), r("effective_sample_size", 4).alias("effective_sample_size"), "promotion_eligible",
    )


def reward_samples(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("action"), F.col("embedding").cast("array<double>").alias("x"), ((F.col("vec_id") % 31 - 10) / 5.0).alias("reward")
    )


@query(
    "d33_reward_statistics",
    """WITH e AS (SELECT label AS action, embedding AS x, least(2, greatest(-2, (vec_id % 31 - 10) / 5.0::DOUBLE)) AS r, len(embedding) AS d FROM embeddings),
c AS (SELECT action, (i - 1) * d - (i - 1) * (i - 2) // 2 + j - i AS position, x[i]::DOUBLE * x[j]::DOUBLE AS v FROM (SELECT *, unnest(range(1, d + 1)) AS i FROM e), (SELECT unnest(range(1, (SELECT max(d) FROM e) + 1)) AS j) WHERE j >= i
 UNION ALL SELECT action, d * (d + 1) // 2 + i - 1, r * x[i]::DOUBLE FROM (SELECT *, unnest(range(1, d + 1)) AS i FROM e))
SELECT action, CAST(position AS INT) AS position, round(sum(v), 4) + 0 AS value FROM c GROUP BY ALL""",
)
def d33_reward_statistics(spark, folder):
    stats = L.reward_statistics(reward_samples(spark, folder))
    return stats.select("action", F.posexplode("cells").alias("position", "v")).select("action", "position", r("v", 4).alias("value"))


@query(
    "d34_normal_equations",
    """SELECT label AS action, CAST(position AS INT) AS position, count(*) AS n, 0.0::DOUBLE AS residual
FROM embeddings, (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS position) GROUP BY ALL""",
)
def d34_normal_equations(spark, folder):
    """The predictions solve the ridge equations: sum of x (x w) + w equals the sum of r x, per action."""
    samples = reward_samples(spark, folder)
    models = L.solve_models(L.reward_statistics(samples))
    scored = L.predict(samples, models, "action", "x")
    gap = F.col("expected_reward") - S.clamp(F.col("reward"), -L.REWARD_LIMIT, L.REWARD_LIMIT)
    cells = scored.select("action", F.posexplode(F.transform("x", lambda v: v * gap)).alias("position", "v"))
    sums = cells.groupBy("action", "position").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    weights = models.select("action", F.posexplode("weights").alias("position", "w"))
    residual = F.round(F.col("v") + F.col("w"), 6) + 0.0
    return sums.join(weights, ["action", "position"]).select("action", "position", "n", F.abs(residual).alias("residual"))


def two_features(spark, folder):
    """Contexts of a constant and one component, small enough for SQL to invert."""
    samples = reward_samples(spark, folder)
    return samples.select("action", F.array(F.lit(1.0), F.get("x", 0)).alias("x"), "reward")


TWO_FEATURES = """
smp AS (SELECT vec_id, label AS action, embedding[1]::DOUBLE AS x, least(2, greatest(-2, (vec_id % 31 - 10) / 5.0::DOUBLE)) AS r FROM embeddings),
sms AS (SELECT action, count(*) AS n, count(*) + 1.0::DOUBLE AS a, sum(x) AS b, sum(x * x) + 1.0::DOUBLE AS d, sum(r) AS p, sum(r * x) AS q FROM smp GROUP BY action),
mdl AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS w0, (a * q - b * p) / (a * d - b * b) AS w1 FROM sms),
prd AS (SELECT smp.*, n, w0 + w1 * x AS expected, sqrt((d - 2 * b * x + a * x * x) / (a * d - b * b)) AS uncertainty FROM smp JOIN mdl USING (action))"""


@query(
    "d34_reward_prediction",
    f"""WITH {TWO_FEATURES} SELECT action, count(*) AS n, round(avg(expected), 6) + 0 AS expected, round(avg(uncertainty), 6) + 0 AS uncertainty,
 count(*) FILTER (n >= 20 AND uncertainty <= 0.75) AS known FROM prd GROUP BY action""",
)
def d34_reward_prediction(spark, folder):
    """Every context scored by the model of its action."""
    samples = two_features(spark, folder)
    models = L.solve_models(L.reward_statistics(samples))
    scored = L.predict(samples, models, "action", "x")
    return scored.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("expected_reward")).alias("expected"), r(F.avg("uncertainty")).alias("uncertainty"), F.count_if("sufficiently_known").alias("known")
    )


@query(
    "f8_learned_policy",
    f"""WITH {TWO_FEATURES}, best AS (SELECT vec_id // 10 AS decision, arg_max({{'a': action, 't': vec_id, 'lb': expected - uncertainty, 'n': n}}, (round(expected - uncertainty, 9), -vec_id))
   FILTER (action <> 0 AND vec_id % 3 <> 1) AS c FROM prd GROUP BY 1)
SELECT decision, CAST(c.a AS VARCHAR) AS action, c.t AS target, CASE WHEN c IS NULL THEN 'no reversible candidate passed deterministic safety'
 WHEN c.n < 30 THEN 'insufficient measured outcomes; remain on no-intervention baseline' WHEN c.lb <= 0.05::DOUBLE THEN 'lower-confidence benefit does not beat no intervention'
 ELSE 'shadow candidate beats baseline with required lower-confidence benefit' END AS reason FROM best""",
)
def f8_learned_policy(spark, folder):
    """Candidates of a decision scored by the learned models; the vector is the target acted on."""
    samples = two_features(spark, folder)
    models = L.solve_models(L.reward_statistics(samples))
    rows = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("decision"), F.col("label").alias("learned"), "vec_id",
        F.array(F.lit(1.0), F.get("embedding", 0).cast("double")).alias("x"), (F.col("vec_id") % 3 != 1).alias("reversible"),
        F.when(F.col("label") == 0, "None").otherwise(F.col("label").cast("string")).alias("action"), F.lit(True).alias("safety_passed"),
    )
    scored = L.predict(rows, models, "learned", "x").withColumn("lower_bound", F.round("lower_bound", 9))
    out = L.shadow_choice(scored, ["decision"], "vec_id", target="vec_id")
    return out.select("decision", "action", "target", G.reason_text(F.col("reason")).alias("reason"))


@query(
    "f8_shadow_policy",
    """SELECT l_orderkey, best.a AS action, CASE WHEN best IS NULL THEN 'no_reversible_safe_candidate' WHEN best.o < 10 THEN 'insufficient_measured_outcomes' WHEN best.lb <= 0.05::DOUBLE THEN 'lower_bound_does_not_beat_baseline' ELSE 'shadow_candidate_beats_baseline' END AS reason
FROM (SELECT l_orderkey, arg_max({'a': l_linenumber, 'lb': l_discount, 'o': l_quantity}, (l_discount, -(l_linenumber * 1000000 + l_partkey))) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS best FROM lineitem GROUP BY l_orderkey)""",
)
def f8_shadow_policy(spark, folder):
    """Line numbers are the actions of a decision (the order), the discount their lower bound."""
    scored = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("action"), (F.col("l_returnflag") != "R").alias("reversible"), (F.col("l_linestatus") == "F").alias("safety_passed"),
        F.col("l_discount").alias("lower_bound"), F.col("l_discount").alias("expected_reward"), F.lit(0.0).alias("uncertainty"), F.col("l_quantity").alias("observations"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"),
    )
    scored = scored.withColumn("action", F.col("action").cast("string"))
    out = L.shadow_choice(scored, ["l_orderkey"], "ordinal", 0.05, 10)
    return out.select("l_orderkey", F.col("action").cast("int").alias("action"), "reason")


@query(
    "d38_private_updates",
    """SELECT vec_id, round(norm, 5) AS original_norm, round(least(norm, 0.5), 5) AS clipped_norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * CASE WHEN norm > 0.5 THEN 0.5 / norm ELSE 1 END)), 5) + 0 AS total
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)""",
)
def d38_private_updates(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("u", L.private_update(F.col("embedding").cast("array<double>"), 0.5))
    total = F.aggregate("u.protected", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", r(F.col("u.original_norm"), 5).alias("original_norm"), r(F.col("u.clipped_norm"), 5).alias("clipped_norm"), r(total, 5).alias("total"))


@query(
    "d38_fleet_mean",
    """SELECT label, CAST(i - 1 AS INT) AS position, round(avg(x), 6) + 0 AS mean, count(*) AS updates FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE * CASE WHEN norm > 0.5 THEN 0.5 / norm ELSE 1 END AS x
 FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)) GROUP BY ALL""",
)
def d38_fleet_mean(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("u", L.private_update(F.col("embedding").cast("array<double>"), 0.5))
    out = L.fleet_mean(rows.select("label", F.col("u.protected").alias("v")), "v", ["label"])
    return out.select("label", "position", r("mean").alias("mean"), "updates")
