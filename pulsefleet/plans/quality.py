"""Queries for episodes, splits, manifests and record contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefleet.operators import episodes as E
from pulsefleet.operators import quality as Q
from pulsefleet.operators import splits as P
from pulsefleet.operators import tables as T
from pulsefleet.plans.history import KEY, ORDER, OVER, r
from pulsefleet.plans.registry import query
from pulsefleet.plans.views import epoch_us, table, telemetry, with_predictions, with_telemetry

HOUR, DAY = 3_600_000_000, 86_400_000_000
RULES = E.EpisodeRules(max_gap=12 * HOUR)


def frames(spark, folder):
    """Frames with slowly changing context and a collector health map."""
    status = F.when(F.col("seq") % 40 == 0, "unavailable").otherwise("OK")
    return telemetry(spark, folder).select(
        "device_id",
        "t",
        "seq",
        "cpu",
        "mem",
        "disk",
        F.concat(F.lit("s"), F.floor(F.col("t") / (10 * DAY)).cast("string")).alias("session_id"),
        F.concat(F.lit("P"), (F.floor(F.col("t") / (2 * DAY)) % 3).cast("string")).alias("workload_phase"),
        F.when(F.col("net") > 100, "HEAVY").otherwise("LIGHT").alias("behavior_class"),
        F.when(F.col("phase") == "signup", "SHELL").otherwise("BROWSER").alias("app_family"),
        F.create_map(F.lit("qoe"), status, F.lit("net"), F.when(F.col("seq") % 55 == 0, "FAILED").otherwise("OK")).alias("health"),
    )


FRAMES = f"""
frm AS (SELECT device_id, t, seq, cpu, mem, disk, 's' || (t // {10 * DAY}) AS session_id, 'P' || (t // {2 * DAY} % 3) AS workload_phase,
  CASE WHEN net > 100 THEN 'HEAVY' ELSE 'LIGHT' END AS behavior_class,
  CASE WHEN phase = 'signup' THEN 'SHELL' ELSE 'BROWSER' END AS app_family, seq % 40 = 0 AS bad_qoe, seq % 55 = 0 AS bad_net FROM tel)"""
CUT = f"""
cut AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS episode_index
 FROM (SELECT *, CASE WHEN pt IS NULL THEN 'first_frame' WHEN t - pt > {12 * HOUR} THEN 'telemetry_gap'
   WHEN session_id <> ps THEN 'session_changed' WHEN workload_phase <> pp THEN 'workload_phase_changed'
   WHEN behavior_class <> pb OR app_family <> pa THEN 'foreground_behavior_changed' END AS reason
  FROM (SELECT *, lag(t) OVER ({OVER}) AS pt, lag(session_id) OVER ({OVER}) AS ps, lag(workload_phase) OVER ({OVER}) AS pp,
     lag(behavior_class) OVER ({OVER}) AS pb, lag(app_family) OVER ({OVER}) AS pa FROM frm)))"""
EPISODES = """
epi AS (SELECT device_id, episode_index, min(t) AS start_t, max(t) AS end_t, count(*) AS frame_count, max(reason) AS start_reason,
  CAST(bool_or(bad_qoe) AS INT) + CAST(bool_or(bad_net) AS INT) AS bad_collectors,
  concat_ws(',', CASE WHEN bool_or(bad_net) THEN 'net' END, CASE WHEN bool_or(bad_qoe) THEN 'qoe' END) AS failed
 FROM cut GROUP BY device_id, episode_index)"""


def cut(spark, folder):
    return E.cut_episodes(frames(spark, folder), KEY, ORDER, "session_id", "workload_phase", ["behavior_class", "app_family"], RULES)


def built(spark, folder):
    return E.episodes(
        cut(spark, folder), KEY, ORDER, ["cpu", "mem", "disk"], ["session_id"], collectors="health", rules=RULES
    )


@query(
    "e11_episode_building",
    with_telemetry(
        """SELECT device_id, CAST(episode_index AS BIGINT) AS episode_index, start_t, end_t, frame_count, start_reason,
 coalesce(lead(start_reason) OVER (PARTITION BY device_id ORDER BY start_t, episode_index), 'input_exhausted') AS end_reason,
 frame_count >= 3 AND bad_collectors = 0 AS valid FROM epi""",
        FRAMES, CUT, EPISODES,
    ),
)
def e11_episode_building(spark, folder):
    return built(spark, folder).select(
        "device_id", "episode_index", "start_t", "end_t", "frame_count", "start_reason", "end_reason", "valid"
    )



@query(
    "d35_stable_baseline",
    with_telemetry(
        "SELECT device_id, CAST(episode_index AS BIGINT) AS episode_index, "
        + ", ".join(
            f"""round(m_{c}, 6) + 0 AS {c}_median,
 round(list_aggregate(list_transform(v_{c}, lambda x: abs(x - m_{c})), 'median'), 6) + 0 AS {c}_mad,
 round(v_{c}[CAST(round_even((len(v_{c}) - 1) * 0.05, 0) AS INT) + 1], 6) + 0 AS {c}_p05,
 round(v_{c}[CAST(round_even((len(v_{c}) - 1) * 0.95, 0) AS INT) + 1], 6) + 0 AS {c}_p95"""
            for c in ("cpu", "mem", "disk")
        )
        + " FROM (SELECT device_id, episode_index, "
        + ", ".join(f"median({c}) AS m_{c}, list_sort(list({c})) AS v_{c}" for c in ("cpu", "mem", "disk"))
        + """ FROM (SELECT *, row_number() OVER (PARTITION BY device_id, episode_index ORDER BY t, seq) AS i FROM cut)
 WHERE i <= 5 GROUP BY device_id, episode_index)""",
        FRAMES, CUT,
    ),
)
def d35_stable_baseline(spark, folder):
    out = [f"{c}_{k}" for c in ("cpu", "mem", "disk") for k in ("median", "mad", "p05", "p95")]
    return built(spark, folder).select("device_id", "episode_index", *[r(c).alias(c) for c in out])


@query(
    "d36_episode_quality",
    with_telemetry(
        """SELECT failed AS failed_collectors, frame_count >= 3 AND bad_collectors = 0 AS valid, count(*) AS episodes,
 CAST(sum(frame_count) AS BIGINT) AS frames FROM epi GROUP BY ALL""",
        FRAMES, CUT, EPISODES,
    ),
)
def d36_episode_quality(spark, folder):
    rows = built(spark, folder).withColumn("failed_collectors", F.array_join("failed_collectors", ","))
    return rows.groupBy("failed_collectors", "valid").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("frame_count").alias("frames")
    )


_CTX = f"""
ctx AS (SELECT *, sum(CASE WHEN lag_ctx IS DISTINCT FROM workload_phase || '/' || behavior_class THEN 1 ELSE 0 END)
   OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode_index
  FROM (SELECT *, lag(workload_phase || '/' || behavior_class) OVER ({OVER}) AS lag_ctx FROM frm))"""


@query(
    "e12_context_episodes",
    with_telemetry(
        """SELECT device_id, CAST(episode_index AS BIGINT) AS episode_index, started_at, coalesce(nxt, started_at) AS ended_at,
 CASE WHEN nxt IS NULL THEN 'OPEN' ELSE 'WORKLOAD_OR_FOREGROUND_CHANGE' END AS end_reason,
 CASE WHEN episode_index = 1 THEN 'INITIAL' ELSE 'CHANGED_CONTEXT' END AS start_reason, captures, samples
FROM (SELECT *, lead(started_at) OVER (PARTITION BY device_id ORDER BY started_at, episode_index) AS nxt FROM
 (SELECT device_id, episode_index, min(t) AS started_at, count(*) AS samples, CAST(sum(CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS captures
  FROM ctx GROUP BY device_id, episode_index))""",
        FRAMES, _CTX,
    ),
)
def e12_context_episodes(spark, folder):
    rows, _ = E.context_episodes(
        frames(spark, folder), KEY, ORDER, "workload_phase", "behavior_class", F.col("seq") % 3 == 0
    )
    return rows.select(
        "device_id", "episode_index", "started_at", "ended_at", "end_reason", "start_reason", "captures", "samples"
    )


# -- splits ---------------------------------------------------------------------------------


def order_episodes(spark, folder):
    """An order is an episode of its customer; the key makes the start unique."""
    start = F.floor(epoch_us("o_orderdate") / 1000) + F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("episode_id"),
        F.col("o_custkey").alias("device_id"),
        F.col("o_orderpriority").alias("workload_class"),
        start.alias("start_t"),
        (start + 3_600_000 * (1 + F.col("o_orderkey") % 5)).alias("end_t"),
    )


ORDER_EPISODES = """
oep AS (SELECT CAST(o_orderkey AS VARCHAR) AS episode_id, o_custkey AS device_id, o_orderpriority AS workload_class,
  epoch_us(o_orderdate) // 1000 + o_orderkey AS start_t,
  epoch_us(o_orderdate) // 1000 + o_orderkey + 3600000 * (1 + o_orderkey % 5) AS end_t FROM orders)"""
SPLIT = """
grp AS (SELECT device_id, row_number() OVER (ORDER BY min(start_t)) AS rank, count(*) OVER () AS n FROM oep GROUP BY device_id),
cnt AS (SELECT *, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS v, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS l FROM grp),
spl AS (SELECT oep.*, CASE WHEN rank <= n - 2 * v - l THEN 'train' WHEN rank <= n - v - l THEN 'validation'
  WHEN rank <= n - l THEN 'calibration' ELSE 'locked_test' END AS role FROM oep JOIN cnt USING (device_id))"""


@query(
    "e21_grouped_temporal_split",
    f"WITH {ORDER_EPISODES}, {SPLIT} SELECT role, count(*) AS episodes, count(DISTINCT device_id) AS devices, min(start_t) AS first_start, max(end_t) AS last_end FROM spl GROUP BY role",
)
def e21_grouped_temporal_split(spark, folder):
    split = P.split_grouped_temporal(order_episodes(spark, folder), "device_id")
    return split.groupBy("role").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_distinct("device_id").alias("devices"),
        F.min("start_t").alias("first_start"),
        F.max("end_t").alias("last_end"),
    )


@query(
    "e22_purged_split",
    f"""WITH {ORDER_EPISODES},
rnk AS (SELECT *, row_number() OVER (ORDER BY start_t) AS rank, count(*) OVER () AS n FROM oep),
cnt AS (SELECT *, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS v, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS l FROM rnk),
spl AS (SELECT *, CASE WHEN rank <= n - 2 * v - l THEN 1 WHEN rank <= n - v - l THEN 2 WHEN rank <= n - l THEN 3 ELSE 4 END AS role FROM cnt),
k1 AS (SELECT max(end_t) AS e FROM spl WHERE role = 1),
r2 AS (SELECT * FROM spl, k1 WHERE role = 2 AND start_t >= k1.e + 86400000),
k2 AS (SELECT greatest((SELECT e FROM k1), coalesce(max(end_t), 0)) AS e FROM r2),
r3 AS (SELECT * FROM spl, k2 WHERE role = 3 AND start_t >= k2.e + 86400000),
k3 AS (SELECT greatest((SELECT e FROM k2), coalesce(max(end_t), 0)) AS e FROM r3),
r4 AS (SELECT * FROM spl, k3 WHERE role = 4 AND start_t >= k3.e + 86400000),
kept AS (SELECT episode_id, 'train' AS role FROM spl WHERE role = 1 UNION ALL SELECT episode_id, 'validation' FROM r2
  UNION ALL SELECT episode_id, 'calibration' FROM r3 UNION ALL SELECT episode_id, 'locked_test' FROM r4)
SELECT coalesce(kept.role, 'purged') AS role, count(*) AS episodes FROM spl LEFT JOIN kept USING (episode_id) GROUP BY 1""",
)
def e22_purged_split(spark, folder):
    """Episode-level split with a one-day purge gap; purged episodes are counted, not lost."""
    split = P.split_grouped_temporal(order_episodes(spark, folder), "episode_id", purge_gap=86_400_000)
    return split.groupBy(F.coalesce("role", F.lit("purged")).alias("role")).agg(F.count(F.lit(1)).alias("episodes"))


@query(
    "e23_split_leaks",
    f"""WITH {ORDER_EPISODES}, {SPLIT}
SELECT 'workload_class' AS field, workload_class AS value, count(DISTINCT role) AS roles FROM spl GROUP BY workload_class HAVING count(DISTINCT role) > 1
UNION ALL SELECT 'device_id', CAST(device_id AS VARCHAR), count(DISTINCT role) FROM spl GROUP BY device_id HAVING count(DISTINCT role) > 1""",
)
def e23_split_leaks(spark, folder):
    """A device split leaks no device, but workload classes cross the roles."""
    split = P.split_grouped_temporal(order_episodes(spark, folder), "device_id")
    found = [
        P.leaking_values(split, c).select(
            F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.size("roles").cast("long").alias("roles")
        )
        for c in ("workload_class", "device_id")
    ]
    return T.union_all(found)


@query(
    "a21_locked_manifest",
    """WITH ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents), n AS (SELECT count(*) AS n FROM ids),
leaves AS (SELECT CASE WHEN n <= 4096 THEN '' ELSE substr(sha256(id), 1, 3) END AS place, sha256(string_agg(id, chr(10) ORDER BY id)) AS hash FROM ids, n GROUP BY 1)
SELECT CAST(1 AS INTEGER) AS schema_version, 'independent locked test episodes' AS purpose, (SELECT n FROM n) AS ids,
 CASE WHEN (SELECT n FROM n) <= 4096 THEN min(hash) ELSE sha256(string_agg(hash, chr(10) ORDER BY place)) END AS content_hash FROM leaves""",
)
def a21_locked_manifest(spark, folder):
    """The header of all documents as locked ids."""
    return P.locked_manifest(P.locked_ids(table(spark, folder, "documents"), "doc_id"))


@query(
    "c11_locked_overlap",
    """SELECT CAST(doc_id AS VARCHAR) AS episode_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')""",
)
def c11_locked_overlap(spark, folder):
    locked = P.locked_ids(table(spark, folder, "documents").where(F.col("source") == "src3"), "doc_id")
    used = table(spark, folder, "labels").select(F.col("doc_id").alias("episode_id"))
    return P.locked_overlap(used, locked, "train")


# -- contracts ------------------------------------------------------------------------------


def raw_frames(spark, folder):
    """Version 3 frames with planted defects."""
    tel = telemetry(spark, folder)
    gap = lambda every, value: F.when(F.col("seq") % every != 0, value)
    return tel.select(
        F.when(F.col("seq") % 17 == 0, 2).otherwise(3).alias("schema_version"),
        F.col("t").alias("monotonic_timestamp_ms"),
        F.col("t").cast("string").alias("wall_timestamp_utc"),
        F.when(F.col("device_id") % 10 == 3, "").otherwise(F.col("device_id").cast("string")).alias("device_id"),
        F.lit("s").alias("session_id"),
        F.lit("e").alias("episode_id"),
        F.lit("w11").alias("windows_build_family"),
        F.struct(F.lit("8").alias("cpu_core_tier")).alias("hardware"),
        F.create_map(F.lit("qoe"), F.lit("OK")).alias("collector_health"),
        F.create_map(F.lit("qoe"), F.lit("1")).alias("feature_source_versions"),
        F.when(F.col("phase") == "error", "GUESSED").when(F.col("phase") == "view", "weak_heuristic").otherwise("MEASURED_QOE").alias("provenance"),
        F.struct(F.lit("A").alias("app_family")).alias("foreground"),
        F.when(F.col("seq") % 29 == 0, "").otherwise(F.col("phase")).alias("workload_phase"),
        F.struct(
            F.col("cpu").alias("cpu_percent"), F.col("mem").alias("memory_percent"), gap(31, F.col("disk")).alias("disk_free_percent")
        ).alias("resources"),
        F.when(
            F.col("seq") % 37 != 0,
            F.struct(F.col("cpu").alias("cpu_robust_z"), F.col("mem").alias("memory_robust_z"), F.col("disk").alias("disk_robust_z")),
        ).alias("normalized_resources"),
    )


def _counts_sql(source: str, rules: dict[str, str]) -> str:
    parts = [f"SELECT '{code}' AS error, count(*) AS rows FROM {source} WHERE {rule} HAVING count(*) > 0" for code, rule in rules.items()]
    return " UNION ALL ".join(parts)


@query(
    "b1_frame_contract",
    with_telemetry(
        _counts_sql(
            "tel",
            {
                "missing:device_id": "device_id % 10 = 3",
                "missing:workload_phase": "seq % 29 = 0",
                "missing:resources.disk_free_percent": "seq % 31 = 0",
                "missing:normalized_resources": "seq % 37 = 0",
                "missing:normalized_resources.cpu_robust_z": "seq % 37 = 0",
                "missing:normalized_resources.memory_robust_z": "seq % 37 = 0",
                "missing:normalized_resources.disk_robust_z": "seq % 37 = 0",
                "schema_version": "seq % 17 = 0",
                "provenance": "phase = 'error'",
                "(valid)": "device_id % 10 <> 3 AND seq % 29 <> 0 AND seq % 31 <> 0 AND seq % 37 <> 0 AND seq % 17 <> 0 AND phase <> 'error'",
            },
        )
    ),
)
def b1_frame_contract(spark, folder):
    """Violations per rule, and the count of valid frames."""
    checked = Q.validate(raw_frames(spark, folder), "telemetry_frame")
    codes = F.when(F.size("errors") == 0, F.array(F.lit("(valid)"))).otherwise(F.col("errors"))
    return checked.select(F.explode(codes).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


def outcome_labels(spark, folder):
    """Labels of documents as outcome labels; some documents carry a second, contradictory one."""
    labels = table(spark, folder, "labels")
    base = labels.select(
        F.col("doc_id").cast("string").alias("episode_id"),
        F.when(F.col("quality") == 1, "no_user_impact_event").otherwise("USER_IMPACT_EVENT").alias("primary_outcome"),
        F.when(F.col("doc_id") % 7 == 0, "WEAK_HEURISTIC").otherwise("manual_review").alias("provenance"),
        F.when(F.col("doc_id") % 11 != 0, F.lit(0.9)).alias("label_confidence"),
    )
    second = labels.where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("episode_id"),
        F.lit("USER_IMPACT_EVENT").alias("primary_outcome"),
        F.lit("MEASURED_QOE").alias("provenance"),
        F.lit(0.5).alias("label_confidence"),
    )
    return base.unionByName(second)


OUTCOMES = """
olb AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, CASE WHEN quality = 1 THEN 'NO_USER_IMPACT_EVENT' ELSE 'USER_IMPACT_EVENT' END AS outcome,
   CASE WHEN doc_id % 7 = 0 THEN 'WEAK_HEURISTIC' ELSE 'MANUAL_REVIEW' END AS provenance, doc_id % 11 <> 0 AS has_confidence FROM labels
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'USER_IMPACT_EVENT', 'MEASURED_QOE', true FROM labels WHERE toxic = 1)"""


@query(
    "b2_label_contract",
    "WITH " + OUTCOMES + _counts_sql("olb", {
        "missing:label_confidence": "NOT has_confidence", "weak_provenance": "provenance = 'WEAK_HEURISTIC'",
        "missing:qoe_evidence": "CAST(episode_id AS BIGINT) % 13 = 0", "missing:session_id": "CAST(episode_id AS BIGINT) % 17 = 0",
        "missing:hardware": "CAST(episode_id AS BIGINT) % 19 = 0",
    }),
)
def b2_label_contract(spark, folder):
    """Outcome labels in certification mode, with all fields of the record."""
    k = F.col("episode_id").cast("long")
    labels = outcome_labels(spark, folder).withColumns(
        {**_common(k), "qoe_evidence": F.when(k % 13 != 0, F.create_map(F.lit("ms"), F.lit(1.0)))}
    )
    return _violations(labels, "outcome_label", True)


def _common(k):
    """The common fields of a version 3 record; some rows lack the session or the hardware."""
    return {
        "schema_version": F.lit(3), "monotonic_timestamp_ms": k, "wall_timestamp_utc": k.cast("string"), "device_id": F.lit("d"),
        "session_id": F.when(k % 17 == 0, "").otherwise("s"), "windows_build_family": F.lit("w11"),
        "hardware": F.when(k % 19 != 0, F.struct(F.lit("8").alias("cpu_core_tier"))),
        "collector_health": F.create_map(F.lit("qoe"), F.lit("OK")), "feature_source_versions": F.create_map(F.lit("qoe"), F.lit("1")),
    }


def _violations(rows, record, for_certification=False):
    checked = Q.validate(rows, record, for_certification)
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "b2_episode_contract",
    _counts_sql("orders", {
        "missing:session_id": "o_orderkey % 17 = 0", "missing:hardware": "o_orderkey % 19 = 0", "missing:workload_class": "o_orderkey % 7 = 0",
        "missing:stable_baseline": "o_orderkey % 23 = 0", "interval": "o_orderkey % 11 = 0", "provenance": "o_orderkey % 29 = 0",
    }),
)
def b2_episode_contract(spark, folder):
    """Orders as workload episodes; some end before they start."""
    k = F.col("o_orderkey")
    episodes = table(spark, folder, "orders").select(
        *[c.alias(n) for n, c in _common(k).items()],
        k.cast("string").alias("episode_id"),
        F.when(k % 29 == 0, "GUESSED").otherwise("MEASURED_QOE").alias("provenance"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).alias("workload_class"),
        F.lit("first_frame").alias("start_reason"),
        F.lit("input_exhausted").alias("end_reason"),
        k.alias("start_monotonic_ms"),
        (k + F.when(k % 11 == 0, 0).otherwise(1000)).alias("end_monotonic_ms"),
        F.when(k % 23 != 0, F.create_map(F.lit("cpu"), F.lit(1.0))).alias("stable_baseline"),
        F.lit(1000).alias("observation_interval_ms"),
        F.lit(1000).alias("outcome_interval_ms"),
        F.create_map(F.lit("valid"), F.lit(True)).alias("data_quality"),
    )
    return _violations(episodes, "workload_episode")


@query(
    "b2_action_contract",
    _counts_sql("orders", {
        "missing:session_id": "o_orderkey % 17 = 0", "missing:hardware": "o_orderkey % 19 = 0", "missing:transaction_id": "o_orderkey % 7 = 0",
        "missing:rollback": "o_orderkey % 23 = 0", "weak_provenance": "o_orderkey % 11 = 0",
    }),
)
def b2_action_contract(spark, folder):
    """Orders as action outcomes, for certification."""
    k = F.col("o_orderkey")
    outcomes = table(spark, folder, "orders").select(
        *[c.alias(n) for n, c in _common(k).items()],
        k.cast("string").alias("episode_id"),
        F.when(k % 11 == 0, "weak_heuristic").otherwise("manual_review").alias("provenance"),
        F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("transaction_id"),
        F.col("o_orderpriority").alias("action_type"),
        F.col("o_orderstatus").alias("outcome"),
        F.when(k % 23 != 0, F.create_map(F.lit("done"), F.lit(False))).alias("rollback"),
        F.create_map(F.lit("cpu"), F.lit(1.0)).alias("measured_effect"),
    )
    return _violations(outcomes, "action_outcome", True)


@query(
    "b3_eligible_provenance",
    "WITH " + OUTCOMES + "SELECT provenance, provenance <> 'WEAK_HEURISTIC' AS eligible, count(*) AS labels FROM olb GROUP BY ALL",
)
def b3_eligible_provenance(spark, folder):
    labels = outcome_labels(spark, folder).withColumn("eligible", Q.certifiable(F.col("provenance")))
    return labels.groupBy(F.upper("provenance").alias("provenance"), "eligible").agg(F.count(F.lit(1)).alias("labels"))


@query(
    "b5_label_validation",
    "WITH " + OUTCOMES + """SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(e) AS BIGINT) AS eligible, count(*) FILTER (k > 1) AS contradictory_episodes,
 CAST(sum(i) AS BIGINT) AS user_impact_event, CAST(sum(n - i) AS BIGINT) AS no_user_impact_event,
 count(*) FILTER (k > 1) = 0 AND sum(n) = sum(e) AS accepted
FROM (SELECT episode_id, count(*) AS n, count(*) FILTER (provenance <> 'WEAK_HEURISTIC') AS e, count(DISTINCT outcome) AS k,
 count(*) FILTER (outcome = 'USER_IMPACT_EVENT') AS i FROM olb GROUP BY episode_id)""",
)
def b5_label_validation(spark, folder):
    return Q.label_report(outcome_labels(spark, folder), for_certification=True)


def certification_episodes(spark, folder):
    """Documents with labels as certification episodes; some break a rule."""
    m = lambda k, v=0: F.col("doc_id") % k == v
    docs = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("episode_id"),
        F.when(m(13), "SYNTHETIC").otherwise("MEASURED_QOE").alias("label_provenance"),
        F.col("lang").alias("support_slice"),
        (~m(5)).alias("eligible"),
        (~m(6)).alias("accepted"),
        (F.col("quality") == 1).alias("correct"),
        m(3).alias("critical_event"),
        (m(3) & ~m(8)).alias("critical_detected"),
        (~m(4)).alias("committed_action"),
        (F.col("toxic") == 1).alias("severe_harm"),
        m(9).alias("rollback_attempted"),
        m(9).alias("rollback_succeeded"),
        F.lit(False).alias("protected_policy_violation"),
    )


@query(
    "b6_locked_episode_rules",
    """WITH e AS (SELECT l.doc_id, toxic = 1 AS harm FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT doc_id FROM documents WHERE doc_id % 50 <> 1)
SELECT error, count(*) AS episodes FROM (
 SELECT 'weak_provenance' AS error FROM e WHERE doc_id % 13 = 0
 UNION ALL SELECT 'accepted_without_eligible' FROM e WHERE doc_id % 5 = 0 AND doc_id % 6 <> 0
 UNION ALL SELECT 'severe_harm_without_committed_action' FROM e WHERE harm AND doc_id % 4 = 0
 UNION ALL SELECT 'not_in_manifest' FROM e WHERE doc_id NOT IN (SELECT doc_id FROM m)
 UNION ALL SELECT 'missing_from_input' FROM m WHERE doc_id NOT IN (SELECT doc_id FROM e)) GROUP BY error""",
)
def b6_locked_episode_rules(spark, folder):
    manifest = table(spark, folder, "documents").where(F.col("doc_id") % 50 != 1).select(F.col("doc_id").cast("string").alias("episode_id"))
    errors = Q.locked_episode_errors(certification_episodes(spark, folder), manifest)
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("episodes"))


@query(
    "b7_contradictory_descriptors",
    """SELECT l_orderkey AS episode_id, count(DISTINCT l_returnflag || l_linestatus) AS versions FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_returnflag || l_linestatus) > 1""",
)
def b7_contradictory_descriptors(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"), "l_returnflag", "l_linestatus"
    )
    return P.contradictory_ids(rows)


@query(
    "g1_set_difference",
    """SELECT CASE WHEN b.id IS NULL THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS ids
FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT DISTINCT doc_id AS id FROM labels) b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL GROUP BY 1""",
)
def g1_set_difference(spark, folder):
    left = table(spark, folder, "documents").where(F.col("doc_id") % 2 == 0)
    return T.same_ids(left, table(spark, folder, "labels"), "doc_id").groupBy("side").agg(F.count(F.lit(1)).alias("ids"))


@query(
    "g1_set_intersection",
    """SELECT 'both' AS side, count(*) AS ids FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels)""",
)
def g1_set_intersection(spark, folder):
    """Ids that both sides have, and ids that either has."""
    left = table(spark, folder, "documents").where(F.col("doc_id") % 2 == 0).select("doc_id")
    right = table(spark, folder, "labels").select("doc_id")
    sides = {"both": left.intersect(right), "either": left.union(right).distinct()}
    return T.union_all([f.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("ids")) for n, f in sides.items()])
