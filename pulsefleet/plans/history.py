"""Queries over device history: windows, labels, rolling statistics, streaks and as-of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators import windows as W
from pulsefleet.plans.registry import query
from pulsefleet.plans.views import pressure_sql, telemetry, with_telemetry

KEY, ORDER = ["device_id"], ["t", "seq"]


def r(c, digits: int = 6):
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return F.round(S.col(c), digits) + F.lit(0.0)


OVER = "PARTITION BY device_id ORDER BY t, seq"
_STATS_SQL = ",\n".join(
    f"""round({s}, 6) + 0 AS {s}_last, round(avg({s}) OVER w8, 6) + 0 AS {s}_mean,
 round(stddev_pop({s}) OVER w8, 5) + 0 AS {s}_std, round(min({s}) OVER w8, 6) + 0 AS {s}_min,
 round(max({s}) OVER w8, 6) + 0 AS {s}_max, round({s} - first({s}) OVER w8, 6) + 0 AS {s}_delta,
 round(CASE WHEN max({s}) OVER w8 - first({s}) OVER w8 <= 1e-8 + 1e-5 * abs(first({s}) OVER w8)
        AND first({s}) OVER w8 - min({s}) OVER w8 <= 1e-8 + 1e-5 * abs(first({s}) OVER w8) THEN 0
      ELSE regr_slope({s}, n) OVER w8 END, 6) + 0 AS {s}_slope,
 round(max({s}) OVER w8 - min({s}) OVER w8, 6) + 0 AS {s}_range"""
    for s in W.SERIES
)
_FEATURES_SQL = with_telemetry(
    f"""
SELECT device_id, seq, cpu_last, mem_last, disk_last, net_last, process_last, top_cpu_last, top_mem_last,
  {", ".join(f"{s}_{k}" for s in W.SERIES for k in W.STATS if k != "last")},
  round(cpu - mem, 6) + 0 AS cpu_mem_gap, round(mem - disk, 6) + 0 AS mem_disk_gap,
  round(cpu - disk, 6) + 0 AS cpu_disk_gap,
  round(CASE WHEN disk < 10 THEN greatest(0, (10 - disk) / 10 * 100) ELSE 0 END, 6) + 0.0::DOUBLE AS disk_pressure,
  round(least(100, greatest(0, mem / 85 * 100)), 6) + 0 AS memory_pressure,
  round(least(100, greatest(0, cpu / 80 * 100)), 6) + 0 AS cpu_pressure,
  round(greatest(0, net - net_median), 6) + 0 AS net_spike,
  round(process - first_process, 6) + 0 AS process_growth, round(top_cpu, 6) + 0 AS top_cpu_pressure,
  round(least(100, greatest(0, top_mem / 10)), 6) + 0 AS top_mem_pressure,
  round(least(100, greatest(0, cpu / 80 * 100)) * 0.42 + least(100, greatest(0, mem / 85 * 100)) * 0.42
    + CASE WHEN disk < 10 THEN greatest(0, (10 - disk) / 10 * 100) ELSE 0 END * 0.16, 6) + 0 AS resource_pressure,
  round(greatest(0, first_cpu - cpu) * 0.4 + greatest(0, first_mem - mem) * 0.4, 6) + 0 AS recovery_signal,
  round(cpu - 35, 6) + 0 AS cpu_baseline_delta, round(mem - 55, 6) + 0 AS mem_baseline_delta,
  round(disk - 50, 6) + 0 AS disk_baseline_delta, round(net, 6) + 0 AS net_baseline_delta,
  round(process - 120, 6) + 0 AS process_baseline_delta
FROM win WHERE full_n = 8
""",
    f"num AS (SELECT *, row_number() OVER ({OVER}) AS n FROM tel)",
    f"""win AS (
SELECT device_id, seq, cpu, mem, disk, net, process, top_cpu, top_mem, count(*) OVER w8 AS full_n,
 median(net) OVER w8 AS net_median, first(process) OVER w8 AS first_process, first(cpu) OVER w8 AS first_cpu,
 first(mem) OVER w8 AS first_mem,
{_STATS_SQL}
FROM num WINDOW w8 AS ({OVER} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))""",
)


@query("e1_window_features", _FEATURES_SQL)
def e1_window_features(spark, folder):
    f = W.window_features(telemetry(spark, folder), KEY, ORDER)
    digits = lambda name: 5 if name.endswith("_std") else 6
    return f.select("device_id", "seq", *[r(n, digits(n)).alias(n) for n in W.FEATURES])


def _label_sql(low="low", peak="peak", cpu="cpu_peak", mem="mem_peak", first="p_first", last="p_last") -> str:
    return f"""CASE WHEN {low} <= 3.5 OR {cpu} >= 96 OR {mem} >= 96 OR {peak} >= 82 THEN 'CRITICAL'
 WHEN {peak} >= 55 AND {last} + 8 < {first} THEN 'RECOVERY'
 WHEN {cpu} >= 80 OR {mem} >= 85 OR {low} <= 10 OR {peak} >= 58 THEN 'WARNING' ELSE 'NORMAL' END"""


_LABEL_CTES = (
    f"prs AS (SELECT *, {pressure_sql()} AS p FROM tel)",
    f"""fut AS (SELECT device_id, seq, phase, min(disk) OVER f5 AS low, max(p) OVER f5 AS peak,
 max(cpu) OVER f5 AS cpu_peak, max(mem) OVER f5 AS mem_peak, first(p) OVER f5 AS p_first, last(p) OVER f5 AS p_last,
 count(*) OVER f5 AS n_future, row_number() OVER ({OVER}) AS n
 FROM prs WINDOW f5 AS ({OVER} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))""",
)


@query(
    "e2_future_labels",
    with_telemetry(f"SELECT device_id, seq, {_label_sql()} AS label FROM fut WHERE n_future = 5", *_LABEL_CTES),
)
def e2_future_labels(spark, folder):
    return W.future_labels(telemetry(spark, folder), KEY, ORDER).select("device_id", "seq", "label")


@query(
    "e3_training_set_summary",
    with_telemetry(
        f"""SELECT label, label_source, count(*) AS samples FROM (
  SELECT CASE WHEN phase = 'error' THEN 'WARNING' ELSE {_label_sql()} END AS label,
         CASE WHEN phase = 'error' THEN 'manual' ELSE 'heuristic' END AS label_source
  FROM fut WHERE n_future = 5 AND n >= 8) GROUP BY ALL""",
        *_LABEL_CTES,
    ),
)
def e3_training_set_summary(spark, folder):
    """Windows per label and label source; errors carry a manual WARNING label."""
    tel = telemetry(spark, folder).withColumn("scenario_label", F.when(F.col("phase") == "error", "warning"))
    rows = W.training_set(tel, KEY, ORDER, manual="scenario_label")
    return rows.groupBy("label", "label_source").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "e4_rolling_means",
    with_telemetry(
        "SELECT device_id, seq, "
        + ", ".join(f"round(avg({s}) OVER w, 6) + 0 AS {s}_mean" for s in W.SERIES)
        + f" FROM tel WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    ),
)
def e4_rolling_means(spark, folder):
    rows = W.rolling_means(telemetry(spark, folder), KEY, ORDER, W.SERIES)
    return rows.select("device_id", "seq", *[r(f"{s}_mean").alias(f"{s}_mean") for s in W.SERIES])


_DEV = ("cpu", "mem", "disk", "net", "process")


def deviation_sql(c: str) -> str:
    return f"""CASE WHEN n < 4 THEN 0 WHEN sd_{c} < 1e-6 THEN CASE WHEN abs({c} - m_{c}) > 0 THEN 50 ELSE 0 END
 ELSE least(100, greatest(0, abs({c} - m_{c}) / greatest(1, sd_{c} * 2) * 100)) END"""


DEVIATION_CTE = (
    "dev AS (SELECT *, count(*) OVER w AS n, "
    + ", ".join(f"avg({c}) OVER w AS m_{c}, stddev_pop({c}) OVER w AS sd_{c}" for c in _DEV)
    + f" FROM tel WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING))"
)


@query(
    "e5_deviation_scores",
    with_telemetry(
        "SELECT device_id, seq, "
        + ", ".join(f"round(CAST({deviation_sql(c)} AS DOUBLE), 4) + 0 AS {c}_deviation" for c in _DEV)
        + " FROM dev",
        DEVIATION_CTE,
    ),
)
def e5_deviation_scores(spark, folder):
    rows = W.deviation_scores(telemetry(spark, folder), KEY, ORDER, _DEV)
    return rows.select("device_id", "seq", *[r(f"{c}_deviation", 4).alias(f"{c}_deviation") for c in _DEV])


_RZ = ("cpu", "mem", "disk")


@query(
    "e6_robust_z",
    with_telemetry(
        "SELECT device_id, seq, sample_count, "
        + ", ".join(
            f"""round(med_{c}, 6) + 0 AS {c}_median, round(mad_{c}, 6) + 0 AS {c}_mad,
 round(({c} - med_{c}) / greatest(0.01, mad_{c} * 1.4826), 4) + 0 AS {c}_z"""
            for c in _RZ
        )
        + " FROM (SELECT *, "
        + ", ".join(
            f"list_aggregate(list_transform(v_{c}, lambda x: abs(x - med_{c})), 'median') AS mad_{c}" for c in _RZ
        )
        + " FROM (SELECT *, CAST(count(*) OVER w AS INTEGER) AS sample_count, "
        + ", ".join(f"list({c}) OVER w AS v_{c}, median({c}) OVER w AS med_{c}" for c in _RZ)
        + f" FROM tel WINDOW w AS ({OVER} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)))"
    ),
)
def e6_robust_z(spark, folder):
    rows = W.robust_z(telemetry(spark, folder), KEY, ORDER, _RZ)
    out = [r(f"{c}_{k}", 4 if k == "z" else 6).alias(f"{c}_{k}") for c in _RZ for k in ("median", "mad", "z")]
    return rows.select("device_id", "seq", "sample_count", *out)


@query(
    "e7_counter_rates",
    with_telemetry(
        f"""SELECT device_id, seq, round(CASE WHEN pt IS NULL OR t <= pt OR bytes < pb THEN 0
 ELSE (bytes - pb) * 1e6 / (t - pt) END, 6) + 0.0::DOUBLE AS bytes_rate,
 round(least(100, greatest(0, CASE WHEN pt IS NULL OR t <= pt OR busy_ms < pm THEN 0
 ELSE (busy_ms - pm) * 1e6 / (t - pt) END / 10 / 4)), 6) + 0.0::DOUBLE AS cpu_share
FROM (SELECT *, lag(t) OVER ({OVER}) AS pt, lag(bytes) OVER ({OVER}) AS pb, lag(busy_ms) OVER ({OVER}) AS pm FROM cnt)""",
        "cnt AS (SELECT device_id, t, seq, CAST(seq % 900 * 1000 AS DOUBLE) AS bytes, seq * 100.0 AS busy_ms FROM tel)",
    ),
)
def e7_counter_rates(spark, folder):
    """Rates of two cumulative counters; the first restarts every 900 events."""
    tel = telemetry(spark, folder).select(
        "device_id", "t", "seq", (F.pmod("seq", F.lit(900)) * 1000.0).alias("bytes"), (F.col("seq") * 100.0).alias("busy_ms")
    )
    rows = W.counter_rates(tel, KEY, ORDER, ["bytes", "busy_ms"])
    share = W.cpu_percent("busy_ms_rate", F.lit(4))
    return rows.select("device_id", "seq", r("bytes_rate").alias("bytes_rate"), r(share).alias("cpu_share"))


@query(
    "e8_rolling_p95",
    with_telemetry(
        f"""SELECT device_id, seq, round(list_sort(v)[CAST(ceil(len(v) * 0.95) AS INTEGER)], 6) + 0 AS net_p95 FROM
 (SELECT device_id, seq, list(net) OVER ({OVER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM tel)"""
    ),
)
def e8_rolling_p95(spark, folder):
    rows = W.rolling_p95(telemetry(spark, folder), KEY, ORDER, "net")
    return rows.select("device_id", "seq", r("net_p95").alias("net_p95"))


@query(
    "e10_latency_ewma",
    with_telemetry(
        """SELECT device_id, round(sum(net * power(0.85, total - i) * CASE WHEN i = 1 THEN 1 ELSE 0.15 END), 4) + 0 AS ewma,
 count(*) AS samples FROM ewm GROUP BY device_id""",
        f"ewm AS (SELECT device_id, net, row_number() OVER ({OVER}) AS i, count(*) OVER (PARTITION BY device_id) AS total FROM tel)",
    ),
)
def e10_latency_ewma(spark, folder):
    rows = W.ewma_last(telemetry(spark, folder), KEY, ORDER, "net", 0.15)
    return rows.select("device_id", r("ewma", 4).alias("ewma"), "samples")


@query(
    "e13_focus_duration",
    with_telemetry(
        f"""SELECT device_id, seq, t - max(started) OVER ({OVER}) AS focus_duration FROM
 (SELECT *, CASE WHEN lag(phase) OVER ({OVER}) IS DISTINCT FROM phase THEN t END AS started FROM tel)"""
    ),
)
def e13_focus_duration(spark, folder):
    return W.focus_durations(telemetry(spark, folder), KEY, ORDER, ["phase"]).select(
        "device_id", "seq", "focus_duration"
    )


@query(
    "e15_alert_hysteresis",
    with_telemetry(
        f"""SELECT device_id, seq, alert, CASE WHEN alert AND NOT was THEN 'RAISED' WHEN NOT alert AND was THEN 'CLEARED' END AS alert_edge
FROM (SELECT *, lag(alert, 1, false) OVER ({OVER}) AS was FROM
 (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS alert FROM
  (SELECT *, CASE WHEN crit AND lag(crit) OVER ({OVER}) THEN true WHEN calm AND lag(calm) OVER ({OVER}) THEN false END AS ev FROM
   (SELECT *, p >= 65 AS crit, p < 45 AS calm FROM prs))))""",
        f"prs AS (SELECT *, {pressure_sql()} AS p FROM tel)",
    ),
)
def e15_alert_hysteresis(spark, folder):
    """Raised after two critical samples in a row, cleared after two calm ones."""
    tel = telemetry(spark, folder).withColumn("p", S.pressure("cpu", "mem", "disk"))
    rows = W.alert_states(tel, KEY, ORDER, F.col("p") >= 65, F.col("p") < 45)
    return rows.select("device_id", "seq", "alert", "alert_edge")


@query(
    "e19_budget_governor",
    with_telemetry(
        f"""SELECT device_id, seq, over_budget, CASE WHEN over_budget THEN named WHEN was THEN 'recovered_within_budget'
 ELSE 'within_budget' END AS reason
FROM (SELECT *, lag(over_budget, 1, false) OVER ({OVER}) AS was FROM
 (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER u, false) AS over_budget, last_value(br IGNORE NULLS) OVER u AS named FROM
  (SELECT *, CASE WHEN br IS NOT NULL THEN true WHEN count(*) OVER w3 = 3 AND count(br) OVER w3 = 0 THEN false END AS ev FROM
   (SELECT *, CASE WHEN net > 120 THEN 'collector_budget' WHEN mem > 95 THEN 'memory_budget' END AS br FROM tel)
   WINDOW w3 AS ({OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  WINDOW u AS ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""
    ),
)
def e19_budget_governor(spark, folder):
    budgets = [("net", 120.0, "collector_budget"), ("mem", 95.0, "memory_budget")]
    rows = W.budget_governor(telemetry(spark, folder), KEY, ORDER, budgets)
    return rows.select("device_id", "seq", "over_budget", "reason")


@query(
    "e20_change_or_every",
    with_telemetry(
        f"""SELECT device_id, seq, tick FROM (SELECT device_id, seq, row_number() OVER ({OVER}) AS tick,
 lag(phase) OVER ({OVER}) IS DISTINCT FROM phase AS changed FROM tel) WHERE changed OR tick % 10 = 0"""
    ),
)
def e20_change_or_every(spark, folder):
    return W.change_or_every(telemetry(spark, folder), KEY, ORDER, ["phase"]).select("device_id", "seq", "tick")


@query(
    "b12_replay_filter",
    with_telemetry(
        f"""SELECT verdict, count(*) AS messages FROM (
 SELECT CASE WHEN NOT usable THEN 'stale_or_future_request'
  WHEN v <= coalesce(max(CASE WHEN usable THEN v END) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  THEN 'replayed_or_out_of_order_request' ELSE 'accepted' END AS verdict
 FROM (SELECT *, seq + seq * 7 % 23 * 10 AS v, phase <> 'signup' AS usable FROM tel)) GROUP BY verdict"""
    ),
)
def b12_replay_filter(spark, folder):
    tel = telemetry(spark, folder).withColumn("v", F.col("seq") + F.pmod(F.col("seq") * 7, F.lit(23)) * 10)
    rows = W.accepted_in_order(tel, KEY, ORDER, "v", F.col("phase") != "signup")
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("messages"))


_ASOF = """SELECT device_id, seq, round(CASE WHEN {fresh} THEN v END, 6) + 0 AS value_asof, CASE WHEN {fresh} THEN age END AS value_age
FROM (SELECT *, {here} - last_value(seen IGNORE NULLS) OVER u AS age, last_value(pv IGNORE NULLS) OVER u AS v
 FROM (SELECT *, CASE WHEN phase = 'purchase' THEN net END AS pv, CASE WHEN phase = 'purchase' THEN {here} END AS seen
  FROM (SELECT *, row_number() OVER ({over}) AS i FROM tel))
 WINDOW u AS ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("c12_asof_with_ttl", with_telemetry(_ASOF.format(here="i", fresh="age <= 30", over=OVER)))
def c12_asof_with_ttl(spark, folder):
    """The latest purchase value is reused for up to 30 samples."""
    tel = telemetry(spark, folder).withColumn("value", F.when(F.col("phase") == "purchase", F.col("net")))
    rows = W.asof_last(tel, KEY, ORDER, "value", max_age=30)
    return rows.select("device_id", "seq", r("value_asof").alias("value_asof"), "value_age")


@query(
    "c13_asof_reuse",
    with_telemetry(
        f"""SELECT l.device_id, l.seq, round(x.net, 6) + 0 AS value_asof, l.t - x.t AS value_age
FROM (SELECT * FROM tel WHERE phase <> 'purchase') l
ASOF LEFT JOIN (SELECT * FROM tel WHERE phase = 'purchase') x ON l.device_id = x.device_id AND l.t >= x.t"""
    ),
)
def c13_asof_reuse(spark, folder):
    """Other events with the latest purchase of the device at or before them, without age limit."""
    tel = telemetry(spark, folder)
    left = tel.where(F.col("phase") != "purchase").select("device_id", "t", "seq")
    right = tel.where(F.col("phase") == "purchase").select("device_id", "t", "seq", F.col("net").alias("value"))
    rows = W.asof_join(left, right, KEY, ORDER, "value")
    return rows.select("device_id", "seq", r("value_asof").alias("value_asof"), "value_age")
