"""Queries that train and score models, and streams run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators import evaluation as V
from pulsefleet.operators import learning as L
from pulsefleet.operators import ranking as R
from pulsefleet.operators import sequential as Q
from pulsefleet.operators import splits as P
from pulsefleet.operators import training as M
from pulsefleet.operators import windows as W
from pulsefleet.operators.rollups import normal_rows
from pulsefleet.plans.history import _LABEL_CTES, KEY, ORDER, _label_sql, r
from pulsefleet.plans.quality import CUT, FRAMES, HOUR
from pulsefleet.plans.registry import ORACLES, query, report
from pulsefleet.plans.sequential import _VALUES
from pulsefleet.plans.views import as_telemetry, table, telemetry, with_telemetry
from pulsefleet.session import checkpointed, shared_folder
from pulsefleet.sources.files import window_values
from pulsefleet.sources.sinks import read_keyed
from pulsefleet.streaming import event_order as E
from pulsefleet.streaming import stream as K

# -- the training chain: medians, windows, split, forest, report, readiness, stored model -----------

_MODELS: dict[tuple[str, str], tuple[str, dict[str, float]]] = {}


#: Held-out windows by session, table folder and baseline: validation and test read one written table.
_HELD_OUT: dict[tuple, DataFrame] = {}


def _rows(spark, folder, baseline):
    """Labelled windows with the role of their device."""
    rows = W.training_set(telemetry(spark, folder), KEY, ORDER, baseline=baseline)
    return P.split_grouped_temporal(rows, "device_id", "t", "t")


def _held_out(spark, folder, baseline, role):
    """Labelled windows of the devices that validate or test, written once."""
    key = (spark.sparkContext.applicationId, folder, tuple(sorted(baseline.items())))
    if key not in _HELD_OUT:
        _HELD_OUT[key] = checkpointed(_rows(spark, folder, baseline).where("role IN ('validation', 'locked_test')"))
    return _HELD_OUT[key].where(F.col("role") == role)


def _fleet_baseline(spark, folder) -> dict[str, float]:
    """Medians of the five series over the normal rows of the fleet."""
    tel = telemetry(spark, folder).withColumns(
        {"fleet": F.lit("all"), "scenario_label": F.when((F.col("phase") == "view") & (F.col("device_id") % 2 == 0), "normal").otherwise("AUTO")}
    )
    medians = R.device_medians(normal_rows(tel, ["fleet"], "scenario_label"), ["fleet"], list(W.DEFAULT_BASELINE)).first()
    return {name: medians[name] for name in W.DEFAULT_BASELINE}


def _trained(spark, folder) -> tuple[str, dict[str, float]]:
    """Folder of the stored model and its baseline; trained once per application and table folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MODELS:
        baseline = _fleet_baseline(spark, folder)
        model = M.train_forest(_rows(spark, folder, baseline).where("role = 'train'"))
        scored = _kept_scores(_held_out(spark, folder, baseline, "validation"), model)
        report = V.multiclass_report(V.confusion_matrix(scored, "label", "predicted_class"))
        ready = V.readiness(report.select("class", F.col("support").alias("rows")), report.select("class", "recall")).first()
        path = shared_folder(spark)
        extra = {"window": W.WINDOW, "horizon": W.HORIZON, "readiness": ready["status"], "blockers": ready["blockers"]}
        M.save_model(model, path, spark, baseline, extra)
        _MODELS[key] = (path, baseline)
    return _MODELS[key]


def _kept_scores(rows, model):
    """Scores of labelled rows, written once: a plan that scores sends the whole forest with every stage."""
    return checkpointed(M.score(rows, model).select("device_id", "seq", "label", "predicted_class", "risk"))


def _scored(spark, folder):
    """Rows of the locked test devices, scored by the stored model."""
    path, _ = _trained(spark, folder)
    model, meta = M.load_model(path, spark)
    return _kept_scores(_held_out(spark, folder, meta["baseline"], "locked_test"), model)


_ROLE_CTES = (
    f"""win AS (SELECT device_id, seq, t, {_label_sql()} AS label FROM (SELECT fut.*, tel.t FROM fut JOIN tel USING (device_id, seq)) WHERE n_future = 5 AND n >= 8)""",
    """grp AS (SELECT device_id, row_number() OVER (ORDER BY min(t), device_id) AS rank, count(*) OVER () AS n FROM win GROUP BY device_id)""",
    """rol AS (SELECT win.*, CASE WHEN rank <= n - 2 * v - l THEN 'train' WHEN rank <= n - v - l THEN 'validation' WHEN rank <= n - l THEN 'calibration' ELSE 'locked_test' END AS role
  FROM win JOIN (SELECT *, greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS v, greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) AS l FROM grp) USING (device_id))""",
)


@query(
    "j1_forest_report",
    with_telemetry(
        "SELECT label AS class, count(*) AS support, true AS all_predicted FROM rol WHERE role = 'locked_test' GROUP BY label", *_LABEL_CTES, *_ROLE_CTES
    ),
)
def j1_forest_report(spark, folder):
    """The part of ``j1_forest_classes`` that SQL can say. Support per class of devices that training never saw; every row has a predicted class, hits are within both sides."""
    matrix = V.confusion_matrix(_scored(spark, folder), "label", "predicted_class")
    report = V.multiclass_report(matrix)
    within = F.bool_and((F.col("hits") <= F.col("support")) & (F.col("hits") <= F.col("predicted")))
    totals = report.agg((within & (F.sum("predicted") == F.sum("support"))).alias("all_predicted"))
    return report.where("support > 0").select("class", "support").join(F.broadcast(totals))


@report("j1_forest_classes")
def j1_forest_classes(spark, folder):
    """The report itself: per class the support, predictions, hits and rates, and whether hits reach the largest class."""
    classes = V.multiclass_report(V.confusion_matrix(_scored(spark, folder), "label", "predicted_class"))
    totals = classes.agg((F.sum("hits") >= F.max("support")).alias("beats_majority"))
    return classes.join(F.broadcast(totals))


@query("f7_feature_importances", "SELECT 12 AS features, true AS descending, true AS known, true AS shares")
def f7_feature_importances(spark, folder):
    """The twelve most important features: in order, among the contract's, with shares of at most one in all."""
    path, _ = _trained(spark, folder)
    model, _ = M.load_model(path, spark)
    rows = M.importances(model, spark)
    listed = rows.agg(F.collect_list(F.struct("importance", "feature")).alias("l")).select(
        F.transform("l", lambda x: x["importance"]).alias("v"), F.transform("l", lambda x: x["feature"]).alias("names")
    )
    return listed.select(
        F.size("v").alias("features"),
        (F.reverse(F.array_sort("v")) == F.col("v")).alias("descending"),
        (F.size(F.array_except("names", F.array(*[F.lit(f) for f in W.FEATURES]))) == 0).alias("known"),
        F.aggregate("v", F.lit(0.0), lambda x, y: x + y).between(0.0, 1.0 + 1e-9).alias("shares"),
    )


@report("f7_importance_rows")
def f7_importance_rows(spark, folder):
    """The twelve most important features and their importances."""
    model, _ = M.load_model(_trained(spark, folder)[0], spark)
    return M.importances(model, spark)


def _per_class(scored):
    return scored.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk"))


@report("j2_saved_model_classes")
def j2_saved_model_classes(spark, folder):
    """Rows and mean risk per class that the stored model predicts."""
    return _per_class(_scored(spark, folder))


@query(
    "j2_saved_model_scores",
    with_telemetry(
        """SELECT count(*) AS n, 'ai_reliability_v2' AS contract, true AS in_range, true AS repeated,
 (SELECT round(median(cpu), 6) FROM tel WHERE phase = 'view' AND device_id % 2 = 0) AS cpu_baseline FROM rol WHERE role = 'locked_test'""",
        *_LABEL_CTES, *_ROLE_CTES,
    ),
)
def j2_saved_model_scores(spark, folder):
    """The stored model, read twice, gives the same scores; its metadata holds the medians it was fit with."""
    path, _ = _trained(spark, folder)
    _, meta = M.load_model(path, spark)
    first = _scored(spark, folder).select("device_id", "seq", "risk")
    again = _scored(spark, folder).select("device_id", "seq", F.col("risk").alias("risk_again"))
    both = first.join(again, ["device_id", "seq"])
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(meta["contract"]).alias("contract"),
        F.bool_and(F.col("risk").between(0.0, 100.0)).alias("in_range"),
        F.bool_and(F.col("risk") == F.col("risk_again")).alias("repeated"),
        F.round(F.lit(meta["baseline"]["cpu"]), 6).alias("cpu_baseline"),
    )


# -- streams -------------------------------------------------------------------------------------------


def _events(spark, folder, files: int = 1, order: str = "event_id"):
    """The events as a stream: the table itself, or cut into files in the order of a column, a batch each."""
    stored = table(spark, folder, "events")
    if files == 1:
        return K.file_stream(spark, folder, stored.schema, "events.parquet")
    base = shared_folder(spark)
    stored.repartitionByRange(files, order).write.parquet(base)
    return K.file_stream(spark, base, stored.schema, files_per_batch=1)


#: How far apart in event time the files of a history may be delivered: as long as any history here.
DISORDER = "366 days"


def _scattered(spark, folder):
    """The events as a stream of files in any order, a batch each, and a last row without device behind them.

    The last row's time lets the watermark pass all rows, as a heartbeat does on a running stream.
    """
    stored = table(spark, folder, "events")
    base = shared_folder(spark)
    stored.repartition(5, "event_id").write.parquet(base)
    end = stored.agg((F.max("ts") + F.expr(f"interval {DISORDER}") + F.expr("interval 1 hour")).alias("ts"))
    end.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts").cast(f.dataType) for f in stored.schema]).write.mode("append").parquet(base)
    return K.file_stream(spark, base, stored.schema, files_per_batch=1)


def _rewards_in_order():
    """Scores from the sums over the rows before, for contexts of a constant and one component."""
    over = "OVER (PARTITION BY action ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH smp AS (SELECT vec_id, label AS action, embedding[1]::DOUBLE AS x, least(2, greatest(-2, (vec_id % 31 - 10) / 5.0::DOUBLE)) AS r FROM embeddings),
bef AS (SELECT action, vec_id, x, count(*) {over} AS n, count(*) {over} + 1.0::DOUBLE AS a, coalesce(sum(x) {over}, 0) AS b, coalesce(sum(x * x) {over}, 0) + 1.0::DOUBLE AS d,
 coalesce(sum(r) {over}, 0) AS p, coalesce(sum(r * x) {over}, 0) AS q FROM smp),
prd AS (SELECT *, ((d * p - b * q) + (a * q - b * p) * x) / (a * d - b * b) AS expected, sqrt((d - 2 * b * x + a * x * x) / (a * d - b * b)) AS uncertainty FROM bef)
SELECT action, vec_id, round(expected, 6) + 0 AS expected_reward, round(uncertainty, 6) + 0 AS uncertainty, n AS observations, n >= 20 AND uncertainty <= 0.75 AS sufficiently_known FROM prd"""


def _scored_rewards(rows):
    return rows.select(
        "action", "vec_id", r("expected_reward").alias("expected_reward"), r("uncertainty").alias("uncertainty"), "observations", "sufficiently_known"
    )


def _reward_rows(vectors):
    """Contexts of a constant and one component, one a second by vec_id."""
    return vectors.select(
        F.col("label").alias("action"), (F.col("vec_id") * 1_000_000).alias("t"), "vec_id",
        F.array(F.lit(1.0), F.get("embedding", 0).cast("double")).alias("x"), ((F.col("vec_id") % 31 - 10) / 5.0).alias("reward"),
    )


@query("d34_online_rewards", _rewards_in_order())
def d34_online_rewards(spark, folder):
    """Every context scored by the samples before it."""
    return _scored_rewards(L.online_predictions(_reward_rows(table(spark, folder, "embeddings")), ["t", "vec_id"], 2))


@query("d34_stream_rewards", _rewards_in_order())
def d34_stream_rewards(spark, folder):
    """The same from a stream whose files come in any order."""
    base = shared_folder(spark)
    rows = _reward_rows(table(spark, folder, "embeddings"))
    rows.repartition(5, "vec_id").write.parquet(f"{base}/in")
    # A row without an action, a century on, lets the watermark pass all others.
    end = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "t" else (F.max("t") + 3_155_760_000_000_000).alias("t") for f in rows.schema]
    rows.agg(*end).write.mode("append").parquet(f"{base}/in")
    stream = K.file_stream(spark, f"{base}/in", rows.schema, files_per_batch=1)
    scored = E.in_event_order(stream, ["action"], ["t", "vec_id"], L.online_kernel(2), L.ONLINE_OUTPUTS, "36500 days")
    E.store_in_order(scored, f"{base}/out", f"{base}/state").awaitTermination()
    return _scored_rewards(spark.read.schema(scored.schema).parquet(f"{base}/out").where("not late"))


def _telemetry_stream(spark, folder, **cut):
    return as_telemetry(_events(spark, folder, **cut))


def _drain(spark, stream):
    """Run a stream over everything available and return the stored rows."""
    base = shared_folder(spark)
    running = K.store_rows(stream, f"{base}/rows", f"{base}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query(
    "k1_stream_batches",
    """SELECT user_id AS device_id, epoch_us(ts) // 86400000000 AS ts, max(event_id) AS seq, arg_max(least(value, 100.0), event_id) AS cpu, count(*) > 0 AS kept
FROM events GROUP BY ALL""",
)
def k1_stream_batches(spark, folder):
    """Snapshots of a day replace each other across batches: the last written counts."""
    tel = _telemetry_stream(spark, folder, files=5)
    snapshots = tel.select(
        "device_id", F.floor(F.col("t") / 86_400_000_000).alias("ts"), "seq", F.struct("cpu", "mem", "disk").alias("system"),
        F.array(F.struct(F.lit(1).alias("pid"), F.col("top_cpu").alias("cpu"))).alias("processes"), F.struct("phase").alias("intent"),
    )
    base = shared_folder(spark)
    running = K.store_snapshots(snapshots, f"{base}/rows", f"{base}/checkpoint", ["seq"], seconds=None)
    running.awaitTermination()
    rows = {name: read_keyed(spark, f"{base}/rows", name, ["seq"]) for name in ("metrics", "process_samples", "user_intent_samples")}
    written = rows["process_samples"].select("device_id", "ts", F.col("seq").alias("process_seq"))
    return rows["metrics"].join(written, ["device_id", "ts"]).select(
        "device_id", "ts", "seq", "cpu", (F.col("seq") == F.col("process_seq")).alias("kept")
    )


@query("k2_stream_baseline", ORACLES["e9_adaptive_baseline"])
def k2_stream_baseline(spark, folder):
    """The adaptive baseline as keyed state; it must equal the batch result."""
    folded = K.stateful_fold(_telemetry_stream(spark, folder), KEY, ORDER, Q.baseline_kernel(list(_VALUES)), Q.BASELINE_OUTPUTS)
    rows = _drain(spark, folded)
    return rows.select(
        "device_id", "seq", "sample_count", "ready", r("confidence", 4).alias("confidence"), r("anomaly_score", 4).alias("anomaly_score"),
        r(F.get("means", 0), 4).alias("cpu_mean"), r(F.get("means", 6), 4).alias("top_mem_mean"), "dominant_metric", "status",
    )


@query(
    "k3_late_rows",
    with_telemetry(
        """SELECT device_id, count(*) AS rows, count(*) FILTER (late) AS late, round(sum(CASE WHEN NOT late THEN m END), 4) AS means FROM (
  SELECT *, false AS late, avg(cpu) OVER (PARTITION BY device_id ORDER BY t, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m FROM tel WHERE seq % 10 <> 0
  UNION ALL SELECT *, NOT coalesce((t, seq) > (SELECT max((x.t, x.seq)) FROM tel x WHERE x.device_id = tel.device_id AND x.seq % 10 <> 0), true), 0 FROM tel WHERE seq % 10 = 0) GROUP BY device_id"""
    ),
)
def k3_late_rows(spark, folder):
    """A tenth of the rows comes in a second file, after its time: late rows are marked and change no state."""
    stored = table(spark, folder, "events")
    base = shared_folder(spark)
    late = F.col("event_id") % 10 == 0
    # The first batch is the files of the first write; the second write begins when they are there.
    stored.where(~late).write.mode("append").parquet(base)
    files = len(spark.read.parquet(base).inputFiles())
    stored.where(late).write.mode("append").parquet(base)
    # The state reads one column: the other ten would be unpacked for every device and batch.
    tel = as_telemetry(K.file_stream(spark, base, stored.schema, files_per_batch=files)).select(*KEY, *ORDER, "cpu")
    rows = _drain(spark, K.stateful_fold(tel, KEY, ORDER, K.rolling_mean_kernel(["cpu"]), "cpu_mean double"))
    on_time = F.when(~F.col("late") & (F.col("seq") % 10 != 0), F.col("cpu_mean"))
    return rows.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.round(F.sum(on_time), 4).alias("means")
    )


@query(
    "k4_stream_episodes",
    with_telemetry("SELECT device_id, seq, CAST(episode_index AS BIGINT) AS episode_index, reason AS boundary_reason FROM cut", FRAMES, CUT),
)
def k4_stream_episodes(spark, folder):
    """Episode cuts as keyed state; they must equal the batch cuts."""
    tel = _telemetry_stream(spark, folder)
    day = 24 * HOUR
    shaped = tel.select(
        "device_id", "t", "seq",
        F.concat(F.lit("s"), F.floor(F.col("t") / (10 * day)).cast("string")).alias("session_id"),
        F.concat(F.lit("P"), (F.floor(F.col("t") / (2 * day)) % 3).cast("string")).alias("workload_phase"),
        F.when(F.col("net") > 100, "HEAVY").otherwise("LIGHT").alias("behavior_class"),
        F.when(F.col("phase") == "signup", "SHELL").otherwise("BROWSER").alias("app_family"),
    )
    kernel = K.boundary_kernel("t", "session_id", "workload_phase", ["behavior_class", "app_family"], 12 * HOUR)
    folded = K.stateful_fold(shaped, KEY, ORDER, kernel, "episode_index long, boundary_reason string")
    return _drain(spark, folded).select("device_id", "seq", "episode_index", "boundary_reason")


@query(
    "k4_stream_sessions",
    """WITH e AS (SELECT user_id AS device_id, ts, ts >= coalesce(lag(ts) OVER w, TIMESTAMP '1900-01-01') + INTERVAL 6 HOUR AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT device_id, started, frames FROM (SELECT device_id, min(ts) AS started, count(*) AS frames, max(ts) AS last FROM s GROUP BY device_id, session)
WHERE last + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def k4_stream_sessions(spark, folder):
    """Sessions by the gap rule that are closed by the watermark: an hour behind the newest event."""
    events = _events(spark, folder).select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("at"))
    rows = _drain(spark, K.sessions(events, ["device_id"], "at", "6 hours", "1 hour"))
    return rows.select("device_id", F.col("started").cast("timestamp_ntz").alias("started"), "frames")


_EDGE = "alert, CASE WHEN alert AND NOT was THEN 'RAISED' WHEN NOT alert AND was THEN 'CLEARED' END AS alert_edge"


@query("e15_stream_alerts", ORACLES["e15_alert_hysteresis"].replace(_EDGE, "alert"))
def e15_stream_alerts(spark, folder):
    tel = _telemetry_stream(spark, folder).withColumn("p", S.pressure("cpu", "mem", "disk"))
    flags = tel.select("device_id", "t", "seq", (F.col("p") >= 65).alias("critical"), (F.col("p") < 45).alias("calm"))
    folded = K.stateful_fold(flags, KEY, ORDER, K.alert_kernel("critical", "calm"), "alert boolean")
    return _drain(spark, folded).select("device_id", "seq", "alert")


def _stream_scores(spark, folder):
    """The windows of a stream cut into batches, scored by the stored model."""
    path, _ = _trained(spark, folder)
    base = shared_folder(spark)
    windows = E.windowed(as_telemetry(_scattered(spark, folder)), KEY, ORDER, DISORDER)
    # Windows are stored between state and scoring: both are streams of their own.
    E.store_in_order(windows, f"{base}/windows", f"{base}/state").awaitTermination()
    packets = K.file_stream(spark, f"{base}/windows", windows.schema, files_per_batch=20).where("not late")

    def features(batch, meta):
        columns = W.feature_columns(window_values(), baseline=meta["baseline"])
        return batch.select(*KEY, *ORDER, *[c.alias(n) for n, c in columns.items()])

    K.score_stream(packets, path, features, f"{base}/scores", f"{base}/checkpoint", seconds=None).awaitTermination()
    return spark.read.parquet(f"{base}/scores")


@report("j3_stream_classes")
def j3_stream_classes(spark, folder):
    """Windows of the stream and mean risk per predicted class."""
    return _per_class(_stream_scores(spark, folder))


@query(
    "j3_stream_scores",
    """SELECT user_id AS device_id, count(*) - 7 AS windows, true AS equal_to_batch FROM events GROUP BY user_id HAVING count(*) >= 8""",
)
def j3_stream_scores(spark, folder):
    """A stored model scores the windows of a stream cut into batches; the scores are those of the whole table."""
    path, baseline = _trained(spark, folder)
    scores = _stream_scores(spark, folder).select("device_id", "seq", "risk")
    model, _ = M.load_model(path, spark)
    whole = M.score(W.window_features(telemetry(spark, folder), KEY, ORDER, baseline=baseline), model)
    both = scores.join(whole.select("device_id", "seq", F.col("risk").alias("batch_risk")), ["device_id", "seq"], "full")
    same = F.coalesce(F.abs(F.col("risk") - F.col("batch_risk")) < 1e-6, F.lit(False))
    return both.groupBy("device_id").agg(F.count(F.lit(1)).alias("windows"), F.bool_and(same).alias("equal_to_batch"))
