import json
import time

import pytest
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators import sequential as Q
from pulsefleet.operators import tables
from pulsefleet.operators import windows as W
from pulsefleet.sources import files, migrations, sinks
from pulsefleet.streaming import event_order as E
from pulsefleet.streaming import stream as K


def record(run="r1", **change):
    base = {
        "schema_version": 1, "run_id": run, "device_id": "d", "scenario": "coding", "variant": "windows_baseline", "run_type": "cold", "iteration": 1, "order_index": 1,
        "metrics": {"latency": {"unit": "ms", "direction": "lower", "samples": [1.0, 2.0]}}, "optimizer_overhead": {"cpu_percent_samples": [0.5]},
        "safety": {"crashes": 0}, "environment": {"os_build": "x"}, "notes": "",
    }
    return base | change


def test_benchmark_reader_rejects_bad_lines(spark, tmp_path):
    empty = {"latency": {"unit": "ms", "direction": "lower", "samples": []}}
    lines = [json.dumps(record()), "", "{not json", json.dumps(record("r2", metrics=empty)), json.dumps(record("r3")), json.dumps(record("r3")), json.dumps(record("r4", scenario="x"))]
    (tmp_path / "runs.jsonl").write_text("\n".join(lines))
    good, bad = files.read_benchmark_runs(spark, str(tmp_path / "runs.jsonl"))
    assert [r["run_id"] for r in good.collect()] == ["r1"]
    codes = [set(r["errors"]) for r in bad.collect()]
    assert any("malformed" in c for c in codes) and any("metric_samples" in c for c in codes) and any("unknown_scenario" in c for c in codes)
    assert sum("duplicate_run_id" in c for c in codes) == 2
    sums = files.overhead_sums(good).first()
    assert (sums["cpu_sum"], sums["cpu_n"], sums["os_build"]) == (0.5, 1, "x")


def test_certification_reader(spark, tmp_path):
    records = [{"episode_id": "a", "eligible": True}, {"episode_id": "b", "eligible": "yes"}]
    (tmp_path / "e.json").write_text(json.dumps(records[:1]))
    good, bad = files.read_certification_episodes(spark, str(tmp_path / "e.json"), as_list=True)
    assert [r["episode_id"] for r in good.collect()] == ["a"] and bad.count() == 0
    (tmp_path / "e.jsonl").write_text("\n".join([*map(json.dumps, records), "{no"]))
    good, bad = files.read_certification_episodes(spark, str(tmp_path / "e.jsonl"))
    assert [r["episode_id"] for r in good.collect()] == ["a"] and bad.count() == 2


def test_runtime_windows(spark):
    packets = spark.createDataFrame(
        [("a", [float(v) for v in range(10)], [1.0] * 8, [2.0] * 8), ("b", [1.0] * 7, [1.0] * 8, [2.0] * 8)],
        "id string, cpu_history array<double>, mem_history array<double>, disk_history array<double>",
    )
    rows = {r["id"]: r for r in files.window_rows(packets).collect()}
    assert rows["a"]["error"] is None and rows["a"]["values"]["cpu"] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0] and rows["a"]["values"]["net"] == [0.0] * 8
    assert "cpu_history" in rows["b"]["error"]
    features = files.window_rows(packets).where("error is null").select(*[c.alias(n) for n, c in W.feature_columns(files.window_values()).items()])
    assert len(features.columns) == 73 and features.first()["cpu_slope"] == pytest.approx(1.0)


def test_metrics_of_old_schema(spark, tmp_path):
    spark.createDataFrame([("d", 1, 10.0, 20.0, 30.0)], "device_id string, ts long, cpu double, mem double, disk double").write.parquet(str(tmp_path / "old"))
    spark.createDataFrame([("d", 2, 1.0, 2.0, 3.0, 5.0, None, "warning ")], "device_id string, ts long, cpu double, mem double, disk double, net_down_kbps double, net_up_kbps double, scenario_label string").write.parquet(str(tmp_path / "new"))
    rows = {r["ts"]: r for r in files.read_metrics(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()}
    assert rows[1]["net"] == 0.0 and rows[1]["scenario_label"] == "AUTO" and rows[1]["process_count"] == 0
    assert rows[2]["net"] == 5.0 and rows[2]["scenario_label"] == "WARNING"


def test_event_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event":"alert","risk":"71"}\n{"event":"tick","risk":"x"}\n{broken\n\n')
    assert [r["value"] for r in files.malformed_lines(spark.read.text(str(tmp_path / "log.jsonl"))).collect()] == ["{broken"]
    rows = files.read_event_log(spark, str(tmp_path / "log.jsonl"), ["event", "risk"], {"risk": "int"}).orderBy("event").collect()
    assert [(r["event"], r["risk"]) for r in rows] == [("alert", 71), ("tick", None)]


def test_export_and_report(spark, tmp_path):
    episodes = spark.createDataFrame([("e1", "d1"), ("e2", "d2")], "episode_id string, device_id string")
    cols = [c for c in sinks.EXPORT_COLUMNS if c not in ("episode_id", "observed_at")]
    rows = spark.createDataFrame([("e1", 2), ("e1", 1), ("e2", 3)], "episode_id string, observed_at long").select("*", *[F.lit("x").alias(c) for c in cols])
    sinks.write_csv(sinks.device_export(rows, episodes, "d1"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(sinks.EXPORT_COLUMNS) and [r["observed_at"] for r in back.collect()] == ["1", "2"]
    sinks.write_report(sinks.failure_row(rows, "bad input"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["status"] == "NOT_CERTIFIED"


def test_prediction_text(spark):
    texts = ['{"risk": 40, "confidence": 200, "class": "WARNING", "root_cause": {"primary": "cpu"}}', "80", "{broken", '{"risk": 400}', "", '{"probability": 12}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_prediction("t").alias("p")).collect()
    assert [r["p"]["risk"] for r in rows] == [40.0, 80.0, -1.0, -1.0, -1.0, 12.0]
    assert rows[0]["p"]["confidence"] == 100.0 and rows[0]["p"]["root_cause"] == "cpu" and rows[1]["p"]["predicted_class"] == "CRITICAL"


def test_prediction_text_of_any_length(spark):
    rows = spark.range(0, 2050, 41).select(S.parse_prediction(F.repeat(F.lit("{"), F.col("id").cast("int"))).alias("p")).collect()
    assert all(r["p"]["risk"] == -1.0 for r in rows)


def put(spark, folder, rows):
    """One more file for a stream; the pause keeps file times apart, so batches keep their order."""
    spark.createDataFrame(rows, "device_id string, t long, v double").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    all_rows = [("a", t, float(t % 5)) for t in range(40)] + [("b", t, float(t % 3)) for t in range(40)]
    for part in range(4):
        put(spark, folder, [r for r in all_rows if r[1] // 10 == part])
    source = K.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    kernel = Q.cooldown_kernel("t", 3.0, 1.0)
    outputs = "accepted boolean, remaining_seconds double"
    folded = K.stateful_fold(source, ["device_id"], ["t"], kernel, outputs)
    K.store_rows(folded, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["device_id"], r["t"]): r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = Q.cooldown(spark.createDataFrame(all_rows, "device_id string, t long, v double"), ["device_id"], ["t"], 3.0, 1.0)
    assert got == {(r["device_id"], r["t"]): r["accepted"] for r in batch.collect()}


def test_late_rows_are_marked_and_do_not_touch_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", 10, 1.0), ("a", 20, 1.0)])
    put(spark, folder, [("a", 15, 9.0), ("a", 30, 1.0)])
    source = K.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    folded = K.stateful_fold(source, ["device_id"], ["t"], K.rolling_mean_kernel(["v"]), "v_mean double")
    K.store_rows(folded, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r["t"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[15]["late"] and rows[15]["v_mean"] is None
    assert not rows[30]["late"] and rows[30]["v_mean"] == 1.0


def test_sessions_by_gap(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 5, 10, 40, 45)] + [("a", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "device_id string, at string").select("device_id", F.col("at").cast("timestamp").alias("at")).write.parquet(folder)
    source = K.file_stream(spark, folder, spark.read.parquet(folder).schema)
    made = K.sessions(source, ["device_id"], "at", "15 seconds", "1 minute")
    K.store_rows(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["frames"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_repeated_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 5.0), ("d", 1, 6.0), ("d", 2, 7.0)], "device_id string, ts long, cpu double")
    for _ in range(2):
        sinks.write_batch({"metrics": rows}, str(tmp_path), 0, ["cpu"])
    back = spark.read.parquet(str(tmp_path / "metrics")).orderBy("ts").collect()
    assert [(r["ts"], r["cpu"]) for r in back] == [(1, 6.0), (2, 7.0)]


def test_later_batches_replace_rows_of_a_key(spark, tmp_path):
    schema = "device_id string, ts long, cpu double, written long"
    for batch, rows in enumerate([[("d", 1, 5.0, 1), ("d", 2, 7.0, 2)], [("d", 1, 6.0, 3), ("d", 2, 1.0, 1)]]):
        sinks.write_batch({"metrics": spark.createDataFrame(rows, schema)}, str(tmp_path / "t"), batch, ["written"])
    expected = [(1, 6.0), (2, 7.0)]
    back = sinks.read_keyed(spark, str(tmp_path / "t"), "metrics", ["written"])
    assert [(r["ts"], r["cpu"]) for r in back.orderBy("ts").collect()] == expected
    sinks.compact(spark, str(tmp_path / "t"), "metrics", ["written"], str(tmp_path / "c"))
    back = sinks.read_keyed(spark, str(tmp_path / "c"), "metrics", ["written"])
    assert [(r["ts"], r["cpu"]) for r in back.orderBy("ts").collect()] == expected


def test_windows_do_not_depend_on_batches(spark, tmp_path):
    """16 samples of a device in batches of five, delivered from the last to the first, give the nine windows of the whole."""
    folder = str(tmp_path / "in")
    rows = [("a", t, float(t * t % 11)) for t in range(16)]
    for low in reversed(range(0, 16, 5)):
        put(spark, folder, rows[low : low + 5])
    put(spark, folder, [(None, 10**12, 0.0)])
    source = K.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    windows = E.windowed(source, ["device_id"], ["t"], "1 hour", ["v"])
    E.store_in_order(windows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["t"]: r["values"]["v"] for r in spark.read.parquet(str(tmp_path / "out")).where("not late").collect()}
    assert got == {t: [rows[k][2] for k in range(t - 7, t + 1)] for t in range(7, 16)}


def test_update_of_present_rows_takes_the_last_delta_row_of_a_key(spark):
    base = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "c", 0), (None, "d", 0)], "id long, name string, status int")
    delta = spark.createDataFrame([(1, 5, 2), (1, 7, 1), (1, 7, 1), (3, 9, 1), (None, 9, 1)], "id long, status int, at int")
    got = lambda order: sorted((r.name, r.status) for r in tables.update_where_present(base, delta, ["id"], ["status"], order).collect())
    assert got(["at"]) == [("a", 5), ("b", 5), ("c", 0), ("d", 0)]
    assert got([]) == [("a", 7), ("b", 7), ("c", 0), ("d", 0)]


def test_migrations_are_repeatable_and_rewrite_nothing(spark, tmp_path):
    one = migrations.Step(3, "first", "id long, name string", {"name": "none"})
    two = migrations.Step(5, "second", "size double, name string", {"size": 1.5, "name": "later"})
    base = str(tmp_path / "t")
    assert migrations.version(spark, base) == 0
    assert migrations.migrate(spark, base, [one], 10) == [3] and migrations.migrate(spark, base, [one], 11) == []
    migrations.write_rows(spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"), base, [one, two])
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t/rows").rglob("*.parquet")}
    # Steps are given in any order and applied by number.
    assert migrations.migrate(spark, base, [two, one], 12) == [5] and migrations.migrate(spark, base, [one, two], 13) == []
    migrations.write_rows(spark.createDataFrame([(3, 9)], "id int, size int"), base, [one, two])
    rows = {tuple(r) for r in migrations.read_rows(spark, base, [one, two]).collect()}
    assert rows == {(1, "a", 1.5, 3), (2, "none", 1.5, 3), (3, "none", 9.0, 5)}
    assert all(f.stat().st_mtime_ns == t for f, t in before.items()) and before
    assert [(r["version"], r["name"], r["applied_at"]) for r in migrations.ledger(spark, base).orderBy("version").collect()] == [(3, "first", 10), (5, "second", 12)]


def test_migrations_that_do_not_fit_leave_no_trace(spark, tmp_path):
    base = str(tmp_path / "t")
    one = migrations.Step(1, "first", "id long")
    assert migrations.read_rows(spark, base, [one]).count() == 0
    migrations.migrate(spark, base, [one], 1)
    for steps in (
        [migrations.Step(1, "other", "id long")],
        [one, migrations.Step(2, "a", "x int"), migrations.Step(2, "b", "y int")],
        [one, migrations.Step(2, "a", "x int", {"y": 1})],
        [one, migrations.Step(2, "a", "x int"), migrations.Step(3, "b", "y no_such_type")],
    ):
        with pytest.raises(Exception):
            migrations.migrate(spark, base, steps, 2)
    assert migrations.version(spark, base) == 1
