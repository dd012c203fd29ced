import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pulsefleet.operators import episodes as E
from pulsefleet.operators import quality as Q
from pulsefleet.operators import splits as P
from pulsefleet.operators import tables as T


def frames(spark, rows):
    """rows: (t, phase, cpu, qoe status)."""
    data = [("d", t, "s", p, "INTERACTIVE", "IDE", c, 50.0, 40.0, {"qoe": q}) for t, p, c, q in rows]
    return spark.createDataFrame(
        data,
        "device_id string, t long, session string, phase string, behavior string, app string, cpu double, mem double, disk double, health map<string,string>",
    )


def build(spark, rows, **rules):
    rules = E.EpisodeRules(**rules)
    cut = E.cut_episodes(frames(spark, rows), ["device_id"], ["t"], "session", "phase", ["behavior", "app"], rules)
    made = E.episodes(cut, ["device_id"], ["t"], ["cpu"], collectors="health", rules=rules)
    return made.orderBy("start_t").collect()


def test_one_episode(spark):
    (e,) = build(spark, [(1000, "ACTIVE", 10.0, "OK"), (2000, "ACTIVE", 20.0, "OK"), (3000, "ACTIVE", 30.0, "OK")])
    assert e["cpu_median"] == 20.0 and e["valid"]
    assert (e["start_reason"], e["end_reason"]) == ("first_frame", "input_exhausted")


def test_phase_change_and_gap(spark):
    rows = [(1000, "ACTIVE"), (2000, "ACTIVE"), (3000, "COMPILING"), (4000, "COMPILING"), (25000, "COMPILING"), (26000, "COMPILING")]
    made = build(spark, [(t, p, 1.0, "OK") for t, p in rows])
    assert [e["end_reason"] for e in made] == ["workload_phase_changed", "telemetry_gap", "input_exhausted"]
    assert not made[0]["valid"] and made[0]["frame_count"] == 2


def test_failed_collector_is_listed(spark):
    (e,) = build(spark, [(1000, "A", 1.0, "OK"), (2000, "A", 1.0, "UNAVAILABLE"), (3000, "A", 1.0, "OK")])
    assert not e["valid"] and e["failed_collectors"] == ["qoe"]


def test_gap_limit_is_exclusive(spark):
    made = build(spark, [(t, "A", 1.0, "OK") for t in (1000, 10000, 19000)], max_gap=9000)
    assert len(made) == 1


def test_stuck_clock_is_reported(spark):
    cut = E.cut_episodes(frames(spark, [(1000, "A", 1.0, "OK"), (1000, "A", 2.0, "OK")]), ["device_id"], ["t"], "session", "phase", ["behavior", "app"])
    assert E.out_of_order_frames(cut).count() == 1


def test_context_episodes_and_erasure(spark):
    ticks = spark.createDataFrame(
        [("d", 1000, "A", "I", True), ("d", 6000, "A", "I", False), ("d", 11000, "B", "I", True)],
        "device_id string, t long, phase string, behaviour string, captured boolean",
    )
    made, summaries = E.context_episodes(ticks, ["device_id"], ["t"], "phase", "behaviour", F.col("captured"))
    assert made.count() == 2 and summaries.count() == 2
    rows = {r["episode_index"]: r for r in made.collect()}
    assert rows[1]["end_reason"] == "WORKLOAD_OR_FOREGROUND_CHANGE" and rows[1]["ended_at"] == 11000
    assert rows[2]["end_reason"] == "OPEN"
    episodes = made.select("device_id", F.concat("device_id", F.lit("-"), "episode_index").alias("episode_id"))
    sums = summaries.select(F.concat("device_id", F.lit("-"), "episode_index").alias("episode_id"), F.col("t").cast("string").alias("summary_id"))
    tables = {"devices": episodes.select("device_id").distinct(), "episodes": episodes, "summaries": sums, "baselines": sums.select("summary_id")}
    out = T.erase_devices(tables, episodes, "episodes", "summaries", ["baselines"], ["summaries"], ["episodes", "devices"])
    assert [out[n].count() for n in ("devices", "episodes", "summaries", "baselines")] == [0, 0, 0, 0]


def descriptors(spark, n, device=lambda i: i):
    return spark.createDataFrame(
        [(f"e{i}", f"d{device(i)}", i * 10_000, i * 10_000 + 1000) for i in range(n)], "episode_id string, device_id string, start_t long, end_t long"
    )


def test_split_assigns_all_and_is_disjoint(spark):
    split = P.split_grouped_temporal(descriptors(spark, 10), "episode_id", purge_gap=200)
    roles = {r["role"]: r["count"] for r in split.groupBy("role").count().collect()}
    assert sum(roles.values()) == 10 and None not in roles and set(roles) == set(P.ROLES)


def test_split_by_device_keeps_devices_whole(spark):
    split = P.split_grouped_temporal(descriptors(spark, 8, lambda i: i // 2), "device_id")
    assert P.leaking_values(split, "device_id").count() == 0


def test_purge_drops_close_starts(spark):
    split = P.split_grouped_temporal(descriptors(spark, 10), "episode_id", purge_gap=15_000)
    # The validation episode goes; calibration is then far enough from train, and locked_test is not.
    assert split.where(F.col("role").isNull()).count() == 2


def test_too_few_groups(spark):
    with pytest.raises(P.LeakageError):
        P.role_counts(3)
    assert P.role_counts(10) == {"train": 7, "validation": 1, "calibration": 1, "locked_test": 1}
    assert sum(P.role_counts(4).values()) == 4


def test_leak_is_found(spark):
    rows = spark.createDataFrame([("e1", "train"), ("e1", "locked_test"), ("e2", "train")], "episode_id string, role string")
    assert [r["episode_id"] for r in P.leaking_values(rows, "episode_id").collect()] == ["e1"]


def test_manifest_round_trip(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("a",), ("",)], "id string")
    locked = P.locked_ids(ids, "id")
    manifest = P.locked_manifest(locked)
    assert sorted(r["episode_id"] for r in locked.collect()) == ["a", "b"] and manifest.first()["ids"] == 2
    assert manifest.first()["content_hash"] == hashlib.sha256(b"a\nb").hexdigest()
    assert P.manifest_problems(manifest, locked).count() == 0
    assert P.manifest_problems(manifest, locked.where("episode_id = 'a'")).first()["problem"] == "hash_mismatch"
    with pytest.raises(P.LeakageError):
        P.locked_manifest(locked.where("false"))
    used = spark.createDataFrame([("a",), ("z",)], "episode_id string")
    with pytest.raises(P.LeakageError):
        P.reject_locked_use(used, locked, "train")
    with pytest.raises(P.LeakageError):
        P.locked_overlap(used, locked, "locked_test")


def test_manifest_hash_of_a_tree(spark):
    """More ids than a leaf holds: the hash is that of the leaves' hashes, in order."""
    locked = P.locked_ids(spark.range(1000).selectExpr("cast(id AS string) AS id"), "id")
    leaves = {}
    for i in range(1000):
        leaves.setdefault(hashlib.sha256(str(i).encode()).hexdigest()[:2], []).append(str(i))
    digest = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    pairs = sorted((place, digest(sorted(own))) for place, own in leaves.items())
    tops = {}
    for place, own in pairs:
        tops.setdefault(place[:1], []).append(own)
    assert P.ids_hash(locked, 1) == (1000, digest([digest(tops[t]) for t in sorted(tops)]))


def test_frame_contract_lists_missing_fields(spark):
    row = {
        "schema_version": 3, "monotonic_timestamp_ms": 1, "wall_timestamp_utc": "t", "device_id": "d", "session_id": "s", "episode_id": "e", "windows_build_family": "w",
        "hardware": {"cpu_core_tier": "8"}, "collector_health": {"q": "OK"}, "feature_source_versions": {"q": "1"}, "provenance": "MEASURED_QOE", "foreground": {"app_family": "A"},
        "workload_phase": "A", "resources": {"cpu_percent": 1.0, "memory_percent": 1.0, "disk_free_percent": 1.0},
    }
    schema = """schema_version int, monotonic_timestamp_ms long, wall_timestamp_utc string, device_id string, session_id string, episode_id string, windows_build_family string,
      hardware struct<cpu_core_tier:string>, collector_health map<string,string>, feature_source_versions map<string,string>, provenance string, foreground struct<app_family:string>,
      workload_phase string, resources struct<cpu_percent:double,memory_percent:double,disk_free_percent:double>"""
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(row)]))
    errors = Q.validate(df, "telemetry_frame").first()["errors"]
    assert errors[0] == "missing:normalized_resources" and len(errors) == 4


def test_weak_label_only_fails_certification(spark):
    labels = spark.createDataFrame([("e", "WEAK_HEURISTIC", "USER_IMPACT_EVENT")], "episode_id string, provenance string, primary_outcome string")
    codes = lambda strict: {c for c, _ in Q.contract_rules(labels, "outcome_label", strict)}
    assert "weak_provenance" in codes(True) and "weak_provenance" not in codes(False)
    report = Q.label_report(labels).first()
    assert report["accepted"] and report["eligible"] == 0
    assert not Q.label_report(labels, for_certification=True).first()["accepted"]


def test_two_outcomes_are_contradictory(spark):
    labels = spark.createDataFrame(
        [("e", "MEASURED_QOE", "USER_IMPACT_EVENT"), ("e", "MEASURED_QOE", "NO_USER_IMPACT_EVENT")], "episode_id string, provenance string, primary_outcome string"
    )
    assert Q.contradictory_labels(labels).count() == 1 and not Q.label_report(labels).first()["accepted"]


def test_empty_labels_are_rejected(spark):
    empty = spark.createDataFrame([], "episode_id string, provenance string, primary_outcome string")
    report = Q.label_report(empty).first()
    assert report["total"] == 0 and not report["accepted"]


def test_end_must_follow_start(spark):
    df = spark.createDataFrame([(5, 5), (5, 6)], "start_monotonic_ms long, end_monotonic_ms long")
    rule = [r for r in Q.contract_rules(df, "workload_episode") if r[0] == "interval"]
    assert sorted(len(r["errors"]) for r in Q.with_errors(df, rule).collect()) == [0, 1]
