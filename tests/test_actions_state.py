import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsefleet.functions import gates as G
from pulsefleet.operators import graph as N
from pulsefleet.operators import learning as L
from pulsefleet.operators import process as P
from pulsefleet.operators import sequential as Q
from pulsefleet.operators import windows as W
from pulsefleet.operators.ordered import Ordered
from pulsefleet.plans import decisions

SNAP = "t_ms long, cpu double, available_mb double, page_faults double, working_set_mb double, foreground_alive boolean, foreground_hung boolean, measured boolean"


def impact(spark, before, after):
    names = [part.split()[0] for part in SNAP.split(", ")]
    df = spark.createDataFrame([(before, after)], f"pre struct<{SNAP.replace(' ', ':').replace(',:', ',')}>, post struct<{SNAP.replace(' ', ':').replace(',:', ',')}>")
    side = lambda s: {n: F.col(f"{s}.{n}") for n in names}
    return df.select(G.action_impact(side("pre"), side("post"), F.lit(True)).alias("i")).first()["i"]


def snap(t, cpu, free, faults, hung=False, measured=True):
    return (t, cpu, free, float(faults), 500.0, True, hung, measured)


def test_helpful_neutral_harmful(spark):
    good = impact(spark, snap(1000, 80.0, 300.0, 100), snap(11000, 60.0, 420.0, 120))
    assert good["status"] == "VERIFIED_HELPFUL" and not good["rollback_required"]
    assert impact(spark, snap(1000, 40.0, 500.0, 100), snap(11000, 39.0, 505.0, 105))["status"] == "VERIFIED_NEUTRAL"
    bad = impact(spark, snap(1000, 40.0, 500.0, 100), snap(11000, 70.0, 250.0, 2000, hung=True))
    assert bad["status"] == "VERIFIED_HARMFUL" and bad["rollback_required"]
    assert impact(spark, snap(1000, 40.0, 500.0, 100, measured=False), snap(11000, 70.0, 250.0, 100))["status"] == "PLANNED"


def logged(spark, n, reward=0.5, propensity=1.0, causal=True):
    rows = [("p", "a", "a", reward, 0.0, propensity if not callable(propensity) else propensity(i), causal, True) for i in range(n)]
    return spark.createDataFrame(
        rows, "policy string, logged_action string, candidate_action string, reward double, baseline_reward double, logging_propensity double, causal_support boolean, observed boolean"
    )


def test_off_policy_promotion(spark):
    verdict = lambda df: L.evaluate_policies(df, ["policy"]).first()
    assert verdict(logged(spark, 60))["promotion_eligible"]
    assert not verdict(logged(spark, 5))["promotion_eligible"]
    poor = verdict(logged(spark, 30, 0.8, lambda i: 0.01 if i == 0 else 1.0))
    assert not poor["promotion_eligible"] and poor["effective_sample_size"] < 30
    assert verdict(logged(spark, 60, causal=False))["reason"] == "causal_checksum_missing_for_observed_outcomes"
    assert verdict(logged(spark, 60, propensity=2.0))["reason"] == "invalid_logging_propensity"


def test_reward_model_learns(spark):
    x = [1.0, 0.5, 0.25, 0.0]
    samples = spark.createDataFrame([("eco", x, 0.8)] * 80, "action string, x array<double>, reward double")
    models = L.solve_models(L.reward_statistics(samples))
    ask = spark.createDataFrame([("eco", x), ("other", x)], "action string, x array<double>")
    out = {r["action"]: r for r in L.predict(ask, models, "action", "x").collect()}
    assert out["eco"]["expected_reward"] > 0.5 and out["eco"]["observations"] == 80
    assert out["eco"]["uncertainty"] < out["other"]["uncertainty"] == pytest.approx(np.linalg.norm(x))


def test_reward_model_equals_numpy_and_merges(spark):
    rng = np.random.default_rng(1)
    xs, rs = rng.normal(size=(50, 5)), rng.normal(size=50)
    df = spark.createDataFrame([("a", x.tolist(), float(r)) for x, r in zip(xs, rs)], "action string, x array<double>, reward double")
    half = df.withColumn("h", F.monotonically_increasing_id() % 2)
    merged = L.merge_statistics(L.reward_statistics(half.where("h = 0")).unionByName(L.reward_statistics(half.where("h = 1"))))
    row = L.solve_models(merged).first()
    a = np.eye(5) + xs.T @ xs
    assert np.allclose(row["weights"], np.linalg.solve(a, xs.T @ np.clip(rs, -2, 2)))
    assert np.allclose(np.array(row["inverse"]).reshape(5, 5), np.linalg.inv(a)) and row["n"] == 50


def test_private_update_is_clipped(spark):
    row = spark.range(1).select(L.private_update(F.array(F.lit(10.0), F.lit(10.0), F.lit(10.0)), 1.0).alias("u")).first()["u"]
    assert row["clipped_norm"] <= 1.000001 and row["original_norm"] == pytest.approx(300**0.5)
    noisy = spark.range(1).select(L.private_update(F.array(F.lit(0.1), F.lit(0.2)), 1.0, 0.5, 7).alias("u"))
    assert noisy.first() == noisy.first() and noisy.first()["u"]["protected"] != [0.1, 0.2]


def test_shadow_choice_needs_safety(spark):
    schema = "d int, action string, reversible boolean, safety_passed boolean, lower_bound double, expected_reward double, uncertainty double, observations long, o int"
    rows = [(1, "eco", True, False, 0.9, 0.9, 0.0, 80, 0), (2, "eco", True, True, 0.4, 0.9, 0.0, 80, 0), (2, "low", True, True, 0.6, 0.9, 0.0, 80, 1), (3, "eco", True, True, 0.9, 0.9, 0.0, 3, 0)]
    out = {r["d"]: r for r in L.shadow_choice(spark.createDataFrame(rows, schema), ["d"], "o").collect()}
    assert not out[1]["would_act"] and out[1]["reason"] == "no_reversible_safe_candidate"
    assert out[2]["would_act"] and out[2]["action"] == "low"
    assert out[3]["reason"] == "insufficient_measured_outcomes"


PROC = "device_id string, tick long, pid long, name string, category string, safety string, private_mb double, working_set_mb double, expected_gain_mb double, cpu double, waste_score double, safety_score double, is_foreground boolean, matches_user_intent boolean, is_recently_active boolean, has_visible_window boolean, is_system_critical boolean, trusted_path boolean, signed_trusted boolean"


def test_low_end_autopilot(spark):
    rows = [
        ("d", 1, 101, "video_editor.exe", "FOREGROUND_APP", "USER_ACTIVE", 450.0, 900.0, 0.0, 42.0, 80.0, 90.0, True, True, False, True, False, True, True),
        ("d", 1, 202, "cloud_sync.exe", "UPDATER_SYNC", "CANDIDATE", 220.0, 320.0, 100.0, 11.0, 60.0, 90.0, False, False, False, False, False, True, True),
        ("d", 1, 303, "browser_helper.exe", "BROWSER_CHILD", "CANDIDATE", 160.0, 260.0, 80.0, 8.0, 50.0, 90.0, False, False, False, False, False, True, True),
        ("d", 1, 404, "security_service.exe", "BACKGROUND_HELPER", "PROTECTED", 250.0, 500.0, 90.0, 15.0, 50.0, 90.0, False, False, False, False, True, True, True),
    ]
    rec = P.autopilot_recommendations(spark.createDataFrame(rows, PROC), ["device_id", "tick"], ["pid"])
    got = rec.orderBy("rank").collect()
    assert [r["pid"] for r in got] == [202, 303] and all(r["reversible"] for r in got)
    system = spark.createDataFrame(
        [("d", 1, 76.0, 92.0, 4.0, 4096.0, 84.0, "CRITICAL", 26.0, 220.0)],
        "device_id string, tick long, cpu double, mem double, disk double, total_memory_mb double, risk double, level string, baseline_anomaly double, plan_gain_mb double",
    )
    out = P.autopilot_results(system, rec, ["device_id", "tick"]).first()
    assert out["low_end_device"] and out["status"] == "READY_DRY_RUN" and out["user_apps_touched"] == 0 and out["estimated_ram_mb"] == 180.0


def test_descendants_stop_on_cycles(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 9)], "tick int, parent_pid long, pid long")
    roots = spark.createDataFrame([(1, 1)], "tick int, node long")
    assert {r["node"] for r in N.descendants(edges, roots, ["tick"]).collect()} == {1, 2, 3}


def test_family_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    """A chain of 10,000 processes settles in rounds that double, with the distance of every member."""
    rounds = []
    written = N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: rounds.append(1) or written(df))
    edges = spark.range(1, 10_000).selectExpr("1 AS tick", "id AS parent_pid", "id + 1 AS pid")
    roots = spark.createDataFrame([(1, 1)], "tick int, node long")
    got = N.descendants(edges, roots, ["tick"]).selectExpr("count(*) AS n", "count_if(depth = node - 1) AS right").first()
    assert (got["n"], got["right"]) == (10_000, 10_000)
    assert len(rounds) <= 2 + N.SHALLOW + 1 + 15


@pytest.mark.parametrize(("several", "shallow"), [(False, 0), (False, 2), (True, 0)])
def test_descendants_equal_a_search_per_tick(spark, monkeypatch, several, shallow):
    """Random forests with cycles, several roots above each other, self-loops, absent roots and repeated edges."""
    monkeypatch.setattr(N, "SHALLOW", shallow)
    rng = np.random.default_rng(5)
    edges, roots, want = [], [], {}
    for tick in range(12):
        up = {(int(rng.integers(0, 40)), n) for n in range(40) if rng.random() < 0.95}
        if several:
            up |= {(int(rng.integers(0, 40)), n) for n in range(40) if rng.random() < 0.2}
        start = {int(x) for x in rng.integers(0, 45, 3 if tick else 0)}
        edges += [(tick, a, b) for a, b in up] * 2
        roots += [(tick, x) for x in start]
        depth, newest, d = dict.fromkeys(start, 0), start, 0
        while newest:
            d += 1
            newest = {b for a, b in up if a in newest and b not in depth}
            depth |= dict.fromkeys(newest, d)
        want |= {(tick, n): d for n, d in depth.items()}
    got = N.descendants(
        spark.createDataFrame(edges, "tick int, parent_pid long, pid long"), spark.createDataFrame(roots, "tick int, node long"), ["tick"]
    ).collect()
    assert {(r["tick"], r["node"]): r["depth"] for r in got} == want and len(got) == len(want)


def test_descendants_of_empty_tables(spark):
    edges = spark.createDataFrame([], "tick int, parent_pid long, pid long")
    roots = spark.createDataFrame([], "tick int, node long")
    assert N.descendants(edges, roots, ["tick"]).count() == 0


@pytest.mark.parametrize("seconds", [0.0, 0.5, 3.0, 5000.0])
def test_cooldown_of_heavy_keys_by_pointers(spark, small_segments, monkeypatch, seconds):
    """Ties, bursts and gaps of two heavy keys and a light one equal the fold, row by row, without a loop over segments."""
    rng = np.random.default_rng(11)
    rows = []
    for key, n in (("a", 400), ("b", 90), ("c", 8)):
        clock = np.cumsum(rng.choice([0, 0, 200_000, 700_000, 9_000_000], n))
        rows += [(key, int(t), i) for i, t in enumerate(clock)]
    df = spark.createDataFrame(rows, "k string, t long, seq int").repartition(5)
    monkeypatch.setattr(Q, "_fold_heavy", None)
    got = {(r["k"], r["seq"]): (r["accepted"], r["remaining_seconds"]) for r in Q.cooldown(df, ["k"], ["t", "seq"], seconds).collect()}
    want = {}
    for key in "abc":
        own = sorted(r for r in rows if r[0] == key)
        out, _ = Q.cooldown_kernel("t", seconds, 1e6)({"t": [r[1] for r in own]}, None)
        want |= {(key, r[2]): (x, y) for r, x, y in zip(own, out["accepted"], out["remaining_seconds"])}
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def sampled(spark, rows, **settings):
    names = ("elevated", "severe", "foreground_changed", "invalid", "safety", "within_budget", "collector_failed")
    data = [("d", t, *[bool(flags.get(n, n == "within_budget")) for n in names]) for t, flags in rows]
    df = spark.createDataFrame(data, "device_id string, t long, " + ", ".join(f"{n} boolean" for n in names))
    return [(r["t"], r["capture"], r["reason"]) for r in Q.adaptive_sampling(df, ["device_id"], ["t"], **settings).orderBy("t").collect()]


def test_stable_sampling(spark):
    out = sampled(spark, [(t, {}) for t in range(0, 6000, 1000)])
    assert [t for t, take, _ in out if take] == [0, 5000]


def test_foreground_change_and_burst_cap(spark):
    assert sampled(spark, [(0, {}), (500, {"foreground_changed": 1})])[1][1:] == (True, "foreground_changed")
    out = sampled(spark, [(0, {}), (1000, {"elevated": 1}), (4000, {"elevated": 1})], burst_ms=3000)
    assert out[1][1] and out[2][1:] == (False, "focused_burst_capped")


def test_failure_backoff_and_safety_override(spark):
    out = sampled(spark, [(0, {"collector_failed": 1}), (2000, {"elevated": 1}), (2500, {"safety": 1})])
    assert out[1][1:] == (False, "collector_failure_backoff") and out[2][1]


def test_collector_cost(spark):
    df = spark.createDataFrame([("qoe", 1, 2.0, True), ("qoe", 2, 10.0, True), ("qoe", 3, 6.0, False)], "c string, t long, ms double, ok boolean")
    row = W.collector_cost(df, ["c"], ["t"], "ms", "ok").first()
    assert (row["last_duration"], row["p95_duration"], row["healthy"]) == (6.0, 10.0, False) and row["p50_duration"] >= 6.0


def test_ewma(spark):
    df = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 1.0)], "d string, t long, v double")
    assert W.ewma_last(df, ["d"], ["t"], "v", 0.5).first()["ewma"] == 0.5


def test_window_features_of_the_contract_case(spark):
    cpu, mem, disk = [20, 25, 30, 35, 40, 42, 45, 50], range(30, 38), range(70, 62, -1)
    net, proc = [1, 1, 2, 2, 2, 3, 3, 4], [80, 80, 81, 82, 82, 83, 84, 84]
    rows = [("d", i, float(c), float(m), float(k), float(n), float(p), 0.0, 0.0) for i, (c, m, k, n, p) in enumerate(zip(cpu, mem, disk, net, proc))]
    df = spark.createDataFrame(rows, "device_id string, t long, cpu double, mem double, disk double, net double, process double, top_cpu double, top_mem double")
    out = W.window_features(df, ["device_id"], ["t"])
    row = out.first()
    assert out.count() == 1 and len(W.FEATURES) == 73 and set(W.FEATURES) <= set(out.columns)
    assert row["cpu_slope"] == pytest.approx(np.polyfit(range(8), cpu, 1)[0]) and row["cpu_std"] == pytest.approx(np.std(cpu))
    assert row["net_spike"] == 2.0 and row["top_cpu_slope"] == 0.0
    assert W.window_features(df.where("t < 7"), ["device_id"], ["t"]).count() == 0


BURSTS = {
    # A spread key, a key with 99 % of its rows in one second, and a key with a single timestamp.
    "spread": [("hot", t, t % 7) for t in range(1090)],
    "burst": [("hot", t * 1_000_000, 1) for t in range(10)] + [("hot", 5_000_000 + t % 997, t % 7) for t in range(1080)],
    "one_time": [("hot", 5000, t % 7) for t in range(1090)],
}


@pytest.mark.parametrize("shape", sorted(BURSTS))
def test_segments_cover_every_row_once(spark, small_segments, shape):
    rows = BURSTS[shape] + [("cold", t, 1) for t in range(20)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumn("i", F.monotonically_increasing_id())
    seq = Ordered(df, ["k"], ["t", "i"], before=7, after=5)
    assert seq.split
    sizes = seq.df.groupBy("k", "__seg").agg(F.count(F.lit(1)).alias("n"), F.count_if("__halo").alias("halo")).collect()
    assert len(sizes) == 1 + -(-1090 // 25) and max(r["n"] - r["halo"] for r in sizes) <= 25 and max(r["halo"] for r in sizes) <= 12
    seq.with_columns({"n": F.count(F.lit(1)).over(seq.rows(-7, 0)), "m": F.count(F.lit(1)).over(seq.rows(1, 5))})
    seq.cumulate({"total": ("sum", F.col("v")), "place": ("sum", F.lit(1))})
    out = seq.result()
    assert out.count() == df.count() and out.select("i").distinct().count() == df.count()
    # Only the first seven and last five rows of each key see a shorter frame.
    assert out.where("n < 8").count() == 14 and out.where("m < 5").count() == 10
    hot = out.where("k = 'hot'").orderBy("place").collect()
    assert [r["place"] for r in hot] == list(range(1, 1091))
    assert hot[-1]["total"] == sum(v for k, _, v in rows if k == "hot")


def test_scores_of_processes_build_no_array_of_reasons(spark, data):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = decisions.nodes(spark, data)
    assert "array" in plan(rows.select("criticality_reasons")) and "dependency" not in plan(rows.select("criticality", "protected_from_intervention"))
    points = {"active foreground process": 100, "foreground process-family dependency": 92, "matches current user intent": 95,
              "recently active application": 82, "visible user-facing window": 72, "deterministic protected target": 100,
              "audio/video deadline dependency": 96, "active compilation throughput dependency": 88, "current workload I/O dependency": 75,
              "no observed foreground dependency": 10}
    got = rows.select("criticality", "criticality_reasons").distinct().collect()
    assert len(got) > 10 and all(row.criticality == max(points[x] for x in row.criticality_reasons) for row in got)


def test_equal_edges_meet_in_one_shuffle(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 1, 2), (1, 2, 3), (2, 5, 6), (2, 6, 6)], "k int, parent_pid int, pid int")
    roots = spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "k int, node int")
    seen, checkpointed = [], N.checkpointed
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(N, "checkpointed", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), checkpointed(df))[1])
        found = N.descendants(edges, roots, ["k"]).collect()
    assert sorted((r.k, r.node, r.depth) for r in found) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 5, 0), (2, 6, 1)]
    assert seen[0].count("Exchange") == 1
