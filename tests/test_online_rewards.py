"""The reward model as a stream of decisions: each scored by the samples before it."""

import numpy as np
from pyspark.sql import functions as F

from pulsefleet.operators import learning as L
from pulsefleet.plans import streams


def samples(n=160, d=6, seed=3):
    draw = np.random.default_rng(seed)
    return [(int(i % 3), i, draw.normal(size=d).tolist(), float(draw.normal() * 2)) for i in range(n)]


def batch(before, x):
    """Expected reward and uncertainty by a fit of the rows before."""
    a, b = np.eye(len(x)), np.zeros(len(x))
    for _, _, v, r in before:
        a, b = a + np.outer(v, v), b + min(2.0, max(-2.0, r)) * np.array(v)
    inverse = np.linalg.inv(a)
    return float(inverse @ b @ np.array(x)), float(np.sqrt(np.array(x) @ inverse @ np.array(x)))


def test_scores_equal_a_fit_of_the_rows_before(spark, small_segments):
    rows = samples()
    df = spark.createDataFrame(rows, "action long, t long, x array<double>, reward double")
    got = {r.t: r for r in L.online_predictions(df, ["t"], 6).collect()}
    assert len(got) == len(rows)
    for row in rows:
        before = [o for o in rows if o[0] == row[0] and o[1] < row[1]]
        expected, uncertainty = batch(before, row[2])
        r = got[row[1]]
        assert abs(r.expected_reward - expected) < 1e-9 and abs(r.uncertainty - uncertainty) < 1e-9
        assert r.observations == len(before) and r.sufficiently_known == (len(before) >= 20 and uncertainty <= 0.75)


def test_last_state_is_that_of_the_batch_model(spark):
    rows = samples()
    _, (inverse, total, n) = L.online_kernel(6)({"x": [r[2] for r in rows if r[0] == 1], "reward": [r[3] for r in rows if r[0] == 1]}, None)
    df = spark.createDataFrame(rows, "action long, t long, x array<double>, reward double").where("action = 1")
    model = L.solve_models(L.reward_statistics(df)).first()
    assert n == model["n"] and np.allclose(inverse, model["inverse"], atol=1e-9)
    assert np.allclose(np.array(inverse).reshape(6, 6) @ total, model["weights"], atol=1e-9)


def test_unusable_rows_change_nothing(spark):
    kernel = L.online_kernel(2)
    good = [[1.0, 0.5], [0.2, 1.0]]
    odd = [None, [1.0], [float("nan"), 1.0], [None, 1.0], [1.0, 2.0]]
    out, state = kernel({"x": [good[0], *odd, good[1]], "reward": [1.0, 1.0, 1.0, 1.0, 1.0, None, -9.0]}, None)
    assert state == kernel({"x": good, "reward": [1.0, -2.0]}, None)[1]
    assert out["expected_reward"][1:5] == [None] * 4 and out["expected_reward"][5] is not None and out["observations"][-1] == 1


def test_stream_equals_batch(spark, data):
    assert streams.d34_stream_rewards(spark, data).exceptAll(streams.d34_online_rewards(spark, data)).isEmpty()
    assert streams.d34_online_rewards(spark, data).agg(F.count("*")).first()[0] == spark.read.parquet(f"{data}/embeddings.parquet").count()
