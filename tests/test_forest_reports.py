"""The values of the trained forest's reports, which no SQL can say, against its scored rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsefleet.functions.scoring import LABELS
from pulsefleet.operators import training
from pulsefleet.operators.windows import FEATURES
from pulsefleet.plans import streams


@pytest.fixture(scope="module")
def scored(spark, data):
    return streams._scored(spark, data).select("label", "predicted_class", "risk").toPandas()


def rows(spark, data, name):
    return entry.queries()[name](spark, data).toPandas()


def test_classes_are_those_of_the_scored_rows(spark, data, scored):
    got = rows(spark, data, "j1_forest_classes").set_index("class")
    assert set(got.index) == set(scored.label) | set(scored.predicted_class)
    for name, row in got.iterrows():
        hits = int(((scored.label == name) & (scored.predicted_class == name)).sum())
        assert (row.support, row.predicted, row.hits) == ((scored.label == name).sum(), (scored.predicted_class == name).sum(), hits)
        assert row.precision == pytest.approx(hits / row.predicted if row.predicted else 0.0)
        assert row.recall == pytest.approx(hits / row.support if row.support else 0.0)
    reached = (scored.label == scored.predicted_class).sum() >= scored.label.value_counts().max()
    assert (got.beats_majority == reached).all()


def test_importances(spark, data):
    got = rows(spark, data, "f7_importance_rows")
    assert len(got) == 12 and set(got.feature) <= set(FEATURES) and got.importance.is_monotonic_decreasing
    assert got.importance.iloc[0] > 0 and got.importance.sum() <= 1 + 1e-9


def test_stored_model_and_stream(spark, data, scored):
    got = rows(spark, data, "j2_saved_model_classes").set_index("predicted_class")
    expected = scored.groupby("predicted_class").risk.agg(["size", "mean"])
    assert got.n.to_dict() == expected["size"].to_dict()
    assert got.mean_risk.to_dict() == pytest.approx(expected["mean"].to_dict())
    stream = rows(spark, data, "j3_stream_classes")
    assert stream.n.sum() == rows(spark, data, "j3_stream_scores").windows.sum() and stream.mean_risk.between(0, 100).all()


def test_a_fit_has_no_more_tasks_than_run_at_once(spark, monkeypatch):
    assert training.fit_tasks(spark.range(0)) == training.fit_tasks(spark.range(training.TASK_ROWS)) == 1
    monkeypatch.setattr(training, "TASK_ROWS", 10)
    assert training.fit_tasks(spark.range(21)) == 3
    assert training.fit_tasks(spark.range(10_000)) == spark.sparkContext.defaultParallelism


def test_forests_side_by_side_vote_like_one(spark, tmp_path, monkeypatch):
    assert training.tree_shares(20_000, 1, 12, 420) == [420]
    assert training.tree_shares(300_000, 2, 12, 420) == [70] * 6 and training.tree_shares(9_000_000, 12, 12, 420) == [420]
    monkeypatch.setattr(training, "ONE_FOREST_ROWS", 10)
    monkeypatch.setattr(training, "LEAST_TREES", 2)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("id") % 4 + 1).cast("int"))
    values = [((F.col("id") % 4) * 10 + F.rand(i)).alias(name) for i, name in enumerate(FEATURES)]
    rows = spark.range(400).select("id", *values, label.alias("label"))
    model = training.train_forest(rows, trees=7, depth=3)
    assert [f.getNumTrees for f in model.stages[1:]] == [3, 2, 2]
    training.save_model(model, str(tmp_path), spark, {})
    model, _ = training.load_model(str(tmp_path), spark)
    scored = training.score(rows, model).orderBy("id").toPandas()
    votes = [np.stack(model.transform(rows).orderBy("id").toPandas()[f"raw{i}"].map(lambda v: v.toArray())) for i in range(3)]
    assert [len(v) for v in votes] == [400] * 3 and np.allclose(sum(votes).sum(axis=1), 7)
    assert [LABELS[i] for i in sum(votes).argmax(axis=1)] == scored.predicted_class.tolist() == scored.label.tolist()
    assert training.importances(model, spark, top=99).toPandas().importance.sum() == pytest.approx(1.0)


def test_reports_read_stored_scores(spark, data):
    # A plan that scores sends the forest with every stage.
    assert "UDF" not in streams._scored(spark, data)._jdf.queryExecution().toString()


def test_late_rows_keep_state_over_one_column(spark, data, monkeypatch):
    seen, fold = [], streams.K.stateful_fold
    monkeypatch.setattr(streams.K, "stateful_fold", lambda stream, *rest: (seen.append(stream.columns), fold(stream, *rest))[1])
    assert rows(spark, data, "k3_late_rows")["rows"].sum() == spark.read.parquet(f"{data}/events.parquet").count()
    assert seen == [["device_id", "t", "seq", "cpu"]]


def test_many_trees_are_fit_in_turns(spark, monkeypatch):
    assert training.split_shares(20_000, [420]) == [420]
    assert training.split_shares(300_000, [105] * 4) == [35] * 12 and training.split_shares(9_000_000, [420]) == [39] * 2 + [38] * 9
    monkeypatch.setattr(training, "ONE_FOREST_ROWS", 10)
    monkeypatch.setattr(training, "LEAST_TREES", 2)
    monkeypatch.setattr(training, "MOST_TREES", 2)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("id") % 4 + 1).cast("int"))
    values = [((F.col("id") % 4) * 10 + F.rand(i)).alias(name) for i, name in enumerate(FEATURES)]
    rows = spark.range(400).select("id", *values, label.alias("label"))
    model = training.train_forest(rows, trees=7, depth=3)
    trees = [f.getNumTrees for f in model.stages[1:]]
    assert sum(trees) == 7 and max(trees) == 2
    scored = training.score(rows, model).toPandas()
    assert scored.predicted_class.tolist() == scored.label.tolist()


def test_validation_and_test_read_one_table_of_windows(spark, data, monkeypatch):
    streams._trained(spark, data)
    monkeypatch.setattr(streams.W, "training_set", lambda *rest, **named: pytest.fail("the windows are written"))
    scored = streams._scored(spark, data)
    assert scored.count() > 0 and scored.select("device_id", "seq").distinct().count() == scored.count()


def test_a_task_of_the_fit_is_not_small(spark):
    assert training.fit_tasks(spark.range(304_572)) == 1 and training.fit_tasks(spark.range(3_045_720)) == 7


def test_stages_of_a_stored_model_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "ONE_FOREST_ROWS", 10)
    monkeypatch.setattr(training, "LEAST_TREES", 1)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(200).select("id", *[((F.col("id") % 4) * 10 + F.rand(i)).alias(name) for i, name in enumerate(FEATURES)], label.alias("label"))
    model = training.train_forest(rows, trees=6, depth=2)
    training.save_model(model, str(tmp_path), spark, {"cpu": 1.5})
    again, meta = training.load_model(str(tmp_path), spark)
    assert meta["baseline"] == {"cpu": 1.5} and [s.uid for s in again.stages] == [s.uid for s in model.stages]
    assert len(again.stages) > 5 and (tmp_path / "model" / "1" / "metadata").exists()
    first, second = (training.score(rows, m).orderBy("id").toPandas() for m in (model, again))
    assert first.equals(second)
