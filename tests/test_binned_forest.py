"""The forest that is grown from binned rows, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsefleet.functions.scoring import LABELS
from pulsefleet.operators import forest, training
from pulsefleet.operators.windows import FEATURES
from pulsefleet.plans import streams
from tests import compare

NAMES = ["a", "b", "c", "d", "e"]


def noisy(spark, n=3000):
    """Rows of three classes that five features tell apart in part."""
    columns = [(F.rand(i) * 8 + F.col("id") % 3 * (i + 1)).alias(name) for i, name in enumerate(NAMES)]
    return spark.range(0, n, 1, 16).select("id", *columns, F.round(F.rand(9) * 3).alias("few"), (F.col("id") % 3).cast("double").alias("label_id")).persist()


def fitted(rows, monkeypatch, blocks=1, **how):
    folders = []
    written = forest._written
    with monkeypatch.context() as m:
        m.setattr(forest, "LOT_ROWS", 200)
        m.setattr(forest, "BLOCK_ROWS", -(-rows.count() // blocks))
        m.setattr(forest, "_written", lambda *x: folders.append(written(*x)) or folders[0])
        model = forest.train(rows, [*NAMES, "few"], F.col("label_id"), {0: 1.0, 1: 1.5, 2: 0.5}, **{"trees": 5, "depth": 4, "min_leaf": 2, "seed": 3, **how})
    return model, rows.sparkSession.read.parquet(folders[0])


def test_blocks_make_no_difference(spark, monkeypatch):
    rows = noisy(spark)
    one, lots = fitted(rows, monkeypatch)
    many, dealt = fitted(rows, monkeypatch, blocks=4)
    assert lots.select("block").distinct().count() == 1 and dealt.select("block").distinct().count() == 4 and dealt.count() >= 15
    assert (one.feature == many.feature).all() and (one.test == many.test).all() and (one.leaves == many.leaves).all()
    assert np.allclose(one.importances, many.importances) and one.importances.sum() == pytest.approx(1.0)


def test_leaves_hold_the_class_shares_of_the_rows_in_bag(spark, monkeypatch):
    rows = noisy(spark)
    model, lots = fitted(rows, monkeypatch)
    lots = sorted((r.lot, bytes(r.cells)) for r in lots.collect())
    cells = np.frombuffer(b"".join(c for _, c in lots), np.uint8).reshape(-1, len(NAMES) + 1)
    assert len(cells) == 3000 and len(model.cuts[-1]) == 4
    weights = np.array([1.0, 1.5, 0.5])
    votes = np.zeros((len(cells), 3))
    for tree in range(model.trees):
        draws = forest._draws(3, tree, [(lot, len(c) // cells.shape[1]) for lot, c in lots])
        assert 0.95 < draws.mean() < 1.05 and draws.max() > 2
        reached = {}
        for i, row in enumerate(cells):
            node = 1
            while node < 16:
                node = 2 * node + int(row[model.feature[tree][node]] // 3 >= model.test[tree][node])
            reached.setdefault(node, []).append(i)
        for node, own in reached.items():
            counts = np.bincount(cells[own, 0] % 3, draws[own], 3) * weights
            if counts.sum():
                assert np.allclose(model.leaves[tree][node - 16], counts / counts.sum(), atol=1e-6)
            votes[own] += model.leaves[tree][node - 16]
    assert np.allclose(model.votes(cells // 3), votes / model.trees)
    assert (votes.argmax(axis=1) == cells[:, 0] % 3).mean() > 0.6


def test_best_splits_are_those_of_a_plain_search():
    lots = np.random.default_rng(5)
    counts = lots.poisson(0.4, (300, 3, forest.BINS, 4)).astype(np.int32)
    counts[:, 1:] = 0
    for node in range(300):
        # All features of a node split the same rows.
        for c in range(4):
            for other in (1, 2):
                np.add.at(counts[node, other, :, c], lots.integers(0, forest.BINS, counts[node, 0, :, c].sum()), 1)
    counts[7, :, :, 1:] = 0
    weights, subsets = np.array([1.0, 2.0, 0.5, 3.0]), np.tile([4, 6, 9], (300, 1))
    feature, test, gain, left, right = forest.best_splits(counts, subsets, weights, 9)

    def gini(n):
        w = n * weights
        return w.sum() - (w * w).sum() / w.sum()

    assert feature[7] == -1 and (feature >= 0).sum() == 299
    for node in range(300):
        found = [(-1.0, None)]
        for slot in range(3):
            for cut in range(1, forest.BINS):
                low, high = counts[node, slot, :cut].sum(axis=0), counts[node, slot, cut:].sum(axis=0)
                if min(low.sum(), high.sum()) >= 9:
                    found.append((gini(low + high) - gini(low) - gini(high), (slot, cut)))
        assert max(found)[0] == pytest.approx(gain[node], abs=1e-9)
        if feature[node] >= 0:
            slot = [4, 6, 9].index(feature[node])
            assert (left[node] == counts[node, slot, : test[node]].sum(axis=0)).all() and (right[node] == counts[node, slot, test[node] :].sum(axis=0)).all()
            assert min(left[node].sum(), right[node].sum()) >= 9


def test_many_rows_are_stored_scored_and_ranked(spark, tmp_path, monkeypatch):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(400).select("id", *[((F.col("id") % 4) * 10 + F.rand(i)).alias(name) for i, name in enumerate(FEATURES)], label.alias("label"))
    assert not isinstance(training.train_forest(rows, trees=2, depth=2), training.Forest)
    monkeypatch.setattr(training, "BINNED_ROWS", 399)
    model = training.train_forest(rows, trees=7, depth=3)
    assert isinstance(model, training.Forest) and model.trees == 7
    training.save_model(model, str(tmp_path), spark, {"cpu": 1.5}, {"readiness": "x"})
    again, meta = training.load_model(str(tmp_path), spark)
    assert meta["baseline"] == {"cpu": 1.5} and meta["readiness"] == "x" and training.model_version(str(tmp_path), spark)
    first, second = (training.score(rows, m).orderBy("id").toPandas() for m in (model, again))
    assert first.equals(second) and first.predicted_class.tolist() == first.label.tolist()
    assert set(first.columns) == {"id", *FEATURES, "label", "risk", "confidence", "predicted_class", "recommended_action"}
    ranked = training.importances(again, spark, top=99).toPandas()
    assert len(ranked) == len(FEATURES) and ranked.importance.is_monotonic_decreasing and ranked.importance.sum() == pytest.approx(1.0)


def test_cut_points_are_quantiles_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "LOT_ROWS", 3000)
    rows = spark.range(0, 40_000, 1, 3).select((F.col("id") * 7919 % 40_009).alias("spread"), (F.col("id") % 5).alias("few"), F.when(F.col("id") % 10 < 8, 0.0).otherwise(F.col("id")).alias("tied"))
    spread, few, tied = forest.cut_points(rows, ["spread", "few", "tied"])
    assert few.tolist() == [0, 1, 2, 3, 4] and len(spread) == forest.BINS - 1 and tied[0] == 0.0 and 6 <= len(tied) <= 8
    whole = np.sort(np.arange(40_000) * 7919 % 40_009)
    ranks = np.searchsorted(whole, spread) / 40_000
    assert np.abs(ranks - np.arange(1, forest.BINS) / forest.BINS).max() < 2 / forest.QUANTILES


def test_missing_features_are_an_error(spark, monkeypatch):
    model, _ = fitted(noisy(spark), monkeypatch, trees=2)
    for value in (None, float("nan")):
        row = spark.createDataFrame([(1.0, 2.0, value, 1.0, 1.0, 1.0)], ", ".join(f"{n} double" for n in [*NAMES, "few"]))
        with pytest.raises(Exception, match="a feature is"):
            row.select(model.probabilities(spark)).collect()


def test_queries_of_the_binned_forest_equal_sql(spark, data, monkeypatch):
    """j1, f7, j2 and the stream of j3 with the forest that many rows get."""
    monkeypatch.setattr(training, "BINNED_ROWS", 100)
    monkeypatch.setattr(streams, "_MODELS", {})
    duck = compare.connect(data)
    for name in ("j1_forest_report", "f7_feature_importances", "j2_saved_model_scores", "j3_stream_scores"):
        got = compare.spark_rows(entry.queries()[name](spark, data))
        assert compare.difference(got, compare.sql_rows(duck, entry.oracle_sql()[name])) is None
    (path, _), = streams._MODELS.values()
    assert isinstance(training.load_model(path, spark)[0], training.Forest)
    scored = streams._scored(spark, data).toPandas()
    rows = entry.queries()["j2_saved_model_classes"](spark, data).toPandas().set_index("predicted_class")
    assert rows.n.to_dict() == scored.predicted_class.value_counts().to_dict()
    assert rows.mean_risk.to_dict() == pytest.approx(scored.groupby("predicted_class").risk.mean().to_dict())


def test_scoring_sends_no_trees_with_its_stages(spark, monkeypatch):
    """The forest goes to the executors as a broadcast, once for all batches."""
    rows = noisy(spark)
    model, _ = fitted(rows, monkeypatch, trees=3)
    assert rows.select(model.probabilities(spark).alias("p")).count() == 3000 and len(model.sent) == 1
    first = next(iter(model.sent.values()))
    got = rows.select("a", model.probabilities(spark).alias("p")).collect()
    assert next(iter(model.sent.values())) is first and all(sum(r.p) == pytest.approx(1.0) for r in got)
