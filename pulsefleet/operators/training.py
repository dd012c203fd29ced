"""Risk model: class-balanced random forest on window features, metadata, scoring, importances."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators import forest
from pulsefleet.operators.forest import Forest
from pulsefleet.operators.windows import FEATURES

# Fixed values of the model contract.
CONTRACT = "ai_reliability_v2"
TREES, DEPTH, MIN_LEAF, SEED = 420, 12, 2, 42

#: Rows of a task of the fit, at least. All statistics of a pass are sent once per task, while forests of few tasks fill the slots side by side.
TASK_ROWS = 500_000
#: Rows up to which all trees are one forest, and the least trees of one of several.
ONE_FOREST_ROWS, LEAST_TREES = 20_000, 20
#: Most trees that are fit at once over more rows: all open nodes of a level then fit one pass, and a pass keeps the places of these trees only.
MOST_TREES = 40
#: Rows above which the forest is grown from binned rows (``operators/forest.py``): Spark's fit sends the counts of all open nodes from each task.
BINNED_ROWS = 40_000
#: Stages of a model that are saved or loaded at once.
FILES_AT_ONCE = 4


def label_id(label) -> F.Column:
    return S.by_value(S.col(label), {name: float(i) for i, name in enumerate(S.LABELS)}, -1.0)


def class_weights(rows: DataFrame, label: str = "label") -> dict[str, float]:
    """Weight n / (classes * class rows), so that classes count the same. There are four labels."""
    counts = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {name: total / (len(counts) * n) for name, n in counts.items()}


def with_class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.withColumn("weight", S.by_value(F.col(label), class_weights(rows, label), 1.0))


def fit_tasks(rows: DataFrame) -> int:
    """Tasks of a fit. Each sends the statistics of all open nodes of its trees in every pass, so tasks must not be small, nor more than run at once."""
    return max(1, min(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism))


def tree_shares(rows: int, tasks: int, slots: int, trees: int) -> list[int]:
    """Trees of the forests that are fit side by side: as many forests of ``tasks`` tasks as fill the slots."""
    forests = 1 if rows <= ONE_FOREST_ROWS else max(1, min(-(-slots // tasks), trees // LEAST_TREES))
    return [trees // forests + (i < trees % forests) for i in range(forests)]


def split_shares(rows: int, shares: Sequence[int]) -> list[int]:
    """The shares cut into forests of at most ``MOST_TREES``, so that many trees over many rows are fit in turns."""
    if rows <= ONE_FOREST_ROWS:
        return list(shares)
    turns = -(-max(shares) // MOST_TREES)
    return [share // turns + (i < share % turns) for i in range(turns) for share in shares]


def train_forest(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = "label",
    trees: int = TREES,
    depth: int = DEPTH,
    min_leaf: int = MIN_LEAF,
    seed: int = SEED,
) -> PipelineModel | Forest:
    # Each fit passes over its input several times; windows are dearer than their stored features, and these than one vector.
    plain = rows.select(*features, label).persist()
    try:
        if plain.count() <= BINNED_ROWS:
            return _spark_forest(plain, features, label, trees, depth, min_leaf, seed)
        ids = {name: float(i) for i, name in enumerate(S.LABELS)}
        weights = {int(ids.get(name, -1)): weight for name, weight in class_weights(plain, label).items()}
        return forest.train(plain, features, label_id(label), weights, trees, depth, min_leaf, seed)
    finally:
        plain.unpersist()


def _spark_forest(rows: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, min_leaf: int, seed: int) -> PipelineModel:
    """The forest of Spark's library."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    kept = assembler.transform(rows).select("features", label).persist()
    tasks, n = fit_tasks(kept), kept.count()
    shares = tree_shares(n, tasks, rows.sparkSession.sparkContext.defaultParallelism, trees)
    forests = split_shares(n, shares)
    assembled = with_class_weights(kept, label).select("features", label_id(label).alias("label_id"), "weight").coalesce(tasks)
    names = [{}] if len(forests) == 1 else [{"rawPredictionCol": f"raw{i}", "probabilityCol": "", "predictionCol": ""} for i in range(len(forests))]

    def fit(i: int):
        forest = RandomForestClassifier(
            featuresCol="features", labelCol="label_id", weightCol="weight", numTrees=forests[i], maxDepth=depth,
            minInstancesPerNode=min_leaf, seed=seed + i, cacheNodeIds=True, **names[i],
        )
        return forest.fit(assembled)

    # Trees do not know of each other. Fits of few tasks side by side send fewer statistics than one whose tasks fill all slots.
    try:
        with ThreadPoolExecutor(len(shares)) as pool:
            return PipelineModel([assembler, *pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(len(forests)))])
    finally:
        kept.unpersist()


def score(rows: DataFrame, model: PipelineModel | Forest) -> DataFrame:
    """Rows with risk, confidence, class and action. All trees of all forests of the model vote alike."""
    if isinstance(model, Forest):
        shares = rows.withColumn("__p", model.probabilities(rows.sparkSession))
        return shares.withColumns(S.prediction_payload(_by_label(model.classes))).drop("__p")
    scored, forests = model.transform(rows), model.stages[1:]
    classes = forests[0].numClasses
    if len(forests) == 1:
        scored = scored.withColumn("__p", vector_to_array("probability"))
    else:
        votes = [vector_to_array(forest.getRawPredictionCol()) for forest in forests]
        summed = [sum((F.get(v, i) for v in votes), F.lit(0.0)) for i in range(classes)]
        scored = scored.withColumn("__p", F.transform(F.array(*summed), lambda x: x / sum(forest.getNumTrees for forest in forests)))
    out = scored.withColumns(S.prediction_payload(_by_label(classes)))
    return out.drop("__p", "features", "probability", "prediction", *[forest.getRawPredictionCol() for forest in forests])


def _by_label(classes: int) -> dict[str, F.Column]:
    return {name: F.get("__p", i) for i, name in enumerate(S.LABELS) if i < classes}


def importances(model: PipelineModel | Forest, spark: SparkSession, features: Sequence[str] = FEATURES, top: int = 12) -> DataFrame:
    """The most important features; the model has one number per feature, the mean over its trees."""
    if isinstance(model, Forest):
        values = model.importances.tolist()
    else:
        forests = model.stages[1:]
        trees = sum(stage.getNumTrees for stage in forests)
        values = sum(stage.featureImportances.toArray() * (stage.getNumTrees / trees) for stage in forests).tolist()
    frame = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature").limit(top)


def _stages(spark: SparkSession, path: str, of, stages: Sequence) -> list:
    """``of(stage, folder)`` for each stage; a forest's trees are one job of few tasks, so several go side by side."""
    folders = [f"{path}/model/{i}" for i in range(len(stages))]
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(of), stages, folders))


def save_model(model: PipelineModel | Forest, path: str, spark: SparkSession, baseline: Mapping[str, float], extra: Mapping[str, object] | None = None) -> None:
    """The model and, beside it, the metadata that scoring reads (baseline, thresholds, readiness)."""
    if isinstance(model, Forest):
        spark.createDataFrame(model.table()).write.mode("overwrite").parquet(f"{path}/model")
        kind = {"forest": model.meta()}
    else:
        _stages(spark, path, lambda stage, folder: stage.write().overwrite().save(folder), model.stages)
        kind = {"stages": len(model.stages)}
    meta = {"contract": CONTRACT, "features": list(FEATURES), "labels": list(S.LABELS), "baseline": dict(baseline), **kind, **(extra or {})}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel | Forest, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if "forest" in meta:
        return Forest.of_table(spark.read.parquet(f"{path}/model").toArrow(), meta["forest"]), meta
    kinds = [VectorAssembler, *[RandomForestClassificationModel] * (meta["stages"] - 1)]
    return PipelineModel(_stages(spark, path, lambda kind, folder: kind.load(folder), kinds)), meta


def model_version(path: str, spark: SparkSession) -> str:
    """Changes whenever ``save_model`` has written to ``path``: the metadata is the last that it writes."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getModificationTime()}" for f in files))
