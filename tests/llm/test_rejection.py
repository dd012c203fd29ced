"""Rejection by the language identifier: noise and unlearnt scripts go, texts of the learnt languages stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsefleet.llm import langid


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def noise_rows(first):
    rng = np.random.default_rng(5)
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    ]
    made = [" ".join("".join(rng.choice(list("qxzjvkwypg"), rng.integers(3, 9))) for _ in range(60)) for _ in range(20)]
    return [(first + i, text, "en", "src1", len(text)) for i, text in enumerate(strange + made)]


def test_noise_goes_and_clean_texts_stay(spark, documents):
    noise = spark.createDataFrame(noise_rows(10**6), documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    # Noise is no label to learn from: its lang is null.
    both = documents.select(*noise.columns).union(noise.withColumn("lang", F.lit(None).cast("string")))
    kept = langid.in_known_language(both)
    lettered = documents.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.where("doc_id >= 1000000").count() == 0
    assert kept.where("doc_id < 1000000").count() >= 0.99 * lettered


def test_threshold_is_between_noise_and_clean_texts_and_spares_clean_ones():
    own = langid.Settings(most_lost=0.0, least_caught=0.5)
    assert langid._threshold(np.array([0.8, 0.9]), np.array([0.2, 0.4, 0.5]), own) == pytest.approx(0.6)
    assert langid._threshold(np.array([0.3, 0.9]), np.array([0.6, 0.7]), own) == 0.3
    assert langid._threshold(np.array([0.97, 0.99]), np.zeros(0), own) == 0.97


def test_every_language_is_learnt_however_many_there_are(spark):
    rows = [(f"{c * 4} {c * 5} {c * 3}", f"l{c}", k) for k, c in enumerate("abcdefghij")] * 2
    model = langid.train(spark.createDataFrame(rows, 'text string, lang string, `order` long'), langid.Settings(sample_rows=4, epochs=2))
    assert model.languages == [f"l{c}" for c in "abcdefghij"]
