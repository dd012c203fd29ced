"""Language identification: averaged hashed subword embeddings with a linear softmax.

The features of a text are its words and the byte n-grams of each word between marks for start and end,
hashed to a fixed number of rows of an embedding table. A text is the mean of its rows, and a linear
softmax over the mean gives the languages. Table and softmax are trained in numpy by stochastic gradient
descent on a bounded sample of labelled texts (``sample_rows``, spread evenly over the languages). A part
of the sample is kept aside to calibrate: a temperature for the probabilities, and the probability below
which a text is rejected. For that, noise is made of each text kept aside: its letters shuffled, or its letters
exchanged for those of another script.

Prediction covers every whole text: as the model is linear in the mean, each row of the table is reduced
to one score per language once, and each distinct word of a batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.llm.common import Words, packed, release, slices, split_words, stored
from pulsefleet.llm.tokenizer import ragged

UNKNOWN = "und"

#: Times the quota that is looked at to find the rows with the smallest orders.
SPARE = 4

#: Words are runs of a-z and bytes above 0x7F (texts are in lower case by then).
_BREAKS = ~((np.arange(256) >= 0x80) | ((np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))))


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dimensions: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    sample_rows: int = 2000  # bound on the labelled texts that the model is fit on
    calibration_share: float = 0.25
    epochs: int = 12
    rate: float = 1.0
    seed: int = 7
    most_lost: float = 0.002  # share of calibration texts that may be rejected
    least_caught: float = 0.95  # share of noise texts that the threshold is to be above, where most_lost allows it


# -- features ------------------------------------------------------------------------------------


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def subwords(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for words given as bytes and offsets: word of each row, row."""
    sizes = np.diff(offsets) + 2
    ends = np.cumsum(sizes)
    marked = np.full(int(ends[-1]) if len(ends) else 0, ord("<"), dtype=np.uint64)
    starts = ends - sizes
    marked[ragged(starts + 1, sizes - 2)] = data
    marked[ends - 1] = ord(">")
    words, rows = [], []
    for n in settings.grams:
        count = np.maximum(sizes - n + 1, 0)
        at = ragged(starts, count)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + marked[at + k] + np.uint64(1)
        words.append(np.repeat(np.arange(len(sizes)), count))
        rows.append(_mixed(h, settings.buckets))
    # The whole word: a sum of its bytes times powers of an odd number.
    powers = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 0, 0x9E3779B97F4A7C15, dtype=np.uint64))
    if len(sizes):
        inside = np.arange(len(marked)) - np.repeat(starts, sizes)
        whole = np.add.reduceat(marked * powers[inside], starts)
        words.append(np.arange(len(sizes)))
        rows.append(_mixed(whole, settings.buckets))
    return np.concatenate(words), np.concatenate(rows)


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the distinct words, and each word's place among them."""
    distinct, codes = words.encoded()
    _, offsets, data = distinct.buffers()
    offsets = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], codes


# -- training ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Scores per table row and language, the bias, the temperature and the rejection threshold."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of the best language of each text (ties: the first) and its probability; -1 without words."""
        words = split_words(texts, _BREAKS)
        best, sure = np.full(len(texts), -1), np.zeros(len(texts))
        if not len(words) or not self.languages:
            return best, sure
        data, offsets, codes = _distinct(words)
        word, row = subwords(data, offsets, self.settings)
        per_word = np.stack([np.bincount(word, self.scores[row, k], len(offsets) - 1) for k in range(len(self.languages))], axis=1)
        rows = np.bincount(word, minlength=len(offsets) - 1)
        full = np.flatnonzero(np.diff(words.first))
        starts = words.first[full]
        sums = np.stack([np.add.reduceat(per_word[codes, k], starts) for k in range(len(self.languages))], axis=1)
        logits = sums / np.add.reduceat(rows[codes], starts)[:, None] + self.bias
        chances = _softmax(logits / self.temperature)
        best[full] = chances.argmax(axis=1)
        sure[full] = chances.max(axis=1)
        return best, sure


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sgd(rows: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, classes: int, settings: Settings):
    """Embedding table, softmax weights and bias; one step per text, at a rate that falls to zero."""
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1, 1, (settings.buckets, settings.dimensions)) / settings.dimensions
    softmax, bias = np.zeros((settings.dimensions, classes)), np.zeros(classes)
    steps, done = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            rate = settings.rate * (1 - done / steps)
            done += 1
            mean = weights[i] @ table[rows[i]]
            slope = _softmax(mean @ softmax + bias)
            slope[labels[i]] -= 1
            # The mean spreads a step over many rows; each row takes the step in proportion to its weight.
            pull = softmax @ slope
            softmax -= rate * np.outer(mean, slope)
            bias -= 0.1 * rate * slope
            table[rows[i]] -= rate * (weights[i] / weights[i].max())[:, None] * pull
    return table, softmax, bias


def _temperature(logits: np.ndarray, labels: np.ndarray, noise: np.ndarray) -> float:
    """The temperature, from a grid, with the least log loss: of their labels for texts, of all languages alike for noise."""
    grid = np.geomspace(0.05, 50, 141)

    def loss(t: float) -> float:
        clean = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean()
        return clean - (np.log(np.maximum(_softmax(noise / t), 1e-300)).mean() if len(noise) else 0.0)

    return float(grid[int(np.argmin([loss(t) for t in grid]))])


#: Characters of a noise text; shuffled letters have a new feature with nearly every one.
NOISE = 1000

#: Letters of another script for a-z.
_OTHER = str.maketrans({chr(97 + k): chr(0x561 + k) for k in range(26)})


def _noise(text: str, seed: int) -> list[str]:
    """The text's first NOISE characters in lower case with their letters shuffled, and in another script."""
    text = text[:NOISE]
    chars = np.array(list(text.lower()))
    letters = np.flatnonzero([c.isalpha() for c in chars.tolist()])
    chars[letters] = chars[np.random.default_rng(seed).permutation(letters)]
    return ["".join(chars.tolist()), text.lower().translate(_OTHER)]


def _threshold(clean: np.ndarray, noise: np.ndarray, settings: Settings) -> float:
    """From the ascending scores of clean texts and of noise: between the two, but never above what ``most_lost`` allows."""
    most = float(clean[int(settings.most_lost * len(clean))])
    if not len(noise):
        return most
    caught = float(noise[min(len(noise) - 1, int(settings.least_caught * len(noise)))])
    return (caught + most) / 2 if caught < most else most


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a sample of ``labelled`` (text, lang, order: a long spread evenly that picks the sample).

    Rows with a null text or lang are left out. Without any row the model knows no language. Every value of
    lang is learnt, from one text at least: with more than ``sample_rows`` values the sample has a text of each.
    """
    labelled = labelled.where("text is not null and lang is not null")
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy("lang").collect()
    languages = [row["lang"] for row in known]
    if not languages:
        return Model([], np.zeros((settings.buckets, 0)), np.zeros(0), 1.0, 0.0, settings)
    quota = max(1, settings.sample_rows // len(languages))
    # About SPARE times the quota of each language passes by its order; the smallest of them are the sample.
    limits = [(r["lang"], int(min(1.0, SPARE * quota / r["rows"]) * (2**64 - 2**12)) - 2**63) for r in known]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, most long"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    few = labelled.join(limits, "lang").where((F.col("order") <= F.col("most")) | (F.col("most") > 2**62))
    sample = few.withColumn("nth", nth).where(F.col("nth") <= quota)
    schema = "lang string, nth int, noise boolean, rows binary, weights binary"
    # By rank in the language, so that both parts hold all languages.
    every = max(2, round(1 / settings.calibration_share))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                made = [(i, _noise(piece.column("text")[i].as_py(), settings.seed + n)[n // every % 2]) for i, n in enumerate(piece.column("nth").to_pylist()) if n % every == 0]
                at = pa.array([*range(piece.num_rows), *(i for i, _ in made)])
                words = split_words(pa.concat_arrays([piece.column("text"), pa.array([t for _, t in made], piece.column("text").type)]), _BREAKS)
                out = []
                for low, high in zip(words.first.tolist(), words.first[1:].tolist()):
                    ends = words.offsets[low : high + 1]
                    _, row = subwords(words.data[ends[0] : ends[-1]], ends - ends[0], settings) if high > low else (None, np.zeros(0, np.int64))
                    met, count = np.unique(row, return_counts=True)
                    out.append((met.astype("<u4").tobytes(), (count / max(1, count.sum())).astype("<f4").tobytes()))
                noisy = pa.array([i >= piece.num_rows for i in range(len(at))])
                listed = [piece.column("lang").take(at), piece.column("nth").take(at), noisy, *(pa.array(c, pa.binary()) for c in zip(*out))]
                yield pa.RecordBatch.from_arrays(listed, names=["lang", "nth", "noise", "rows", "weights"])

    got = sample.select("lang", "nth", "text").mapInArrow(features, schema).toArrow()
    order = pc.sort_indices(got.select(["noise", "nth", "lang"]), [("noise", "ascending"), ("nth", "ascending"), ("lang", "ascending")]).to_pylist()
    features_of, weights_of = got.column("rows"), got.column("weights")
    order = [i for i in order if len(features_of[i].as_buffer())]
    heads = got.select(["noise", "nth", "lang"]).take(order)
    place = {name: k for k, name in enumerate(languages)}
    # Views of the collected bytes: the sample is in the driver's memory once.
    rows = [np.frombuffer(features_of[i].as_buffer(), "<u4") for i in order]
    weights = [np.frombuffer(weights_of[i].as_buffer(), "<f4") for i in order]
    noisy = heads.column("noise").to_numpy()
    noise, clean_rows = np.flatnonzero(noisy), int((~noisy).sum())
    labels = np.array([place[name] for name in heads.column("lang").to_pylist()[:clean_rows]], dtype=np.int64)
    aside = heads.column("nth").to_numpy()[:clean_rows] % every == 0
    learn = np.flatnonzero(~aside)
    table, softmax, bias = _sgd([rows[i] for i in learn], [weights[i] for i in learn], labels[learn], len(languages), settings)
    scores = table @ softmax
    check = np.flatnonzero(aside)
    temperature, threshold = 1.0, 0.0
    if len(check):
        logits = lambda at: np.array([weights[i] @ scores[rows[i]] + bias for i in at]).reshape(-1, len(languages))
        clean, odd = logits(check), logits(noise)
        temperature = _temperature(clean, labels[check], odd)
        sure = lambda values: np.sort(_softmax(values / temperature).max(axis=1))
        threshold = _threshold(sure(clean), sure(odd), settings)
    del got, features_of, weights_of, rows, weights
    pa.default_memory_pool().release_unused()
    release(labelled.sparkSession)
    return Model(languages, scores, bias, temperature, threshold, settings)


# -- prediction ------------------------------------------------------------------------------------


def predicted(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score. ``und`` with score 0: the text is null or has no letter.

    A letter is any character of Unicode's general category L.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    rows = docs.select(*keep, F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "__text"):
                best, sure = model.predict(piece.column("__text"))
                known = piece.column("__letters").to_numpy(zero_copy_only=False) & (best >= 0)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in keep], pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, sure, 0.0))],
                    names=schema.names,
                )

    return rows.mapInArrow(of, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    learnt = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return learnt.select("text", "lang", F.xxhash64("doc_id").alias("order"))


def identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score.

    Null and empty texts and texts without letters are ``und``; so is everything if no row has a label.
    Rows with a null doc_id are predicted but not learnt from. Repeated rows are returned each. Other
    columns of ``docs`` are not read.
    """
    model = train(_labelled(docs), settings)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(rows, model, ["doc_id", "held_out"])


def in_known_language(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that the model rejects: no letters, or a probability below its threshold."""
    model = train(_labelled(docs), settings)
    if not model.languages:
        return docs
    rows = packed(docs)
    judged = predicted(rows.select("key", F.col("row.text").alias("text")), model, ["key"])
    lost = stored(judged.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.threshold)).select("key").distinct())
    return rows.join(lost, "key", "left_anti").select("row.*")
