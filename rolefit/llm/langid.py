"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. A text is lower-cased, everything but letters becomes one space, and its character 1- to 3-grams are hashed into BUCKETS.
2. Document frequencies are counted over every learning row (a vector of counts per task, added up in two steps).
3. The weights are fitted by follow-the-regularised-leader with elastic-net penalties on a sample of the learning rows whose
   expected size per language is bounded by `per_class`, a parameter; the sample is drawn by the hash of the id. One part
   of it is held back to calibrate the temperature of the softmax.
4. Weights (BUCKETS x languages, at most MAX_LANGUAGES) are broadcast and every text is scored as a whole in one map over the table.

The prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import char_table, code_points, mix64, text_slices

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The most languages a model may have; its weights are broadcast.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the text, ascending, and how often. Nothing for a text without letters."""
    points = code_points(text.lower())
    letters = char_table("isalpha")[points] if len(points) else np.zeros(0, bool)
    if not letters.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    points = np.where(letters, points, 32)
    kept = np.ones(len(points), bool)
    kept[1:] = letters[1:] | letters[:-1]
    points = np.concatenate(([32], points[kept], [32])).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    grams = np.zeros(len(points), np.uint64)
    for order in ORDERS:
        grams = grams[:len(points) - order + 1] + points[order - 1:] * _MULTIPLIERS[order - 1]
        total += np.bincount((mix64(grams + np.uint64(order)) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.int32)


def _weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[found]
    return values / max(1e-12, np.sqrt(values @ values))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        found, counts = ngram_counts(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax((_weigh(found, counts, self.idf) @ self.weights[found] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Documents that have letters, and of these those that have a bucket, over all rows of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for _, texts in text_slices(batches, "text"):
            for t in texts:
                found, _ = ngram_counts(t)
                df[found] += 1
                n += len(found) > 0
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()])], ["n", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                df += np.frombuffer(row["df"], np.int64)
                n += row["n"]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()])], ["n", "df"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "n long, df binary")
    some = parts.repartition(32).mapInArrow(add, "n long, df binary").collect()  # 32 vectors at most
    return sum(r.n for r in some), sum((np.frombuffer(r.df, np.int64) for r in some), np.zeros(BUCKETS, np.int64))


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """Rows drawn by the hash of their key so that each class has `per_class` rows to be expected, or all that it has; more than
    MAX_LANGUAGES classes are an error."""
    sizes = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels")
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(label) == r[label], F.lit(min(1.0, per_class / r["count"]))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30))


def sample_features(sample: DataFrame, label: str, key: str, text: str) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            pairs = [ngram_counts(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([a.tobytes() for a, _ in pairs], pa.binary()),
                 pa.array([c.tobytes() for _, c in pairs], pa.binary())], ["lang", "draw", "found", "counts"])

    rows = sample.select(F.col(label).alias("lang"), F.xxhash64(F.lit("draw"), key).alias("draw"), F.col(text).alias("text")).mapInArrow(
        step, "lang string, draw long, found binary, counts binary").collect()
    out = [(r.lang, r.draw, np.frombuffer(r.found, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows]
    return sorted((x for x in out if len(x[2])), key=lambda x: (x[1], x[0]))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0,
             l1: float = 0.02, l2: float = 0.02, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal, one step a row: rows are (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray, penalty: float) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - penalty, 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    for _ in range(passes):
        for found, values, label in rows:
            at = np.append(found, BUCKETS)  # the last bucket is the bias, without l1
            x = np.append(values, 1.0)
            w = weights(z[at], n[at], l1)
            w[-1] = weights(z[-1], n[-1], 0.0)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            squared = g * g
            z[at] += g - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * w
            n[at] += squared
    w = weights(z, n, l1)
    return w[:-1], weights(z[-1], n[-1], 0.0)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss: golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(scores / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(learn: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_class: int = 600) -> Model:
    """A model from the rows of `learn` that have a label. Without any such row it answers `und` always."""
    rows = learn.where(F.col(label).isNotNull())
    n, df = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = sample_features(bounded_sample(rows, label, key, per_class), label, key, text)
    languages = sorted({x[0] for x in sample})
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    data = [(found, _weigh(found, counts, idf), languages.index(lang)) for lang, _, found, counts in sample]
    held = data[::5] if len(data) >= 50 else data
    w, bias = fit_ftrl([x for i, x in enumerate(data) if i % 5] if len(data) >= 50 else data, len(languages))
    scores = np.array([v @ w[f] + bias for f, v, _ in held])
    return Model(languages, idf.astype(np.float32), w.astype(np.float32), bias, fit_temperature(scores, np.array([k for *_, k in held])))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (probability of the predicted language) for every row.

    A null text, an empty one and one without letters get `und` and score 0. Repeated rows stay repeated. Ties go to the
    language that comes first in the alphabet. Columns other than key and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, texts in text_slices(batches, "text"):
            found = [own.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        step, f"key {key_type}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: Model, accept: Callable[[str, float], bool], text: str = "text") -> DataFrame:
    """The rows whose language and score are accepted, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, texts in text_slices(batches, text):
            yield part.filter(pa.array([accept(*own.predict(t)) for t in texts], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)


