"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

1. One map over the table turns every whole text into FEATURES numbers (shares as logits, sizes as logarithms). They are
   written once, 8 bytes each, so that no text is read twice.
2. The moments of each class (count, sum, sum of outer products) are added up over all labelled learning rows, per task first.
3. Each class covariance is shrunk towards the pooled one and towards its own diagonal; its Cholesky factor and log determinant are
   cached in the model.
4. The score is the logistic of the difference of the two Mahalanobis log densities plus the log ratio of the class
   frequencies, divided by `scale`, which is fitted to least log loss on the learning rows: features are not independent
   given Gaussians, and plain differences would all end near 0 or 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import char_table, checkpointed, code_points, text_slices

FEATURES = ("length", "letters", "capitals", "marks", "blanks", "word_length", "word_spread", "vocabulary", "repeats", "top_word",
            "pairs", "stops", "bars", "line_length", "line_copies", "packed", "short_words")


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text; an empty one has those of zero counts."""
    points = code_points(text)
    n, words, lines = len(points), text.split(), text.split("\n")
    letters = int(char_table("isalpha")[points].sum())
    capitals = int(char_table("isupper")[points].sum())
    digits = int(char_table("isdigit")[points].sum())
    blanks = int(char_table("isspace")[points].sum())
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    k = len(words)
    counts = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    raw = text.encode("utf-8", "surrogatepass")
    return np.array([
        np.log1p(n), _logit(letters, n), _logit(min(capitals, letters), letters), _logit(max(0, n - letters - digits - blanks), n),
        _logit(blanks, n), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(len(counts)) - np.log1p(k), _logit(repeats, max(k - 1, repeats)),
        _logit(max(counts.values(), default=0), k), _logit(pairs, max(k - 1, pairs)), _logit(min(k, text.count(".")), k), _logit(min(k, text.count("|")), k),
        np.log1p(n / len(lines)), _logit(len(lines) - len(set(lines)), len(lines)), np.log((len(zlib.compress(raw, 1)) + 1) / (len(raw) + 16)),
        _logit(int((lengths <= 2).sum()) if words else 0, k)])


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and stats array<double> for every row."""
    key_type = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            flat = np.concatenate([statistics(t) for t in texts]) if texts else np.zeros(0)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "stats"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        step, f"key {key_type}, stats array<double>").withColumnRenamed("key", key)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class over all rows of (label, stats); one small row per task and class, then 16 at most."""
    d = len(FEATURES)

    def pack(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["label", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels, x = np.asarray(batch.column(0)), _rows(batch.column(1))
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in np.unique(labels):
                total[int(c)] = total.get(int(c), 0) + x[labels == c].T @ x[labels == c]
        yield pack(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total[row["label"]] = total.get(row["label"], 0) + np.frombuffer(row["sums"])
        yield pack(total)

    parts = labelled.select(F.col("label").cast("int").alias("label"), "stats").mapInArrow(count, "label int, sums binary")
    total: dict[int, np.ndarray] = {}
    for row in parts.repartition(16).mapInArrow(add, "label int, sums binary").collect():  # 16 tasks x 2 classes at most
        total[row.label] = total.get(row.label, 0) + np.frombuffer(row.sums).reshape(d + 1, d + 1)
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in total.items()}


@dataclass
class Discriminant:
    """Means, Cholesky factors and constants of the two classes; `only` is the answer where one class alone was seen."""
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    only: float | None = None
    scale: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the class frequencies."""
        density = [c - 0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0) for m, f, c in zip(self.means, self.factors, self.constants)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.scale, -500, 500)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, diagonal: float = 0.05,
                 ridge: float = 1e-3) -> Discriminant:
    """The model of the moments. With one class alone every score is that class; with none it is 0.5."""
    d = len(FEATURES)
    if len(moments.keys() & {0, 1}) < 2:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), only=float(next(iter(moments.keys() & {0, 1}), 0.5)))
    n = np.array([moments[c][0] for c in (0, 1)])
    means = np.array([moments[c][1] / moments[c][0] for c in (0, 1)])
    scatter = np.array([moments[c][2] - moments[c][0] * np.outer(means[c], means[c]) for c in (0, 1)])
    both = scatter.sum(axis=0) / n.sum()
    factors, constants = [], []
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / n[c] + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + ridge * np.eye(d)
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


#: Steps of the scale among which the one of least log loss is taken.
SCALES = tuple(2.0 ** k for k in range(0, 7))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> Discriminant:
    """A model from the statistics of the rows that `labels` (key, label 0 or 1) marks. Null labels do not count; a key with
    several labels counts once for each."""
    labelled = stats.join(labels.where(F.col("label").isin(0, 1)), key).select("label", "stats")
    model = discriminant(class_moments(labelled))
    if model.only is not None:
        return model
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SCALES))
        for batch in batches:
            sign = 2 * np.asarray(batch.column(0)).astype(float) - 1
            margin = shared.value.margin(_rows(batch.column(1))) * sign
            total += [np.logaddexp(0, -margin / s).sum() for s in SCALES]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SCALES)), pa.int32()), pa.array(total)], ["k", "loss"])

    loss = labelled.mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    model.scale = SCALES[min(loss, key=lambda r: (r.loss, r.k)).k]
    return model


def score(stats: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """key and score in 0 to 1 for every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    key_type = stats.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_rows(batch.column(1))))], ["key", "score"])

    return stats.select(F.col(key).alias("key"), "stats").mapInArrow(step, f"key {key_type}, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, learn: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score for every document.

    labels has key and label; only documents where `learn` holds are learnt from. A null text counts as empty and gets a
    score too. Repeated rows stay repeated. Other columns of either table are not read.
    """
    stats = checkpointed(statistics_table(docs, key, text))
    return score(stats, fit(stats.where(learn), labels.select(key, "label"), key), key)
