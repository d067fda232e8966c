"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Each class is a Gaussian. Its covariance is shrunk towards the pooled one and towards a scaled identity, and
kept as a Cholesky factor, so that a score costs two triangular products. Means and covariances come from
sums over all labelled training rows: 1 + d + d*d numbers for each class, whatever the number of rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared

SYMBOLS, ENDS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@+]"), re.compile(r"[.!?][\"')\]]*$")
FEATURES = (
    "words", "word_length", "long_words", "symbols", "marks", "upper", "digits", "distinct", "same_next", "top_word",
    "repeated_pairs", "repeated_lines", "open_lines", "bare_words", "line_words",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics, in the order of FEATURES; shares go through a logit that small counts soften."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    letters = sum(map(str.isalpha, text)) if chars < 64 else _letters(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    logit = lambda k, of: float(np.log((k + 0.5) / (max(of, k) - k + 0.5 + 0.02 * of)))
    return [
        float(np.log1p(n)),
        float(np.log((chars + 5) / (n + 1))),
        logit(sum(len(x) > 25 for x in count), len(count)),
        logit(len(SYMBOLS.findall(text)), chars),
        logit(text.count("!") + text.count("?"), chars),
        logit(_upper(text), letters),
        logit(_digits(text), chars),
        logit(len(count), n),
        logit(sum(a == b for a, b in zip(words, words[1:])), n),
        logit(max(count.values(), default=0), n),
        logit(sum(v for v in pairs.values() if v > 1), n),
        logit(len(lines) - len(set(lines)), len(lines)),
        logit(sum(ENDS.search(x) is None for x in lines), len(lines)),
        logit(sum(v for w, v in count.items() if not any(map(str.isalnum, w))), n),
        float(np.log1p(n / (len(lines) + 1))),
    ]


def _letters(text: str) -> int:
    return len(LETTERS.sub("", text))


LETTERS, UPPER, DIGITS = re.compile(r"[\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")


def _upper(text: str) -> int:
    return len(UPPER.findall(text))


def _digits(text: str) -> int:
    return len(DIGITS.findall(text))


@dataclass(frozen=True)
class Model:
    """Standardisation, and of each class its mean, the Cholesky factor of its covariance and its log weight."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1, from the difference of the log densities."""
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, weight in zip(self.means, self.factors, self.weights):
            d = forward(factor, (z - mean).T)
            logs.append(weight - 0.5 * (d * d).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """factor @ x = b for a lower triangular factor."""
    x = np.empty_like(b)
    for i in range(len(factor)):
        x[i] = (b[i] - factor[i, :i] @ x[:i]) / factor[i, i]
    return x


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = 0.5, ridge: float = 0.01) -> Model | float:
    """From each class's count, sums (2, d) and sums of products (2, d, d). A class without rows: a constant.

    pooled: share of the pooled covariance in a class's; ridge: share of the scaled identity after that.
    """
    if not n.all():
        return 0.5 if not n.any() else float(n[1] > 0)
    centre = sums.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / n.sum() - centre**2, 1e-12))
    means = (sums / n[:, None] - centre) / scale
    cov = np.array([(q / k - np.outer(s / k, s / k)) / np.outer(scale, scale) for k, s, q in zip(n, sums, squares)])
    common, d = (cov * n[:, None, None]).sum(axis=0) / n.sum(), len(centre)
    factors = []
    for c in cov:
        c = (1 - pooled) * c + pooled * common
        factors.append(np.linalg.cholesky((1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-6) * np.eye(d)))
    return Model(centre, scale, means, np.array(factors), np.log(n / n.sum()))


def features(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, held_out, x of every row, as a written table. Null and empty texts have statistics too."""

    def get(batches):
        for batch in batches:
            for part in shared.slices(batch, "text"):
                x = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])

    rows = shared.spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (shared.id_remainder("doc_id", 5) == 0).alias("held_out"))
    return shared.written(rows.mapInArrow(shared.tidy(get), "doc_id long, held_out boolean, x array<double>"), spark, "features")


def train(rows: DataFrame, labels: DataFrame) -> Model | float:
    """From all rows (doc_id, x) that `labels` (doc_id, quality 0 or 1; others are left out) marks.

    A doc_id with several rows or labels counts once for each pair.
    """
    d = len(FEATURES)

    def get(batches):
        n, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x, y = np.array(batch.column(0).flatten()).reshape(-1, d), batch.column(1).to_numpy()
            for c in (0, 1):
                z = x[y == c]
                n[c] += len(z)
                sums[c] += z.sum(axis=0)
                squares[c] += z.T @ z
        v = np.concatenate([n, sums.reshape(-1), squares.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["i", "v"])

    marks = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    got = rows.join(marks, "doc_id").select("x", "y").mapInArrow(shared.tidy(get), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 + 2 * d + 2 * d * d)
    for r in got:
        v[r.i] = r.v
    return fit(v[:2], v[2 : 2 + 2 * d].reshape(2, d), v[2 + 2 * d :].reshape(2, d, d))


def score(rows: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """rows (doc_id, held_out, x) to doc_id, held_out, score, predicted."""
    d = len(FEATURES)

    def get(batches):
        for batch in batches:
            x = np.array(batch.column(2).flatten()).reshape(-1, d)
            s = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(shared.tidy(get), "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every row of `documents`, learnt from the labelled rows that aren't held out."""
    rows = features(shared.table(spark, sf_dir, "documents"), spark)
    return score(rows, train(rows.where("not held_out"), shared.table(spark, sf_dir, "labels")))
