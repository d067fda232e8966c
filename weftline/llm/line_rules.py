"""Quality rules over lines: a linear-chain conditional random field marks each line as content or boilerplate.

The field has a weight vector for the lines' features and weights for the first state and each change of
state. It is fitted by gradient ascent on sequences of lines: a fixed small set, and labelled documents up to
a bound. In a document of quality 0 all lines count as boilerplate, in others those that repeat an earlier
line, since documents are labelled and lines are not. Viterbi decoding labels a document's lines; the share of its words in content lines decides.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER, LETTER, DIGIT, ENDS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]"), re.compile(r"[0-9]"), re.compile(r"[.!?:;,][\"')\]]*\s*$")
N_FEATURES = 12

#: Short documents as lines with marks: 1 content, 0 boilerplate.
SEQUENCES = (
    (("Home | News | Sport | Weather | Contact", 0), ("The council met on Tuesday to discuss the new bridge over the river.", 1), ("Residents said that the plan would bring more traffic to the old town.", 1), ("A second meeting is expected in the spring.", 1), ("Share this page", 0), ("Copyright 2020 All rights reserved", 0)),
    (("BUY NOW!!! BEST PRICE!!! FREE!!! FREE!!!", 0), ("CLICK HERE >>> $$$ >>> CLICK HERE", 0), ("BUY NOW!!! BEST PRICE!!! FREE!!! FREE!!!", 0)),
    (("She opened the window and looked down at the quiet street.", 1), ("Nobody had come that way since the morning, and the snow lay untouched.", 1), ("He would not be back before dark.", 1)),
    (("### *** %%% &&& ###", 0), ("login * register * cart * help * login", 0), ("tag tag tag tag tag tag tag tag", 0)),
    (("Heat the oil in a wide pan and fry the onions until they are soft.", 1), ("Add the rice, stir for a minute, and pour in the stock.", 1), ("Print | Email | Save", 0), ("Serve at once.", 1)),
)


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    seen, dup = set(), 0
    for x in text.split("\n"):
        if x.strip(BLANKS):
            dup += x in seen
            seen.add(x)
    windows = list(zip(words, words[1:], words[2:]))
    count, again, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            again += i + 3 - max(i, upto)
            upto = i + 3
    return n, chars, len(SYMBOLS.findall(text)), dup, again


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def line_features(lines: list[str]) -> np.ndarray:
    """A row for each line that has a word."""
    out, seen = [], set()
    for x in lines:
        words = x.split()
        if not words:
            continue
        n, chars = len(words), len(x)
        letters = len(LETTER.findall(x))
        pairs = sum(a == b for a, b in zip(words, words[1:]))
        out.append(
            (
                1.0,
                np.log1p(n),
                len(SYMBOLS.findall(x)) / chars * 10,
                (x.count("!") + x.count("?")) / n,
                len(UPPER.findall(x)) / max(letters, 1),
                len(DIGIT.findall(x)) / chars,
                len(set(words)) / n if n > 3 else 1.0,
                pairs / n * 4,
                sum(not any(map(str.isalnum, w)) for w in words) / n,
                0.0 if ENDS.search(x) else 1.0,
                letters / chars,
                1.0 if x in seen else 0.0,
            )
        )
        seen.add(x)
    return np.array(out, float).reshape(-1, N_FEATURES)


LINES = 1 << 18


class Field:
    """State 1 is content. w: weights of a line's features for it; start, change: of the first and adjacent states."""

    def __init__(self):
        self.w, self.start, self.change = np.zeros(N_FEATURES), np.zeros(2), np.zeros((2, 2))

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
        groups = []  # of like lengths, at most 256 documents and, but for a longer one alone, LINES lines when padded
        for i in order:
            if not groups or len(groups[-1]) == 256 or (len(groups[-1]) + 1) * len(xs[i]) > LINES:
                groups.append([])
            groups[-1].append(i)
        padded = []
        for g in groups:
            t = max(len(xs[i]) for i in g)
            x, y, on = np.zeros((len(g), t, N_FEATURES)), np.zeros((len(g), t), int), np.zeros((len(g), t), bool)
            for k, i in enumerate(g):
                x[k, : len(xs[i])], y[k, : len(xs[i])], on[k, : len(xs[i])] = xs[i], ys[i], True
            padded.append((x, y, on))
        total = max(1, sum(len(xs[i]) for i in order))
        theta, speed = np.zeros(N_FEATURES + 6), np.zeros(N_FEATURES + 6)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self._set(theta)
            grad = sum((self._gradient(*p) for p in padded), np.zeros_like(theta)) / total - decay * theta
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            speed = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            theta = theta + rate / (1 + step / 20) * speed
        self._set(theta)
        return self

    def _set(self, theta: np.ndarray) -> None:
        self.w, self.start, self.change = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 2], theta[N_FEATURES + 2 :].reshape(2, 2)

    def _unary(self, x: np.ndarray) -> np.ndarray:
        u = x @ self.w
        return np.stack([np.zeros_like(u), u], axis=-1)

    def _gradient(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Of the log likelihood: counts in the labels minus expected counts, by forward and backward sums."""
        n, t, _ = x.shape
        u, k = self._unary(x), np.arange(n)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = self.start + u[:, 0]
        for i in range(1, t):
            a[:, i] = np.where(on[:, i, None], np.logaddexp.reduce(a[:, i - 1, :, None] + self.change, axis=1) + u[:, i], a[:, i - 1])
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(on[:, i + 1, None], np.logaddexp.reduce(self.change + (u[:, i + 1] + b[:, i + 1])[:, None, :], axis=2), 0)
        p = np.exp(a + b - z[:, None, None]) * on[:, :, None]
        grad = np.zeros(N_FEATURES + 6)
        grad[:N_FEATURES] = np.einsum("nt,ntf->f", (y * on) - p[:, :, 1], x)
        grad[N_FEATURES : N_FEATURES + 2] = np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(axis=0)
        for i in range(1, t):
            both = on[:, i]
            if not both.any():
                break
            pair = np.exp(a[:, i - 1, :, None] + self.change + (u[:, i] + b[:, i])[:, None, :] - z[:, None, None])[both].sum(axis=0)
            true = np.bincount(2 * y[both, i - 1] + y[both, i], minlength=4).reshape(2, 2)
            grad[N_FEATURES + 2 :] += (true - pair).reshape(-1)
        return grad

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely states of a document's lines (Viterbi); of equal ones, content."""
        if not len(x):
            return np.zeros(0, int)
        u, (c00, c01, c10, c11) = (x @ self.w).tolist(), self.change.reshape(-1).tolist()
        s0, s1, back = float(self.start[0]), float(self.start[1]) + u[0], []
        for v in u[1:]:
            f0, f1 = s1 + c10 >= s0 + c00, s1 + c11 >= s0 + c01
            back.append((f0, f1))
            s0, s1 = (s1 + c10 if f0 else s0 + c00), (s1 + c11 if f1 else s0 + c01) + v
        state, out = int(s1 >= s0), []
        out.append(state)
        for f in reversed(back):
            state = int(f[state])
            out.append(state)
        return np.array(out[::-1])


def content_share(text: str | None, field: Field) -> float:
    """Of the words, those in lines marked as content; 0 without words."""
    lines = [x for x in (text or "").split("\n") if x.split()]
    sizes = np.array([len(x.split()) for x in lines], float)
    return float((sizes * field.decode(line_features(lines))).sum() / sizes.sum()) if lines else 0.0


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, most_docs: int = 2000, most_lines: int = 200_000) -> Field:
    """Fits on SEQUENCES and on labelled documents with all their lines: a sample bounded by most_docs documents and
    most_lines lines, in order of the hash of doc_id, those left out that would exceed the lines.

    Documents with crc32(doc_id) mod 5 of 0 are never used. A line's label is made from its document's, as no line has
    one of its own, so what the field learns is lines of good and of bad documents. Without labels, SEQUENCES alone serve.
    """
    marks = labels.where((F.col("quality").isin(0, 1)) & (shared.id_remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = docs.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "quality")

    def get(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.int64()), ("x", pa.binary())])
        for batch in batches:
            for doc, text, quality in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = line_features((text or "").split("\n"))
                if len(x):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "quality": quality, "lines": len(x), "x": x.astype(np.float32).tobytes()}], schema)

    order = ["doc_id", "lines", "quality"]
    found = shared.written(rows.mapInArrow(shared.tidy(get), "doc_id long, quality int, lines long, x binary"), spark, "line-features")
    chosen, room = [], most_lines
    for r in found.select(F.xxhash64("doc_id").alias("h"), *order).orderBy("h", *order).limit(most_docs).collect():
        if r.lines <= room:
            chosen.append((r.doc_id, r.lines))
            room -= r.lines
    ids = sorted({d for d, _ in chosen})
    got = found.where(F.col("doc_id").isin(ids)).orderBy(*order, "x").limit(len(chosen)).toArrow().to_pylist() if ids else []
    xs = [line_features([x for x, _ in s]) for s in SEQUENCES] + [np.frombuffer(r["x"], np.float32).astype(float).reshape(-1, N_FEATURES) for r in got]
    ys = [np.array([y for _, y in s]) for s in SEQUENCES] + [np.array(r["quality"] * (1 - x[:, -1]), int) for r, x in zip(got, xs[len(SEQUENCES) :])]
    return Field().fit(xs, ys)


def judge(docs: DataFrame, field: Field, share: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """The measures, base_failed and kept of every row; with all columns of docs, if keep_columns.

    Null and empty texts have no words and fail. Columns of docs that are named like a measure are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in (docs.columns if keep_columns else ["doc_id"]) if c not in (*new, "base_failed", "kept")]
    schema = docs.select(*kept)
    for c in new:
        schema = schema.withColumn(c, F.lit(0).cast("long"))
    schema = schema.withColumn("base_failed", F.lit(True)).withColumn("kept", F.lit(True)).schema

    def get(batches):
        for batch in batches:
            for part in shared.slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                m = [measures(t) for t in texts]
                failed = [base_failed(x[0], x[4]) for x in m]
                good = [not f and content_share(t, field) >= share for t, f in zip(texts, failed)]
                cols = [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array([x[k] for x in m], pa.int64()) for k in range(5)] + [pa.array(failed, pa.bool_()), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *new, "base_failed", "kept"])

    return shared.spread(docs).mapInArrow(shared.tidy(get), schema)


def op6_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' measures and verdict on every row of `documents`."""
    docs = shared.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge(docs, train(docs, shared.table(spark, sf_dir, "labels"), spark))
