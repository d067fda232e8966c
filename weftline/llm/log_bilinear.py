"""Log-bilinear language model, trained with noise-contrastive estimation; normalised token log-probabilities.

Words with a count of a tenth of the root of all tokens or more are modelled, so the model grows with the corpus. A
prediction has two steps. Outputs of the first are the DIRECT most frequent words, classes of the other modelled words,
classes of all other words by their last letters, and the end; of the second, the words of a class. Modelled words that
end alike stand together, and runs of them, a third as many as each has words, are the classes. Vectors of the two tokens
before, weighted by place and summed, times an output's vector, plus its bias, are its score in either step, and a
softmax over the step's outputs normalises it: matrix products over batches, for the second step class by class.
A word inside a class by last letters has its count plus one over the class's counts, each plus one, plus one for a
word that was never seen; so probabilities of all words, known or not, sum to one.

Counts come from all training texts. Every partition trains on all its training texts from the same start, one pass in
small batches against words drawn from the unigram distribution, in the second step from the class's own. A task
hands on the vectors that it moved, and each vector is averaged over the tasks by how often they moved it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared

DIRECT, ENDINGS, CONTEXT, DIM = 32, 64, 2, 16
#: So many words are sent to every task with their counts, none longer than LONGEST bytes; others are joined.
FREQUENT, LONGEST = 300_000, 64
SIGNS = ".,!?;:%$#&*\"')(|"


def least_count(tokens: int) -> int:
    """From which count on a word is modelled."""
    return max(10, math.isqrt(tokens) // 10)


def endings(words: pa.Array) -> pa.Array:
    """The last two characters before closing signs."""
    return pc.utf8_slice_codeunits(pc.utf8_rtrim(words, characters=SIGNS), start=-2, stop=1 << 30)


@dataclass
class Vocabulary:
    """frequent: words by falling count; the first n_words of them are modelled, and number[i] is the i-th one's number.

    Modelled words are numbered by rank up to DIRECT and then class by class, `size` words a class. mass: of each class
    by last letters, counts plus one. top, own: the share of each output of the first step, and of each modelled word.
    """

    tokens: int
    kinds: int
    ends: int
    frequent: pa.Array
    counts: np.ndarray
    endings: pa.Array
    mass: np.ndarray
    seen: np.ndarray = field(default=None)
    n_words: int = 0
    direct: int = 0
    number: np.ndarray = field(default=None)
    size: int = 1
    top: np.ndarray = field(default=None)
    own: np.ndarray = field(default=None)

    def __post_init__(self):
        self.n_words = int((self.counts >= least_count(self.tokens)).sum())
        self.direct = min(DIRECT, self.n_words)
        order = list(range(self.direct))
        rest = self.frequent[self.direct : self.n_words].to_pylist()
        order += [self.direct + i for i in sorted(range(len(rest)), key=lambda i: rest[i].rstrip(SIGNS)[::-1])]
        self.number = np.empty(self.n_words, np.int64)
        self.number[order] = np.arange(self.n_words)
        self.size = max(1, math.ceil(math.sqrt(3 * len(rest))))  # the second step is taken by a third of the tokens
        n = np.zeros(self.n_words)
        n[self.number] = self.counts[: self.n_words]
        self.own = n + 0.5
        top = np.zeros(self.n_top)
        np.add.at(top, self.first_step(np.arange(self.n_words)), n)
        top[self.first_ending : self.end], top[self.end] = self.seen, self.ends
        self.top = (top + 0.5) / (top + 0.5).sum()

    @property
    def first_ending(self) -> int:
        return self.direct + -(-(self.n_words - self.direct) // self.size)

    @property
    def end(self) -> int:
        """The end's number among the outputs of the first step."""
        return self.first_ending + ENDINGS

    @property
    def n_top(self) -> int:
        return self.end + 1

    @property
    def n_inputs(self) -> int:
        """Modelled words, classes by last letters, and the end, which also stands before a text's first token."""
        return self.n_words + ENDINGS + 1

    def first_step(self, word: np.ndarray) -> np.ndarray:
        """The output of the first step of modelled words, given by number."""
        return np.where(word < self.direct, word, self.direct + (word - self.direct) // self.size)

    def inputs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words: the number among the inputs, and the place among the frequent ones or -1."""
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.frequent), -1)).astype(np.int64)
        kind = np.asarray(pc.fill_null(pc.index_in(endings(words), value_set=self.endings), ENDINGS - 1)).astype(np.int64)
        out = self.n_words + kind
        modelled = (at >= 0) & (at < self.n_words)
        out[modelled] = self.number[at[modelled]]
        return out, at

    def outputs(self, inputs: np.ndarray) -> np.ndarray:
        """The outputs of the first step of tokens, given by number among the inputs."""
        return np.where(inputs < self.n_words, self.first_step(inputs), inputs - self.n_words + self.first_ending)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and the texts' offsets."""
    flat, offsets = shared.split_words(texts)
    named = flat.dictionary_encode()
    return named.dictionary, np.asarray(named.indices, dtype=np.int64), offsets


def count_words(train: DataFrame, spark: SparkSession) -> DataFrame:
    """(word, n) over all texts, as a written table."""

    def counted(texts: list[pa.Array]) -> pa.RecordBatch:
        words, at, _ = tokens(pa.concat_arrays(texts))
        return pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    def get(batches):
        held, size = [], 0  # texts of 12 MB are counted at a time, so that fewer rows go back
        for batch in batches:
            for part in shared.slices(batch, "text"):
                held.append(part.column(part.schema.get_field_index("text")))
                size += held[-1].nbytes
                if size >= 12 << 20:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return shared.written(train.select("text").mapInArrow(shared.tidy(get), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), spark, "word-counts")


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    """The driver gets the frequent words and one number for each class by last letters, both bounded.

    Frequent words are those from a count on that at most FREQUENT words have; where more words than that tie at the
    highest counts, there are none from that count down.
    """
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the words whose count is above a bound, chosen by how many words have each count: no task sorts them all
    able, room, least = counts.where(F.octet_length("word") <= LONGEST), FREQUENT, 0
    for r in able.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(FREQUENT).collect():
        if r.k > room:
            least = r.n + 1
            break
        room -= r.k
    top = able.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    frequent, n = top["word"].combine_chunks().cast(pa.string()), top["n"].to_numpy()
    bound = max(least, least_count(words + n_texts))

    def get(batches):
        for batch in batches:
            w, n = batch.column(0), batch.column(1)
            rare = pc.or_(pc.less(n, bound), pc.greater(pc.binary_length(w), LONGEST))
            yield pa.RecordBatch.from_arrays([endings(w.filter(rare)), pc.add(n.filter(rare), 1), n.filter(rare)], names=["ending", "m", "n"])

    by_end = counts.mapInArrow(shared.tidy(get), "ending string, m long, n long").groupBy("ending").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    m_all, n_all = by_end.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    best = by_end.orderBy(F.desc("m"), "ending").limit(ENDINGS - 1).collect()
    mass, seen = np.ones(ENDINGS), np.zeros(ENDINGS)
    for k, r in enumerate(best):
        mass[k] += r.m
        seen[k] = r.n
    mass[-1] += m_all - sum(r.m for r in best)
    seen[-1] = n_all - sum(r.n for r in best)
    return Vocabulary(words + n_texts, kinds + (n_texts > 0), n_texts, frequent, n, pa.array([r.ending for r in best], pa.string()), mass, seen)


@dataclass
class Model:
    """before: vectors of inputs; place: weights of the context's places; top: of the first step's outputs, own: of the
    modelled words in their classes, each with its bias in the last column."""

    before: np.ndarray
    place: np.ndarray
    top: np.ndarray
    own: np.ndarray

    @classmethod
    def start(cls, v: Vocabulary, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda n, bias: np.hstack([rng.standard_normal((n, DIM)) * 0.1, bias[:, None]]).astype(np.float32)
        classes = v.first_step(np.arange(v.n_words))
        share = v.own / np.bincount(classes, v.own, v.n_top)[classes] if v.n_words else v.own
        return cls((rng.standard_normal((v.n_inputs, DIM)) * 0.1).astype(np.float32), np.ones((CONTEXT, DIM), np.float32), draw(v.n_top, np.log(v.top)), draw(v.n_words, np.log(share)))

    def parts(self) -> list[np.ndarray]:
        return [self.before, self.place, self.top, self.own]

    def context(self, c: np.ndarray) -> np.ndarray:
        """With a one at the end, for the bias."""
        h = np.ones((len(c), DIM + 1), np.float32)
        h[:, :DIM] = np.einsum("nkd,kd->nd", self.before[c], self.place)
        return h

    @staticmethod
    def chosen(h: np.ndarray, outputs: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Natural logs of a step's probabilities, of output cols[i] after the context rows[i]."""
        s = h @ outputs.T
        s -= s.max(axis=1, keepdims=True)
        got = s[rows, cols]
        np.exp(s, out=s)
        return got - np.log(s.sum(axis=1))[rows]


class Trainer:
    """Noise-contrastive estimation with AdaGrad; the first step's noise of a batch is shared by its tokens."""

    def __init__(self, model: Model, v: Vocabulary, noise: int = 32, own_noise: int = 4, rate: float = 0.3, seed: int = 0):
        self.m, self.v, self.noise, self.own_noise, self.rate, self.rng = model, v, noise, own_noise, rate, np.random.default_rng(seed)
        self.edges, self.log_kq = np.cumsum(v.top), np.log(noise * v.top).astype(np.float32)
        classes = v.first_step(np.arange(v.n_words))
        self.upto = np.concatenate([[0.0], np.cumsum(v.own)])
        starts = np.searchsorted(classes, np.arange(v.n_top + 1))  # numbers of words rise with their classes
        self.low, self.mass = self.upto[starts[:-1]], np.diff(self.upto[starts])
        self.own_log_kq = np.log(own_noise * v.own / self.mass[classes]).astype(np.float32) if v.n_words else np.zeros(0, np.float32)
        self.squares = [np.full_like(x, 1e-2) for x in model.parts()]
        self.moved = [np.zeros(len(x), np.int64) for x in model.parts()]
        self.kinds = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in model.parts()]  # short numbers sort faster

    def _move(self, k: int, at: np.ndarray, g: np.ndarray) -> None:
        """Adds to the rows `at` of part k what their gradients, summed by row, ask for."""
        at = at.astype(self.kinds[k])
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        rows = at[first]
        g = np.add.reduceat(g[order], first, axis=0)
        s = self.squares[k][rows] + g * g
        self.squares[k][rows] = s
        self.m.parts()[k][rows] += self.rate * g / np.sqrt(s)
        self.moved[k][rows] += np.diff(np.append(first, len(at)))

    def step(self, c: np.ndarray, word: np.ndarray, y: np.ndarray) -> None:
        """c: contexts; word, y: the tokens' numbers among the inputs and among the first step's outputs."""
        m, v, n = self.m, self.v, len(y)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(self.noise)), v.n_top - 1)
        vectors = m.before[c]
        h = np.ones((n, DIM + 1), np.float32)
        h[:, :DIM] = np.einsum("nkd,kd->nd", vectors, m.place)
        true_rows, noise_rows = m.top[y], m.top[drawn]
        true = 1 / (1 + np.exp(self.log_kq[y] - np.einsum("nd,nd->n", h, true_rows)))
        false = 1 / (1 + np.exp(self.log_kq[drawn] - h @ noise_rows.T))
        up = (1 - true)[:, None]
        dh = up * true_rows - false @ noise_rows
        moves = [(2, np.concatenate([y, drawn]), np.concatenate([up * h, -(false.T @ h)]))]
        inner = np.nonzero((y >= v.direct) & (y < v.first_ending))[0]
        if len(inner):
            k, hi, own = y[inner], h[inner], word[inner]
            u = self.low[k][:, None] + self.rng.random((len(inner), self.own_noise)) * self.mass[k][:, None]
            other = np.clip(np.searchsorted(self.upto, u, side="right") - 1, 0, v.n_words - 1)
            pick = np.concatenate([own[:, None], other], axis=1)
            rows = m.own[pick]
            p = 1 / (1 + np.exp(self.own_log_kq[pick] - np.einsum("nd,nkd->nk", hi, rows)))
            p[:, 0] -= 1
            dh[inner] -= np.einsum("nk,nkd->nd", p, rows)
            moves.append((3, pick.reshape(-1), (-p[:, :, None] * hi[:, None, :]).reshape(-1, DIM + 1)))
        d = dh[:, None, :DIM]
        moves.append((0, c.reshape(-1), (d * m.place).reshape(-1, DIM)))
        moves.append((1, np.arange(CONTEXT), np.einsum("nd,nkd->kd", dh[:, :DIM], vectors)))
        for k, at, g in moves:
            self._move(k, at, g * np.float32(1 / n))


def sequences(texts: pa.Array, v: Vocabulary):
    """Of the texts' tokens, with the ends: input numbers, contexts, places among distinct words (-1: end), offsets, the
    words, and their places among the frequent ones."""
    words, at, offsets = tokens(texts)
    inputs, place = v.inputs(words)
    which = np.insert(at, offsets[1:], -1)
    x = np.insert(inputs[at] if len(words) else at, offsets[1:], v.n_inputs - 1)
    starts = offsets + np.arange(len(offsets))
    c = np.full((len(x), CONTEXT), v.n_inputs - 1)
    for k in range(CONTEXT):
        c[k + 1 :, k] = x[: len(x) - k - 1]
        for j in range(k + 1):  # what lies before a text is an end
            s = starts[:-1] + j
            c[s[s < starts[1:]], k] = v.n_inputs - 1
    return x, c, which, starts, words, place


MOVED = "part int, row long, n long, vector array<float>"


def train(docs: DataFrame, vocab: Vocabulary, spark: SparkSession, batch_size: int = 1024) -> Model:
    """docs: the training texts (text). An empty table gives the unigram model.

    What tasks hand on is at most a row for each vector that a token of theirs moved; the driver gets the mean of each.
    """
    sent = spark.sparkContext.broadcast(vocab)

    def get(batches):
        v, t = sent.value, None
        for batch in batches:
            for part in shared.slices(batch, "text"):
                t = t or Trainer(Model.start(v), v, seed=TaskContext.get().partitionId())
                x, c, *_ = sequences(part.column(0), v)
                y = v.outputs(x)
                for i in range(0, len(y), batch_size):
                    t.step(c[i : i + batch_size], x[i : i + batch_size], y[i : i + batch_size])
        for k, (part, n) in enumerate(zip(t.m.parts(), t.moved) if t else ()):
            rows = np.nonzero(n)[0]
            for at in range(0, len(rows), 50_000):
                some = rows[at : at + 50_000]
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some]), pa.ListArray.from_arrays(ends, pa.array(part[some].reshape(-1)))], names=["part", "row", "n", "vector"])

    moved = shared.written(docs.select("text").mapInArrow(shared.tidy(get), MOVED), spark, "moved")
    weighted = [F.sum(F.col("n") * F.get("vector", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(DIM + 1)]
    mean = moved.groupBy("part", "row").agg(F.sum("n").alias("n"), *weighted)
    got = mean.select("part", "row", *[(F.col(f"s{i}") / F.col("n")).cast("float").alias(f"s{i}") for i in range(DIM + 1)]).toArrow()
    model = Model.start(vocab)
    part, row = got["part"].to_numpy(), got["row"].to_numpy()
    values = np.stack([got[f"s{i}"].to_numpy() for i in range(DIM + 1)], axis=1)
    for k, x in enumerate(model.parts()):
        x[row[part == k]] = values[part == k][:, : x.shape[1]]
    return model


def token_log10(x: np.ndarray, c: np.ndarray, model: Model, v: Vocabulary, step: int = 4096) -> np.ndarray:
    """log10 of each token's probability after its context: both steps, but for words in classes by last letters only
    the first. Every distinct context is computed once."""
    key, inverse = np.unique(c[:, 0] * v.n_inputs + c[:, 1], return_inverse=True)
    y, out = v.outputs(x), np.zeros(len(x))
    order = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[order], np.arange(0, len(key) + step, step))
    h = np.concatenate([model.context(np.stack([key[i : i + step] // v.n_inputs, key[i : i + step] % v.n_inputs], axis=1)) for i in range(0, len(key), step)]) if len(key) else np.zeros((0, DIM + 1), np.float32)
    for k, at in enumerate(range(0, len(key), step)):
        own = order[bounds[k] : bounds[k + 1]]
        out[own] = Model.chosen(h[at : at + step], model.top, inverse[own] - at, y[own])
    inner = np.nonzero((y >= v.direct) & (y < v.first_ending))[0]
    inner = inner[np.argsort(y[inner], kind="stable")]
    for own in np.split(inner, np.nonzero(np.diff(y[inner]))[0] + 1) if len(inner) else ():
        first = v.direct + (int(y[own[0]]) - v.direct) * v.size
        words = model.own[first : min(first + v.size, v.n_words)]
        for at in range(0, len(own), step):
            some = own[at : at + step]
            out[some] += Model.chosen(h[inverse[some]], words, np.arange(len(some)), x[some] - first)
    return out / math.log(10)


SCORED = "_row long, n_tokens long, n_known long, base double, score double, rest array<struct<word string, n long>>"


def score(docs: DataFrame, vocab: Vocabulary, counts: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """docs (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score, score.

    Words that aren't among the frequent ones are listed by document and joined with the counts of all words.
    """
    sent = spark.sparkContext.broadcast((vocab, model))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])

    def get(batches):
        v, m = sent.value
        floor = math.log10(v.tokens + v.kinds + 1)
        for batch in batches:
            for part in shared.slices(batch, "text"):
                x, c, which, starts, words, place = sequences(part.column(2), v)
                got = token_log10(x, c, m, v)
                plus = np.append(np.where(place >= 0, np.log10(1.0 + v.counts[np.maximum(place, 0)]) if len(v.counts) else 0.0, 0.0), math.log10(v.ends + 1))  # the last is the end's
                rest_words = (x >= v.n_words) & (x < v.n_inputs - 1)
                got[rest_words] += plus[which[rest_words]] - np.log10(v.mass[x[rest_words] - v.n_words])
                base = plus[which] - floor
                known = np.append(place >= 0, v.ends > 0)[which]
                add = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  every text has an end
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                far = (which >= 0) & ~np.append(place >= 0, True)[which]
                pair, n = np.unique(doc[far] * max(len(words), 1) + which[far], return_counts=True)
                offsets = np.searchsorted(pair // max(len(words), 1), np.arange(len(starts)))
                rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([words.take(pa.array(pair % max(len(words), 1))), pa.array(n.astype(np.int64))], names=["word", "n"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(starts)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(got)), rest.cast(schema.field("rest").type)], schema=schema)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<word:string,n:bigint>>"
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(shared.tidy(get), ddl)
    rows = shared.written(rows.withColumn("_row", F.monotonically_increasing_id()), spark, "lm-rows")
    rest = rows.select("_row", F.explode("rest").alias("r")).select("_row", "r.word", "r.n")
    rest = rest.join(counts.withColumnRenamed("n", "c"), "word").select("_row", "n", (F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    rest = rest.groupBy("_row").agg(F.sum("n").alias("more_known"), F.sum("more").alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rest").join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def score_texts(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The texts with crc32(doc_id) mod 7 other than 2 train. A null or empty text is one end. Without training
    texts all tokens are unknown: base and model are uniform over the one unseen kind. Equal rows are rows of
    their own; other columns are not read. Training keeps the table's own partitions, as tasks of more texts learn more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (shared.id_remainder("doc_id", 7) == 2).alias("held_out"))
    fit = docs.where("not held_out")
    counts = count_words(fit, spark)
    vocab = vocabulary(counts, fit.count())
    return score(shared.spread(docs), vocab, counts, train(fit, vocab, spark), spark)


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of `documents`."""
    return score_texts(shared.table(spark, sf_dir, "documents"), spark)
