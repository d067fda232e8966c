"""Nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts with few cut edges; a small softmax classifier
learns the parts. Every row is indexed under its most likely part. A query goes down the list of its most probable
parts as far as queries of the sample need for the wanted recall, and what they hold is ranked exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared


def neighbour_graph(x: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """The k rows with the largest inner products with each row, itself aside."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), step):
        s = x[at : at + step] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + step] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each row: halves again and again, each cut at the median of the main direction and then improved
    by exchanging the rows that lower the number of cut edges most, as many from either side."""
    part = np.zeros(len(x), np.int64)
    rng = np.random.default_rng(3)

    def halve(own: np.ndarray, first: int, n: int) -> None:
        if n < 2 or len(own) < 2:
            part[own] = first
            return
        low = n // 2
        cut = len(own) * low // n
        centred = x[own] - x[own].mean(axis=0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(20):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) or 1.0
        side = np.ones(len(own), bool)
        side[np.argsort(centred @ v, kind="stable")[:cut]] = False
        place = np.full(len(x), -1)
        place[own] = np.arange(len(own))
        a = np.repeat(np.arange(len(own)), graph.shape[1])
        b = place[graph[own]].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        for _ in range(rounds):
            across = np.bincount(a, side[a] != side[b], len(own)) - np.bincount(a, side[a] == side[b], len(own))
            zero, one = np.nonzero(~side)[0], np.nonzero(side)[0]
            zero, one = zero[np.argsort(-across[zero], kind="stable")], one[np.argsort(-across[one], kind="stable")]
            k = min(len(zero), len(one))
            good = int((across[zero[:k]] + across[one[:k]] > 0).sum()) // 2  # half: partners move too
            if not good:
                break
            side[zero[:good]], side[one[:good]] = True, False
        halve(own[~side], first, low)
        halve(own[side], first + low, n - low)

    halve(np.arange(len(x)), 0, parts)
    return part


@dataclass(frozen=True)
class Router:
    """A softmax over parts. mass: parts are tried, the most probable first, until those before have this probability."""

    weights: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = unit(x) @ self.weights[:-1] + self.weights[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's parts, the most probable first, and the probability of the parts before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p

    def tried(self, before: np.ndarray) -> np.ndarray:
        """How many parts each row tries, one at least."""
        return np.maximum((before <= self.mass).sum(axis=1), 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(x: np.ndarray, parts: int, k: int, recall: float, steps: int = 200) -> Router:
    """x: the sample. A tenth of it asks for its k nearest, to choose how far a query goes down its list of parts."""
    if parts < 2 or len(x) < 4 * parts:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1.0)
    u = np.hstack([unit(x), np.ones((len(x), 1))])
    y = balanced_parts(x, neighbour_graph(x, 10), parts)
    w, m, s = (np.zeros((u.shape[1], parts)) for _ in range(3))
    hot = np.eye(parts)[y]
    for t in range(1, steps + 1):
        z = u @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = u.T @ (p / p.sum(axis=1, keepdims=True) - hot) / len(x) + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    router = Router(w, 1.0)
    order, before = router.order(x)
    asking = np.arange(0, len(x), 10)
    sims = x[asking] @ x.T
    sims[np.arange(len(asking)), asking] = -np.inf
    near = np.argpartition(-sims, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    rank = np.argsort(order[asking], axis=1)  # of each part for each query
    need = np.take_along_axis(before[asking], np.take_along_axis(rank, order[near, 0], axis=1), axis=1)
    return Router(w, float(np.quantile(need, recall, method="higher")) + 1e-12)


NONE = np.iinfo(np.int64).max


def best(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of each query, the exact scores and the ids of its k nearest rows of x, its own row aside, ties to the smaller id.

    Matrix products find candidates with room for rounding; their scores are then summed in one fixed order. Where
    there are fewer than k, the rest is -inf and NONE.
    """
    scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), NONE)
    by_row = np.argsort(rows, kind="stable")
    for at in range(0, len(q), step):
        some = q[at : at + step]
        rough = some @ x.T
        place = np.minimum(np.searchsorted(rows, q_rows[at : at + step], sorter=by_row), len(rows) - 1)
        own = rows[by_row[place]] == q_rows[at : at + step]
        rough[np.nonzero(own)[0], by_row[place[own]]] = -np.inf
        room = 1e-9 * (1 + np.abs(np.where(np.isfinite(rough), rough, 0)).max(axis=1))
        wide = min(k + 12, len(x))
        top = np.argpartition(-rough, wide - 1, axis=1)[:, :wide]
        sims = np.take_along_axis(rough, top, axis=1)
        few = min(k, wide)
        edge = np.partition(sims, wide - few, axis=1)[:, wide - few]
        more = (sims.min(axis=1) >= edge - room) & (wide < len(x))  # ties may lie outside
        exact = np.where(np.isfinite(sims), (x[top] * some[:, None, :]).sum(axis=2), -np.inf)
        order = np.lexsort((ids[top], -exact), axis=1)[:, :few]
        scores[at : at + step, :few] = np.take_along_axis(exact, order, axis=1)
        found[at : at + step, :few] = np.take_along_axis(ids[top], order, axis=1)
        for i in np.nonzero(more)[0]:
            c = np.nonzero(np.isfinite(rough[i]) & (rough[i] >= edge[i] - room[i]))[0]
            e = (x[c] * some[i]).sum(axis=1)
            o = np.lexsort((ids[c], -e))[:k]
            scores[at + i, : len(o)], found[at + i, : len(o)] = e[o], ids[c[o]]
    found[np.isneginf(scores)] = NONE
    return scores, found


class Run:
    """A run of queries in memory, past which the rows of a block are led in chunks."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.rows, self.ids, self.k = q, rows, ids, k
        self.scores, self.found = np.full((len(q), k), -np.inf), np.full((len(q), k), NONE)

    def add(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        s, f = best(self.q, self.rows, x, rows, ids, self.k)
        s, f = np.hstack([self.scores, s]), np.hstack([self.found, f])
        order = np.lexsort((f, -s), axis=1)[:, : self.k]
        self.scores, self.found = np.take_along_axis(s, order, axis=1), np.take_along_axis(f, order, axis=1)

    def result(self) -> pa.RecordBatch:
        there = self.found != NONE
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(self.scores[there]), pa.array(self.found[there])], names=["score", "vec_id"])
        return pa.RecordBatch.from_arrays([pa.array(self.rows), pa.array(self.ids), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["row", "query_id", "found"])


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v) of the rows that take part; row tells rows with one id apart."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def grid(counts: dict[int, int], size: int):
    """A map column from part to the number of pieces of about `size`."""
    return F.create_map(*[F.lit(int(x)) for p, n in counts.items() for x in (p, -(-n // size))])


def search(
    rows: DataFrame, spark: SparkSession, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sample: int = 8192, recall: float = 0.95, parts: int | None = None, block: int = 262_144, run: int = 65_536, chunk: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for the rows where is_query (of vec_id) holds.

    At most `sample` rows (least hash of the row) fit the partitions. Unless told, there are an eighth of the root of
    the number of rows of them, two at least and one for 64 rows of the sample at most; a sample of fewer than four
    rows a part has one. Every row is indexed. A part's rows are dealt in blocks of about `block` and its queries in
    runs of about `run`; a task holds a run and reads a block past it, so that memory is bounded, a part with a third
    of all rows is many tasks, and a row is sent once for every `run` queries of its part.

    Vectors that are null, zero, or hold a null or a number that isn't finite take no part, nor do null ids. Vectors
    of another length than the most common one are compared with those of their own length, all of them. Rows with
    one id are rows of their own, and a query's own row alone is left out for it; of two queries with one id the
    nearest of both are listed. Ties go to the smaller id. An empty table, or one without queries, gives no rows.
    """
    index = shared.written(valid(rows, id_col, vector_col), spark, "vectors")
    lengths = {r[0]: (r[1], r[2]) for r in index.groupBy(F.size("v")).agg(F.count("*"), F.count_if(is_query("vec_id"))).collect()}
    if not any(asks for _, asks in lengths.values()):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, (n, _) = max(lengths.items(), key=lambda x: (x[1][0], -x[0]))
    usual = index.where(F.size("v") == d)
    near = usual.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(min(1.0, 1.5 * sample / n) * (1 << 20)) + 1)  # so that tasks send few rows
    taken = near.orderBy(F.pmod(F.xxhash64("row"), F.lit(1 << 20)), "row").limit(sample).select("v").toArrow()
    x = np.unique(np.array(taken["v"].combine_chunks().flatten()).reshape(len(taken), -1), axis=0)
    router = fit(x, parts or max(2, min(int(n**0.5) // 8, sample // 64)), k, recall)

    def route(batches):
        for b in batches:
            if b.num_rows:
                order, before = router.order(matrix(b, 2))
                tried = router.tried(before)
                ends = np.concatenate([[0], np.cumsum(tried)]).astype(np.int32)
                lists = order[np.arange(order.shape[1]) < tried[:, None]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(lists))], names=["row", "vec_id", "v", "parts"])

    routed = usual.mapInArrow(shared.tidy(route), "row long, vec_id long, v array<double>, parts array<int>")
    routed = routed.unionByName(index.where(F.size("v") != d).withColumn("parts", F.array(-F.size("v"))))
    routed = shared.written(routed, spark, "routed")
    asking = routed.where(is_query("vec_id"))
    held = {r[0]: r[1] for r in routed.groupBy(F.col("parts")[0]).count().collect()}
    asked = {r[0]: r[1] for r in asking.select(F.explode("parts").alias("p")).groupBy("p").count().collect()}
    blocks, runs = grid(held, block), grid(asked, run)
    stored = routed.select("row", "vec_id", "v", F.col("parts")[0].alias("part")).withColumn("block", F.pmod(F.xxhash64("row"), F.element_at(blocks, F.col("part"))).cast("int"))
    stored = stored.withColumn("run", F.explode(F.sequence(F.lit(0), F.element_at(runs, F.col("part")) - 1))).withColumn("asks", F.lit(False))
    asking = asking.select("row", "vec_id", "v", F.explode("parts").alias("part")).withColumn("run", F.pmod(F.xxhash64(F.lit(1), "row"), F.element_at(runs, F.col("part"))).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("part")) - 1))).withColumn("asks", F.lit(True))
    cols = ["part", "block", "run", "asks", "row", "vec_id", "v"]

    def rank(batches):
        key, asks, waiting, current = None, [], [], None

        def lead():
            nonlocal current, waiting
            if asks and current is None:
                current = Run(np.vstack([matrix(b, 6) for b in asks]), np.concatenate([b.column(4).to_numpy() for b in asks]), np.concatenate([b.column(5).to_numpy() for b in asks]), k)
            if current is not None and waiting:
                current.add(np.vstack([matrix(b, 6) for b in waiting]), *(np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in (4, 5)))
            waiting = []

        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            new = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            for at, to in zip([0, *new.tolist()], [*new.tolist(), len(keys)]):
                if to == at:
                    continue
                if key != tuple(keys[at, :3]):
                    lead()
                    if current is not None:
                        yield current.result()
                    key, asks, current = tuple(keys[at, :3]), [], None
                (asks if keys[at, 3] else waiting).append(b.slice(at, to - at))
                if sum(w.num_rows for w in waiting) >= chunk:
                    lead()
        lead()
        if current is not None:
            yield current.result()

    pairs = stored.select(*cols).unionByName(asking.select(*cols)).repartition("part", "block", "run").sortWithinPartitions("part", "block", "run", F.desc("asks"))
    found = pairs.mapInArrow(shared.tidy(rank), FOUND).groupBy("row", "query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    first = F.slice(F.array_sort(F.transform("found", lambda x: F.struct((-x["score"]).alias("less"), x["vec_id"].alias("vec_id")))), 1, k)
    return found.select("query_id", F.posexplode(first).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))


FOUND = "row long, query_id long, found array<struct<score:double,vec_id:long>>"


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for the rows of `embeddings` whose vec_id is divisible by 20."""
    return search(shared.table(spark, sf_dir, "embeddings"), spark, lambda c: F.col(c) % 20 == 0)
