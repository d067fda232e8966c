"""Near-duplicate texts by SimHash, with a generalised pigeonhole search over the fingerprints.

Distinct fingerprints are cut into parts of bits. If two differ in at most t bits and the parts' thresholds
plus one sum to t + 1, they agree up to a part's threshold in some part. Parts hold bits that go together;
their number and thresholds are chosen by dynamic programming on the candidates they are estimated to give.
Every fingerprint is listed under its value of each part, and probes the values within the threshold; what
meets is verified on all bits. A task reports its links as a forest, and a bucket with many fingerprints is
dealt in pairs of chunks to many tasks, so a dense group gives no table of all its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import graph, shared

BITS, SEED = 64, 42
#: What a listed or probed row costs, in verified pairs.
ROW_COST = 40


def fingerprint(text: str | None, shingle: int = 4, step: int = 1 << 15) -> int:
    """Unsigned; zero for a null text or one without words. Fewer words than a shingle has give one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    count, one = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), step):
        h = np.array([one(whole[a:b], SEED) for a, b in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist())], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """docs with fp (the fingerprint as a signed long) in place of the text."""
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept).withColumn("fp", F.lit(0).cast("long")).schema

    def get(batches):
        for batch in batches:
            for some in shared.slices(batch, text_col):
                at = some.schema.get_field_index(text_col)
                fps = np.array([fingerprint(t, shingle) for t in some.column(at).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in kept), pa.array(fps)], names=[*kept, "fp"])

    return docs.mapInArrow(shared.tidy(get), schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many two bits are both set: 64 x 64 sums over all of them."""

    def get(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            b = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy()).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(b)
            for at in range(0, len(b), 1 << 20):
                both += b[at : at + (1 << 20)].T @ b[at : at + (1 << 20)]
        i = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.append(both.reshape(-1), n).astype(np.int64))], names=["i", "n"])

    sums = dict(fps.select("fp").mapInArrow(shared.tidy(get), "i long, n long").groupBy("i").agg(F.sum("n")).collect())
    if not sums:
        return 0, np.zeros((BITS, BITS))
    return sums.pop(BITS * BITS), np.array([sums[i] for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of like size; each takes, bit by bit, what correlates most with the bits it has."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(var, var))
    np.fill_diagonal(rho, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (rho[b, left].max(), -b))]
        left.remove(part[0])
        while len(part) < size:
            b = max(left, key=lambda b: (rho[b, part].sum(), -b))
            part.append(b)
            left.remove(b)
        parts.append(sorted(part))
    return parts


def chance(both: np.ndarray, n: int, part: list[int]) -> np.ndarray:
    """Of two fingerprints, the chance that they differ in at most 0, 1, ... bits of the part.

    Bits that go together count as fewer independent ones.
    """
    p = np.diag(both)[part] / max(n, 1)
    differ = np.array([1.0])
    for q in 2 * p * (1 - p):
        differ = np.convolve(differ, [1 - q, q])
    cov = both[np.ix_(part, part)] / max(n, 1) - np.outer(p, p)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho2 = (cov / np.outer(var, var)) ** 2
    together = (rho2.sum() - np.trace(rho2)) / max(1, len(part) * (len(part) - 1))
    return np.cumsum(differ) ** (1 / (1 + (len(part) - 1) * together))


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds from -1 for each part so that thresholds plus one sum to budget, at least cost.

    costs[i][t] is of threshold t in part i; -1, which leaves the part out, costs nothing.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(budget - used, len(cost))):
                got = (c + (cost[t] if t >= 0 else 0.0), [*ts, t])
                if used + t + 1 not in new or got < new[used + t + 1]:
                    new[used + t + 1] = got
        best = new
    return best[budget]


def plan(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost: rows listed and probed, and pairs verified."""
    found = []
    for m in range(2, most + 3):
        parts = group_bits(both, n, m)
        costs = []
        for part in parts:
            p = chance(both, n, part)
            costs.append([ROW_COST * n * sum(comb(len(part), k) for k in range(t + 1)) + p[min(t, len(part))] * n * n / 2 for t in range(most + 1)])
        cost, ts = allocate(costs, most + 1)
        found.append((cost, m, [(p, t) for p, t in zip(parts, ts) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def probes(parts: list[tuple[list[int], int]]):
    """A function from batches of fingerprints to rows: part, value, fp, and whether it is listed there."""

    def get(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for k, (bits, t) in enumerate(parts):
                mask = np.uint64(sum(1 << b for b in bits))
                for d in range(t + 1):
                    for flip in combinations(bits, d):
                        value = (fps & mask) ^ np.uint64(sum(1 << b for b in flip))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array(value.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), d == 0))], names=["part", "value", "fp", "listed"])

    return get


def forest(t: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The links among the rows (part, value, x, y, fp, listed, side) of whole buckets, as a forest; None without any."""
    part, value, x, y, side = (t[c].to_numpy() for c in ("part", "value", "x", "y", "side"))
    fp, listed = t["fp"].to_numpy().view(np.uint64), t["listed"].to_numpy(zero_copy_only=False)
    order = np.lexsort((fp, y, x, value, part))
    part, value, x, y, side, fp, listed = (c[order] for c in (part, value, x, y, side, fp, listed))
    new = np.ones(len(fp), bool)
    new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    last = np.append(np.nonzero(new)[0][1:], len(fp))[np.cumsum(new) - 1]  # end of each row's group
    left, a, b, held = np.arange(len(fp)), [], [], 0
    for d in range(1, len(fp)):
        left = left[left + d < last[left]]
        if not len(left):
            break
        i, j = left, left + d
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= most) & (listed[i] | listed[j]) & ((x[i] == y[i]) | (side[i] != side[j]))
        a.append(fp[i[near]].view(np.int64))
        b.append(fp[j[near]].view(np.int64))
        held += int(near.sum())
        if held > 1_000_000:
            p, q = graph.roots(np.concatenate(a), np.concatenate(b))
            a, b, held = [p], [q], 0
    return graph.roots(np.concatenate(a), np.concatenate(b)) if a else None


def verify(most: int, rows: int = 200_000):
    """A function from a task's rows, sorted by part, value, x and y, to links: about `rows` of them are held at a time,
    whole buckets and dealt pairs of chunks, which are small."""

    def get(batches):
        held, n = [], 0

        def found(t: pa.Table):
            if t.num_rows and (pair := forest(t, most)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                t = pa.Table.from_batches(held)
                differ = np.zeros(t.num_rows - 1, bool)
                for c in ("part", "value", "x", "y"):
                    v = t[c].to_numpy()
                    differ |= v[1:] != v[:-1]
                cuts = np.nonzero(differ)[0]
                cut = int(cuts[-1]) + 1 if len(cuts) else 0
                yield from found(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                n = t.num_rows - cut
        if held:
            yield from found(pa.Table.from_batches(held))

    return get


def links(fps: DataFrame, spark: SparkSession, most: int = 4, chunk: int = 1000) -> DataFrame:
    """Links (a, b) that join exactly what distinct fingerprints (fp long, in a written table) within `most` bits join.

    A bucket with more than `chunk` rows is dealt in pairs of chunks; every pair of its rows meets in a task.
    """
    n, both = bit_counts(fps)
    rows = fps.select("fp").mapInArrow(shared.tidy(probes(plan(n, both, most))), "part int, value long, fp long, listed boolean")
    rows = shared.written(rows, spark, "probes")
    hot = rows.groupBy("part", "value").count().where(F.col("count") > chunk).select("part", "value", F.ceil(F.col("count") / chunk).cast("int").alias("k"))
    hot = shared.written(hot, spark, "hot-buckets")
    one = rows.join(hot, ["part", "value"], "left_anti") if (some := hot.head(1)) else rows
    keyed = one.select("part", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "listed", F.lit(0).alias("side"))
    if some:
        many = rows.join(hot, ["part", "value"]).withColumn("c", F.pmod(F.xxhash64("fp", "listed"), F.col("k")).cast("int"))
        many = many.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        keyed = keyed.unionByName(many.select("part", "value", F.least("c", "j").alias("x"), F.greatest("c", "j").alias("y"), "fp", "listed", F.when(F.col("c") <= F.col("j"), 0).otherwise(1).alias("side")))
    keys = ["part", "value", "x", "y"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(shared.tidy(verify(most)), "a long, b long")


def classes(prints: DataFrame, spark: SparkSession, most: int = 4) -> DataFrame:
    """prints (fp and other columns, a written table) to (fp, root) of every distinct fingerprint."""
    fps = shared.written(prints.select("fp").distinct(), spark, "fingerprints")
    found = graph.components(links(fps, spark, most), spark)
    return shared.written(fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), spark, "classes")


def near_duplicates(docs: DataFrame, spark: SparkSession, most: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Null and empty texts and those without words have fingerprint zero and are linked like any other.
    Equal rows are rows of their own. A null doc_id is never a component_id unless its whole component has
    none. An empty table gives an empty one.
    """
    prints = shared.written(fingerprints(shared.spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shingle=shingle), spark, "prints")
    of = classes(prints, spark, most)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    ids = shared.written(of.join(least, "fp").groupBy("root").agg(F.min("first").alias("component_id")), spark, "component-ids")
    named = shared.written(of.join(ids, "root").select("fp", "component_id"), spark, "component-of")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, spark: SparkSession, most: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each component: the least doc_id (nulls last), of equal ones the first in the table."""
    numbered = shared.written(shared.spread(docs).withColumn("_row", F.monotonically_increasing_id()), spark, "numbered")
    prints = shared.written(fingerprints(numbered.select("_row", "doc_id", F.col("text").cast("string").alias("text")), shingle=shingle), spark, "prints")
    of = classes(prints, spark, most)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    least = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    kept = of.join(least, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with its fingerprint and the least doc_id of its component."""
    return near_duplicates(shared.table(spark, sf_dir, "documents"), spark)
