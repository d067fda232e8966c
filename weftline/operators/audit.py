"""Contamination audits and packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import dedup


def benchmark_audit(rows: DataFrame, bench: DataFrame, id_col: str, bench_id: str, prompt: str, k: int, report: float, remove: float) -> DataFrame:
    """(id, bench id, exact, jaccard, action): equal prompts, and pairs whose shingles are similar enough to report.

    action is "removed" for equal prompts and from `remove` on, else "audit_only"; a pair that several tests find is one row.
    """
    key = F.array_join(text.norm_tokens(F.col(prompt)), " ")
    a, b = rows.select(id_col, key.alias("_k")).where("_k <> ''"), bench.select(bench_id, key.alias("_k"))
    exact = a.join(b, "_k").select(id_col, bench_id, F.lit(True).alias("exact"), F.lit(1.0).alias("jaccard"))
    near = dedup.contaminated_pairs(rows, bench, id_col, bench_id, prompt, k, report, 2.0).select(id_col, bench_id, F.lit(False).alias("exact"), "jaccard")
    pairs = exact.unionByName(near).groupBy(id_col, bench_id).agg(F.bool_or("exact").alias("exact"), F.max("jaccard").alias("jaccard"))
    return pairs.withColumn("action", F.when(F.col("exact") | (F.col("jaccard") >= remove), "removed").otherwise("audit_only"))


def pack_tokens(rows: DataFrame, pack: str, order: str, tokens: str) -> DataFrame:
    """(pack, tokens, positions, offsets): a pack's tokens one after another in order, places inside each row, and row starts."""
    g = rows.groupBy(pack).agg(F.array_sort(F.collect_list(F.struct(order, tokens))).alias("_r"))
    parts = F.transform("_r", lambda r: r[tokens])
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.size(x))))
    places = F.flatten(F.transform(parts, lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))))
    return g.select(pack, F.flatten(parts).alias("tokens"), places.alias("positions"), starts.alias("offsets"))


def unpack_tokens(packed: DataFrame, pack: str) -> DataFrame:
    """(pack, i, tokens): the rows of each pack by its offsets."""
    spans = F.zip_with(F.slice("offsets", F.lit(1), F.size("offsets") - 1), F.slice("offsets", F.lit(2), F.size("offsets") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return packed.select(pack, "tokens", F.posexplode(spans).alias("i", "s")).select(pack, "i", F.slice("tokens", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("tokens"))


def resume(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The work that isn't done."""
    return work.join(done.select(*key), key, "left_anti")


def running(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the sum of value over the rows before, per key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
