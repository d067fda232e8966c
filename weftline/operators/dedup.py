"""Duplicates, conflicts and benchmark contamination of rows, by keys and shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.sources.kept import kept, spread


def digest(*cols: str | Column) -> Column:
    """SHA-256 of the columns' JSON; nulls stay apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def first_per_key(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by order.

    An aggregate, not a window: the least struct of each key is combined before the shuffle, so a key with very
    many rows is no large task. order must tell rows apart.
    """
    others = [c for c in rows.columns if c not in key]
    least = F.min(F.struct(*[F.struct(*order).alias("_o"), *others])).alias("_m")
    return rows.groupBy(*key).agg(least).select(*key, *[F.col(f"_m.{c}").alias(c) for c in others]).select(*rows.columns)


def exact_dedup_audit(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Every row that a first row of its key stands for: (key, removed, representative)."""
    first = rows.groupBy(key).agg(F.min(order).alias("representative"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, key).where(F.col(order) != F.col("representative")).select(key, F.col(order).alias("removed"), "representative")


def conflict_groups(rows: DataFrame, prompt: str, target: str, kind: str) -> DataFrame:
    """Prompts with two or more targets: rows, targets, sorted kinds."""
    return rows.groupBy(prompt).agg(F.count("*").alias("n_rows"), F.countDistinct(target).alias("n_targets"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds")).where("n_targets >= 2")


def shingle_table(rows: DataFrame, id_col: str, text_col: str, k: int, short: str = "whole") -> DataFrame:
    """(id, shingle hash, number of the row's shingles)."""
    sh = spread(rows.select(id_col, text_col)).select(id_col, text.bind(text.shingle_hashes(text.norm_tokens(F.col(text_col)), k, short), lambda s: F.struct(s.alias("s"), F.size(s).alias("n"))).alias("x"))
    return sh.select(id_col, F.col("x.n").alias("n"), F.explode("x.s").alias("shingle"))


def contaminated_pairs(rows: DataFrame, bench: DataFrame, id_col: str, bench_id: str, text_col: str, k: int, jaccard: float, overlap: float) -> DataFrame:
    """(id, bench id, shared, jaccard, overlap) where the Jaccard similarity or the overlap reaches its bound.

    An equi-join on shingles. Spark broadcasts the benchmark's shingles if they are below its own bound, else
    both sides are shuffled and large partitions split; pairs are counted before they are shuffled again.
    """
    a = shingle_table(rows, id_col, text_col, k).withColumnRenamed("n", "n_a")
    b = shingle_table(bench.withColumnRenamed(bench_id, "_b"), "_b", text_col, k).withColumnRenamed("n", "n_b")
    pairs = a.join(b, "shingle").groupBy(id_col, "_b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    pairs = pairs.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).withColumn("overlap", F.col("shared") / F.least("n_a", "n_b"))
    return pairs.where((F.col("jaccard") >= jaccard) | (F.col("overlap") >= overlap)).select(id_col, F.col("_b").alias(bench_id), "shared", "jaccard", "overlap")


def near_pairs(rows: DataFrame, id_col: str, text_col: str, stratum: str, k: int, threshold: float) -> DataFrame:
    """(a, b, jaccard, same): similar rows of a stratum by their sets of k-word shingles, a before b.

    Rows of one stratum with equal sets are a class, for which its least id stands: a row (representative, member, 1,
    true) for each other member, so a class of n copies gives n - 1 rows and not n * (n - 1) / 2. Between
    representatives every pair whose Jaccard similarity reaches the threshold is listed, same being false.

    Prefix filter, without loss: ordered by frequency, rarest first, two sets that are similar enough share a
    shingle among the first n - ceil(threshold * n) + 1 of each. Shingles of one class alone come first and join
    nothing, so only the others are dealt out; the sizes must fit too. Rows without a shingle take no part; a null
    stratum is a stratum of its own. Ids must be different and not null.
    """
    hashes = text.shingle_hashes(text.norm_tokens(F.col(text_col)), k, "none")
    base = spread(rows.select(id_col, text_col, stratum)).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))).alias("s"), F.sort_array(hashes).alias("w")).where(F.size("w") > 0)
    key = F.struct("s", F.size("w").alias("n"), F.xxhash64("w").alias("a"), F.xxhash64(F.lit("set"), "w").alias("b"))  # 128 bits and the size
    base = kept(base.withColumn("key", key), "shingle-sets")
    first = base.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("_n"))
    copies = base.select("id", "key").join(first.where("_n > 1"), "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    sets = kept(base.join(first.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "w", F.size("w").alias("n"), "s"), "shingle-classes")
    sh = sets.select("id", "n", "s", F.explode("w").alias("x")).select("id", "n", F.xxhash64("s", "x").alias("h"))
    often = sh.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    common = sh.join(often, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("o"))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("o"))  # of the prefix, after the shingles of one class alone
    probes = common.where(room > 0).select("id", "n", F.explode(F.slice("o", F.lit(1), room.cast("int"))).alias("x")).select("id", "n", "x.h")
    a, b = probes.withColumnsRenamed({"id": "a", "n": "n_a"}), probes.withColumnsRenamed({"id": "b", "n": "n_b"})
    fits = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    found = a.join(b, "h").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    lists = sets.select("id", "w")
    full = found.join(lists.withColumnsRenamed({"id": "a", "w": "w_a"}), "a").join(lists.withColumnsRenamed({"id": "b", "w": "w_b"}), "b")
    both = F.size(F.array_intersect("w_a", "w_b"))
    pairs = full.select("a", "b", text.bind(both, lambda c: c / (F.size("w_a") + F.size("w_b") - c)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)
    return pairs.withColumn("same", F.lit(False)).unionByName(copies.select("a", "b", F.lit(1.0).alias("jaccard"), F.lit(True).alias("same")))


def greedy_representatives(near: DataFrame, spark: SparkSession, checkpoint) -> DataFrame:
    """(removed, representative) of the greedy scan in order of ids: a row goes if a kept row before it is similar.

    near: what near_pairs gives. A copy goes with its class, so the scan runs over representatives alone. The
    lexicographically first independent set, by rounds: a row whose smaller neighbours are all gone is kept;
    its larger neighbours go. checkpoint(df) writes a table and reads it.
    """
    near = checkpoint(near.select("a", "b", "same"))
    pairs, copies = near.where("not same").drop("same"), near.where("same").drop("same")  # a < b
    left, out = pairs, pairs.select(F.col("b").alias("removed")).limit(0)
    while left.head(1):
        later = left.select(F.col("b").alias("x")).distinct()
        stays = left.select(F.col("a").alias("x")).distinct().join(later, "x", "left_anti")
        gone = checkpoint(left.join(stays, left["a"] == stays["x"], "left_semi").select(F.col("b").alias("removed")).distinct())
        out = out.unionByName(gone)
        dead = gone.select(F.col("removed").alias("x"))
        left = checkpoint(left.join(dead, left["a"] == dead["x"], "left_anti").join(dead, left["b"] == dead["x"], "left_anti").join(stays, left["a"] == stays["x"], "left_anti"))
    dead = out.select(F.col("removed").alias("x"))
    gone = pairs.join(dead, pairs["b"] == dead["x"], "left_semi").join(dead, pairs["a"] == dead["x"], "left_anti").groupBy(F.col("b").alias("removed")).agg(F.min("a").alias("representative"))
    gone = checkpoint(gone)
    over = gone.withColumnsRenamed({"removed": "a", "representative": "r"})
    return gone.unionByName(copies.join(over, "a", "left").select(F.col("b").alias("removed"), F.coalesce("r", "a").alias("representative")))


def lag_pairs(turns: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """Adjacent turns of one role."""
    w = Window.partitionBy(key).orderBy(order)
    return turns.withColumn("_before", F.lag(role).over(w)).where(F.col("_before") == F.col(role)).drop("_before")
