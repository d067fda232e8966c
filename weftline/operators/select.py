"""Ordered choice of rows: ordinals, prefixes, samples, limits, cyclic repeats. Every order is stated."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.kept import kept


def ordinals(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """rows with their place (from 0) by order, without sending all of them to one task.

    Rows are sorted by ranges into a written table, since ranges that are sampled anew at every use would not agree;
    a task numbers its own, and the rows in the tasks before are added, which a window over one row for each task
    counts. Nulls come first. Rows that the order doesn't tell apart take consecutive places; an empty table stays
    empty. The names _at, _task and _before are reserved.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = kept(parts, "ordinals").withColumn("_task", F.shiftright("_at", 33))
    counts = parts.groupBy("_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col("_at") - F.shiftleft("_task", 33)
    return parts.join(starts, "_task").select(*rows.columns, (local + F.col("_before")).alias(name))


def prefix_sums(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over them and all rows before, without sending all of them to one task: a task sums its
    own range, and the sums of the tasks before are added. Null values count as nothing."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = kept(parts, "prefix-sums").withColumn("_task", F.shiftright("_at", 33))
    own = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    sums = parts.groupBy("_task").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(sums.select("_task", before.alias("_before")), "_task").select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def hash_order(seed: int | str, id_col: str) -> Column:
    """SHA-256 of the seed, a zero character and the id."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(id_col).cast("string")), 256)


def hash_sample(rows: DataFrame, id_col: str, n: int, seed: int | str, strict: bool = False) -> DataFrame:
    """The n rows that come first by hash; strict: an error if there are fewer."""
    out = rows.orderBy(hash_order(seed, id_col), id_col).limit(n)
    if strict and (got := out.count()) < n:
        raise ValueError(f"{n} rows asked for, {got} there")
    return out


def bounds(start: int | None, end: int | None, n: int) -> tuple[int, int]:
    """A slice's bounds among n rows; negative ones count from the end."""
    return slice(start, end).indices(n)[:2]


def row_slice(rows: DataFrame, order: list[str], start: int | None, end: int | None) -> DataFrame:
    a, b = bounds(start, end, rows.count())
    return ordinals(rows, order).where((F.col("ord") >= a) & (F.col("ord") < b)).drop("ord")


def shuffled(rows: DataFrame, spark: SparkSession, order: list[str], seed: int) -> DataFrame:
    """rows with their place after random.Random(seed).shuffle of the places; the permutation is made on the driver."""
    numbered = ordinals(rows, order)
    places = list(range(rows.count()))
    random.Random(seed).shuffle(places)
    new = spark.createDataFrame([(old, at) for at, old in enumerate(places)], "ord long, place long")
    return numbered.join(new, "ord").drop("ord")


def trim_multiple(rows: DataFrame, ord_col: str, size: int) -> DataFrame:
    """The first floor(n / size) * size rows."""
    n = rows.agg(F.floor(F.count("*") / size) * size).first()[0]
    return rows.where(F.col(ord_col) < n)


def debug_subsample(rows: DataFrame, ord_col: str, n_rows: int, ratio: float) -> DataFrame:
    """The first half, rounded down, and the last half, rounded up, of int(n_rows * ratio) rows."""
    n = int(n_rows * ratio)
    return rows.where((F.col(ord_col) < n // 2) | (F.col(ord_col) >= n_rows - (n - n // 2)))


def repeat_until(shards: DataFrame, shard: str, size: str, total: int) -> DataFrame:
    """(cycle, shard, size): shards in order, round and round, until their sizes reach total; the last counts whole."""
    once = shards.agg(F.sum(size)).first()[0] or 0
    if once <= 0:
        return shards.select(F.lit(0).cast("long").alias("cycle"), shard, size).limit(0)
    cycles = shards.select(shard, size).withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-total // once) - 1).cast("long"))))
    before = Window.partitionBy("cycle").orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("cycle") * once + F.coalesce(F.sum(size).over(before), F.lit(0))
    return cycles.withColumn("_b", at).where(F.col("_b") < total).select("cycle", shard, size)


def interleave(left: DataFrame, right: DataFrame, ord_col: str, group: int) -> DataFrame:
    """Whole groups of rows, by turns from left and right, at their own places."""
    turn = F.floor(F.col(ord_col) / group) % 2
    return left.where(turn == 0).unionByName(right.where(turn == 1))


def join_positions(left: DataFrame, right: DataFrame, shard: str, place: str) -> DataFrame:
    """Rows of two tables that stand at the same place of a shard; shards with different numbers of rows are an error."""
    n = lambda df, name: df.groupBy(shard).agg(F.count("*").alias(name))
    differ = n(left, "_a").join(n(right, "_b"), shard, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    if bad := differ.select(shard).limit(5).collect():
        raise ValueError(f"shards with different numbers of rows: {[r[0] for r in bad]}")
    return left.join(right, [shard, place])


def choose_limit(candidates: list[tuple[int, bool]], override: int | None = None) -> int:
    """The least limit that passes its checks, else the largest; an override wins."""
    if override is not None:
        return override
    good = [n for n, ok in candidates if ok]
    return min(good) if good else max(n for n, _ in candidates)
