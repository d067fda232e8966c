"""State by key on streams: samples that grow by chunks, conversations that end or fail, and a cache of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GROWN = "key long, tokens long, total double, chunks long, status string"


def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A sample's state after a micro-batch: tokens so far, the sum of their scores, chunks, and how it stands.

    Chunks (at, n, score, last) count once each, in order of `at`; what comes after the last chunk is not taken.
    """
    tokens, total, chunks, done = state.get if state.exists else (0, 0.0, 0, False)
    for r in pd.concat(list(frames)).sort_values("at").itertuples():
        if not done:
            tokens, total, chunks, done = tokens + int(r.n), total + float(r.score), chunks + 1, bool(r.last)
    state.update((tokens, total, chunks, done))
    yield pd.DataFrame([(key[0], tokens, total, chunks, "completed" if done else "pending")], columns=["key", "tokens", "total", "chunks", "status"])


def continue_generation(chunks: DataFrame) -> DataFrame:
    """A stream of chunks (key, at, n, score, last) to each key's sample as it grows; state is kept by key."""
    return chunks.groupBy("key").applyInPandasWithState(grow, GROWN, "tokens long, total double, chunks long, done boolean", "update", GroupStateTimeout.NoTimeout)


def latest_state(spark: SparkSession, stream: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Runs a stream of states over all that is there now into Parquet below path, and gives each key's last state."""
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/states/batch={i}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/states")
    last = rows.groupBy(key).agg(F.max(F.struct("_batch", order, *[c for c in rows.columns if c not in (key, order, "_batch", "batch")])).alias("m"))
    return last.select(key, "m.*").drop("_batch")


def conversations(turns: DataFrame, key: str, order: str, role: str, failure: str, most: int) -> DataFrame:
    """(key, turns, outcome): one record for each conversation: a failure by its type, `too_long`, or how it ended.

    A failing turn ends it; turns after that do not count.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    rows = turns.withColumn("_n", F.row_number().over(w)).withColumn("_f", F.first(F.when(F.col(failure).isNotNull(), F.col("_n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.where(F.col("_f").isNull() | (F.col("_n") <= F.col("_f")))
    by = rows.groupBy(key).agg(F.count("*").alias("turns"), F.max(failure).alias("_failed"), F.max(F.struct(order, role)).alias("_l"))
    outcome = F.when(F.col("_failed").isNotNull(), F.concat(F.lit("failed_"), F.col("_failed"))).when(F.col("turns") > most, "too_long").when(F.col(f"_l.{role}") == "assistant", "answered").otherwise("open")
    return by.select(key, "turns", outcome.alias("outcome"))


def remove_prefix(cache: DataFrame, text: str) -> DataFrame:
    """A cache (key, ...) without an entry and all that begin with it; as it is if the text is no entry or empty."""
    there = cache.where(F.col("key") == text).limit(1).count() if text else 0
    return cache.where(~F.col("key").startswith(text)) if there else cache


def cache_stats(cache: DataFrame, hits: int, misses: int, most: int) -> dict:
    """Entries, their characters, the share of requests that hit, and whether the cache is above its bound."""
    n, size = cache.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    return {"entries": n, "size": size, "hits": hits, "misses": misses, "hit_rate": hits / (hits + misses) if hits + misses else 0.0, "full": n > most}


def version_problems(cache: DataFrame) -> DataFrame:
    """(key, version, parent, parent_version) of entries newer than the longest other entry that they begin with."""
    from weftline.streaming.rollout import beginnings

    keys = cache.select("key").distinct()
    above = beginnings(keys.withColumnRenamed("key", "_k"), keys, "_k", "_k").where(F.length("_k") > F.col("n"))
    parent = above.groupBy("_k").agg(F.max(F.struct("n", "key")).alias("m")).select("_k", F.col("m.key").alias("parent"))
    old = cache.select(F.col("key").alias("parent"), F.col("version").alias("parent_version"))
    return cache.join(parent, F.col("key") == F.col("_k")).join(old, "parent").where(F.col("version") > F.col("parent_version")).select("key", "version", "parent", "parent_version")
