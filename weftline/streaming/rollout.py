"""Online state in processing order: an epoch cursor, a buffer served first, a cache of prefixes with versions.

Micro-batches come as DataFrames (foreachBatch); small state is a dataclass that is saved as JSON, tables of
state are written folders.
"""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



@dataclass
class EpochCursor:
    """Serves n of `size` prompts at a time, in an order that is shuffled anew each epoch from seed + epoch.

    A request wraps once at the end of an epoch; one that needs more than that is refused.
    """

    size: int
    seed: int = 0
    shuffle: bool = True
    epoch: int = 0
    offset: int = 0
    served: int = 0

    def order(self) -> list[int]:
        places = list(range(self.size))
        if self.shuffle:
            random.Random(self.seed + self.epoch).shuffle(places)
        return places

    def take(self, n: int) -> list[int]:
        if n > 2 * self.size - self.offset:
            raise ValueError("more than the rest of this epoch and the next")
        got = self.order()[self.offset : self.offset + n]
        self.offset += len(got)
        if len(got) < n:
            self.epoch, self.offset = self.epoch + 1, n - len(got)
            got += self.order()[: self.offset]
        self.served += n
        return got

    def save(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def load(cls, text: str) -> EpochCursor:
        return cls(**json.loads(text))


def serve(buffer: DataFrame, source: DataFrame, n: int, order: str, group: str) -> DataFrame:
    """n groups: those of the buffer first, then the source's, each in order."""
    both = buffer.withColumn("_p", F.lit(0)).unionByName(source.withColumn("_p", F.lit(1)))
    first = both.groupBy(group).agg(F.min(F.struct("_p", order)).alias("_o")).orderBy("_o", group).limit(n).select(group)
    return both.join(first, group, "left_semi").drop("_p")


def keep_until(groups: DataFrame, keep: str, order: str, target: int) -> tuple[DataFrame, DataFrame]:
    """The first `target` groups that pass, in order of completion, and counts of the others by reason."""
    good = groups.where(F.col(keep)).orderBy(order).limit(target)
    return good, groups.where(~F.col(keep)).groupBy("reason").count()


def carry_over(samples: DataFrame, rollout_id: int) -> DataFrame:
    """Aborted samples go back, stamped with the rollout they began in, and what they have so far is not trained on."""
    back = samples.where("status = 'aborted'").withColumn("start_rollout_id", F.coalesce("start_rollout_id", F.lit(rollout_id)))
    return back.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.lit(0)))


def beginnings(texts: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key): every key (key) that begins a text. A text gives a row for each length that keys have, for an
    equi-join; the driver gets the distinct lengths."""
    lengths = sorted(r[0] for r in keys.select(F.length("key")).distinct().collect())
    starts = F.array(*[F.struct(F.lit(n).alias("n"), F.left(text_col, F.lit(n)).alias("key")) for n in lengths]) if lengths else F.array().cast("array<struct<n:int,key:string>>")
    cuts = texts.select(id_col, F.explode(F.filter(starts, lambda x: F.length(x["key"]) == x["n"])).alias("c"))
    return cuts.select(id_col, "c.n", "c.key").join(keys.select("key").distinct(), "key").select(id_col, "n", "key")


def drop_stale(cache: DataFrame, version: int, keep: int, most: int) -> DataFrame:
    """Entries (key, version) without those of version <= current - keep and all that lies below one of these.

    Only a cache of more than `most` entries is swept.
    """
    if cache.count() <= most:
        return cache
    old = cache.where(F.col("version") <= version - keep).select("key")
    below = beginnings(cache.select(F.col("key").alias("_k")).distinct(), old, "_k", "_k").select("_k").distinct()
    return cache.join(below, F.col("key") == F.col("_k"), "left_anti")


def longest_prefix(texts: DataFrame, cache: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key): the longest stored key that begins each text, null if none."""
    hit = beginnings(texts, cache, id_col, text_col).groupBy(id_col).agg(F.max(F.struct("n", "key")).alias("m"))
    return texts.select(id_col).join(hit, id_col, "left").select(id_col, F.col("m.key").alias("key"))


def next_coefficient(c: float, signal: float, rate: float = 0.05, low: float = 0.1, high: float = 10.0) -> float:
    """One update of the sign controller."""
    return min(max(c * (1 + rate * ((signal > 0) - (signal < 0))), low), high)


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time and type, on a batch or a stream. Beyond what online loops need: Spark's own."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def run_once(spark: SparkSession, stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through a streaming query, into Parquet below path: in complete mode the last batch's rows."""
    last = {}

    def put(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={i}")
        last["batch"] = i

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={last['batch']}" if mode == "complete" else f"{path}/rows")
