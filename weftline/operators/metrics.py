"""Measures of grouped rows: distributions, percentiles, rewards by group, trials, paired intervals."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import arrays


def nearest_rank(col: str, p: float) -> Column:
    """The element at ceil(p * n) of the sorted values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")


def floor_rank(values: Column, q: float) -> Column:
    """The element at min(n, int(q * n) + 1) of the sorted array: another rule than the nearest rank."""
    return F.element_at(F.array_sort(values), F.least(F.size(values), F.floor(F.size(values) * q).cast("int") + 1))


def exact_rank(rows: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """(key, name): floor_rank of each key's values by counts of equal ones, so that no task holds a key's values."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    n = n.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    place = F.least("_all", F.floor(F.col("_all") * q) + 1)
    return n.where(F.col("_upto") >= place).groupBy(key).agg(F.min(value).alias(name))


def mixture_problems(parts: DataFrame, mix: str, name: str, weight: str, rows: str, group: int) -> DataFrame:
    """(mix, problems) of each mixture: `weights` that don't sum to one within 1e-9, `names` that repeat, `groups` that rows
    don't fill, and `unequal` numbers of rows."""
    by = parts.groupBy(mix).agg(F.abs(F.sum(weight) - 1).alias("_w"), (F.count(name) - F.countDistinct(name)).alias("_d"), F.count_if(F.col(rows) % group != 0).alias("_b"), F.countDistinct(rows).alias("_k"))
    codes = F.array(F.when(F.col("_w") > 1e-9, "weights"), F.when(F.col("_d") > 0, "names"), F.when(F.col("_b") > 0, "groups"), F.when(F.col("_k") > 1, "unequal"))
    return by.select(mix, F.array_join(F.array_sort(F.filter(codes, lambda x: x.isNotNull())), ",").alias("problems"))


def distribution(rows: DataFrame, kind: str, kinds: DataFrame) -> DataFrame:
    """(kind, n, pct) with all of `kinds`, zero for those that don't occur."""
    n = rows.groupBy(kind).agg(F.count("*").alias("n"))
    out = kinds.join(n, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))
    all_rows = rows.agg(F.count("*").alias("_all"))
    return out.crossJoin(all_rows).select(kind, "n", F.round(F.when(F.col("_all") > 0, 100 * F.col("n") / F.col("_all")).otherwise(0.0), 4).alias("pct"))


def length_stats(col: str, limits: list[int]) -> list[Column]:
    """Count, percentiles, greatest, mean, and for each limit how many fit and their share."""
    out = [F.count(col).alias("n")]
    out += [nearest_rank(col, p / 100).alias(f"p{p}") for p in (50, 75, 90, 95, 99)]
    out += [F.max(col).alias("max_len"), F.round(F.avg(col), 2).alias("mean_len")]
    for m in limits:
        out += [F.count_if(F.col(col) <= m).alias(f"le_{m}"), F.round(100 * F.count_if(F.col(col) <= m) / F.count(col), 4).alias(f"le_{m}_pct")]
    return out


def retention(rows: DataFrame, col: str, stratum: str, limits: list[int]) -> DataFrame:
    """Per limit and stratum: kept, share kept, share of the stratum before and after, and the shift in points."""
    by = rows.groupBy(stratum).agg(F.count("*").alias("n"), *[F.count_if(F.col(col) <= m).alias(f"k{m}") for m in limits])
    long = by.select(stratum, "n", F.explode(F.array(*[F.struct(F.lit(m).alias("max_len"), F.col(f"k{m}").alias("kept")) for m in limits])).alias("x")).select(stratum, "n", "x.max_len", "x.kept")
    w = Window.partitionBy("max_len")
    shift = 100 * F.col("kept") / F.sum("kept").over(w) - 100 * F.col("n") / F.sum("n").over(w)
    return long.select("max_len", stratum, "n", "kept", F.round(F.col("kept") / F.col("n"), 6).alias("share"), F.round(shift, 6).alias("shift_pp"))


def group_norm(rows: DataFrame, group: str, reward: str, scale: bool) -> DataFrame:
    """rows with the reward less its group's mean, over the sample deviation plus 1e-6 if scale."""
    w = Window.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(w)
    return rows.withColumn("advantage", centred / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-6) if scale else centred)


def spread_filter(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Per group whether rewards differ, and the reason if not. One row has no deviation and is dropped."""
    g = rows.groupBy(group).agg(F.stddev_samp(reward).alias("s"), F.min(reward).alias("r"))
    keep = F.coalesce(F.col("s") > 0, F.lit(False))
    return g.select(group, keep.alias("keep"), F.when(~keep, F.concat(F.lit("zero_std_"), F.round("r", 1).cast("string"))).alias("reason"))


def whiten(rows: DataFrame, value: str, mask: str) -> DataFrame:
    """rows with (x - mean) * rsqrt(var + 1e-8) by the masked rows' mean and sample variance; an error without any."""
    m = F.col(mask).cast("double")
    stats = rows.agg(F.sum(m).alias("_n"), F.sum(m * F.col(value)).alias("_s"), F.sum(m * F.col(value) * F.col(value)).alias("_q"))
    n = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.raise_error(F.lit("the mask holds nowhere")).cast("double"))
    mean = F.col("_s") / n
    var = (F.col("_q") / n - mean * mean) * F.when(F.col("_n") >= 2, F.col("_n") / (F.col("_n") - 1)).otherwise(1.0)
    return rows.crossJoin(F.broadcast(stats)).withColumn("whitened", (F.col(value) - mean) / F.sqrt(F.greatest(var, F.lit(0.0)) + 1e-8)).drop("_n", "_s", "_q")


def pass_table(trials: DataFrame, task: str, ok: Column, ks: list[int]) -> DataFrame:
    """(k, pass_at_k, pass_hat_k, tasks): means over the tasks with k trials or more."""
    by = trials.groupBy(task).agg(F.count("*").alias("n"), F.count_if(ok).alias("c"))
    by = by.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where("k <= n")
    at, hat = arrays.pass_at_k(F.col("n"), F.col("c"), F.col("k")), arrays.pass_hat_k(F.col("n"), F.col("c"), F.col("k"))
    return by.groupBy("k").agg(F.round(F.avg(at), 6).alias("pass_at_k"), F.round(F.avg(hat), 6).alias("pass_hat_k"), F.count("*").alias("tasks"))


def paired_delta(base: DataFrame, other: DataFrame, task: str, score: str) -> DataFrame:
    """(task, delta) of the tasks in both."""
    return base.select(task, F.col(score).alias("_a")).join(other.select(task, F.col(score).alias("_b")), task).select(task, (F.col("_b") - F.col("_a")).alias("delta"))


def bootstrap_interval(deltas: list[float], draws: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """Mean and the 2.5 % and 97.5 % points of resampled means, of a list that is one number for each task."""
    if not deltas:
        raise ValueError("no task is in both")
    rng, n = random.Random(seed), len(deltas)
    means = sorted(sum(rng.choices(deltas, k=n)) / n for _ in range(draws))
    return sum(deltas) / n, means[int(0.025 * draws)], means[min(draws - 1, int(0.975 * draws))]


def summary(events: DataFrame, code: str, row: str, samples: int = 5) -> DataFrame:
    """Per code: events, distinct rows, and the first row ids.

    Rows of a code are combined in 1024 shares first, of which each hands on its first ids, so no task holds all of them.
    """
    once = events.groupBy(code, row).agg(F.count("*").alias("_n"))
    first = lambda c: F.slice(F.array_sort(c), 1, samples)
    shares = once.groupBy(code, F.pmod(F.xxhash64(row), F.lit(1024)).alias("_share")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_r"), first(F.collect_list(row)).alias("_f"))
    return shares.groupBy(code).agg(F.sum("_n").alias("n_events"), F.sum("_r").alias("n_rows"), F.array_join(first(F.flatten(F.collect_list("_f"))), ",").alias("samples"))


def timer_report(timers: DataFrame, flops: float, tokens: int) -> DataFrame:
    """(name, value): the seconds of each timer, and what follows from them; a rate without its timer, or of none, is left out."""
    sums = timers.groupBy("name").agg(F.sum("seconds").alias("v"))
    wide = sums.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("actor_train", "log_probs", "ref_log_probs", "train", "train_wait")])
    trained = F.col("actor_train").isNotNull()
    both = F.col("train_wait") + F.col("train")
    rate = lambda x, n: F.when(F.col(n) > 0, x / F.col(n))
    found = {
        "log_probs_tflops": F.when(trained, rate(F.lit(flops), "log_probs")), "ref_log_probs_tflops": F.when(trained, rate(F.lit(flops), "ref_log_probs")), "actor_train_tflops": rate(F.lit(3 * flops), "actor_train"),
        "actor_train_tok_per_s": rate(F.lit(float(tokens)), "actor_train"), "step_time": F.when(both > 0, both), "wait_time_ratio": F.when(both > 0, F.col("train_wait") / both),
    }
    derived = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in found.items()])).alias("x")).select("x.*").where("value is not null")
    return sums.select(F.concat("name", F.lit("_time")).alias("name"), F.col("v").alias("value")).unionByName(derived)


def top_names(rows: DataFrame, name: str, order: str, n: int = 30) -> DataFrame:
    """The most frequent names; of equal counts the one seen first."""
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(n).drop("_first")
