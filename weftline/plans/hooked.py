"""Hooks: places where a caller's function takes part, each with a small function of its own; online state by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.operators import hooks, metrics
from weftline.plans.common import shared_folder, table
from weftline.plans.scores import H, Z, halves
from weftline.streaming import keyed


def events(s, d):
    return table(s, d, "events")


def samples(s, d):
    """Events as samples of groups, by user."""
    e = events(s, d)
    return e.select("event_id", "user_id", F.col("value").alias("reward"), F.when(F.col("event_type") == "error", "aborted").otherwise("completed").alias("status"))


# Functions that stand for a caller's; queries name them by path, as a caller does.


def centred(rows):
    return metrics.group_norm(rows.withColumn("raw_reward", F.col("reward")), "user_id", "reward", False).withColumn("reward", F.col("advantage")).drop("advantage")


def as_rows(rows):
    n = (F.col("event_id") % 4 + 1).cast("int")
    return rows.select("event_id", F.sequence(F.lit(1), n).alias("tokens"), F.array_repeat(F.when(F.col("status") == "aborted", 0).otherwise(1), n).alias("loss_mask"))


def any_spread():
    return F.max("reward") > F.min("reward") + 50


def low_or_few():
    keep = (F.avg("reward") > 45) & (F.count("*") > 3)
    return F.struct(keep.alias("keep"), F.when(F.avg("reward") <= 45, "low").when(F.count("*") <= 3, "few").alias("reason"))


def largest_groups(buffer, n):
    big = buffer.groupBy("user_id").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "user_id").limit(n)
    return buffer.join(big.select("user_id"), "user_id", "left_semi")


def mark_low(rows):
    return rows.withColumn("remove_sample", F.col("reward") < 10)


def count_all(rows):
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def stamp(batch):
    return batch.withColumn("reward", F.round(F.col("reward") / 100, 6))


def told(prompts):
    return prompts.withColumns({"response": F.concat(F.lit("re: "), F.col("c_name")), "status": F.when(F.col("c_custkey") % 7 == 0, "truncated").otherwise("completed")})


def whole_rollout(prompts, rollout_id, evaluation):
    return told(prompts).withColumns({"reward": F.when(F.col("status") == "completed", 1.0).otherwise(0.0) + rollout_id, "evaluation": F.lit(evaluation)})


def hinge(log_ratio, advantage):
    return F.greatest(F.lit(0.0), 0.1 - log_ratio * advantage)


def squared_weight(new, old):
    return F.least(F.exp(2 * (new - old)), F.lit(4.0))


def quiet(rows):
    return True


P = "weftline.plans.hooked."


def reward_post(s, d):
    return hooks.post_process_rewards(P + "centred", samples(s, d)).select("event_id", "raw_reward", F.round("reward", 6).alias("reward"))


def convert(s, d):
    x = hooks.convert_samples(P + "as_rows", samples(s, d))
    return x.select("event_id", F.size("tokens").cast("long").alias("n"), F.aggregate("loss_mask", F.lit(0), lambda a, m: a + m).cast("long").alias("ones"))


def dynamic_filter(s, d):
    return hooks.dynamic_filter(P + "low_or_few", samples(s, d), "user_id")


def hook_compat(s, d):
    """A filter that gives a truth value alone, and none at all."""
    one = hooks.dynamic_filter(P + "any_spread", samples(s, d), "user_id")
    return one.join(hooks.dynamic_filter(None, samples(s, d), "user_id").select("user_id", F.col("keep").alias("kept_without")), "user_id").select("user_id", "keep", F.col("reason").isNull().alias("no_reason"), "kept_without")


def buffer_filter(s, d):
    a = hooks.buffered(P + "largest_groups", samples(s, d), 7, "event_id", "user_id").select("user_id", F.lit("largest").alias("rule"))
    b = hooks.buffered(None, samples(s, d), 7, "event_id", "user_id").select("user_id", F.lit("first").alias("rule"))
    return a.unionByName(b).groupBy("rule", "user_id").agg(F.count("*").alias("n"))


def sample_filter(s, d):
    x = hooks.filter_samples(P + "mark_low", samples(s, d))
    return x.groupBy("remove_sample").agg(F.count("*").alias("n"))


def all_samples(s, d):
    return hooks.see_all_samples(P + "count_all", samples(s, d))


def rollout_post(s, d):
    return hooks.post_process_rollout(P + "stamp", samples(s, d)).select("event_id", "reward")


def generated(s, d):
    return hooks.generate(P + "told", table(s, d, "customer").select("c_custkey", "c_name")).select("c_custkey", "response", "status")


def rolled_out(s, d):
    return hooks.rollout(P + "whole_rollout", table(s, d, "customer").select("c_custkey", "c_name"), 3, True).groupBy("status", "evaluation").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


def data_source(s, d):
    """Groups in order; two that come back are served first; the place is saved and loaded."""
    rows = table(s, d, "customer").select("c_custkey")
    src = hooks.TableSource(rows, "c_custkey")
    first = src.get(10)
    src.add(first.where("c_custkey % 5 = 0"))
    again = hooks.TableSource(rows, "c_custkey", returned=src.returned)
    again.load(src.save())
    second, third = again.get(6), again.get(4)
    tag = lambda df, k: df.select(F.lit(k).cast("long").alias("step"), "c_custkey")
    return tag(first, 0).unionByName(tag(second, 1)).unionByName(tag(third, 2))


def loss(s, d):
    return halves(s, d).select("vec_id", F.round(A.total(F.zip_with("pre", "post", lambda a, b: hooks.token_loss(P + "hinge", a, b))), 6).alias("loss"))


def weights(s, d):
    return halves(s, d).select("vec_id", F.round(A.total(F.zip_with("pre", "post", lambda a, b: hooks.token_loss(P + "squared_weight", a, b))), 6).alias("weight"))


def logged(s, d):
    """A function that takes over the log, one that doesn't, and none: how often the default was called."""
    m, called = samples(s, d).agg(F.avg("reward").alias("mean")), []
    out = [hooks.log(h, m, lambda rows: called.append(1)) for h in (P + "quiet", lambda rows: None, None)]
    return s.createDataFrame([(i, x, len(called)) for i, x in enumerate(out)], "hook long, default_called boolean, calls long")


def instruction_hook(s, d):
    """A reward of another library behind a name: here whether a text keeps to a number of words."""
    from weftline.functions import rewards

    r = rewards.reward_column("words", {"words": P + "keeps_words"})
    x = table(s, d, "conversations").select("conv_id", "turn", r(F.concat(F.lit('{"most":'), F.col("turn") * 20, F.lit("}")), "text", F.lit("")).alias("reward"))
    return x


def keeps_words(response, label, metadata) -> float:
    return float(len((response or "").split(" ")) <= metadata["most"])


def continued(s, d):
    """Chunks of samples from a stream of events, by user; the 20th of a user is the last one taken."""
    schema = events(s, d).schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    chunks = e.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("at"), F.floor("value").cast("long").alias("n"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("last"))
    out = keyed.latest_state(s, keyed.continue_generation(chunks), shared_folder(s, "grown"), "key", "chunks")
    return out.select("key", "tokens", F.round("total", 4).alias("total"), "chunks", "status")


def conversation(s, d):
    t = table(s, d, "conversations").withColumn("failure", F.when(F.col("text").contains("!!"), "shout").when(F.length("text") > 600, "length"))
    return keyed.conversations(t, "conv_id", "turn", "role", "failure", 6)


def trie_admin(s, d):
    """A cache of beginnings: its figures, what is left without a subtree, and entries newer than their parents."""
    docs = table(s, d, "documents")
    cache = docs.select(F.left("text", F.lit(5)).alias("key"), F.lit(4).cast("long").alias("version")).unionByName(docs.select(F.left("text", F.lit(15)).alias("key"), (F.col("doc_id") % 7).alias("version")))
    cache = cache.groupBy("key").agg(F.max("version").alias("version"))
    gone = cache.where(F.length("key") == 5).agg(F.min("key")).first()[0] or ""
    stats = keyed.cache_stats(cache, 30, 10, 5)
    left = keyed.remove_prefix(cache, gone).count()
    bad = keyed.version_problems(cache).count()
    return s.createDataFrame([(stats["entries"], stats["size"], stats["hit_rate"], left, bad)], "entries long, size long, hit_rate double, left_in long, newer long")


def adaptive_state(s, d):
    """A coefficient for each type of event, led on by each event's sign, in order."""
    w = A.adaptive_coefficients(F.transform("v", lambda x: x["x"]), 1.0, 0.05, 0.1, 10.0)
    part = F.floor(F.col("event_id") / 500)
    g = events(s, d).groupBy("event_type", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") - 50).alias("x")))).alias("v"))
    return g.select("event_type", "part", F.round(F.element_at(w, -1), 6).alias("coefficient"))


QUERIES = {
    "udf_reward_post": reward_post, "udf_convert": convert, "udf_dynamic_filter": dynamic_filter, "filter_hook_compat": hook_compat, "udf_buffer_filter": buffer_filter, "udf_sample_filter": sample_filter,
    "udf_all_samples": all_samples, "udf_rollout_post": rollout_post, "udf_generate": generated, "udf_rollout": rolled_out, "udf_data_source": data_source, "udf_loss": loss, "udf_tis": weights, "udf_log": logged,
    "rw_ifbench": instruction_hook, "st_continue_generation": continued, "st_conversation": conversation, "st_trie_admin": trie_admin, "st_adaptive_coef": adaptive_state,
}
SAMPLES = "WITH s AS (SELECT event_id, user_id, value AS reward, CASE WHEN event_type = 'error' THEN 'aborted' ELSE 'completed' END AS status FROM events)"
CACHE = "WITH c AS (SELECT key, max(version) AS version FROM (SELECT left(text, 5) AS key, 4::BIGINT AS version FROM documents UNION ALL SELECT left(text, 15), doc_id % 7 FROM documents) GROUP BY 1), g AS (SELECT min(key) FILTER (length(key) = 5) AS k FROM c)"
SQL = {
    "udf_reward_post": SAMPLES + " SELECT event_id, reward AS raw_reward, round(reward - avg(reward) OVER (PARTITION BY user_id), 6) AS reward FROM s",
    "udf_convert": SAMPLES + " SELECT event_id, event_id % 4 + 1 AS n, CASE WHEN status = 'aborted' THEN 0 ELSE event_id % 4 + 1 END::BIGINT AS ones FROM s",
    "udf_dynamic_filter": SAMPLES + " SELECT user_id, avg(reward) > 45 AND count(*) > 3 AS keep, CASE WHEN avg(reward) <= 45 THEN 'low' WHEN count(*) <= 3 THEN 'few' END AS reason FROM s GROUP BY 1",
    "filter_hook_compat": SAMPLES + " SELECT user_id, max(reward) > min(reward) + 50 AS keep, true AS no_reason, true AS kept_without FROM s GROUP BY 1",
    "udf_buffer_filter": SAMPLES + ", u AS (SELECT user_id, count(*) AS n, min(event_id) AS f FROM s GROUP BY 1) (SELECT 'largest' AS rule, user_id, n FROM u ORDER BY n DESC, user_id LIMIT 7) UNION ALL (SELECT 'first', user_id, n FROM u ORDER BY f LIMIT 7)",
    "udf_sample_filter": SAMPLES + " SELECT reward < 10 AS remove_sample, count(*) AS n FROM s GROUP BY 1",
    "udf_all_samples": SAMPLES + " SELECT status, count(*) AS n FROM s GROUP BY 1",
    "udf_rollout_post": SAMPLES + " SELECT event_id, round(reward / 100, 6) AS reward FROM s",
    "udf_generate": "SELECT c_custkey, 're: ' || c_name AS response, CASE WHEN c_custkey % 7 = 0 THEN 'truncated' ELSE 'completed' END AS status FROM customer",
    "udf_rollout": "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'truncated' ELSE 'completed' END AS status, true AS evaluation, count(*) AS n, sum(CASE WHEN c_custkey % 7 = 0 THEN 3.0::DOUBLE ELSE 4.0 END) AS reward FROM customer GROUP BY 1",
    "udf_data_source": "WITH o AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), f AS (SELECT k FROM o WHERE i < 10), b AS (SELECT k FROM f WHERE k % 5 = 0), n AS (SELECT count(*) AS n FROM b) SELECT 0::BIGINT AS step, k AS c_custkey FROM f UNION ALL SELECT 1, k FROM b UNION ALL SELECT 1, k FROM o, n WHERE i >= 10 AND i < 16 - n UNION ALL SELECT 2, k FROM o, n WHERE i >= 16 - n AND i < 20 - n",
    "udf_loss": H + f" SELECT vec_id, round({Z('greatest(0, 0.1 - A * B)')}, 6) AS loss FROM h",
    "udf_tis": H + f" SELECT vec_id, round({Z('least(exp(2 * (A - B)), 4)')}, 6) AS weight FROM h",
    "udf_log": "SELECT unnest([0, 1, 2])::BIGINT AS hook, unnest([false, true, true]) AS default_called, 2::BIGINT AS calls",
    "rw_ifbench": "SELECT conv_id, turn, (len(string_split(text, ' ')) <= turn * 20)::INT::DOUBLE AS reward FROM conversations",
    "st_continue_generation": "WITH e AS (SELECT *, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS z FROM events) SELECT user_id::BIGINT AS key, sum(floor(value))::BIGINT AS tokens, round(sum(value), 4) AS total, count(*) AS chunks, CASE WHEN any_value(z) IS NULL THEN 'pending' ELSE 'completed' END AS status FROM e WHERE z IS NULL OR event_id <= z GROUP BY 1",
    "st_conversation": "WITH t AS (SELECT *, CASE WHEN contains(text, '!!') THEN 'shout' WHEN length(text) > 600 THEN 'length' END AS f FROM conversations), z AS (SELECT *, min(turn) FILTER (f IS NOT NULL) OVER (PARTITION BY conv_id) AS z FROM t) SELECT conv_id, count(*) AS turns, CASE WHEN max(f) IS NOT NULL THEN 'failed_' || max(f) WHEN count(*) > 6 THEN 'too_long' WHEN arg_max(role, turn) = 'assistant' THEN 'answered' ELSE 'open' END AS outcome FROM z WHERE z IS NULL OR turn <= z GROUP BY 1",
    "st_trie_admin": CACHE + ", p AS (SELECT c.key, arg_max(o.version, length(o.key)) AS pv, any_value(c.version) AS v FROM c JOIN c o ON length(o.key) < length(c.key) AND starts_with(c.key, o.key) GROUP BY 1) SELECT count(*) AS entries, sum(length(key))::BIGINT AS size, 0.75::DOUBLE AS hit_rate, count(*) FILTER (NOT starts_with(key, (SELECT k FROM g))) AS left_in, (SELECT count(*) FROM p WHERE v > pv) AS newer FROM c",
    "st_adaptive_coef": "WITH g AS (SELECT event_type, event_id // 500 AS part, list(value ORDER BY event_id) AS v FROM events GROUP BY 1, 2) SELECT event_type, part, round(list_reduce(list_prepend(1.0::DOUBLE, v), lambda a, x: least(greatest(a * (1 + 0.05 * sign(x - 50)), 0.1), 10.0)), 6) AS coefficient FROM g",
}
