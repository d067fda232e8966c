"""Rollout and score rows: completions, scoring, samples and their records, returns and losses of tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import samples as S
from weftline.functions import text as T
from weftline.operators import metrics, prompts, select
from weftline.plans.common import table
from weftline.plans.scores import H, halves


def docs(s, d):
    return table(s, d, "documents")


def events(s, d):
    return table(s, d, "events")


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def r6(c):
    return F.round(c, 6)


def completions(s, d):
    """Eight positions with eight candidates each."""
    entries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.struct(c.alias("token"), (-F.abs(F.get("v", p * 8 + c))).alias("log_prob"))))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.pmod(F.col("vec_id") + p, F.lit(8)).cast("int"))
    rows = vectors(s, d).select("vec_id", S.completion(tokens, entries, 4).alias("c"))
    return rows.select(
        "vec_id", F.array_join(F.flatten("c.candidate_ids"), ",").alias("ids"), r6(A.total(F.flatten("c.behavior_topk_log_probs"))).alias("scores"), r6(A.total(F.col("c.behavior_sampled_log_probs"))).alias("sampled"),
        F.aggregate("c.loss_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"), S.sample_id(F.lit("r1"), F.col("vec_id"), F.lit(0), F.lit("cfg")).alias("sample_id"),
    )


COMPLETIONS = """
WITH x AS (SELECT vec_id, p, c, -abs(embedding[8 * p + c + 1]::DOUBLE) AS lp FROM embeddings, (SELECT unnest(range(8)) AS p), (SELECT unnest(range(8)) AS c)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY lp DESC, c) AS k FROM x)
SELECT vec_id, string_agg(c::VARCHAR, ',' ORDER BY p, k) FILTER (k <= 4) AS ids, round(sum(lp) FILTER (k <= 4), 6) AS scores, round(sum(lp) FILTER (c = (vec_id + p) % 8), 6) AS sampled, 8::BIGINT AS ones,
  sha256('{"generation_config_hash":"cfg","prompt_id":' || vec_id || ',"response_index":0,"student_revision":"r1"}') AS sample_id
FROM r GROUP BY vec_id
"""


def scoring(s, d):
    """Prompts of 1 to 5 tokens, responses of 1 to 7."""
    prompt, response = F.sequence(F.lit(1), F.pmod("vec_id", F.lit(5)).cast("int") + 1), F.sequence(F.lit(100), F.pmod("vec_id", F.lit(7)).cast("int") + 100)
    p = vectors(s, d).select("vec_id", S.scoring_prefix(prompt, response).alias("p"))
    whole = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v).cast("long")
    return p.select("vec_id", F.size("p.context").cast("long").alias("n"), whole("p.context").alias("total"), F.element_at("p.positions", 1).cast("long").alias("first"), F.element_at("p.positions", -1).cast("long").alias("last"), whole(F.flatten("p.targets")).alias("targets"))


SCORING = """
WITH l AS (SELECT vec_id, vec_id % 5 + 1 AS p, vec_id % 7 + 1 AS r FROM embeddings)
SELECT vec_id, p + r - 1 AS n, (p * (p + 1) // 2 + 100 * (r - 1) + (r - 1) * (r - 2) // 2)::BIGINT AS total, p - 1 AS first, p + r - 2 AS last, (100 * r + r * (r - 1) // 2)::BIGINT AS targets FROM l
"""


def precomputed(s, d):
    """Customers as samples, some with a mask, scores or flags of their own."""
    k = F.col("c_custkey")
    n = F.pmod(k, F.lit(6)).cast("int")
    meta = F.struct(
        F.when(k % 2 == 0, True).alias("is_precomputed"), F.when(k % 7 == 0, True).alias("is_offline"), F.lit(None).cast("boolean").alias("is_offline_scored"),
        F.when(k % 5 != 0, F.array_repeat(F.lit(9), n)).alias("response_tokens"), F.when(k % 3 == 0, F.array_repeat(F.lit(0), F.when(k % 5 != 0, n).otherwise(0))).alias("loss_mask"),
        F.when(k % 4 == 0, "text").alias("response"), F.when(k % 4 == 1, F.array_repeat(F.lit(-0.5), n)).alias("student_log_probs"),
    )
    rows = table(s, d, "customer").select(k, meta.alias("m")).where(S.is_precomputed(F.col("m")))
    x = rows.select(k, S.precomputed(F.sequence(F.lit(1), F.pmod(k, F.lit(4)).cast("int") + 1), F.col("m")).alias("x"))
    return x.select("c_custkey", F.size("x.tokens").cast("long").alias("n"), F.aggregate("x.loss_mask", F.lit(0), lambda a, v: a + v).cast("long").alias("ones"), F.col("x.response_length").cast("long").alias("length"), "x.response", "x.status", F.col("x.rollout_log_probs").isNotNull().alias("scored"))


PRECOMPUTED = """
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 6 ELSE 0 END AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 = 0)
SELECT k AS c_custkey, k % 4 + 1 + n AS n, CASE WHEN k % 3 = 0 THEN 0 ELSE n END::BIGINT AS ones, n AS length, CASE WHEN k % 4 = 0 THEN 'text' ELSE '' END AS response, 'completed' AS status, k % 4 = 1 AS scored FROM r
"""


def score_rows(s, d):
    """Rows with metadata: four tokens, two candidates a token."""
    pair = lambda at: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.array(F.get("v", t * 2 + at), F.get("v", t * 2 + at + 1)))
    meta = F.struct(
        F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("sample_id"), F.array(F.lit(1), F.lit(2)).alias("prompt_tokens"), F.array(*[F.lit(x) for x in (5, 6, 7, 8)]).alias("response_tokens"),
        F.transform(F.slice("v", 1, 4), lambda x: (x > 0).cast("int")).alias("loss_mask"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.array(t, t + 1)).alias("candidate_ids"),
        pair(0).alias("behavior_topk_log_probs"), pair(8).alias("post_teacher_log_probs"), pair(16).alias("pre_teacher_log_probs"), F.slice("v", 33, 4).alias("student_ref_sampled_log_probs"), F.slice("v", 41, 4).alias("behavior_sampled_log_probs"),
        F.lit("r0").alias("pre_teacher_revision"), F.lit("r0").alias("post_teacher_revision"),
    )
    return vectors(s, d).select("vec_id", meta.alias("metadata"))


def attached(s, d):
    rows = S.attach_fields(score_rows(s, d))
    return rows.select("vec_id", "metadata.sample_id", F.lit(",".join(rows.schema["metadata"].dataType.names)).alias("left_in"), F.size("candidate_ids").cast("long").alias("n"), r6(A.total(F.col("rollout_log_probs"))).alias("rollout"), r6(A.total(F.flatten("post_teacher_log_probs"))).alias("post"))


def replaced(s, d):
    """Scores of two anchors composed into one row's metadata, the masks intersected."""
    m = F.col("metadata")
    delta = F.zip_with(m["post_teacher_log_probs"], m["pre_teacher_log_probs"], lambda a, b: F.zip_with(a, b, lambda x, y: x - y))
    post, pre = F.transform(delta, lambda r: F.transform(r, lambda x: F.least(x, F.lit(0.0)))), F.transform(delta, lambda r: F.transform(r, lambda x: F.least(-x, F.lit(0.0))))
    mask = F.zip_with(m["loss_mask"], F.array(*[F.lit(x) for x in (1, 1, 0, 1)]), lambda a, b: a * b)
    x = score_rows(s, d).select("vec_id", S.replace_scores(m, pre, post, mask, "composed").alias("m"))
    return x.select("vec_id", "m.sample_id", "m.pre_teacher_revision", r6(A.total(F.flatten("m.post_teacher_log_probs"))).alias("post"), r6(A.total(F.flatten("m.pre_teacher_log_probs"))).alias("pre"), F.aggregate("m.loss_mask", F.lit(0), lambda a, v: a + v).cast("long").alias("ones"))


def merged(s, d):
    """One teacher's scores from another table, all else as it was."""
    other = score_rows(s, d).where("vec_id % 3 <> 0").withColumn("metadata", F.col("metadata").withField("post_teacher_log_probs", F.col("metadata.pre_teacher_log_probs")).withField("post_teacher_revision", F.lit("r9")))
    x = S.merged_scores(score_rows(s, d), other, "vec_id", "post")
    return x.select("vec_id", F.col("metadata.post_teacher_revision").alias("post_revision"), F.col("metadata.pre_teacher_revision").alias("pre_revision"), r6(A.total(F.flatten("metadata.post_teacher_log_probs"))).alias("post"))


def records(s, d):
    """Samples to JSON and back."""
    k = F.col("c_custkey")
    status = F.get(F.array(*map(F.lit, S.STATUSES)), F.pmod(k, F.lit(5)).cast("int"))
    text = S.record(status, S.speculation(k % 3, k % 4, k % 2, F.lit(10)), index=k, response=F.col("c_name"))
    x = table(s, d, "customer").select("c_custkey", S.from_record(text, "index:bigint,response:string").alias("x"), S.from_record(F.lit('{"index":1,"status":"failed"}'), "index:bigint,response:string").alias("y"))
    return x.select("c_custkey", "x.index", "x.response", "x.status", r6(F.col("x.spec_info.spec_accept_rate")).alias("rate"), F.col("x.spec_info.spec_accept_length").alias("length"), F.col("y.spec_info.spec_draft_token_num").cast("long").alias("missing"))


def generated(s, d):
    g = vectors(s, d).select("vec_id", S.generated(F.transform(F.slice("v", 1, 5), lambda x, i: F.struct(x.alias("log_prob"), (i * 3).alias("token")))).alias("g"))
    return g.select("vec_id", F.array_join("g.tokens", ",").alias("tokens"), r6(A.total(F.col("g.log_probs"))).alias("total"))


def aligned(s, d):
    m = S.aligned_mask(F.transform(F.slice("v", 1, 10), lambda x: (x > 0).cast("int")), F.lit(16))
    return vectors(s, d).select("vec_id", F.size(m).cast("long").alias("n"), F.aggregate(m, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"), F.array_position(m, 1).cast("long").alias("first"))


def sequence_kl(s, d):
    x = S.sequence_kl(F.col("pre"), F.col("post"), F.transform("pre", lambda v: (v > 0).cast("int")))
    return halves(s, d).select("vec_id", F.size(x).cast("long").alias("n"), r6(F.element_at(x, 1)).alias("first"), r6(F.element_at(x, -1)).alias("last"))


def token_returns(s, d):
    r, m = F.col("label").cast("double"), F.transform("pre", lambda v: F.lit(1))
    x = halves(s, d)
    return x.select("vec_id", r6(A.total(S.flat_returns(r, F.col("post")))).alias("flat"), r6(A.total(S.penalised_returns(r, F.col("post"), 0.1))).alias("penalised"), r6(F.element_at(S.discounted_penalised(r, F.col("post"), m, 0.1, 0.9), 1)).alias("discounted"))


def distilled(s, d):
    return halves(s, d).select("vec_id", r6(A.total(S.distillation(F.col("post"), F.slice("pre", 1, 8)))).alias("total"))


def policy_metrics(s, d):
    """Sums over samples of masked means: loss, clipped share, divergence; weights and differences over all masked tokens."""
    one = lambda k: F.zip_with("pre", "post", lambda a, b: A.policy_loss(a - b, b, 0.2, 0.28)[k])
    x = halves(s, d).withColumn("m", F.transform("pre", lambda v: (v > 0).cast("int")))
    mean = lambda v: A.masked_mean(v, F.col("m"))
    rows = x.select(mean(one(0)).alias("loss"), mean(one(1)).alias("clip"), mean(F.zip_with("pre", "post", lambda a, b: b - a)).alias("kl"), F.explode_outer(F.filter(F.arrays_zip("pre", "post"), lambda z: z["pre"] > 0)).alias("z"), F.monotonically_increasing_id().alias("i"))
    w = F.exp(F.col("z.pre") - F.col("z.post"))
    tokens = rows.agg(F.round(F.avg(w), 6).alias("weight_mean"), F.round(F.stddev_pop(w), 6).alias("weight_std"), F.round(F.avg(F.abs(F.col("z.pre") - F.col("z.post"))), 6).alias("abs_diff"))
    sums = x.agg(F.round(F.sum(mean(one(0))), 4).alias("loss"), F.round(F.sum(mean(one(1))), 4).alias("clipped"), F.round(F.sum(mean(F.zip_with("pre", "post", lambda a, b: b - a))), 4).alias("kl"))
    return sums.crossJoin(F.broadcast(tokens))  # a row each


def trainable(s, d):
    mask = F.when(F.col("label") != 3, F.transform("embedding", lambda x: (x > 0).cast("int")))
    return table(s, d, "embeddings").select(mask.alias("m")).agg(F.coalesce(F.sum(F.aggregate("m", F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("long").alias("tokens"))


def rewarded(s, d):
    """Eight tokens with four candidates each: pre as the model's scores, post and half of pre as the teachers'."""
    grid = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(c, t * 4 + 1, 4))
    got = A.reward_sum_count(grid("pre"), grid("post"), F.transform(grid("pre"), lambda r: F.transform(r, lambda x: x / 2)), F.transform(F.slice("post", 1, 8), lambda x: x > 0))
    return halves(s, d).select("vec_id", got.alias("g")).select("vec_id", F.col("g.total").alias("total"), F.col("g.n").alias("n"))


def reward_sum_count(s, d):
    return rewarded(s, d).select("vec_id", r6("total").alias("total"), "n")


def adaptive_reward(s, d):
    """The whole rollout's mean reward, and the coefficient that its sign leads to."""
    from weftline.streaming.rollout import next_coefficient

    x = rewarded(s, d).agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    mean = F.col("t") / F.greatest("n", F.lit(1))
    up, down = next_coefficient(1.0, 1.0), next_coefficient(1.0, -1.0)
    return x.select(F.round(mean, 6).alias("mean"), F.when(mean > 0, up).when(mean < 0, down).otherwise(1.0).alias("coefficient"))


REWARDED = H + """, x AS (SELECT vec_id, t, pre[4 * t + k + 1] AS a, post[4 * t + k + 1] - pre[4 * t + k + 1] / 2 AS dl, post[t + 1] > 0 AS m FROM h, (SELECT unnest(range(8)) AS t), (SELECT unnest(range(4)) AS k)),
w AS (SELECT *, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id, t) AS w FROM x),
g AS (SELECT vec_id, coalesce(sum(w * dl) FILTER (m), 0) AS total, count(*) FILTER (m) AS n FROM w GROUP BY vec_id) """


def dp_mean(s, d):
    by = events(s, d).groupBy((F.col("event_id") % 4).alias("rank")).agg(F.avg("value").alias("m"))
    return by.agg(r6(F.avg("m")).alias("mean"), F.count("*").alias("ranks"))


def timers(s, d):
    """Timers by name, and the rates that follow from them."""
    names = {"click": "actor_train", "view": "log_probs", "purchase": "train_wait", "error": "train"}
    e = events(s, d).where(F.col("event_type").isin(*names)).withColumn("name", F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("event_type")))
    return metrics.timer_report(e.select("name", F.col("value").alias("seconds")), flops=1e6, tokens=5000).select("name", F.round("value", 4).alias("value"))


def problems(s, d):
    e = events(s, d).withColumns({"problem": F.floor(F.col("event_id") / 10), "score": (F.col("event_type") == "purchase").cast("double")})
    return prompts.problem_results(e, "problem", "event_id", "score", "event_type", 10, strict=False).select("problem", r6("score").alias("score"), "samples", "response", "complete")


def first_seen(s, d):
    g = prompts.first_seen_groups(events(s, d), "event_type", "event_id", "value")
    return g.select("place", "event_type", F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("first"))


def seeds(s, d):
    got = prompts.trial_seeds(300, 6)
    return s.range(len(got)).select(F.col("id").alias("trial"), F.get(F.array(*[F.lit(x) for x in got]), F.col("id").cast("int")).alias("seed"))


def chosen_checkpoints(s, d):
    """The iterations that a list names, in its order; there is one for each nation."""
    have = [r[0] for r in table(s, d, "nation").select((F.col("n_nationkey") * 5).alias("i")).collect()]  # a fixed table of 25
    got = prompts.checkpoints(have, "20, 5,115")
    rest = prompts.checkpoints(have, "all")
    return s.createDataFrame([(i, x, len(rest)) for i, x in enumerate(got)], "place long, iteration long, available long")


def periodic(s, d):
    return s.range(40).select(F.col("id").alias("rollout"), prompts.periodic(F.col("id"), 7).alias("plain"), prompts.periodic(F.col("id"), 7, 10, 37).alias("epochs"), prompts.periodic(F.col("id"), None).alias("never"))


def training_budget(s, d):
    rows = [("steps", *prompts.budget(128, 32, steps=400)), ("rollouts", *prompts.budget(128, 32, rollouts=100))]
    return s.createDataFrame(rows, "given string, rollouts long, steps long")


def prepared(s, d):
    """Prompts of 200 words at most, the first 100 of them; the place counts all rows."""
    rows = docs(s, d).select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.struct(F.col("lang").alias("ground_truth"))).alias("label"))
    x = prompts.prepare(rows, ["doc_id"], "text", "label", lambda c: F.split(c, " ", -1), 200, 100)
    return x.select("prompt_id", F.size("tokens").cast("long").alias("n"), "label")


def flattened(s, d):
    return score_rows(s, d).select("vec_id", "metadata.*").select("vec_id", "sample_id", F.size("candidate_ids").cast("long").alias("n"), "pre_teacher_revision")


def train_columns(s, d):
    """The training file has no targets."""
    rows = docs(s, d).select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("target"), F.col("source").alias("answer"))
    rows = rows.select(*[c for c in rows.columns if c not in ("target", "answer")])
    return rows.select("doc_id", F.lit(",".join(rows.columns)).alias("columns"), F.length("prompt").cast("long").alias("n"))


def final_order(s, d):
    return select.ordinals(docs(s, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"], "place")


def cluster_heads(s, d):
    """Of each cluster the row with the fewest tokens, then the least text, then the least id."""
    n = F.size(T.norm_tokens(F.col("text")))
    x = docs(s, d).groupBy("lang", (F.col("doc_id") % 5).alias("part")).agg(F.min(F.struct(n.alias("n"), "text", "doc_id")).alias("m"))
    return x.select("lang", "part", "m.doc_id", F.col("m.n").cast("long").alias("n"))


def sentinel(s, d):
    """Rows with precomputed scores need no reward: a constant for all of them."""
    return events(s, d).select("event_id", F.lit(0.0).alias("reward"))


def verified_mean(s, d):
    """Mean reward of several responses to one problem."""
    from weftline.functions import rewards

    t = table(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    r = F.concat(F.lit("\\boxed{"), (F.col("c_custkey") + F.col("k") % 2).cast("string"), F.lit("}"))
    return t.select("c_custkey", rewards.py_reward(F.lit("math"), r, F.col("c_custkey").cast("string")).alias("x")).groupBy("c_custkey").agg(F.avg("x").alias("reward"))


def no_nulls(s, d):
    """Entries that are null take no part in a mean."""
    v = F.when(F.col("value") >= 10, F.col("value"))
    lists = events(s, d).groupBy("user_id").agg(F.collect_list(F.struct(v.alias("v"))).alias("l"))
    kept = F.filter(F.transform("l", lambda x: x["v"]), lambda x: x.isNotNull())
    return lists.select("user_id", F.size(kept).cast("long").alias("n"), r6(A.total(kept) / F.greatest(F.size(kept), F.lit(1))).alias("mean"))


def fast_check(s, d):
    """Shapes alone: rows whose arrays have the response's length, and the first row of candidates the wanted width."""
    m = F.col("metadata")
    bad = F.when(F.size(m["loss_mask"]) != F.size(m["response_tokens"]), "length").when(F.size(F.get(m["candidate_ids"], F.lit(0))) != F.when(F.col("vec_id") % 9 == 0, 3).otherwise(2), "width")
    return score_rows(s, d).select("vec_id", F.coalesce(bad, F.lit("")).alias("problem"))


def episodes(s, d):
    e = events(s, d).select("user_id", "event_id", F.floor("value").cast("long").alias("tokens"), (F.col("event_type").isin("error", "view")).alias("failed"))
    return prompts.episodes(e, "user_id", "event_id", "tokens", "failed", 400, 9)


EPISODES = """
WITH e AS (SELECT user_id, event_id, floor(value)::BIGINT AS t, (event_type IN ('error', 'view'))::INT AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
u AS (SELECT *, sum(t) OVER w AS c, f + lag(f) OVER w + lag(f, 2) OVER w AS f3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT *, min(CASE WHEN c >= 400 OR f3 = 3 OR n >= 9 THEN n END) OVER (PARTITION BY user_id) AS z FROM u)
SELECT user_id, count(*) AS steps, least(max(c), 400)::BIGINT AS tokens, CASE WHEN max(c) >= 400 THEN 0 ELSE max(c) END::BIGINT AS trained, CASE WHEN max(c) >= 400 THEN 'truncated' ELSE 'completed' END AS status FROM z WHERE z IS NULL OR n <= z GROUP BY 1
"""


def fanned(s, d):
    """Each prompt four times with seeds from a base; a group's reward is its samples' mean."""
    x = prompts.fan_out(table(s, d, "customer").select("c_custkey"), 4, 1000).withColumn("r", (F.col("c_custkey") * 7 + F.col("index")) % 5)
    return x.withColumn("group_reward", F.avg("r").over(Window.partitionBy("c_custkey"))).select("c_custkey", F.col("index").cast("long").alias("index"), F.col("sampling_seed").cast("long").alias("seed"), r6("group_reward").alias("group_reward"))


def routed(s, d):
    """Ten requests to servers that have some open ones."""
    got = prompts.least_loaded({"a": 2, "b": 0, "c": 1}, 10)
    return s.createDataFrame([(i, x) for i, x in enumerate(got)], "request long, server string")


QUERIES = {
    "proj_completion": completions, "proj_scoring_prefix": scoring, "proj_precomputed_sample": precomputed, "proj_attach_fields": attached, "proj_replace_scores": replaced, "join_metadata_scores": merged,
    "proj_sample_dict": records, "fn_generated_tokens": generated, "fn_multimodal_align": aligned, "fn_gspo_kl": sequence_kl, "fn_returns": token_returns, "win_distill_advantage": distilled, "fn_policy_metrics": policy_metrics,
    "agg_trainable_tokens": trainable, "agg_reward_sum_count": reward_sum_count, "agg_adaptive_reward": adaptive_reward, "agg_dp_mean": dp_mean, "agg_perf_timers": timers, "agg_problem_result": problems, "agg_group_by": first_seen,
    "sample_trial_seeds": seeds, "select_checkpoints": chosen_checkpoints, "fn_periodic": periodic, "fn_training_budget": training_budget, "proj_prepare_prompts": prepared, "proj_flatten_struct": flattened,
    "proj_train_columns_only": train_columns, "sort_final": final_order, "sort_cluster_rep": cluster_heads, "rw_opd_sentinel": sentinel, "rw_math_verify": verified_mean, "filter_null_list_entries": no_nulls,
    "pred_sealed_row_fast": fast_check, "st_env_rollout": episodes, "st_group_generate": fanned, "st_least_loaded": routed,
}
V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
SQL = {
    "proj_completion": COMPLETIONS,
    "proj_scoring_prefix": SCORING,
    "proj_precomputed_sample": PRECOMPUTED,
    "proj_attach_fields": V + " SELECT vec_id, 's' || vec_id AS sample_id, 'sample_id,pre_teacher_revision,post_teacher_revision' AS left_in, 4::BIGINT AS n, round(list_sum(v[41:44]), 6) AS rollout, round(list_sum(v[9:16]), 6) AS post FROM v",
    "proj_replace_scores": V + ", x AS (SELECT *, list_transform(range(1, 9), lambda i: v[8 + i] - v[16 + i]) AS d FROM v) SELECT vec_id, 's' || vec_id AS sample_id, 'composed' AS pre_teacher_revision, round(list_sum(list_transform(d, lambda x: least(x, 0))), 6) AS post, round(list_sum(list_transform(d, lambda x: least(-x, 0))), 6) AS pre, ((v[1] > 0)::INT + (v[2] > 0)::INT + (v[4] > 0)::INT)::BIGINT AS ones FROM x",
    "join_metadata_scores": V + " SELECT vec_id, 'r9' AS post_revision, 'r0' AS pre_revision, round(list_sum(v[17:24]), 6) AS post FROM v WHERE vec_id % 3 <> 0",
    "proj_sample_dict": "SELECT c_custkey, c_custkey AS index, c_name AS response, (['pending', 'completed', 'truncated', 'aborted', 'failed'])[c_custkey % 5 + 1] AS status, round(CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 3) / (c_custkey % 4) ELSE 0 END, 6) AS rate, CASE WHEN c_custkey % 2 = 1 THEN 10.0::DOUBLE ELSE 0.0 END AS length, 0::BIGINT AS missing FROM customer",
    "fn_generated_tokens": V + " SELECT vec_id, '0,3,6,9,12' AS tokens, round(list_sum(v[1:5]), 6) AS total FROM v",
    "fn_multimodal_align": V + " SELECT vec_id, 16::BIGINT AS n, len(list_filter(v[1:10], lambda x: x > 0))::BIGINT AS ones, coalesce(list_position(list_transform(v[1:10], lambda x: x > 0), true) + 6, 0)::BIGINT AS first FROM v",
    "fn_gspo_kl": H + ", m AS (SELECT vec_id, coalesce(list_sum(list_transform(list_filter(i, lambda k: pre[k] > 0), lambda k: post[k] - pre[k])), 0) / greatest(len(list_filter(pre, lambda x: x > 0)), 1) AS m FROM h) SELECT vec_id, 32::BIGINT AS n, round(m, 6) AS first, round(m, 6) AS last FROM m",
    "fn_returns": H + " SELECT vec_id, round(32.0::DOUBLE * label, 6) AS flat, round(32.0::DOUBLE * label - 0.1 * list_sum(post), 6) AS penalised, round(list_sum(list_transform(i, lambda k: -0.1 * post[k] * pow(0.9, k - 1))) + label * pow(0.9, 31), 6) AS discounted FROM h",
    "win_distill_advantage": H + " SELECT vec_id, round(list_sum(post[25:32]) - list_sum(pre[1:8]), 6) AS total FROM h",
    "fn_policy_metrics": H + """, x AS (SELECT vec_id, unnest(pre) AS a, unnest(post) AS b FROM h), t AS (SELECT vec_id, a, b, -exp(a - b) * b AS p, -least(greatest(exp(a - b), 0.8), 1.28) * b AS c FROM x WHERE a > 0),
r AS (SELECT vec_id, avg(greatest(p, c)) AS l, avg((c > p)::INT) AS f, avg(b - a) AS k FROM t GROUP BY 1)
SELECT round(sum(l), 4) AS loss, round(sum(f), 4) AS clipped, round(sum(k), 4) AS kl, (SELECT round(avg(exp(a - b)), 6) FROM t) AS weight_mean, (SELECT round(stddev_pop(exp(a - b)), 6) FROM t) AS weight_std, (SELECT round(avg(abs(a - b)), 6) FROM t) AS abs_diff FROM r""",
    "agg_trainable_tokens": "SELECT coalesce(sum(len(list_filter(embedding, lambda x: x > 0))) FILTER (label <> 3), 0)::BIGINT AS tokens FROM embeddings",
    "agg_reward_sum_count": REWARDED + "SELECT vec_id, round(total, 6) AS total, n FROM g",
    "agg_adaptive_reward": REWARDED + "SELECT round(sum(total) / greatest(sum(n), 1), 6) AS mean, CASE WHEN sum(total) > 0 THEN 1.05::DOUBLE WHEN sum(total) < 0 THEN 0.95 ELSE 1 END AS coefficient FROM g",
    "agg_dp_mean": "SELECT round(avg(m), 6) AS mean, count(*) AS ranks FROM (SELECT avg(value) AS m FROM events GROUP BY event_id % 4)",
    "agg_perf_timers": """WITH t AS (SELECT CASE event_type WHEN 'click' THEN 'actor_train' WHEN 'view' THEN 'log_probs' WHEN 'purchase' THEN 'train_wait' ELSE 'train' END AS n, sum(value) AS v FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error') GROUP BY 1),
x AS (SELECT max(v) FILTER (n = 'actor_train') AS a, max(v) FILTER (n = 'log_probs') AS l, max(v) FILTER (n = 'train_wait') AS w, max(v) FILTER (n = 'train') AS r FROM t)
SELECT name, round(value, 4) AS value FROM (SELECT n || '_time' AS name, v AS value FROM t UNION ALL SELECT 'log_probs_tflops', 1e6 / l FROM x UNION ALL SELECT 'actor_train_tflops', 3e6 / a FROM x UNION ALL SELECT 'actor_train_tok_per_s', 5000 / a FROM x UNION ALL SELECT 'step_time', w + r FROM x UNION ALL SELECT 'wait_time_ratio', w / (w + r) FROM x) WHERE value IS NOT NULL""",
    "agg_problem_result": "SELECT event_id // 10 AS problem, round(avg((event_type = 'purchase')::INT), 6) AS score, count(*) AS samples, arg_min(event_type, event_id) AS response, count(*) = 10 AS complete FROM events GROUP BY 1",
    "agg_group_by": "SELECT row_number() OVER (ORDER BY min(event_id)) - 1 AS place, event_type, count(*) AS n, arg_min(value, event_id) AS first FROM events GROUP BY 2",
    "sample_trial_seeds": "SELECT t AS trial, s AS seed FROM (SELECT unnest(range(6)) AS t, unnest([626729, 373753, 361454, 1567, 514337, 363271]::INT[]) AS s)",
    "select_checkpoints": "SELECT unnest([0, 1, 2])::BIGINT AS place, unnest([20, 5, 115])::BIGINT AS iteration, (SELECT count(*) FROM nation) AS available",
    "fn_periodic": "SELECT r AS rollout, (r + 1) % 7 = 0 AS plain, (r + 1) % 7 = 0 OR (r + 1) % 10 = 0 OR r = 36 AS epochs, false AS never FROM (SELECT unnest(range(40)) AS r)",
    "fn_training_budget": "SELECT 'steps' AS given, 100::BIGINT AS rollouts, 400::BIGINT AS steps UNION ALL SELECT 'rollouts', 100, 400",
    "proj_prepare_prompts": "SELECT o AS prompt_id, n, label FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o, len(string_split(text, ' '))::BIGINT AS n, CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, '') ELSE '' END AS label FROM documents) WHERE n <= 200 ORDER BY o LIMIT 100",
    "proj_flatten_struct": "SELECT vec_id, 's' || vec_id AS sample_id, 4::BIGINT AS n, 'r0' AS pre_teacher_revision FROM embeddings",
    "proj_train_columns_only": "SELECT doc_id, 'doc_id,prompt' AS columns, length(text)::BIGINT AS n FROM documents",
    "sort_final": "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents",
    "sort_cluster_rep": "SELECT lang, doc_id % 5 AS part, doc_id, n FROM (SELECT *, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n FROM documents) QUALIFY row_number() OVER (PARTITION BY lang, doc_id % 5 ORDER BY n, text, doc_id) = 1",
    "rw_opd_sentinel": "SELECT event_id, 0.0::DOUBLE AS reward FROM events",
    "rw_math_verify": "SELECT c_custkey, 0.5::DOUBLE AS reward FROM customer",
    "filter_null_list_entries": "SELECT user_id, count(*) FILTER (value >= 10) AS n, round(coalesce(sum(value) FILTER (value >= 10), 0) / greatest(count(*) FILTER (value >= 10), 1), 6) AS mean FROM events GROUP BY 1",
    "pred_sealed_row_fast": "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'width' ELSE '' END AS problem FROM embeddings",
    "st_env_rollout": EPISODES,
    "st_group_generate": "SELECT c_custkey, i AS index, 1000 + i AS seed, round(avg((c_custkey * 7 + i) % 5) OVER (PARTITION BY c_custkey), 6) AS group_reward FROM customer, (SELECT unnest(range(4)) AS i)",
    "st_least_loaded": "SELECT unnest(range(10)) AS request, unnest(['b', 'b', 'c', 'a', 'b', 'c', 'a', 'b', 'c', 'a']) AS server",
}
