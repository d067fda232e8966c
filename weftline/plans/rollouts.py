"""Grouped rollouts, rewards and trials, on `events`: a user's events are a group, in order of event_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.operators import metrics, select
from weftline.plans.common import table


def events(s, d):
    return table(s, d, "events")


def ordered(s, d, col="value"):
    """(user_id, v): each user's values in order."""
    return events(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", col))).alias("e")).select("user_id", F.transform("e", lambda x: x[col]).alias("v"))


LISTS = "WITH g AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)"


def group_norm(s, d):
    return metrics.group_norm(events(s, d), "user_id", "value", True).select("event_id", F.round("advantage", 6).alias("advantage"))


def group_centre(s, d):
    return metrics.group_norm(events(s, d), "user_id", "value", False).select("event_id", F.round("advantage", 6).alias("advantage"))


def success(s, d):
    return events(s, d).withColumn("ok", (F.col("event_type") == "purchase").cast("int"))


def spread(s, d):
    rows = success(s, d).withColumn("g", F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 400).cast("string")))
    return metrics.spread_filter(rows, "g", "ok").groupBy("keep", "reason").agg(F.count("*").alias("n"))


def zero_std(s, d):
    rows = success(s, d).withColumn("g", F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 400).cast("string")))
    g = rows.groupBy("g").agg(F.min("ok").alias("lo"), F.max("ok").alias("hi")).where("lo = hi")
    return g.groupBy(F.round(F.col("lo").cast("double"), 1).alias("reward")).agg(F.count("*").alias("n"))


def passes(s, d):
    return metrics.pass_table(success(s, d), "user_id", F.col("ok") == 1, [1, 2, 4, 8])


PASSES = """
WITH t AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1),
k AS (SELECT t.*, k FROM t, (SELECT unnest([1, 2, 4, 8])::BIGINT AS k) WHERE k <= n),
v AS (SELECT k, CASE WHEN c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)) END AS p,
  list_product(list_transform(range(0, k), lambda i: greatest(c - i, 0) / (n - i))) AS h FROM k)
SELECT k, round(avg(p), 6) AS pass_at_k, round(avg(h), 6) AS pass_hat_k, count(*) AS tasks FROM v GROUP BY 1
"""


def avg_at_k(s, d):
    return success(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"), F.round(F.avg("value"), 6).alias("mean_value"))


def eval_dataset(s, d):
    return success(s, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("reward"), F.round(F.avg((F.col("value") > 90).cast("double")), 6).alias("truncated"), F.count("*").alias("n"))


def category(s, d):
    n = events(s, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def whiten(s, d):
    rows = events(s, d).withColumn("m", (F.col("event_type") != "error").cast("int"))
    return metrics.whiten(rows, "value", "m").select("event_id", F.round("whitened", 5).alias("whitened"))


def returns(s, d):
    return ordered(s, d).select("user_id", F.explode(F.transform(A.discounted_returns(F.col("v"), 0.9), lambda x, i: F.struct(i.alias("i"), F.round(x, 5).alias("g")))).alias("x")).select("user_id", F.col("x.i").cast("long").alias("i"), "x.g")


RETURNS = "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), s AS (SELECT user_id, i, r, value AS g FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.i, o.r, o.value + 0.9 * s.g FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1) SELECT user_id, i::BIGINT AS i, round(g, 5) AS g FROM s"


def gae(s, d):
    both = ordered(s, d).withColumn("w", F.transform("v", lambda x: x / 10))
    adv, ret = A.gae(F.col("v"), F.col("w"), 0.99, 0.95)
    return both.select("user_id", adv.alias("a"), ret.alias("r")).select("user_id", F.posexplode(F.arrays_zip("a", "r")).alias("i", "x")).select("user_id", F.col("i").cast("long").alias("i"), F.round("x.a", 4).alias("advantage"), F.round("x.r", 4).alias("ret"))


GAE = "WITH RECURSIVE o AS (SELECT user_id, value AS v, value / 10 AS w, coalesce(lead(value / 10) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS nw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), s AS (SELECT user_id, i, r, w, v + 0.99 * nw - w AS a FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.i, o.r, o.w, o.v + 0.99 * o.nw - o.w + 0.99 * 0.95 * s.a FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1) SELECT user_id, i::BIGINT AS i, round(a, 4) AS advantage, round(a + w, 4) AS ret FROM s"


def offsets(s, d):
    n = events(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return select.prefix_sums(n, ["user_id"], "n", "upto").select("user_id", "upto")


def token_reward(s, d):
    mask = F.transform(F.col("v"), lambda x: (x < 50).cast("int"))
    rows = ordered(s, d).where(F.exists("v", lambda x: x < 50))
    return rows.select("user_id", F.round(A.total(A.add_at_last(F.transform("v", lambda x: -0.1 * x), F.lit(5.0), mask)), 5).alias("total"), F.size("v").cast("long").alias("n"))


def masked(s, d):
    mask = F.transform(F.col("v"), lambda x: (x >= 30).cast("int"))
    return ordered(s, d).select("user_id", F.round(A.masked_mean(F.col("v"), mask), 6).alias("mean"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))


def mask_runs(s, d):
    runs = A.mask_runs(F.transform(F.col("v"), lambda x: (x >= 30).cast("int")))
    return ordered(s, d).select("user_id", F.explode(runs).alias("r")).select("user_id", F.col("r.start").cast("long").alias("start"), F.col("r.length").cast("long").alias("length"))


def adaptive(s, d):
    c = A.adaptive_coefficients(F.transform("v", lambda x: x - 50), 1.0, 0.05, 0.1, 10.0)
    return ordered(s, d).select("user_id", F.round(F.element_at(c, -1), 6).alias("coefficient"))


def lane(s, d):
    e = events(s, d)
    return e.groupBy("event_type").agg(
        F.count("*").alias("records"), F.countDistinct("user_id").alias("tasks"), F.round(F.sum("value"), 4).alias("cost"), metrics.nearest_rank("value", 0.5).alias("p50"),
        metrics.floor_rank(F.collect_list("value"), 0.95).alias("p95_floor"), F.max("value").alias("longest"),
    )


def suites(s, d):
    e = events(s, d).groupBy("event_type", "user_id").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.avg("m").alias("m"))
    e = e.withColumn("suite", F.when(F.col("event_type").isin("click", "view"), "reach").otherwise("act"))
    return s.sql("SELECT suite, round(avg(m), 6) AS mean, count(*) AS n FROM {suites} GROUP BY GROUPING SETS ((suite), ())", suites=e)


def paired(s, d):
    m = lambda t: events(s, d).where(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias("m"))
    return metrics.paired_delta(m("click"), m("view"), "user_id", "m").agg(F.count("*").alias("tasks"), F.round(F.avg("delta"), 6).alias("delta"))


def bootstrap(s, d):
    m = lambda t: events(s, d).where(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias("m"))
    deltas = [r.delta for r in metrics.paired_delta(m("click"), m("view"), "user_id", "m").orderBy("user_id").collect()]
    return s.createDataFrame([metrics.bootstrap_interval(deltas, 2000)], "delta double, low double, high double")


KINDS = ("click", "error", "purchase", "signup", "view")


def completeness(s, d):
    """Of every third event's records, the kinds that a user has none of; a handful of kinds is expected of each."""
    want = events(s, d).select("user_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, KINDS))))
    have = events(s, d).where("event_id % 3 = 0").select("user_id", "event_type").distinct()
    return want.join(have, ["user_id", "event_type"], "left_anti").groupBy("event_type").agg(F.count("*").alias("missing"))


def rates(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    r = events(s, d).withColumn("rate", (F.col("value") - F.lag("value").over(w)) / gap)
    return r.where("rate is not null").select("event_id", F.round("rate", 5).alias("rate"))


def json_args(s, d):
    v = F.try_parse_json("props")
    return events(s, d).select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("valid"))


def latest(s, d):
    best = events(s, d).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return best.select("user_id", "event_type", "m.event_id", "m.value")


def step_tokens(s, d):
    o = select.ordinals(events(s, d).select("event_id", "value"), ["event_id"])
    return o.groupBy(F.floor(F.col("ord") / 128).cast("long").alias("step")).agg(F.sum(F.floor("value")).cast("long").alias("tokens"), F.count("*").alias("n"))


def optional_columns(s, d):
    """A column is carried only if every row of the user has it."""
    e = events(s, d).withColumn("maybe", F.when(F.col("value") > 2, F.col("value")))
    return e.groupBy("user_id").agg(F.bool_and(F.col("maybe").isNotNull()).alias("has"), F.count("*").alias("n"))


def metric_check(s, d):
    by = events(s, d).groupBy("user_id").agg(F.avg("value").alias("m"))
    return by.agg(F.bool_or(F.col("m") >= 55).alias("reached"), F.count_if(F.col("m") >= 55).alias("n"))


def quantile_hist(s, d):
    top = events(s, d).agg(F.max("value").alias("top"))
    q = events(s, d).where("event_type = 'purchase'").crossJoin(F.broadcast(top)).withColumn("quarter", F.greatest(F.ceil(4 * F.col("value") / F.col("top")), F.lit(1)).cast("long"))
    return q.groupBy("quarter").agg(F.count("*").alias("n"))


QUERIES = {
    "win_group_norm": group_norm, "win_group_centre": group_centre, "filter_dynamic_nonzero_std": spread, "agg_zero_std_counts": zero_std, "agg_pass_at_k": passes,
    "agg_avg_at_k": avg_at_k, "agg_eval_dataset": eval_dataset, "agg_reward_category": category, "agg_whiten_stats": whiten, "win_discounted_return": returns, "win_gae": gae,
    "win_cumulative_offsets": offsets, "win_ppo_token_reward": token_reward, "agg_sample_mean_sum": masked, "fn_mask_lengths": mask_runs, "fn_adaptive_coef": adaptive,
    "agg_suite_means": suites, "join_paired_tasks": paired, "agg_bootstrap_delta": bootstrap, "join_record_expected": completeness, "win_lag_rates": rates,
    "fn_strict_json": json_args, "st_latest_wins": latest, "agg_step_tokens": step_tokens, "proj_optional_columns": optional_columns, "agg_metric_check": metric_check, "agg_length_quantile_hist": quantile_hist,
}
KEYED = "SELECT user_id || '-' || event_id // 400 AS g, (event_type = 'purchase')::INT AS ok FROM events"
SQL = {
    "win_group_norm": "SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-6), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)",
    "win_group_centre": "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 6) AS advantage FROM events",
    "filter_dynamic_nonzero_std": f"SELECT keep, CASE WHEN NOT keep THEN 'zero_std_' || r END AS reason, count(*) AS n FROM (SELECT coalesce(stddev_samp(ok) > 0, false) AS keep, min(ok) AS r FROM ({KEYED}) GROUP BY g) GROUP BY 1, 2",
    "agg_zero_std_counts": f"SELECT round(lo::DOUBLE, 1) AS reward, count(*) AS n FROM (SELECT min(ok) AS lo, max(ok) AS hi FROM ({KEYED}) GROUP BY g) WHERE lo = hi GROUP BY 1",
    "agg_pass_at_k": PASSES,
    "agg_avg_at_k": "SELECT user_id, count(*) AS n, round(avg((event_type = 'purchase')::INT), 6) AS accuracy, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
    "agg_eval_dataset": "SELECT event_type, round(avg(value), 6) AS reward, round(avg((value > 90)::INT), 6) AS truncated, count(*) AS n FROM events GROUP BY 1",
    "agg_reward_category": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1",
    "agg_whiten_stats": "SELECT event_id, round((value - m) / sqrt(v + 1e-8), 5) AS whitened FROM events, (SELECT avg(value) AS m, var_samp(value) AS v FROM events WHERE event_type <> 'error')",
    "win_discounted_return": RETURNS,
    "win_gae": GAE,
    "win_cumulative_offsets": "SELECT user_id, sum(count(*)) OVER (ORDER BY user_id)::BIGINT AS upto FROM events GROUP BY 1",
    "win_ppo_token_reward": "SELECT user_id, round(sum(-0.1 * value) + 5, 5) AS total, count(*) AS n FROM events GROUP BY 1 HAVING bool_or(value < 50)",
    "agg_sample_mean_sum": "SELECT user_id, round(coalesce(sum(value) FILTER (value >= 30), 0) / greatest(count(*) FILTER (value >= 30), 1), 6) AS mean, count(*) FILTER (value >= 30) AS ones FROM events GROUP BY 1",
    "fn_mask_lengths": "WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), r AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM o WHERE value >= 30) SELECT user_id, min(i)::BIGINT AS start, count(*) AS length FROM r GROUP BY user_id, g",
    "fn_adaptive_coef": LISTS + " SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, v), lambda a, x: least(greatest(a * (1 + 0.05 * sign(x - 50)), 0.1), 10.0)), 6) AS coefficient FROM g",
    "agg_suite_means": "WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2), t AS (SELECT event_type, avg(m) AS m FROM m GROUP BY 1) SELECT CASE WHEN event_type IN ('click', 'view') THEN 'reach' ELSE 'act' END AS suite, round(avg(m), 6) AS mean, count(*) AS n FROM t GROUP BY GROUPING SETS ((suite), ())",
    "join_paired_tasks": "WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) SELECT count(*) AS tasks, round(avg(b.m - a.m), 6) AS delta FROM m a JOIN m b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view'",
    "join_record_expected": f"SELECT k.event_type, count(*) AS missing FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest({list(KINDS)}) AS event_type) k WHERE (u.user_id, k.event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 3 = 0) GROUP BY 1",
    "win_lag_rates": "SELECT event_id, round(r, 5) AS rate FROM (SELECT event_id, (value - lag(value) OVER w) / (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r IS NOT NULL",
    "fn_strict_json": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events",
    "st_latest_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "agg_step_tokens": "SELECT (o // 128)::BIGINT AS step, sum(floor(value))::BIGINT AS tokens, count(*) AS n FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events) GROUP BY 1",
    "proj_optional_columns": "SELECT user_id, bool_and(value > 2) AS has, count(*) AS n FROM events GROUP BY 1",
    "agg_metric_check": "SELECT bool_or(m >= 55) AS reached, count(*) FILTER (m >= 55) AS n FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)",
    "agg_length_quantile_hist": "SELECT greatest(ceil(4 * value / (SELECT max(value) FROM events)), 1)::BIGINT AS quarter, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1",
}
